"""Language identification of mixed text (operator 7).

A word's script (by the ranges of its characters) leaves the languages that the
training rows write in it. Each candidate scores a word by the log-probabilities
of its byte trigrams. Viterbi over the words of a text, with a penalty for each
switch, labels spans; a document's language is the one with most of its bytes.

Training takes a bounded sample of rows with a language. Texts for which no switch
can pay, which sums over stretches show, need no lattice. Viterbi runs over the
others of a block at once, word position by word position, so that its cost is in
array operations and its memory bounded by the block; a long text is solved in
pieces side by side, for every label a piece may be entered with.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import bounded_sample
from tessera.llm.quality import fold
from tessera.llm.words import ALNUM, blocks, column, lean, share, shared, small_batches, word_spans

SAMPLE, BITS, SWITCH = 6000, 16, 12.0
#: Texts of more words than this are solved in pieces, where there are no more labels than MANY.
LONG, MANY = 20_000, 16
LAST_LETTER = 0x33FFF


def script_ranges() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First code points of ranges, the script of each (0 for what is no letter), and the scripts' names.

    A letter's script is the first word of its Unicode name (the second after
    halfwidth and fullwidth); Latin is number 1.
    """
    names, starts, scripts = {"": 0, "LATIN": 1}, [0], [0]
    for code in range(LAST_LETTER + 1):
        c = chr(code)
        word = ""
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split()
            word = (name[1] if name[0] in ("HALFWIDTH", "FULLWIDTH") else name[0]).split("-")[0]
        script = names.setdefault(word, len(names))
        if script != scripts[-1]:
            starts.append(code)
            scripts.append(script)
    return np.array([*starts, LAST_LETTER + 1], np.uint32), np.array([*scripts, 0], np.int16), list(names)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a character beyond ASCII begins in UTF-8 bytes, and its code point."""
    at = np.flatnonzero(raw >= 0xC0)
    b = [np.append(raw, np.zeros(3, np.uint8))[at + k].astype(np.uint32) for k in range(4)]
    low = [x & 0x3F for x in b]
    two = (b[0] & 0x1F) << 6 | low[1]
    three = (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    return at, np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))


_ASCII = np.zeros(256, np.uint8)
_ASCII[[*range(65, 91), *range(97, 123)]] = 1


def word_scripts(raw: np.ndarray, s: np.ndarray, e: np.ndarray, ranges: tuple) -> np.ndarray:
    """The script of most letters of each word (of several the least number), 0 without a letter."""
    count = np.concatenate([[0], np.cumsum(_ASCII[raw], dtype=np.int64)])
    ascii_ = count[e] - count[s]
    out = (ascii_ > 0).astype(np.int16)
    at, code = code_points(raw)
    script = ranges[1][np.searchsorted(ranges[0], code, "right") - 1].astype(np.int64)
    at, script = at[script > 0], script[script > 0]
    if len(at):
        word = np.searchsorted(s, at, "right") - 1
        pair, n = np.unique(word << 16 | script, return_counts=True)
        mixed = np.unique(word)
        word, script, n = np.r_[pair >> 16, mixed], np.r_[pair & 0xFFFF, np.ones(len(mixed), np.int64)], np.r_[n, ascii_[mixed]]
        pair, back = np.unique(word << 16 | script, return_inverse=True)  # Latin letters beyond ASCII and within it count together
        n = np.bincount(back, weights=n).astype(np.int64)
        order = np.lexsort([pair & 0xFFFF, -n, pair >> 16])
        first = order[np.unique((pair >> 16)[order], return_index=True)[1]]
        out[pair[first] >> 16] = pair[first] & 0xFFFF
    return out


def _trigrams(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram that ends at each byte, the word before and after it as a blank; and the closing trigram of each word."""
    v = values.astype(np.uint32)
    one, two = np.zeros(len(v), np.uint32), np.zeros(len(v), np.uint32)
    one[1:], two[2:] = v[:-1], v[:-2]
    start = np.zeros(len(v), bool)
    start[s] = True
    one[start], two[start] = 0, 0
    second = s + 1
    second = second[second < e]
    two[second] = 0
    mixed = lambda a, b, c: (((a * np.uint32(31337) + b) * np.uint32(40503) + c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return mixed(two, one, v), mixed(one[e - 1], v[e - 1], np.zeros(len(e), np.uint32))


def word_tables(values: np.ndarray, rel: np.ndarray, raw: np.ndarray, ranges: tuple) -> tuple[np.ndarray, ...]:
    s, e = word_spans(values, rel)
    inside, closing = _trigrams(values, s, e)
    return s, e, inside, closing, word_scripts(raw, s, e, ranges)


class Languages:
    """scores: trigram x language; allowed: script x language; ranges: as script_ranges gives them."""

    def __init__(self, names: list[str], scores: np.ndarray, allowed: np.ndarray, ranges: tuple):
        self.names, self.scores, self.allowed, self.ranges = names, scores.astype(np.float32), allowed, ranges


def _count(ranges: tuple, scripts: int):
    def work(batches):
        for batch in batches:
            data, offs = column(batch, "text")
            langs = batch.column(1).to_pylist()
            totals: dict[str, np.ndarray] = {}
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]]
                s, e, inside, closing, script = word_tables(ALNUM[raw], np.array([0, len(raw)]), raw, ranges)
                mine = ALNUM[raw] != 0
                t = totals.setdefault(langs[i], np.zeros((1 << BITS) + scripts, np.int64))
                np.add.at(t, inside[mine], 1)
                np.add.at(t, closing, 1)
                np.add.at(t, (1 << BITS) + script.astype(np.int64), 1)
            for lang, t in totals.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(t[at])], names=["lang", "at", "n"])

    return work


def train(rows: DataFrame, sample: int = SAMPLE) -> Languages:
    """From at most about ``sample`` of the rows (doc_id, text, lang): trigram log-probabilities and the scripts of each language."""
    *ranges, scripts = script_ranges()
    few = bounded_sample(small_batches(rows).filter("lang is not null and text is not null"), sample, "doc_id")
    counts = few.select("text", "lang").mapInArrow(lean(_count(tuple(ranges), len(scripts))), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    number = counts["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=np.int64)
    table = np.zeros((len(names), (1 << BITS) + len(scripts)))
    table[number, counts["at"].to_numpy()] = counts["n"].to_numpy()
    tri, script = table[:, : 1 << BITS], table[:, 1 << BITS :]
    scores = np.log((tri + 0.02) / (tri.sum(axis=1, keepdims=True) + 0.02 * (1 << BITS)))
    share = script / np.maximum(1, script.sum(axis=1, keepdims=True))
    return Languages(names, scores.T, (share >= 0.01).T, tuple(ranges))


def settled(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """For each text the label that all its words get, or -1 where a switch may pay.

    Stretches under other labels than the best single one cost a switch each, so none
    pays where no label gains more than the penalty in any stretch. Only if they are
    the whole text they cost one switch less; that doesn't pay if all words' best
    gains together are no more than the penalty, or any stretch's than half of it.
    """
    size = np.diff(first)
    sums = np.zeros((len(score) + 1, score.shape[1]))
    np.cumsum(score, axis=0, out=sums[1:], dtype=np.float64)
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
    del sums
    row = np.repeat(np.arange(len(size)), size)
    mine = score[np.arange(len(score)), best[row]]
    most = np.zeros(len(size))
    for j in range(score.shape[1]):
        # Losses count for no more than 50 here, which can only make a gain look larger.
        gain = np.maximum(score[:, j] - mine, -50.0).astype(np.float64)
        before = np.cumsum(gain) - gain
        before -= np.repeat(before[first[:-1][size > 0]], size[size > 0])  # from each text's start on
        apart = row * (2 * np.abs(before).max(initial=0) + 1)  # so that no text sees the minimum of one before it
        rise = before + gain - (np.minimum.accumulate(before - apart) + apart)
        filled = first[:-1][size > 0]
        if len(filled):
            most[size > 0] = np.maximum(most[size > 0], np.maximum.reduceat(rise, filled))
    rest = score.copy()
    rest[np.arange(len(score)), best[row]] = -np.inf
    without = np.zeros(len(size))
    if len(score):
        without[size > 0] = np.add.reduceat(rest.max(axis=1).astype(np.float64) - mine, first[:-1][size > 0])
    return np.where((most <= penalty / 2) | ((most <= penalty) & (without <= penalty)), best, -1)


def _forward(score: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, penalty: float, came: np.ndarray | None = None) -> np.ndarray:
    """Lattice over texts from longest to shortest: scores of the labels after the last word, from those before the first."""
    kind = np.int8 if score.shape[1] < 128 else np.int32
    stay = np.arange(score.shape[1], dtype=kind)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # texts longer than t
    for t, n in enumerate(live.tolist()):
        at, v = start[:n] + t, state[:n]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(n), best] - penalty
            if came is not None:
                came[at] = np.where(top[:, None] > v, best.astype(kind)[:, None], stay)
            np.maximum(v, top[:, None], out=v)
        v += score[at]
    return state


def lattice(score: np.ndarray, first: np.ndarray, penalty: float, entered: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """Best label of each word, given the scores of the labels before the first word and the label of the last one, or neither."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    kind = np.int8 if score.shape[1] < 128 else np.int32
    came, label = np.zeros(score.shape, kind), np.zeros(len(score), kind)
    state = np.zeros((len(size), score.shape[1])) if entered is None else entered[order]
    state = _forward(score, start, size, state, penalty, came)
    now = (state.argmax(axis=1) if left is None else left[order]).astype(kind)
    for t in range((int(size[0]) if len(size) else 0) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, "left"))
        at, mine = start[:n] + t, now[:n]
        label[at] = mine
        now[:n] = came[at, mine] if t else mine
    return label


def _long(score: np.ndarray, penalty: float) -> np.ndarray:
    """As lattice, for one long text: all its pieces at once, entered with each label; then the best chain of them; then the words."""
    n = score.shape[1]
    first = np.append(np.arange(0, len(score), int(len(score) ** 0.5) + 1), len(score))
    pieces = len(first) - 1
    entry = np.where(np.eye(n, dtype=bool), 0.0, -penalty)
    state = np.tile(entry, (pieces, 1))
    state[:n] = 0
    out = _forward(score, np.repeat(first[:-1], n), np.repeat(np.diff(first), n), state, penalty).reshape(pieces, n, n)
    value, back = out[0, 0], np.zeros((pieces, n), np.int64)
    for k in range(1, pieces):
        chained = value[:, None] + out[k]
        back[k], value = chained.argmax(axis=0), chained.max(axis=0)
    left = np.zeros(pieces, np.int64)
    left[-1] = value.argmax()
    for k in range(pieces - 1, 0, -1):
        left[k - 1] = back[k, left[k]]
    entered = np.concatenate([np.zeros((1, n)), entry[left[:-1]]])
    return lattice(score, first, penalty, entered, left)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. score: words x labels; first: the first word of each text, and the number of words."""
    size = np.diff(first)
    whole = settled(score, first, penalty)
    label = np.repeat(whole, size)
    long_ = (size > LONG) & (score.shape[1] <= MANY)
    for k in np.flatnonzero((whole < 0) & long_):
        label[first[k] : first[k + 1]] = _long(score[first[k] : first[k + 1]], penalty)
    open_ = (whole < 0) & ~long_
    at = np.flatnonzero(np.repeat(open_, size))
    if len(at):
        label[at] = lattice(score[at], np.concatenate([[0], np.cumsum(size[open_])]), penalty)
    return label


def label_words(model: Languages, data: np.ndarray, offs: np.ndarray):
    """Of the rows between ``offs``: word starts and ends, first word of each row, label of each word, whether it has letters."""
    raw, rel = data[offs[0] : offs[-1]], offs - offs[0]
    s, e, inside, closing, script = word_tables(ALNUM[raw], rel, raw, model.ranges)
    n = len(model.names)
    score = np.empty((len(s), n), np.float32)
    spots = np.stack([s, e], 1).ravel()
    for k in range(n if len(s) else 0):
        mine = np.ascontiguousarray(model.scores[:, k])
        score[:, k] = np.add.reduceat(np.append(mine[inside], np.float32(0)), spots)[::2] + mine[closing]
    lettered = script > 0
    score[~lettered] = 0
    allowed = model.allowed[script]
    allowed[~allowed.any(axis=1)] = True
    score[~allowed] -= 1e4
    first = np.searchsorted(s, rel)
    return s, e, first, viterbi(score, first, SWITCH), lettered


def _label(held):
    def work(batches):
        model = shared(held)
        n = len(model.names)
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs, (2 << 20) * 8 // max(8, n)):
                rows, names = b - a, pa.array(["und", *model.names])
                lang, share, ends = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows + 1, np.int32)
                start, end, label_of = (np.zeros(0, np.int64) for _ in range(3))
                if n:
                    s, e, first, label, lettered = label_words(model, data, offs[a : b + 1])
                    row = np.repeat(np.arange(rows), np.diff(first))
                    size = np.where(lettered, e - s, 0)
                    weight = np.bincount(row * n + label.astype(np.int64), weights=size, minlength=rows * n).reshape(rows, n)
                    total = weight.sum(axis=1)
                    share = np.where(total > 0, weight.max(axis=1) / np.maximum(1, total), 0.0)
                    lang = np.where(total > 0, weight.argmax(axis=1) + 1, 0)
                    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])]) if len(row) else np.zeros(0, np.int64)
                    last = np.r_[cut[1:], len(row)][: len(cut)]
                    cut, last = cut[total[row[cut]] > 0], last[total[row[cut]] > 0]
                    start, end, label_of = cut - first[row[cut]], last - first[row[cut]], label[cut].astype(np.int64) + 1
                    ends[1:] = np.cumsum(np.bincount(row[cut], minlength=rows))
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end), names.take(pa.array(label_of))], names=["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), names.take(pa.array(lang)), pa.array(share), pa.ListArray.from_arrays(pa.array(ends), spans)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    return work


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the lettered bytes), spans (word ranges with their language).

    und, with score 0, where text is null or has no letter. Without training rows
    every text is und.
    """
    held = share(docs.sparkSession, model)
    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(_label(held)), f"doc_id {kind}, lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>")


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row of ``docs``; learned from rows outside fold 2 of 4.

    Rows with a null doc_id or lang are never learned from; the former count as
    not held out. Repeated rows get equal answers.
    """
    model = train(docs.select("doc_id", "text", "lang").filter(fold(4) != 2), sample)
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
