"""Benchmark decontamination by training suffix arrays (operator 4).

Each block of training texts is a shard. A task sorts the shard's word suffixes by
doubling and binary-searches every suffix of the benchmark's items. Where a suffix
would stand, its neighbours in the array share the most words with it; from the
sorted insertion points every training suffix finds its own longest match in turn.
A suffix that matches its window at least has all its occurrences in one range of
the array, found by two more searches. Windows are compared word by word; only how
far a match goes on beyond PLAIN words is read from hashes.

A training suffix ends where its run of words known to the benchmark does, since
nothing matches beyond; one that begins with an unknown word is not in the array.
That changes no result.

The benchmark goes to the tasks in parts of at most ``part_bytes`` of distinct
text, whose arrays grow in proportion. The documents pass a part in one stage,
without a shuffle; with several parts each pass is written, so that one part is
held at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM, blocks, column, lean, list_column, mix, plain, powers, share, shared, word_spans, words
from tessera.scratch import materialize, release

WINDOW = 10
#: Bytes of benchmark text that one part holds; a single longer item is a part of its own.
PART_BYTES = 8 << 20
#: Bytes of training text in a shard, and suffixes that are compared at once.
SHARD_BYTES, CHUNK = 4 << 20, 1 << 15
#: Words that are compared one by one; no less than WINDOW.
PLAIN = 16
#: Names of items that a batch of rows is given together, or one row.
NAMES = 1 << 21


def suffix_array(ids: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Positions of known words (ids above 0) in the order of the ``depth`` words from there on; the words from position p on end at stop[p].

    Doubling: a rank by h words and that of the suffix h words on give the rank by
    2 h; only suffixes that are still tied are sorted again.
    """
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    rank = np.zeros(len(ids) + 1, np.int64)
    slots, key, ahead = np.arange(1, len(order) + 1), ids[order], np.ones(len(order), np.int64)
    h, position = 1, order
    while len(slots):
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[position] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone & (ahead > 0)]
        if h >= depth or not len(slots):
            break
        position = order[slots - 1]
        ahead = np.where(stop[position] - position > h, rank[np.minimum(position + h, len(ids))], 0)
        key = rank[position] << 32 | ahead
        by = np.argsort(key, kind="stable")
        key, ahead, position = key[by], ahead[by], position[by]
        order[slots - 1] = position
        h *= 2
    return order


def prefix_sums(ids: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of words follows; see ``Words.equal``."""
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * powers(len(ids) + 1)[0][: len(ids)], out=out[1:], dtype=np.uint64)
    return out


class Words:
    """Word ids with where the words from each position on end; and their comparison with those of the items."""

    def __init__(self, ids: np.ndarray, stop: np.ndarray, goals: np.ndarray, goal_sums: np.ndarray):
        self.ids, self.stop, self.goals = ids, stop, goals
        self.sums, self.goal_sums = prefix_sums(ids), goal_sums
        self.down = powers(max(len(ids), len(goals)) + 1)[1]

    def equal(self, p: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from p on have the hash of those from goal g on."""
        return (self.sums[p + n] - self.sums[p]) * self.down[p] == (self.goal_sums[g + n] - self.goal_sums[g]) * self.down[g]

    def common(self, p: np.ndarray, g: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of words that each pair of a training suffix p and a goal g (until end) shares from the start.

        The first PLAIN words are compared one by one; how far longer matches go is
        found by halving, with 64-bit hashes.
        """
        out, live, steps = np.zeros(len(p), np.int64), np.arange(len(p)), np.arange(4)
        for _ in range(PLAIN // len(steps)):
            a, b = (p[live] + out[live])[:, None] + steps, (g[live] + out[live])[:, None] + steps
            x = np.where(a < self.stop[p[live]][:, None], self.ids[np.minimum(a, len(self.ids) - 1)], 0)
            y = np.where(b < end[live][:, None], self.goals[np.minimum(b, len(self.goals) - 1)], -1)
            same = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
            out[live] += same
            live = live[same == len(steps)]
            if not len(live):
                return out
        p, g = p[live], g[live]
        lo, hi = out[live], np.minimum(self.stop[p] - p, end[live] - g)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.equal(p, g, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[live] = lo
        return out

    def below(self, order: np.ndarray, g: np.ndarray, end: np.ndarray, within: bool) -> np.ndarray:
        """Binary search of all goals at once: how many suffixes in ``order`` are below each; with ``within`` also those that begin with it."""
        lo, hi = np.zeros(len(g), np.int64), np.full(len(g), len(order), np.int64)
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            p, at, last = order[mid], g[live], end[live]
            n = self.common(p, at, last)
            x = np.where(p + n < self.stop[p], self.ids[np.minimum(p + n, len(self.ids) - 1)], 0)
            y = np.where(at + n < last, self.goals[np.minimum(at + n, len(self.goals) - 1)], 0)
            up = np.where(at + n == last, within, x < y)
            lo[live], hi[live] = np.where(up, mid + 1, lo[live]), np.where(up, hi[live], mid)
        return lo


class Suffixes:
    """The word suffixes of some items, in order: word ids over their own vocabulary, item after item."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            owners.setdefault((text or "").encode(), set()).add(name)
        texts = sorted(owners)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        w, first = words(np.frombuffer(b"".join(texts), np.uint8), offs, ALNUM)
        self.vocabulary = np.unique(w)
        self.ids = np.searchsorted(self.vocabulary, w).astype(np.int32) + 1
        self.sums = prefix_sums(self.ids)
        self.names = sorted({n for names in owners.values() for n in names})
        number = {n: k for k, n in enumerate(self.names)}
        # Names of item i: owner[own[i] : own[i + 1]].
        self.owner = np.array([number[n] for t in texts for n in sorted(owners[t])], np.int64)
        self.own = np.concatenate([[0], np.cumsum([len(owners[t]) for t in texts], dtype=np.int64)]).astype(np.int64)
        count = np.diff(first)
        stop = np.repeat(first[1:], count)
        self.depth = int(count.max(initial=1))
        self.start = suffix_array(self.ids, stop, self.depth)
        self.end = stop[self.start]
        self.item = np.repeat(np.arange(len(texts)), count)[self.start]
        # Words in the window that begins here: 10, or the whole of a shorter item, or 0 for none.
        whole, head = count[self.item], self.start == first[self.item]
        self.window = np.where(self.end - self.start >= size, size, np.where((whole < size) & head, whole, 0))


def _repeated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges a[i] to b[i], one range after another."""
    n = b - a
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of whole numbers from 0 on, in order."""
    if not len(a):
        return a, b
    wide = int(b.max()) + 1
    key = np.unique(a * wide + b)
    return key // wide, key % wide


def search(held, ids: np.ndarray, first: np.ndarray, longest: bool):
    """Matches of the items in a shard (word ids, 0 for unknown; first word of each row).

    (start, length, pairs (row, set of items), these sets, longest of each row, where that starts (-1: none)).
    """
    rows, n = len(first) - 1, len(ids)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    stop = np.minimum(np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1], np.repeat(first[1:], np.diff(first)))
    order = suffix_array(ids, stop, held.depth)
    best, where = np.zeros(rows, np.int64), np.full(rows, n, np.int64)
    none = np.zeros(0, np.int64)
    if not len(order) or not len(held.start):
        return none, none, none, none, (np.zeros(1, np.int64), none), best, np.full(rows, -1, np.int64)
    text = Words(ids, stop, held.ids, held.sums)
    parts = [slice(i, i + CHUNK) for i in range(0, len(held.start), CHUNK)]
    place = np.concatenate([text.below(order, held.start[s], held.end[s], False) for s in parts])
    # The longest match of each benchmark suffix, from its neighbours in the array.
    match = np.zeros(len(place), np.int64)
    for s in parts:
        for side in (place[s] - 1, place[s]):
            there = np.flatnonzero((side >= 0) & (side < len(order)))
            match[s][there] = np.maximum(match[s][there], text.common(order[side[there]], held.start[s][there], held.end[s][there]))
    if longest:
        # And of each training suffix, from the benchmark suffixes on both sides of it.
        for i in range(0, len(order), CHUNK):
            p = order[i : i + CHUNK]
            after = np.searchsorted(place, np.arange(i, i + len(p)), "right")
            for side in (after - 1, after):
                there = np.flatnonzero((side >= 0) & (side < len(place)))
                q, k = p[there], side[there]
                m = text.common(q, held.start[k], held.end[k])
                r = row_of[q]
                was = best.copy()
                np.maximum.at(best, r, m)
                where[best > was] = n
                top = (m == best[r]) & (m > 0)
                np.minimum.at(where, r[top], q[top])
    hit = np.flatnonzero((held.window > 0) & (match >= held.window))
    g, size = held.start[hit], held.window[hit]
    lo, hi = (text.below(order, g, g + size, within) for within in (False, True))
    # Equal windows have one range; each is taken once, with all its items.
    _, one, kind = np.unique(np.stack([lo, size]), axis=1, return_index=True, return_inverse=True)
    kind = kind.ravel()
    spread = order[_repeated(lo[one], hi[one])]
    of = np.repeat(np.arange(len(one)), hi[one] - lo[one])
    pairs = _distinct(row_of[spread], of)
    sets, set_of = _item_sets(kind, held.item[hit], len(one))
    pairs = _distinct(pairs[0], set_of[pairs[1]])
    return spread, size[one][of], pairs[0], pairs[1], sets, best, np.where(where < n, where - first[:-1], -1)


def _item_sets(kind: np.ndarray, item: np.ndarray, kinds: int):
    """The different sets of items that windows stand in (ends and items, set after set), and the set of each kind of window.

    Windows of a prompt that many items share have one set, however many windows and
    items there are; sets of one size and hash are compared item by item.
    """
    kind, item = _distinct(kind, item)
    start = np.searchsorted(kind, np.arange(kinds + 1))
    count = np.diff(start)
    if not kinds:
        return (np.zeros(1, np.int64), item), np.zeros(0, np.int64)
    marks = np.add.reduceat(mix(item.astype(np.uint64) + np.uint64(1)), start[:-1])
    _, first, alike = np.unique(np.stack([count.astype(np.uint64), marks]), axis=1, return_index=True, return_inverse=True)
    model = first[alike.ravel()]
    steps = np.arange(len(item)) - np.repeat(start[:-1], count)
    unlike = item != item[np.repeat(start[model], count) + steps]
    model = np.where(np.bincount(kind[unlike], minlength=kinds) > 0, np.arange(kinds), model)
    kept, set_of = np.unique(model, return_inverse=True)
    return (np.concatenate([[0], np.cumsum(count[kept])]), item[_repeated(start[kept], start[kept + 1])]), set_of.ravel()


def _flat(batch: pa.RecordBatch, name: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of a list column between two rows."""
    part = batch.column(batch.schema.get_field_index(name)).slice(a, b - a)
    return part.flatten().to_numpy(zero_copy_only=False), part.value_parent_indices().to_numpy()


def _names(held, row: np.ndarray, which: np.ndarray, sets, rows: int):
    """(first row, row after the last, ends, numbers of the items' names per row) for ranges of rows with some NAMES names together, or one row."""
    ends, items = sets
    names = held.own[items + 1] - held.own[items]
    size = np.add.reduceat(np.append(names, 0), ends[:-1]) if len(ends) > 1 else np.zeros(0, np.int64)
    at = np.searchsorted(row, np.arange(rows + 1))
    so_far = np.concatenate([[0], np.cumsum(size[which])])[at]
    a = 0
    while a < rows:
        b = min(rows, max(a + 1, int(np.searchsorted(so_far, so_far[a] + NAMES, "right")) - 1))
        r, w = row[at[a] : at[b]], which[at[a] : at[b]]
        item = items[_repeated(ends[w], ends[w + 1])]
        r = np.repeat(r, ends[w + 1] - ends[w])
        r, item = _distinct(r, item)
        name = held.owner[_repeated(held.own[item], held.own[item + 1])]
        r = np.repeat(r, held.own[item + 1] - held.own[item])
        r, name = _distinct(r, name)
        yield a, b, np.searchsorted(r, np.arange(a + 1, b + 1)), name
        a = b


def _hits(part, kept: list[str], longest: bool, named: bool):
    """Adds one part's findings to the spans that are there, and gives its own item names (if ``named``) and longest match."""

    def work(batches):
        held = shared(part)
        names = pa.array(held.names, pa.string())
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs, SHARD_BYTES):
                w, first = words(data, offs[a : b + 1], ALNUM)
                at = np.searchsorted(held.vocabulary, w)
                known = held.vocabulary[np.minimum(at, len(held.vocabulary) - 1)] == w if len(held.vocabulary) else np.zeros(len(w), bool)
                ids = np.where(known, at + 1, 0).astype(np.int32)
                start, size, row, which, sets, best, where = search(held, ids, first, longest)
                (s0, r0), (e0, _) = _flat(batch, "__starts", a, b), _flat(batch, "__ends", a, b)
                n = len(ids) + 1
                edge = np.bincount(np.r_[start, s0 + first[r0]], minlength=n) - np.bincount(np.r_[start + size, e0 + first[r0]], minlength=n)
                s, e = word_spans((np.cumsum(edge[:-1]) > 0).astype(np.uint8), first)
                of = np.searchsorted(first, s, "right") - 1
                ends = np.searchsorted(s, first)
                if not named:
                    row, which = row[:0], which[:0]
                for i, j, name_ends, name in _names(held, row, which, sets, b - a):
                    spans = slice(ends[i], ends[j])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(batch.schema.get_field_index(c)).slice(a + i, j - i) for c in kept),
                            pa.array(np.diff(first[i : j + 1])),
                            list_column((s - first[of])[spans], ends[i + 1 : j + 1] - ends[i]),
                            list_column((e - first[of])[spans], ends[i + 1 : j + 1] - ends[i]),
                            pa.ListArray.from_arrays(pa.array(np.append(0, name_ends).astype(np.int32)), names.take(pa.array(name))),
                            pa.array(best[i:j]),
                            pa.array(where[i:j]),
                        ],
                        names=[*kept, "__words", "__starts", "__ends", "__found", "__best", "__where"],
                    )

    return work


def _parts(benchmark: DataFrame, part_bytes: int):
    """The distinct items in parts, one at a time on the driver; which part an item is in follows from its id and text, so that one text under many ids is dealt out too."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / part_bytes))
    for k in range(n):
        mine = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, Suffixes([(r["item_id"], r["text"]) for r in mine.collect()])


def hits(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, longest: bool = True, named: bool = True) -> DataFrame:
    """``docs``, all its columns, plus __words (count), __starts and __ends (disjoint hit word ranges), __items (sorted ids), __longest and __longest_start.

    Without ``longest`` the last two are 0 and -1, without ``named`` there are no items.
    """
    docs = plain(docs)
    spark, kept = docs.sparkSession, docs.columns
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{own}, __items array<string>, __longest bigint, __longest_start bigint, __words bigint, __starts array<bigint>, __ends array<bigint>, __found array<string>, __best bigint, __where bigint"
    empty = F.array().cast("array<bigint>")
    out = docs.select("*", empty.alias("__starts"), empty.alias("__ends"), F.array().cast("array<string>").alias("__items"), F.lit(0).cast("long").alias("__longest"), F.lit(-1).cast("long").alias("__longest_start"))
    before = None
    for n, held in _parts(benchmark, part_bytes):
        part = share(spark, held)
        found = out.mapInArrow(lean(_hits(part, [*kept, "__items", "__longest", "__longest_start"], longest, named)), schema)
        better = (F.col("__best") > F.col("__longest")) | ((F.col("__best") == F.col("__longest")) & (F.col("__best") > 0) & (F.col("__where") < F.col("__longest_start")))
        out = found.select(
            *[F.col(f"`{c}`") for c in kept],
            "__words",
            "__starts",
            "__ends",
            F.array_sort(F.array_union("__items", "__found")).alias("__items"),
            F.greatest("__longest", "__best").alias("__longest"),
            F.when(better, F.col("__where")).otherwise(F.col("__longest_start")).alias("__longest_start"),
        )
        if n > 1:
            out = materialize(out, "hits")
            part.unpersist()
            release(before)
            before = out
    return out


def report(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_start, hit_spans.

    A null or empty text has no words and no hits. A null or empty item has no
    windows; items that share an id count as one. A window that several items
    have counts for each. longest_match is the most consecutive words that the text
    shares with any item, shorter than a window or longer, longest_start the first
    word where so many begin (-1 without any); hit_spans are word ranges
    start-end, comma-joined, end exclusive.
    """
    found = hits(docs.select("doc_id", "text"), benchmark, part_bytes)
    n_hit = F.aggregate(F.zip_with("__starts", "__ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.size("__starts") > 0).alias("contaminated"),
        F.col("__longest").alias("longest_match"),
        F.col("__longest_start").alias("longest_start"),
        F.concat_ws(",", F.zip_with("__starts", "__ends", lambda s, e: F.concat_ws("-", s.cast("string"), e.cast("string")))).alias("hit_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns."""
    return hits(docs, benchmark, part_bytes, longest=False, named=False).filter(F.size("__starts") == 0).select(*[F.col(f"`{c}`") for c in plain(docs).columns])
