r"""Token counts of every prefix, for byte-level BPE vocabularies (operator 12).

A text is cut into units, each a run of white space and the letters, digits or
signs that follow it, between which no token can reach. Within a unit the prefix
dynamic programme runs over bytes: the encoding of a prefix is that of a shorter
one and one more token, its last. Of all tokens that the prefix ends with, the last
one is the only one that the merges leave standing beside the shorter prefix's own
last token. So a unit's counts at all its prefixes take one pass, however long it
is, and equal units are taken once per worker.

What is kept of a text is one 16-bit step per code point, the change of the count
from the prefix before; a running sum gives the exact count at every prefix, which
answers how many tokens a cut text has, and how much of it fits a budget, without
encoding again. A prefix is encoded as the library would encode it alone: white
space at its end belongs together, and a contraction or a special token that it
breaks off is plain text.

Counts need not grow with the prefix ("hel" may have more tokens than "hello"), so
what fits a budget is the longest prefix within it.
"""

from __future__ import annotations

import json
from array import array
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import column, lean, small_batches

# The contractions that the pre-tokenizer splits off.
UNIT = regex.compile(r"\s*+(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
PIECE = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: For each class of characters one whose class is the same in all versions of Unicode.
STAND_IN = {"letter": "b", "digit": "0", "space": "\n", "sign": "!"}
#: Units that a worker keeps, and the longest ones among them; texts are cut in pieces of this many characters.
UNITS, LONGEST, PIECE_CHARS = 1 << 18, 64, 1 << 19
_NEVER = 1 << 40


def alphabet() -> dict[str, int]:
    """Character -> byte of vocabulary files: printable bytes stand for themselves, the others for 256, 257, ... in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The tables of a byte-level BPE file (the JSON of a ``tokenizers`` file)."""

    def __init__(self, text: str):
        held = json.loads(text)
        model, before = held["model"], held.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or held.get("normalizer"):
            raise ValueError("tokens: only byte-level BPE without a normalizer is known")
        of = alphabet()
        spelled = lambda t: bytes(of[c] for c in t)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if len({a + b for a, b in merges}) != len(merges) or any(len(m) == 1 for m in model["vocab"] if m not in of):
            raise ValueError("tokens: two merges make the same token, or a letter is no byte")
        # Tokens by number: the bytes, then what each merge makes.
        self.number = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pairs = [-1] * 256, [-1] * 256, {}
        for k, (a, b) in enumerate(merges):
            a, b = self.number[spelled(a)], self.number[spelled(b)]
            self.pairs[a << 32 | b] = 256 + k
            self.number[spelled(merges[k][0] + merges[k][1])] = 256 + k
            self.left.append(a)
            self.right.append(b)
        self.beside: dict[int, bool] = {}
        # A token that its own bytes are not encoded to never stands.
        self.stands = {t: n for t, n in self.number.items() if n < 256 or self.apart(self.left[n], self.right[n], n)}
        # States: beginnings of tokens, the longest one that a prefix ends with; found: the tokens that end there, the longest first.
        self.begins = [b""]
        self.state = {b"": 0}
        for t in self.stands:
            for i in range(1, len(t) + 1):
                if t[:i] not in self.state:
                    self.state[t[:i]] = len(self.begins)
                    self.begins.append(t[:i])
        self.found: list[list[tuple[int, int]]] = [[(len(t) - i, self.stands[t[i:]]) for i in range(len(t)) if t[i:] in self.stands] for t in self.begins]
        self.go: dict[int, int] = {}
        self.special = sorted((a["content"] for a in held.get("added_tokens", []) if a["content"]), key=lambda s: (-len(s), s))
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.odd: dict[int, str] = {}
        self.seen = set(map(chr, range(128)))
        self.steps = Steps(self)

    def apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether the tokens a and b stay beside each other: no merge across them comes before those that made them (nor before ``until``).

        Their merges are undone, the latest first; of two alike the right one is made later.
        """
        while self.pairs.get(a << 32 | b, _NEVER) >= until:
            if a > b and a > 255:
                until, a = a, self.right[a]
            elif b > 255:
                until, b = b + 1, self.left[b]
            else:
                return True
        return False

    def _next(self, key: int) -> int:
        """The state after a state and a byte, which are its key."""
        end = self.begins[key >> 8] + bytes([key & 255])
        while end not in self.state:
            end = end[1:]
        if len(self.go) > 1 << 20:
            self.go.clear()
        self.go[key] = self.state[end]
        return self.state[end]

    def _fits(self, key: int) -> bool:
        if len(self.beside) > 1 << 20:
            self.beside.clear()
        self.beside[key] = self.apart(key >> 32, key & 0xFFFFFFFF)
        return self.beside[key]

    def counts(self, data: bytes) -> array:
        """Tokens of every prefix of ``data`` (a piece that the pre-tokenizer leaves whole), the empty one first."""
        last, count, state = array("i", [-1]), array("i", [0]), 0
        go, found, beside = self.go, self.found, self.beside
        add_token, add_count = last.append, count.append
        for to, byte in enumerate(data, 1):
            key = state << 8 | byte
            state = go[key] if key in go else self._next(key)
            for size, token in found[state]:
                at = to - size
                if at:
                    pair = last[at] << 32 | token
                    if not (beside[pair] if pair in beside else self._fits(pair)):
                        continue
                add_token(token)
                add_count(count[at] + 1)
                break
        return count

    def at_characters(self, piece: str) -> list[int] | array:
        """Tokens of every prefix of a whole piece, one or more characters each."""
        data = piece.encode()
        count = self.counts(data)
        if len(data) == len(piece):
            return count[1:]
        return [count[i + 1] for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]

    def prefixes(self, unit: str) -> list[int] | array:
        """Tokens of every prefix of a unit."""
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha() and len(unit) > 1:
            return self.at_characters(unit)  # one piece: white space of its own beside letters is in the same count
        shadow = unit.translate(self.odd) if self.odd else unit
        blank = _BLANK.match(shadow).end()
        out = list(self.at_characters(unit[:blank])) if blank else []
        done = 0
        for m in PIECE.finditer(shadow):
            s, e = m.span()
            here = self.at_characters(unit[s:e])
            if len(shadow[s:e]) == 3 and shadow[s] == "'" and shadow[s + 1] in "rvl" and shadow[s + 2] in "el":
                here[1] = 2  # half a contraction is a sign and a letter
            out += (done + n for k, n in enumerate(here) if s + k >= blank)
            done += here[-1]
        return out

    def learn(self, text: str, classes) -> None:
        """See to it that the library's classes of all characters of ``text`` are known; they may be of another version of Unicode."""
        for c in set(text) - self.seen:
            self.seen.add(c)
            own = "letter" if regex.match(r"\p{L}", c) else "digit" if regex.match(r"\p{N}", c) else "space" if regex.match(r"\s", c) else "sign"
            if (kind := classes(c)) != own:
                self.odd[ord(c)] = STAND_IN[kind]

    def _plain(self, text: str) -> tuple[bytes, str]:
        """Steps of a text without special tokens, and its last unit; pieces are cut before white space, where units begin."""
        out, unit, at = [], "", 0
        while at < len(text):
            to = at + PIECE_CHARS
            if to < len(text):
                m = _BREAK.search(text, to)
                to = m.start() + 1 if m else len(text)
            some = text[at:to]
            if self.odd and (shadow := some.translate(self.odd)) != some:
                ends = [m.span() for m in UNIT.finditer(shadow)]
                units = [some[a:b] for a, b in ends]
            else:
                units = UNIT.findall(some)
            out.append(b"".join(map(self.steps.__getitem__, units)))
            unit, at = units[-1], to
        return b"".join(out), unit

    def text_steps(self, text: str) -> bytes:
        """16-bit steps of a whole text, one per character."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            steps, tail = self._plain(text[at : m.start()])
            out.append(steps)
            # A special token that is broken off is plain text, which goes on from the last unit before it.
            whole = _sums(self._plain(tail + m[0])[0])
            already = int(_sums(self._plain(tail)[0])[-1]) if tail else 0
            broken = whole[len(tail) :] - already
            broken[-1] = 1
            out.append(np.diff(broken, prepend=0).astype(np.int16).tobytes())
            at = m.end()
        out.append(self._plain(text[at:])[0])
        return b"".join(out)


class Steps(dict):
    """Unit -> its 16-bit steps. Units are kept in two generations, so that common ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, unit: str) -> bytes:
        steps = self.older.get(unit)
        if steps is None:
            counts = self.vocabulary.prefixes(unit)
            steps = array("h", map(sub, counts, chain((0,), counts))).tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = steps
        return steps


_BREAK, _BLANK = regex.compile(r"\S(?=\s)"), regex.compile(r"\s*")


def _sums(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int64)


def library_classes(text: str):
    """character -> its class in the library's pre-tokenizer, of a vocabulary file's text."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(text).pre_tokenizer.pre_tokenize_str

    def classes(c: str) -> str:
        with_letter = [x[1] for x in split(f"a{c}1")]
        if with_letter[0] == (0, 2):
            return "letter"
        if with_letter[1] == (1, 3):
            return "digit"
        return "sign" if (1, 3) in [x[1] for x in split(f"a{c}!")] else "space"

    return classes


def _table(shared, limits: tuple[int, ...]):
    def work(batches):
        held = shared.value  # one object per worker: what is built for one task serves the next
        if "built" not in held:
            held["built"] = Vocabulary(held["text"]), library_classes(held["text"])
        vocabulary, classes = held["built"]
        for batch in batches:
            data, offs = column(batch, "text")
            n, steps = [], []
            fits: list[list[int]] = [[] for _ in limits]
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]].tobytes().decode()
                vocabulary.learn(text, classes)
                steps.append(vocabulary.text_steps(text))
                counts = _sums(steps[-1])
                n.append(int(counts[-1]) if len(counts) else 0)
                for out, limit in zip(fits, limits, strict=True):
                    out.append(longest_within(counts, limit))
            cols = [batch.column(0), pa.array(np.diff(offs)), pa.array(n, pa.int64()), *(pa.array(f, pa.int64()) for f in fits), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", *(f"chars_{k}" for k in limits), "steps"])

    return work


def longest_within(counts: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens."""
    if limit < 0 or not len(counts):
        return 0
    if counts[-1] <= limit:
        return len(counts)
    within = np.flatnonzero(counts <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_table(docs: DataFrame, vocabulary: str, limits: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, chars_<limit> of each of ``limits``, and steps, for every row of ``docs``.

    ``vocabulary`` is a path that the driver reads; the file (some MB) goes to the
    workers. Tokens are those of the library without begin, end or added special
    tokens; strings of special tokens within a text are one token each, as is its
    default. chars_<limit> is how many characters (code points) of the text fit that
    many tokens. Null texts are empty, and have 0 bytes, tokens and steps. Repeated
    rows are repeated; other columns are left out, whatever their names. A text of
    any length is taken whole: one of 20 MB takes some 200 MB of a worker.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"text": f.read()})
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, " + "".join(f"chars_{k} long, " for k in limits) + "steps binary"
    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(_table(shared, limits)), schema)


def _answers(by: str):
    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index("steps")
            asked = batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for steps, n in zip(batch.column(at), asked, strict=True):
                counts = _sums(steps.as_py() or b"")
                if n is None:
                    out.append(None)
                elif by == "tokens":
                    out.append(longest_within(counts, n))
                else:
                    out.append(int(counts[min(n, len(counts)) - 1]) if n > 0 and len(counts) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "answer"])

    return work


def _asked(table: DataFrame, n, by: str) -> DataFrame:
    rows = small_batches(table).select("*", (F.lit(n) if isinstance(n, int) else n).cast("long").alias("__asked"))
    return rows.mapInArrow(lean(_answers(by)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", answer long")


def fitting(table: DataFrame, tokens) -> DataFrame:
    """A prefix table plus answer: how many characters of each text fit ``tokens`` (a number or a column; null gives null)."""
    return _asked(table, tokens, "tokens")


def counted(table: DataFrame, characters) -> DataFrame:
    """A prefix table plus answer: how many tokens the first ``characters`` (a number or a column) of each text have; beyond its end those of the whole text."""
    return _asked(table, characters, "characters")


def report(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_<limit> of every row of ``docs``."""
    out = prefix_table(docs, vocabulary, (limit,))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), f"chars_{limit}")
