r"""Secret scans with a recursive decoding worklist (operator 9).

A text is the first layer. Each layer is scanned for secrets; then what decodes in
it becomes a new layer, until no layer is new: the layer with its URL or Unicode
escapes decoded and all else kept; runs of base64 (from each of four places, as a
run may be glued to other characters; wrapped lines joined) and of hex; and gzip or
zlib data that begins anywhere in what these decode to. Layers are known by their
digest, so that cycles end. A layer can tell for each of its characters the range of
the original text it came from, so that what is found in it maps back: by one entry
per escape, or by arithmetic, so that a long text costs no more than its length. Of
bytes that are not UTF-8 the stretches of plain characters are taken, each a layer;
all that any pattern matches or opens is within one.

Regular expressions run only over texts that hold a keyword, a marker or a long
enough run, which plain byte searches tell; no pattern loses a match by that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import column, lean, small_batches

# The patterns and least lengths of the kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 8, 16
_KEYWORDS = ("passw", "secret", "token", "api")

#: Unpacked data is scanned in pieces of this size, which overlap.
LAYER_CHARS, OVERLAP = 32 << 20, 1 << 20

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
# A secret has 14 characters at least (token= and 8 more), which are 19 of base64.
LEAST_SECRET = 14
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,}+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")
BLANK = re.compile(r"[ \t\r\n]+")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{28,}")
#: Anything that can be found or opened in bytes has so many plain characters in a row.
PLAIN = re.compile(rb"[\t\n\r -~]{%d,}+" % LEAST_SECRET)
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns; runs of fewer than 32 hex digits fail by the pattern."""
    found = []
    folded = text.lower()
    if any(k in folded for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _texts(data: bytes):
    """(text, first byte) of what can be read in ``data``: all of it if it is UTF-8, else each long enough stretch of plain characters; first byte -1: of UTF-8 with characters of several bytes."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        for m in PLAIN.finditer(data):
            yield m[0].decode("ascii"), m.start()
        return
    if PLAIN.search(data):
        yield text, 0 if len(text) == len(data) else -1


def _unpacked(data: bytes):
    """What gzip or zlib data that begins anywhere in ``data`` unfolds to, in overlapping pieces: all members, of broken data what comes before the fault."""
    at = 0
    while (m := PACKED.search(data, at)) is not None:
        at = now = m.start()
        at += 1
        opener, tail, piece = zlib.decompressobj(47), b"", bytearray()
        try:
            while now < len(data) and not opener.eof:
                # In small steps, so that a fault loses little of what came before it.
                some = data[now : now + (1 << 10)]
                piece += opener.decompress(some, LAYER_CHARS - OVERLAP)
                now += len(some) - len(opener.unconsumed_tail) - len(opener.unused_data)
                if len(piece) >= LAYER_CHARS - OVERLAP:
                    yield tail + piece
                    tail, piece = bytes(piece[-OVERLAP:]), bytearray()
        except zlib.error:
            pass
        if opener.eof:
            at = now  # what follows is searched for the next member
        if piece:
            yield tail + piece


def _opened(data: bytes, seen: set[bytes]):
    """The pieces of ``_unpacked``, and what is packed in them in turn; a piece that has been there is not opened again."""
    for piece in _unpacked(data):
        mark = hashlib.blake2b(piece, digest_size=16).digest()
        if mark not in seen:
            seen.add(mark)
            yield piece
            yield from _opened(bytes(piece), seen)


class _Steps:
    """Places of the characters of bytes that stand for ``width`` characters each, or for six bits of each of them (width 0), in a run.

    ``at`` are the run's own characters, where blanks are left out; ``first`` the first
    of them that counts; ``starts`` the first byte of each character, where they have several.
    """

    def __init__(self, width: int, first: int, byte: int, at: np.ndarray | None, count: int, starts: np.ndarray | None):
        self.width, self.first, self.byte, self.at, self.count, self.starts = width, first, byte, at, count, starts

    def span(self, k: int) -> tuple[int, int]:
        a, z = (k, k + 1) if self.starts is None else (int(self.starts[k]), int(self.starts[k + 1]))
        a, z = a + self.byte, z + self.byte
        if self.width:
            return self.first + self.width * a, self.first + self.width * z
        a, z = self.first + a * 8 // 6, min(self.count, self.first - (-z * 8 // 6)) - 1
        return (a, z + 1) if self.at is None else (int(self.at[a]), int(self.at[z]) + 1)


class _Pieces:
    """Places in a text of which some parts, the escapes, were decoded: an entry for each escape and for each stretch between them."""

    def __init__(self):
        self.begin, self.start, self.end = array("q"), array("q"), array("q")

    def add(self, begin: int, start: int, end: int) -> None:
        """From character ``begin`` on: the range of one escape, or (end -1) as it stands from ``start`` on."""
        self.begin.append(begin)
        self.start.append(start)
        self.end.append(end)

    def span(self, k: int) -> tuple[int, int]:
        i = bisect_right(self.begin, k) - 1
        start, end = self.start[i], self.end[i]
        if end >= 0:
            return start, end
        return start + k - self.begin[i], start + k - self.begin[i] + 1


class _Within:
    """Places of a layer within another one, from its character ``first`` on, whose own places may be known (``outer``)."""

    def __init__(self, outer, first: int, inner):
        self.outer, self.first, self.inner = outer, first, inner

    def span(self, k: int) -> tuple[int, int]:
        a, z = self.inner.span(k)
        a, z = a + self.first, z + self.first
        return (a, z) if self.outer is None else (self.outer.span(a)[0], self.outer.span(z - 1)[1])


def _of_bytes(data: bytes, places):
    """(decoded text, place) of decoded bytes, as they are and unpacked; places(byte, starts): of the text from that byte on."""
    for out, byte in _texts(data):
        starts = None
        if byte < 0:
            starts = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        yield out, places(max(byte, 0), starts)
    for piece in _opened(data, set()):
        for out, _ in _texts(bytes(piece)):
            yield out, None


def _base64(layer: str, start: int, end: int):
    """(start, end, decoded text, place) of a run of base64, perhaps over several lines, from each of four places."""
    at, run = None, layer[start:end]
    if "\n" in run:
        at = np.flatnonzero(~np.isin(np.frombuffer(run.encode("ascii"), np.uint8), np.frombuffer(b" \t\r\n", np.uint8)))
        run = BLANK.sub("", run)
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    count = len(run)
    for skip in range(4):
        part = run[skip:]
        part = part[:-1] if len(part) % 4 == 1 else part
        if len(part) < 19:
            continue
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        for out, place in _of_bytes(data, lambda byte, starts: _Steps(0, skip, byte, at, count, starts)):  # noqa: B023
            yield start, end, out, place


def _layers(text: str):
    """(start, end, decoded text, place) of all that decodes in ``text``; place tells each decoded character's (start, end) in the run, or is None if the run stands for all."""
    if "%" in text and URL_ESCAPE.search(text):
        yield 0, len(text), *_unescaped(text, URL_ESCAPE, _url)
    if "\\" in text and UNICODE_ESCAPE.search(text):
        yield 0, len(text), *_unescaped(text, UNICODE_ESCAPE, _unicode)
    wrapped = [m.span() for m in BASE64_LINES.finditer(text) if m.end() - m.start() > 19] if "\n" in text else []
    for s, e in wrapped:
        yield from _base64(text, s, e)
    k = 0
    for m in BASE64_RUN.finditer(text):
        while k < len(wrapped) and wrapped[k][1] < m.end():
            k += 1
        if k == len(wrapped) or m.start() < wrapped[k][0]:
            yield from _base64(text, m.start(), m.end())
    for m in HEX_RUN.finditer(text):
        for skip in range(2):
            digits = m[0][skip:]
            digits = digits[: len(digits) & ~1]
            for out, place in _of_bytes(bytes.fromhex(digits), lambda byte, starts: _Steps(2, skip, byte, None, 0, starts)):  # noqa: B023
                yield m.start(), m.end(), out, place


def _url(m: re.Match):
    at = m.start()
    data = bytes.fromhex(m[0].replace("%", ""))
    try:
        out, wide = data.decode("utf-8"), True
    except UnicodeDecodeError:
        out, wide = data.decode("latin-1"), False
    for c in out:
        n = len(c.encode()) if wide else 1
        yield c, (at, at + 3 * n)
        at += 3 * n


def _unicode(m: re.Match):
    if m[1]:
        c = chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)
    else:
        code = int(m[3] or m[4], 16)
        c = chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd"
    yield c, m.span()


def _unescaped(text: str, escape: re.Pattern, decoded) -> tuple[str, _Pieces]:
    """The whole text with its escapes decoded."""
    out, place, at, n = [], _Pieces(), 0, 0
    for m in escape.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
            place.add(n, at, -1)
            n += m.start() - at
        for c, (a, z) in decoded(m):
            out.append(c)
            place.add(n, a, z)
            n += 1
        at = m.end()
    out.append(text[at:])
    place.add(n, at, -1)
    return "".join(out), place


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans (both by start, then kind as listed, then end), and the number of layers beyond the first."""
    base = base_spans(text)
    everything = set(base)
    seen, n = {hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()}, 0
    # Open layers, the innermost last; each gives its next one when it is asked, so that big ones are not held together.
    work: list[tuple] = [(_layers(text), text, None, 0, len(text))]
    while work:
        inside, layer, places, lo, hi = work[-1]
        found = next(inside, None)
        if found is None:
            work.pop()
            continue
        s, e, out, inner = found
        if len(work) > 1 and places is None:
            a, b, mapped = lo, hi, None
        else:
            a, b = (s, e) if places is None else (places.span(s)[0], places.span(e - 1)[1])
            mapped = None if inner is None else _Within(places, s, inner)
        mark = hashlib.blake2b(out.encode("utf-8", "replace") + f"@{a}:{b}".encode(), digest_size=16).digest()
        if mark in seen or out == layer[s:e]:
            continue
        seen.add(mark)
        n += 1
        for kind, x, y in base_spans(out):
            everything.add((kind, mapped.span(x)[0], mapped.span(y - 1)[1]) if mapped is not None else (kind, a, b))
        work.append((_layers(out), out, mapped, a, b))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(everything, key=order), n


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches):
    for batch in batches:
        data, offs = column(batch, "text")
        rows: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base", "spans", "layers")}
        for i in range(batch.num_rows):
            base, every, layers = scan(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
            for k in KINDS:
                rows[f"n_{k}"].append(sum(x[0] == k for x in base))
            rows["base"].append(_join(base))
            rows["spans"].append(_join(every))
            rows["layers"].append(layers)
        types = {"base": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in rows.items())], names=["doc_id", *rows])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, layers of every row of ``docs`` (doc_id, text, any others).

    base and spans are kind:start:end lists; a null or empty text has none. A
    secret found in a layer that was compressed maps to the whole packed run.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(_scan), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string, layers long")


def report(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "layers")
