"""Word hashes of whole Arrow text columns, by array arithmetic instead of a loop over words."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 19
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse modulo 2**64, for i < n."""
    import builtins

    held = builtins.__dict__.setdefault("_tessera_powers", {})  # one pair of tables per worker, never pickled
    if len(held.get("up", ())) < n:
        n = max(n, BLOCK)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            held[name] = np.cumprod(t, dtype=np.uint64)
    return held["up"], held["down"]


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte -> 0 for a separator, else its (lower-cased) value plus 1."""
    t = np.arange(256, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t += 1
    t[list(separators)] = 0
    return t


#: Words end at white space: the space and bytes 9 to 13.
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


#: Bytes of a batch that goes to a Python worker, in a session that leaves Spark's own bound as it is (64 MB, of which worker and executor hold copies).
BATCH_BYTES, _BATCH, _DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after seeing to it that their session's Arrow batches are small; a bound that the user has set stays."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows


def lean(work):
    """``work`` over batches, handing memory that is free back to the system after each batch that it takes: workers live on between tasks, beside an executor that needs the room."""

    def trim() -> None:
        import ctypes

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (AttributeError, OSError):  # another libc
            pass

    def watched(batches):
        for batch in batches:
            yield batch
            del batch
            trim()

    def run(batches):
        yield from work(watched(batches))
        trim()

    return run


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and row offsets; null rows are empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, limit: int = BLOCK, rows: int = 1 << 20):
    """Row ranges of at most ``limit`` bytes (or one row) and ``rows`` rows."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n, at + rows)
        yield at, end
        at = end


def word_spans(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of non-zero values; runs also end where a row starts (``starts`` ends with the length)."""
    n = len(values)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = values != 0
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    here = inside[1:-1]
    first = here & (~inside[:-2] | edge[:-1])
    last = here & (~inside[2:] | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values in each span; spans are in order and apart. At most BLOCK values (or one span) are summed up at once."""
    out, at = np.empty(len(s), np.uint64), 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + BLOCK, "right")))
        base, some = s[at], values[s[at] : e[to - 1]]
        up, down = powers(len(some) + 1)
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=total[1:], dtype=np.uint64)
        out[at:to] = mix((total[e[at:to] - base] - total[s[at:to] - base]) * down[s[at:to] - base])
        at = to
    return out


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows between ``offs``: all word hashes in order, and each row's first word (one more at the end).

    Pieces of about BLOCK bytes, cut at separators, are taken one at a time, so that
    a long row needs no more memory than its words' hashes.
    """
    raw, rel = data[offs[0] : offs[-1]], offs - offs[0]
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        to = min(at + BLOCK, len(raw))
        while to < len(raw):
            apart = np.flatnonzero(table[raw[to : to + 4096]] == 0)
            to += int(apart[0]) if len(apart) else min(4096, len(raw) - to)
            if len(apart):
                break
        values = table[raw[at:to]]
        a, b = np.searchsorted(rel, (at, to + 1))
        s, e = word_spans(values, rel[a:b] - at)
        hashes.append(hash_spans(values, s, e))
        starts.append(s + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), rel)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(int(n) * _P & 0xFFFFFFFFFFFFFFFF))
    for k in range(n):
        out = (out ^ w[k : m + k]) * np.uint64(_Q)
        out ^= out >> np.uint64(29)
    return mix(out)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` without columns whose names begin with two underscores: the operators' own are called so."""
    return small_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])


def share(spark: SparkSession, held):
    """A broadcast of an object's attributes: plain values, which workers read without this package. See ``shared``."""
    return spark.sparkContext.broadcast(vars(held))


def shared(broadcast) -> SimpleNamespace:
    return SimpleNamespace(**broadcast.value)


def list_column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
