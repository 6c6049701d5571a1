"""Hashed sparse text features, and follow-the-regularised-leader training on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import column, hash_spans, lean, mix, small_batches
from tessera.scratch import materialize, release

#: Kinds of bytes: 0 ends a token; letters, digits and what is beyond ASCII form words; each other byte value forms runs of its own.
_KIND = np.zeros(256, np.uint16)
_KIND[33:127] = np.arange(33, 127)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_FOLD = np.arange(256, dtype=np.uint16) + 1
_FOLD[65:91] += 32


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows between ``offs``, and each row's first token: words in lower case, and runs of one punctuation mark."""
    raw = data[offs[0] : offs[-1]]
    kind, rel, n = _KIND[raw], offs - offs[0], len(raw)
    before, after = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    s = np.flatnonzero((kind != 0) & ((before != kind) | edge[:-1]))
    e = np.flatnonzero((kind != 0) & ((after != kind) | edge[1:])) + 1
    return hash_spans(_FOLD[raw], s, e), np.searchsorted(s, rel)


def row_vectors(feature: np.ndarray, row: np.ndarray, n_rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, feature) with counts: rows, features, counts."""
    pair, count = np.unique((row.astype(np.int64) << bits) | feature, return_counts=True)
    return pair >> bits, pair & ((1 << bits) - 1), count


def bounded_sample(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """At most about ``limit`` rows, chosen by a hash of ``key``; all of them where there are fewer.

    The share follows from the row count, so the sample's size is bounded
    whatever the input, and it is the same in every run.
    """
    total = rows.count()
    if total <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(limit / total * (1 << 40)))


#: Bytes of text that training takes at most; a text of more than a sixteenth of it is not learned from.
SAMPLE_BYTES = 128 << 20


def fit_in_task(examples: DataFrame, fit, schema: str, limit: int = SAMPLE_BYTES):
    """The rows (pandas) that ``fit`` makes of a bounded sample (doc_id, y, text), in one task.

    fit(data, offs, y) gets the texts in the order of doc_id, whatever the
    partitions were, and returns arrays by column name. Where the sample's texts have
    more than ``limit`` bytes, those of a part of it by a hash. The task's memory
    follows from the sample's bounds; if its executor is lost, it runs again elsewhere.
    """

    def work(batches):
        held = list(batches)
        plain = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("text", pa.string())])
        whole = pa.Table.from_batches(held).cast(plain) if held else plain.empty_table()
        whole = whole.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        batch = whole.to_batches()[0] if whole.num_rows else pa.RecordBatch.from_pylist([], schema=whole.schema)
        data, offs = column(batch, "text")
        found = fit(data, offs, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    rows = small_batches(examples).filter(F.col("y").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(rows.filter(F.octet_length("text") <= limit // 16), "examples")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > limit:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int(limit / total * (1 << 40)))
    out = rows.repartition(1).mapInArrow(lean(work), schema).toPandas()
    release(rows)
    return out


class Leader:
    """FTRL-proximal for weights with a gradient per example."""

    def __init__(self, n: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = np.zeros(n), np.zeros(n), alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
