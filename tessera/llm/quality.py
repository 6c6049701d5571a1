"""Quality classifier (operator 6): hashed word n-grams, logistic regression by follow-the-regularised-leader.

A document is a sparse vector of its one- and two-word counts, scaled by the
square root of the counts and to unit length. A word that repeats the one before
it is hashed as a repeat, so that stuttered text looks alike whatever the word.
Training takes a bounded sample of labelled rows; scores are sparse dot products
inside the scan, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import Leader, bounded_sample, fit_in_task, row_vectors, tokens
from tessera.llm.words import blocks, column, lean, mix, plain

BITS = 18
#: Labelled rows that training takes at most.
SAMPLE = 6000
#: Passes over the sample: PASSES, or as many as give UPDATES steps where the sample is small.
PASSES, UPDATES = 3, 24_000
_REPEAT = np.uint64(0x7265706561746564)


def _ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, first = tokens(data, offs)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same_row = row[1:] == row[:-1]
    again = np.zeros(len(t), bool)
    again[1:] = same_row & (t[1:] == t[:-1])
    w = np.where(again, _REPEAT, t)
    pair = mix(w[:-1] ^ mix(w[1:] + np.uint64(2)))[same_row]
    # A pair that ends in a repeat is a repeat alone; its first word says nothing.
    pair = np.where(again[1:][same_row], _REPEAT, pair)
    f = np.concatenate([mix(w), mix(pair)]) >> np.uint64(64 - BITS)
    return f.astype(np.int64), np.concatenate([row, row[1:][same_row]])


def vectors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(offs) - 1
    row, feature, count = row_vectors(*_ngrams(data, offs), n, BITS)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=count, minlength=n))
    return row, feature, value / norm[row]


def _fit(data: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    examples = []
    for a, b in blocks(offs):
        row, feature, value = vectors(data, offs[a : b + 1])
        ends = np.searchsorted(row, np.arange(b - a + 1))
        feature, value = feature.astype(np.int32), value.astype(np.float32)
        examples += [(np.append(feature[i:j], np.int32(1 << BITS)), np.append(value[i:j], np.float32(1))) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    model, order = Leader((1 << BITS) + 1, alpha=4.0, l1=0.01, l2=0.02), np.random.default_rng(6)
    for _ in range(max(PASSES, -(-UPDATES // max(1, len(examples))))):
        for i in order.permutation(len(examples)):
            at, x = examples[i]
            w = model.weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            model.update(at, w, (p - y[i]) * x)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return {"at": at, "w": w[at]}


def train(examples: DataFrame) -> np.ndarray:
    """Weights (the last one is the bias) from a bounded number of rows (doc_id, text, y in 0 and 1).

    Rows with a null label are left out. Without any row all weights are 0.
    """
    found = fit_in_task(examples, _fit, "at long, w double")
    w = np.zeros((1 << BITS) + 1)
    w[found["at"].to_numpy()] = found["w"].to_numpy()
    return w


def _score(shared):
    def work(batches):
        w = shared.value
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs):
                row, feature, value = vectors(data, offs[a : b + 1])
                dot = np.bincount(row, weights=w[feature] * value, minlength=b - a) + w[-1]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))], names=[*batch.schema.names, "__score"])

    return work


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs``, all columns, plus __score in 0 to 1; a null or empty text scores the bias alone."""
    docs = plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __score double"
    return docs.mapInArrow(lean(_score(shared)), schema)


def fold(modulus: int):
    """crc32 of the doc_id's digits, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def labelled(docs: DataFrame, labels: DataFrame, label: str, wanted, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most about ``sample`` labelled documents for which ``wanted`` holds.

    The labels are sampled before the join, so what is broadcast has a fixed
    bound and no text is shuffled.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isNotNull() & wanted)
    few = bounded_sample(known, sample, "doc_id").withColumnRenamed("doc_id", "label_id")
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learned from rows of other folds only.

    Rows with a null doc_id are never learned from and count as not held out.
    Repeated rows are scored alike.
    """
    weights = train(labelled(docs, labels, "quality", fold(5) != 0, sample))
    out = scored(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
