"""Toxicity (operator 10): cumulative-link ordinal regression on sparse text features.

Model. P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector w >= 0 for all
thresholds theta_1 < theta_2 < theta_3: clean words don't make up for toxic ones.
x holds the log-scaled counts of the words and word beginnings of 4 to 8 bytes
that the screen below lets in. The expected severity is the sum over k of
P(grade >= k).

Fit. The likelihood of a grade known to lie in lo..hi is P(grade >= lo) less
P(grade > hi), a difference of two sigmoids; its slopes drive a proximal gradient
ascent with steps per coordinate. The labels here say toxic or not, which is grade
0, or 1 to 3. They leave theta_2 and theta_3 open; those are put where, by the
model, a toxic document of the sample passes them with 2/3 and 1/3 on average.
Labels that name the grade (``graded``) fit all thresholds.

Screen. A feature comes in if, of the sample's documents that hold it, a Wilson
bound puts more than LEAST_SHARE among the toxic ones. Copies count together as
one document there: documents of the sample that share their least feature hash
weigh one over their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import fit_in_task, row_vectors
from tessera.llm.quality import fold, labelled
from tessera.llm.words import ALNUM, blocks, column, hash_spans, lean, mix, plain, share, shared, word_spans

BITS = 20
#: Labelled rows that training takes at most.
SAMPLE = 6000
GRADES = 3
STEMS = (4, 5, 6, 7, 8)
STEPS, STEP, L2 = 600, 0.3, 1e-4
Z, LEAST_SHARE = 1.64, 0.5


def _folded(data: np.ndarray) -> np.ndarray:
    """Byte values as ALNUM has them, with the capitals of the two-byte Latin letters lowered too."""
    v = ALNUM[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    v[latin] += 0x20
    return v


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and counts: words, and beginnings of words that are longer."""
    v, rel = _folded(data[offs[0] : offs[-1]]), offs - offs[0]
    s, e = word_spans(v, rel)
    row = np.searchsorted(rel, s, "right") - 1
    found, rows = [mix(hash_spans(v, s, e))], [row]
    for n in STEMS:
        long_ = e - s > n
        found.append(mix(hash_spans(v, s[long_], s[long_] + n) + np.uint64(n)))
        rows.append(row[long_])
    f = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return row_vectors(f, np.concatenate(rows), len(offs) - 1, BITS)


class Ordinal:
    """Shared weights and ordered thresholds; a document counts as toxic from P(grade > 0) = cut on."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.5):
        self.weights, self.thresholds, self.cut = weights.astype(np.float32), thresholds, cut


def above(thresholds: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """P(grade > k) for each row and threshold."""
    return 1 / (1 + np.exp(-np.clip(dot[:, None] - thresholds, -30, 30)))


def screen(row: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each feature speaks for toxicity. row, at: the sample's (document, feature) pairs, sorted by document."""
    first = np.searchsorted(row, np.arange(len(y)))
    least = np.minimum.reduceat(mix(at.astype(np.uint64)), np.minimum(first, len(at) - 1)) if len(at) else np.zeros(len(y), np.uint64)
    _, family, size = np.unique(least, return_inverse=True, return_counts=True)
    weight = (1.0 / size[family])[row]
    n = np.bincount(at, weights=weight, minlength=1 << BITS)
    p = np.bincount(at, weights=weight * y[row], minlength=1 << BITS) / np.maximum(n, 1e-9)
    bound = (p + Z * Z / (2 * n.clip(1e-9)) - Z * np.sqrt((p * (1 - p) + Z * Z / (4 * n.clip(1e-9))) / n.clip(1e-9))) / (1 + Z * Z / n.clip(1e-9))
    return (n > 0) & (bound > LEAST_SHARE)


def likelihood(dot: np.ndarray, theta: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of grades that lie in lo..hi, and its slopes by the rows' dot products and by the thresholds."""
    n, row = len(dot), np.arange(len(dot))
    p = np.concatenate([np.ones((n, 1)), above(theta, dot), np.zeros((n, 1))], axis=1)  # P(grade >= k), k from 0 to GRADES + 1
    a, b = p[row, lo], p[row, hi + 1]
    q = np.maximum(a - b, 1e-12)
    up, down = weight * a * (1 - a) / q, weight * b * (1 - b) / q
    slope = np.bincount(hi + 1, weights=down, minlength=GRADES + 2) - np.bincount(lo, weights=up, minlength=GRADES + 2)
    return float((weight * np.log(q)).sum()), up - down, slope[1 : GRADES + 1]


def fit_ordinal(row: np.ndarray, at: np.ndarray, x: np.ndarray, size: int, lo: np.ndarray, hi: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (``size`` of them) and thresholds from a sparse matrix (row, at, x) and the grades lo..hi of its rows."""
    # Rare grades count as much as the rest together, up to tenfold.
    bad = lo > 0
    weight = np.where(bad, min(10.0, max(1.0, (~bad).sum() / max(1, bad.sum()))), 1.0)
    weight /= weight.sum()
    reached = lo[:, None] > np.arange(GRADES)
    share = np.clip((weight[:, None] * reached).sum(axis=0), 1e-3, 1 - 1e-3)
    theta, w = np.maximum.accumulate(np.log(1 / share - 1) + np.arange(GRADES) * 1e-3), np.zeros(size)
    past, theta_past = np.full(size, 1e-12), np.full(GRADES, 1e-12)
    for _ in range(steps):
        _, by_dot, by_theta = likelihood(np.bincount(row, weights=w[at] * x, minlength=len(lo)), theta, lo, hi, weight)
        slope = L2 * w - np.bincount(at, weights=by_dot[row] * x, minlength=size)
        past += slope * slope
        w = np.maximum(0.0, w - STEP / np.sqrt(past) * slope)
        theta_past += by_theta * by_theta
        theta = theta + STEP / np.sqrt(theta_past) * by_theta
        theta = np.maximum.accumulate(theta + np.arange(GRADES) * 1e-6)
    # The weighting raised all probabilities: the thresholds take them back to the sample's own
    # shares. So what was fitted of them steers the weights alone; what is kept is set here.
    dot = np.bincount(row, weights=w[at] * x, minlength=len(lo))
    split = (lo == hi).all()
    for k in range(GRADES):
        low, high = -40.0, 40.0
        for _ in range(60):
            theta[k] = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(dot - theta[k], -40, 40)))
            if k and not split:
                more = p[bad].sum() > (GRADES - k) / GRADES * above(theta[:1], dot)[bad].sum() if bad.any() else True
            else:
                more = p.mean() > (lo > k).mean()
            low, high = (theta[k], high) if more else (low, theta[k])
    return w, np.maximum.accumulate(theta)


def _fit(graded: bool):
    def fit(data: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        parts = [(np.zeros(0, np.int32),) * 3]
        for a, b in blocks(offs):
            r, f, c = features(data, offs[a : b + 1])
            parts.append(((r + a).astype(np.int32), f.astype(np.int32), c.astype(np.int32)))
        row, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        y = np.clip(y, 0, GRADES if graded else 1).astype(np.int64)
        used = screen(row, at, (y > 0).astype(np.int64))[at]
        names, column_ = np.unique(at[used], return_inverse=True)
        row, x = row[used], np.log1p(n[used])
        w, theta = fit_ordinal(row, column_, x, len(names), y, y if graded else y * GRADES)
        dot = np.bincount(row, weights=w[column_] * x, minlength=len(y))
        cut = best_cut(above(theta[:1], dot)[:, 0], y > 0)
        kind = np.repeat([0, 1, 2], [GRADES, 1, len(names)])
        return {"kind": kind, "at": np.concatenate([np.arange(GRADES), [0], names]), "value": np.concatenate([theta, [cut], w])}

    return fit


def train(examples: DataFrame, graded: bool = False) -> Ordinal:
    """The model from a bounded number of rows (doc_id, text, y); without rows it predicts grade 0.

    y is 0 or 1, or with ``graded`` the grade, 0 to 3.
    """
    if examples.isEmpty():
        return Ordinal(np.zeros(1 << BITS), 10.0 + np.arange(GRADES))
    found = fit_in_task(examples, _fit(graded), "kind long, at long, value double")
    part = lambda k: found[found["kind"] == k]
    w = np.zeros(1 << BITS)
    w[part(2)["at"].to_numpy()] = part(2)["value"].to_numpy()
    return Ordinal(w, part(0).sort_values("at")["value"].to_numpy(), float(part(1)["value"].max()))


def best_cut(p: np.ndarray, true: np.ndarray) -> float:
    """The cut with the best F2 (recall counts double) on the sample, halfway to the next lower probability."""
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(true[order])
    f2 = np.where(np.r_[q[1:] < q[:-1], True], 5 * hits / (np.arange(1, len(p) + 1) + 4 * true.sum()), -1.0)
    k = int(f2.argmax())
    return float((q[k] + q[k + 1]) / 2) if true.any() and k + 1 < len(q) else 0.5


def _severity(held):
    def work(batches):
        model = shared(held)
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs):
                row, feature, count = features(data, offs[a : b + 1])
                dot = np.bincount(row, weights=model.weights[feature] * np.log1p(count), minlength=b - a)
                p = above(model.thresholds, dot)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(np.where(p[:, 0] >= model.cut, 1 + (p[:, 1:] >= 0.5).sum(axis=1), 0).astype(np.int32))], names=[*batch.schema.names, "__p", "__severity", "__grade"])

    return work


def severities(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs``, all columns, plus __p (probability of any toxicity), __severity (expected, 0 to 3), __grade (0 below the cut, else 1 and 1 for each higher threshold that is more likely passed than not)."""
    docs = plain(docs)
    held = share(docs.sparkSession, model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __p double, __severity double, __grade int"
    return docs.mapInArrow(lean(_severity(held)), schema)


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, p_toxic, severity, grade, toxic of every row of ``docs``; learned from rows outside fold 0 of 5.

    A null or empty text has no features and gets the thresholds' own values. Rows
    with a null doc_id are scored and count as not held out.
    """
    model = train(labelled(docs, labels, "toxic", fold(5) != 0, sample))
    out = severities(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), F.col("__p").alias("p_toxic"), F.col("__severity").alias("severity"), F.col("__grade").alias("grade"), (F.col("__grade") >= 1).alias("toxic"))
