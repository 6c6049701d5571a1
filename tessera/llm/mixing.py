"""Mixing to target weights by iterative proportional fitting (operator 1).

Token counts are summed to cells of source x language x topic in one aggregation;
fitting works on the cells alone, so a hot source costs no more than another. A
cell's factor times the rate is the number of copies that its documents get in the
sample, on average: in expectation the sampled tokens have all target marginals.

Topics, which the documents don't carry, are the nearest of TOPICS centroids over
hashed word counts; the centroids are fitted on all documents, by rounds of sums per
centroid, in whole numbers so that their order does not matter. For that each text
is sketched once, into a written table of 256 bytes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM, blocks, column, lean, plain, small_batches, words
from tessera.scratch import materialize, release

TOPICS, SKETCH_BITS, TOPIC_ROUNDS = 8, 8, 15
#: Rounds of the fitting at most, the largest share that may be left open for it to end, and for its outcome to count.
ROUNDS, TOLERANCE, LEEWAY = 200, 1e-11, 1e-4
#: Values of the two dimensions with fewer values, together: the square of that meets on the driver.
MOST = 2000
#: Tokens of the sample, as a share of all.
RATE = 0.5
#: Rows that are sketched at once.
ROWS = 4096
#: Up to this many cells the fitting is done in memory, beyond it by Spark: the same rounds over the same sums.
CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"


def sketches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word count of each row, and the direction of its log word counts, by hash, in 256 steps a word."""
    w, first = words(data, offs, ALNUM)
    rows, size = len(offs) - 1, 1 << SKETCH_BITS
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    v = np.log1p(np.bincount(row * size + (w >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=rows * size).reshape(rows, size).astype(np.float32))
    return n, np.rint(v * (255 / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True)))).astype(np.uint8)


def _held(v: pa.Array) -> np.ndarray:
    """Sketches of a binary column, a row each."""
    return np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) if len(v) else np.zeros((0, 1 << SKETCH_BITS), np.uint8)


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (v.astype(np.float32) @ c.T).argmax(axis=1)


def _sketch(batches):
    for batch in batches:
        data, offs = column(batch, "text")
        for a, b in blocks(offs, rows=ROWS):
            n, v = sketches(data, offs[a : b + 1])
            ends = pa.py_buffer((np.arange(b - a + 1) * v.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(n), pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(np.ascontiguousarray(v))])], names=["id", "source", "lang", "tokens", "v"])


def sketched(docs: DataFrame) -> DataFrame:
    """id, source, lang, tokens and sketch of every row, 256 bytes each; a written table."""
    rows = small_batches(docs).select(F.xxhash64("doc_id").alias("id"), *(F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in DIMENSIONS[:2]), "text")
    return materialize(rows.mapInArrow(lean(_sketch), "id long, source string, lang string, tokens long, v binary"), "sketches")


def _sums(shared):
    """Of the rows' sketches: (topic, at, s), the sums over the nearest centroid."""

    def work(batches):
        c = shared.value
        total = np.zeros(c.shape, np.int64)
        for batch in batches:
            v = _held(batch.column(0))
            near = _nearest(v, c)
            for k in range(len(c)):
                total[k] += v[near == k].sum(axis=0, dtype=np.int64)
        topic, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(at), pa.array(total[topic, at])], names=["topic", "at", "s"])

    return work


def fit_topics(seen: DataFrame, k: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Centroids of all sketches, by spherical k-means from k different ones with the least hashes; one zero centroid without words."""
    worded = seen.filter("tokens > 0")
    first = worded.select("id", "v").distinct().orderBy("id", "v").limit(8 * k).collect()
    start = list(dict.fromkeys(bytes(r["v"]) for r in first))[:k]
    if not start:
        return np.zeros((1, 1 << SKETCH_BITS), np.float32)
    c = np.frombuffer(b"".join(start), np.uint8).reshape(len(start), -1).astype(np.float32)
    c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    for _ in range(rounds):
        held = seen.sparkSession.sparkContext.broadcast(c)
        total, now = np.zeros(c.shape), c
        for r in worded.select("v").mapInArrow(lean(_sums(held)), "topic long, at long, s long").groupBy("topic", "at").agg(F.sum("s").alias("s")).collect():
            total[r["topic"], r["at"]] = r["s"]
        held.destroy()
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(1e-12, size), c).astype(np.float32)
        if np.array_equal(c, now):
            break
    return c


def _topics(shared):
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f"topic{k}" for k in _nearest(_held(batch.column(3)), shared.value)], pa.string())], names=["source", "lang", "tokens", "topic"])

    return work


def topic_rows(seen: DataFrame, centroids: np.ndarray) -> DataFrame:
    """source, lang, tokens, topic of every sketch."""
    held = seen.sparkSession.sparkContext.broadcast(centroids)
    return seen.select("source", "lang", "tokens", "v").mapInArrow(lean(_topics(held)), "source string, lang string, tokens long, topic string")


def _assign(shared):
    def work(batches):
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs, rows=ROWS):
                n, v = sketches(data, offs[a : b + 1])
                topic = [f"topic{k}" for k in _nearest(v, shared.value)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pa.array(n), pa.array(topic, pa.string())], names=[*batch.schema.names, "__tokens", "__topic"])

    return work


def with_topics(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``docs``, all columns, plus __tokens (words) and __topic."""
    docs = plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(centroids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __tokens long, __topic string"
    return docs.mapInArrow(lean(_assign(shared)), schema)


def _sums_at(first: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, tokens: np.ndarray, x: np.ndarray, n_i: int) -> np.ndarray:
    """Value, slope and matrix of the fitting's potential at the multipliers ``x`` (of i, then of j), one after another, flat.

    Cells stand in groups, which begin at ``first`` and have the target shares ``m``:
    a group's own multiplier is the one that gives it its share, so it is no unknown.
    """
    n, out_v, out_g, out_h = len(x), 0.0, np.zeros(len(x)), np.zeros((len(x), len(x)))
    groups = max(1, (1 << 22) // max(1, n))
    ends = np.append(first, len(i))
    for a in range(0, len(first), groups):
        b = min(len(first), a + groups)
        cut, begin = slice(ends[a], ends[b]), ends[a:b] - ends[a]
        at, size = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), np.maximum(m[a:b], 0)
        p, q = i[cut], j[cut] + n_i
        e = np.log(tokens[cut]) + x[p] + x[q]
        top = np.maximum.reduceat(e, begin)
        w = np.exp(e - top[at])
        z = np.add.reduceat(w, begin)
        share = w / z[at]
        out_v += float(size @ (np.log(z) + top))
        held = size[at] * share
        out_g += np.bincount(p, weights=held, minlength=n) + np.bincount(q, weights=held, minlength=n)
        cross = np.bincount(p * n + q, weights=held, minlength=n * n).reshape(n, n)
        dense = (np.bincount(at * n + p, weights=share, minlength=(b - a) * n) + np.bincount(at * n + q, weights=share, minlength=(b - a) * n)).reshape(b - a, n)
        out_h += cross + cross.T - dense.T @ (size[:, None] * dense)
    out_h[np.diag_indices(n)] += out_g
    return np.concatenate([[out_v], out_g, out_h.ravel()])


def _fit(evaluate, target: np.ndarray, rounds: int) -> np.ndarray:
    """The multipliers at which the slope is ``target``: Newton steps down the potential, which is convex."""
    n = len(target)
    split = lambda s: (s[0], s[1 : n + 1], s[n + 1 :].reshape(n, n))
    x = np.zeros(n)
    value, slope, matrix = split(evaluate(x))
    for _ in range(rounds):
        off = slope - target
        if np.abs(off).max(initial=0) <= TOLERANCE or np.abs(x).max(initial=0) > 600:
            break
        size, turn = np.linalg.eigh(matrix)
        step = -turn @ np.where(size > 1e-15 * max(size[-1], 1e-300), (turn.T @ off) / np.maximum(size, 1e-300), 0.0)
        step *= min(1.0, 30 / max(1e-300, float(np.abs(step).max())))
        now, share = value - target @ x, 1.0
        while share > 1e-9:
            new = split(evaluate(x + share * step))
            # Close to the end the potential no longer tells two places apart; the slope still does.
            if new[0] - target @ (x + share * step) < now or np.abs(new[1] - target).max() < 0.9 * np.abs(off).max():
                break
            share /= 2
        else:
            break
        x = x + share * step
        value, slope, matrix = new
    return x


def _eliminated(counts: list[int]) -> int:
    """The dimension with the most values, whose multipliers follow from the others'."""
    d = max(range(3), key=lambda k: (counts[k], -k))
    if sum(counts) - counts[d] > MOST:
        raise ValueError(f"mixing: two dimensions have more than {MOST} values together")
    return d


def rake_memory(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Factor of each cell, so that factor * tokens has the target shares on each dimension, wherever the cells that there are allow it.

    Factors are a product of one multiplier per value. Values that a target doesn't
    name, or names with 0, get factor 0; cells of a value that no words have get 1,
    as nothing tells theirs. A target value without tokens is left out, the others
    scaled up.
    """
    names = [sorted({k[d] for k, v in cells.items() if v > 0 and targets[d].get(k[d], 0.0) > 0}) for d in range(3)]
    number = [{v: n for n, v in enumerate(vs)} for vs in names]
    used = [k for k, v in cells.items() if v > 0 and all(k[d] in number[d] for d in range(3))]
    worded = [{k[d] for k, v in cells.items() if v > 0} for d in range(3)]
    out = {k: 0.0 if all(k[d] in worded[d] for d in range(3)) else 1.0 for k in cells}
    if not used:
        return out
    d = _eliminated([len(vs) for vs in names])
    p, q = (k for k in range(3) if k != d)
    used.sort(key=lambda k: number[d][k[d]])
    g, i, j = (np.array([number[k][c[k]] for c in used], np.int64) for k in (d, p, q))
    shares = [np.array([targets[k][v] for v in names[k]]) for k in range(3)]
    shares = [v / v.sum() for v in shares]
    tokens = np.array([float(cells[k]) for k in used])
    present, first = np.unique(g, return_index=True)
    x = _fit(lambda x: _sums_at(first, shares[d][present], i, j, tokens, x, len(names[p])), np.concatenate([shares[p], shares[q]]), rounds)
    weight = np.exp(x[i] + x[j + len(names[p])])
    z = np.bincount(g, weights=tokens * weight, minlength=len(names[d]))
    multiplier = sum(v for v in cells.values() if v > 0) * shares[d] / np.where(z > 0, z, 1.0)
    of = [dict(zip(names[p], np.exp(x[: len(names[p])]), strict=True)), dict(zip(names[q], np.exp(x[len(names[p]) :]), strict=True)), dict(zip(names[d], multiplier, strict=True))]
    for k in cells:
        if all(k[c] in number[c] for c in range(3)):
            out[k] = float(of[0][k[p]] * of[1][k[q]] * of[2][k[d]])
    return out


def _spark_sums(shared, n_i: int):
    def work(batches):
        x = shared.value
        total = np.zeros(1 + len(x) + len(x) ** 2)
        for batch in batches:
            lists = [batch.column(k) for k in (1, 2, 3)]
            first = np.append(0, np.cumsum(pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False)))[:-1]
            if batch.num_rows:
                total += _sums_at(first, batch.column(0).to_numpy(), *(v.flatten().to_numpy(zero_copy_only=False) for v in lists), x, n_i)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    return work


def rake_spark(cells: DataFrame, targets: list[DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """As rake_memory, where cells (source, lang, topic, tokens) and targets (value, share) are too many for one machine.

    The cells of a value of the largest dimension are one row: a cell for each pair of
    the others' values at most. Each round is one sum over these rows.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    some = cells.filter("tokens > 0")
    kept = [t.toDF(d, "share").filter("share > 0").join(some.select(d).distinct(), d, "left_semi") for d, t in zip(DIMENSIONS, targets, strict=True)]
    counts = [k.count() for k in kept]
    e = _eliminated(counts)
    p, q = (k for k in range(3) if k != e)
    few = [{r[DIMENSIONS[k]]: r["share"] for r in kept[k].collect()} for k in (p, q)]
    few = [{n: v / sum(f.values()) for n, v in sorted(f.items())} for f in few]
    whole = kept[e].agg(F.sum("share")).first()[0] or 1.0
    outer = kept[e].select(DIMENSIONS[e], (F.col("share") / whole).alias("m"))
    n_i = len(few[0])

    def numbered(values: dict[str, float], column: str, held: dict[str, float] | None = None) -> DataFrame:
        rows = [(n, k, float((held or values)[n])) for k, n in enumerate(values)]
        return F.broadcast(spark.createDataFrame(rows, f"`{column}` string, `__{column}` int, `__x_{column}` double"))

    here = some.join(numbered(few[0], DIMENSIONS[p]), DIMENSIONS[p]).join(numbered(few[1], DIMENSIONS[q]), DIMENSIONS[q]).join(outer, DIMENSIONS[e])
    cell = F.struct(F.col(f"__{DIMENSIONS[p]}").cast("long").alias("i"), F.col(f"__{DIMENSIONS[q]}").cast("long").alias("j"), F.col("tokens").cast("double").alias("t"))
    grouped = here.groupBy(DIMENSIONS[e]).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(cell)).alias("c"))
    rows = materialize(grouped.select("m", *[F.transform("c", lambda c: c[k]).alias(k) for k in "ijt"]), "groups")  # noqa: B023

    def evaluate(x: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(x)
        out = np.zeros(1 + len(x) + len(x) ** 2)
        for r in rows.mapInArrow(lean(_spark_sums(held, n_i)), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        held.destroy()
        return out

    if not few[0] or not few[1]:
        x = np.zeros(n_i + len(few[1]))
    else:
        x = _fit(evaluate, np.array([*few[0].values(), *few[1].values()]), rounds)
    release(rows)
    of = [dict(zip(few[0], np.exp(x[:n_i]).tolist(), strict=True)), dict(zip(few[1], np.exp(x[n_i:]).tolist(), strict=True))]
    weighed = cells
    for column, values in ((DIMENSIONS[p], of[0]), (DIMENSIONS[q], of[1])):
        weighed = weighed.join(numbered(values, column), column, "left")
    product = F.col(f"__x_{DIMENSIONS[p]}") * F.col(f"__x_{DIMENSIONS[q]}")
    z = weighed.filter("tokens > 0").groupBy(DIMENSIONS[e]).agg(F.sum(F.col("tokens") * product).alias("z"))
    multiplier = outer.join(z, DIMENSIONS[e]).select(DIMENSIONS[e], (F.lit(float(total)) * F.col("m") / F.col("z")).alias("__by"))
    out = weighed.join(multiplier, DIMENSIONS[e], "left")
    known = F.lit(True)
    for d in DIMENSIONS:
        out = out.join(some.select(d).distinct().withColumn(f"__has_{d}", F.lit(True)), d, "left")
        known = known & F.coalesce(F.col(f"__has_{d}"), F.lit(False))
    return materialize(out.select(*cells.columns, F.coalesce(product * F.col("__by"), F.when(known, 0.0).otherwise(1.0)).alias("factor")), "cells")


def _check(residual: float) -> None:
    if residual > LEEWAY:
        raise ValueError(f"mixing: no weights have all the targets; a share stays off by {residual:.2e}")


def _want(cells: DataFrame, d: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """value, share: the targets of a dimension that have tokens, scaled up to 1; the tempered cells' where none are given, or none of those have tokens."""
    own = cells.filter("tokens > 0").groupBy(F.col(d).alias("value")).agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))).alias("share"))
    if given:
        named = own.select("value").join(cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, share double"), "value")
        if (named.agg(F.sum("share")).first()[0] or 0) > 0:
            own = named
    return own.select("value", (F.col("share") / (own.agg(F.sum("share")).first()[0] or 1.0)).alias("share"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, bound: int = CELLS, rate: float = RATE) -> DataFrame:
    """source, lang, topic, factor, expected, probability, residual of each cell of ``rows`` (source, lang, topic, tokens).

    Without targets the cells' tokens are raised to ``power``, so that large ones
    shrink, and the marginals of that are aimed at; some weights have them all.
    A value that a target doesn't name gets probability 0; a target value without
    tokens is left out and the rest scaled up; a target of which no value has tokens
    counts as none. expected is the number of copies of a document in a sample of
    ``rate`` times the tokens, probability that of at least one. residual, the same in
    all rows, is the largest difference between a target share and the one reached;
    above LEEWAY, as where no weights of the cells have all the targets, it is an error.
    The outcome does not depend on where the fitting is done (``bound``).
    """
    spark = rows.sparkSession
    cells = materialize(_cells(rows), "cells")
    copies = [F.col("factor"), (F.col("factor") * rate).alias("expected"), F.least(F.lit(1.0), F.col("factor") * rate).alias("probability")]
    want = [_want(cells, d, (targets or {}).get(d), power) for d in DIMENSIONS]
    if cells.count() <= bound:
        held = {tuple(r[d] for d in DIMENSIONS): float(r["tokens"]) for r in cells.collect()}
        shares = [{r["value"]: r["share"] for r in w.collect()} for w in want]
        total = sum(held.values()) or 1.0
        fitted = rake_memory(held, shares)
        residual = 0.0
        for i, share in enumerate(shares):
            got = dict.fromkeys(share, 0.0)
            for k, v in held.items():
                got[k[i]] = got.get(k[i], 0.0) + v * fitted[k] / total
            residual = max([residual, *(abs(v - share.get(k, 0.0)) for k, v in got.items())])
        _check(residual)
        made = spark.createDataFrame([(*k, v) for k, v in sorted(fitted.items())], ", ".join(f"{d} string" for d in DIMENSIONS) + ", factor double")
        return made.select(*DIMENSIONS, *copies, F.lit(residual).alias("residual"))
    fitted = rake_spark(cells, want)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    residual = 0.0
    for d, share in zip(DIMENSIONS, want, strict=True):
        got = fitted.groupBy(F.col(d).alias("value")).agg((F.sum(F.col("tokens") * F.col("factor")) / total).alias("got")).join(share, "value", "full")
        residual = max(residual, got.agg(F.max(F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
    _check(residual)
    return fitted.select(*DIMENSIONS, *copies, F.lit(residual).alias("residual"))


def marginals(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """dimension, value, share: what the copies that ``cells`` (as ``probabilities`` gives them) expect of ``rows`` reach of each marginal, in tokens."""
    weighed = rows.join(cells.select(*DIMENSIONS, "expected"), [*DIMENSIONS]).withColumn("w", F.col("tokens") * F.col("expected"))
    total = weighed.agg(F.sum("w")).first()[0] or 1.0
    sums = weighed.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])).alias("k"), "w").groupBy("k").agg(F.sum("w").alias("w"))
    return sums.select("k.*", (F.col("w") / total).alias("share"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 1, bound: int = CELLS, rate: float = RATE) -> DataFrame:
    """``docs``, all columns, plus topic, tokens, factor, expected, probability, residual, copies and sampled, under names with a leading __.

    Null or missing source and lang are a value of their own, "(none)". A text
    without words has 0 tokens and its cell's probability. copies is ``expected``
    rounded up or down by a hash of the doc_id (of the text where that is null), so
    it is the same in every run and for repeated rows; sampled is copies > 0. A cell
    whose target asks for more than its documents hold has copies above 1, so that
    the marginals are met whatever the factors.
    """
    seen = sketched(docs)
    centroids = fit_topics(seen)
    cells = materialize(probabilities(topic_rows(seen, centroids), targets, bound=bound, rate=rate), "cells")
    release(seen)
    tagged = with_topics(docs, centroids)
    dims = {"source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "topic": F.col("__topic")}
    small = cells.count() <= bound
    named = cells.select(*(F.col(d).alias(f"__{d}_of") for d in DIMENSIONS), *(F.col(c).alias(f"__{c}") for c in ("factor", "expected", "probability", "residual")))
    joined = tagged.join(F.broadcast(named) if small else named, [c == F.col(f"__{d}_of") for d, c in dims.items()], "left").drop(*(f"__{d}_of" for d in DIMENSIONS))
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    draw = F.pmod(drawn, F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("__expected")
    return joined.withColumn("__copies", F.coalesce(whole + (draw < F.col("__expected") - whole).cast("long"), F.lit(0).cast("long"))).withColumn("__sampled", F.col("__copies") > 0)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, residual, copies, sampled of every row of ``docs``."""
    out = mix(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), *(F.col(f"__{c}").alias(c) for c in ("factor", "probability", "residual", "copies", "sampled")))
