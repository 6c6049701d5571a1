"""Steepest feasible directions of design variables, and leading modes of pair operators.

Both keep vectors in distributed rows and bring only sums over them to the driver:
a matrix with a row and a column per constraint, or per mode, whatever the number of
design variables or points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.spatial import normal_draw
from tessera.scratch import materialize, release

#: Constraints, and modes with their extra directions, at most: their squares meet on the driver.
MOST = 500


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _total(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all rows of the ``size`` numbers that ``work`` makes of each batch; each task adds up its own first."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


@dataclass
class Direction:
    """rows: (id, direction); multipliers by constraint, as for gradients of the length they came with; slopes: how each constraint changes along the direction, by scaled gradients."""

    rows: DataFrame
    multipliers: dict[str, float]
    slopes: dict[str, float]
    rounds: int


def _least_squares(h: np.ndarray, b: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The minimum of x h x / 2 - b x with x >= 0 where it is not free; few unknowns."""
    x, held = np.zeros(len(b)), free.copy()
    for n in range(20 * len(b) + 20):
        slope = b - h @ x
        slope[held] = -np.inf
        if not held.all() and slope.max(initial=-np.inf) > 1e-13 * max(1.0, np.abs(b).max(initial=0)):
            held[int(np.argmax(slope))] = True
        elif n or not held.any():
            break
        while True:
            s = np.zeros(len(b))
            s[held] = np.linalg.lstsq(h[np.ix_(held, held)], b[held], rcond=1e-13)[0]
            bad = held & ~free & (s <= 0)
            if not bad.any():
                x = s
                break
            share = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + share * (s - x)
            held &= free | (x > 1e-15)
            x[~held] = 0
    return x


def feasible_direction(gradients: DataFrame, objective: str, constraints: dict[str, str], bounds: DataFrame | None = None, rounds: int = 60, tolerance: float = 1e-9) -> Direction:
    """The direction closest to steepest descent of ``objective`` that no active constraint forbids.

    ``gradients`` are (id, name, value), each once; missing values are 0. ``constraints``
    names the active ones and how they stand: "LE" must not grow along the direction,
    "GE" must not fall, "EQ" must stay. ``bounds`` are (id, sense): design variables
    at their "lower" or "upper" end, however many. Gradients are scaled to unit length.

    That is the projection of the descent onto a cone. Its multipliers, one for each
    constraint, are found by rounds of one sum over the design variables: the slopes
    of the constraints along the present direction, and the products of their
    gradients over the variables that no bound holds. Constraints whose multiplier
    would pull the wrong way are released, and taken up again if need be. A round that
    does not come closer is halved; no end within ``rounds`` is an error.
    """
    names = sorted(constraints)
    m = len(names)
    if m > MOST or any(s not in ("LE", "GE", "EQ") for s in constraints.values()):
        raise ValueError(f"feasible direction: more than {MOST} constraints, or one that is not LE, GE or EQ")
    at = {n: k for k, n in enumerate([objective, *names])}
    wide = gradients.groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value").cast("double"))), F.lit(0.0)) for n in at]).alias("g"))
    if bounds is None:
        held = wide.withColumns({"lower": F.lit(False), "upper": F.lit(False)})
    else:
        ends = bounds.groupBy("id").agg(F.max(F.col("sense") == "lower").alias("lower"), F.max(F.col("sense") == "upper").alias("upper"))
        held = wide.join(ends, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("lower", "upper")})
    rows = materialize(held, "gradients")
    size = np.sqrt(_total(rows.select("g"), lambda b: (_lists(b, "g") ** 2).sum(axis=0), m + 1))
    if size[0] == 0:
        raise ValueError(f"feasible direction: {objective} has no gradient")
    sign = np.array([-1.0 if constraints[n] == "GE" else 1.0 for n in names])
    scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0.0) * np.concatenate([[1.0], sign])
    free = np.array([constraints[n] == "EQ" for n in names], bool)

    def along(multipliers: np.ndarray):
        """(direction, free of bounds, scaled gradients) of a batch."""

        def work(batch):
            g = _lists(batch, "g") * scale
            d = -(g[:, 0] + g[:, 1:] @ multipliers)
            low, high = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(bool) for c in ("lower", "upper"))
            stopped = (low & (d < 0)) | (high & (d > 0)) | (low & high)
            return np.where(stopped, 0.0, d), ~stopped, g

        return work

    def sums(multipliers: np.ndarray):
        direction = along(multipliers)

        def work(batch):
            d, open_, g = direction(batch)
            a = g[:, 1:]
            return np.concatenate([[d @ d / 2], a.T @ d, (a[open_].T @ a[open_]).ravel()])

        out = _total(rows.select("g", "lower", "upper"), work, 1 + m + m * m)
        return out[0], out[1 : m + 1], out[m + 1 :].reshape(m, m)

    x = np.zeros(m)
    value, slope, h = sums(x)
    for n in range(1, rounds + 1):
        off = np.where(free, np.abs(slope), np.abs(np.minimum(x, -slope)))
        if off.max(initial=0) <= tolerance:
            break
        step = _least_squares(h, slope + h @ x, free) - x
        share = 1.0
        while True:
            new = sums(x + share * step)
            if new[0] <= value * (1 + 1e-12) or share < 1e-6:
                break
            share /= 2
        x = x + share * step
        value, slope, h = new
    else:
        raise ArithmeticError(f"feasible direction: {rounds} rounds leave the conditions off by {off.max():.1e}")
    direction = along(x)

    def final(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(direction(batch)[0])], names=["id", "direction"])

    kind = dict(rows.dtypes)["id"]
    out = materialize(rows.select("id", "g", "lower", "upper").mapInArrow(final, f"id {kind}, direction double"), "direction")
    release(rows)
    told = lambda v: {n: float(v[k]) for k, n in enumerate(names)}
    return Direction(out, told(x * sign * np.where(size[1:] > 0, size[0] / np.where(size[1:] > 0, size[1:], 1), 0)), told(slope * sign), n)


@dataclass
class Modes:
    """rows: (id, modes: one value per mode, of unit length over all ids); values: the eigenvalues, largest first; share: what they hold of the trace."""

    rows: DataFrame
    values: list[float]
    share: float


def _products(rows: DataFrame, *names: str) -> np.ndarray:
    """The matrix of products of all columns of the named array columns, side by side."""
    width = sum(map(len, rows.select(*names).first()))

    def work(batch):
        v = np.concatenate([_lists(batch, n) for n in names], axis=1)
        return (v.T @ v).ravel()

    return _total(rows.select(*names), work, width * width).reshape(width, width)


def _turned(rows: DataFrame, names: list[str], by: np.ndarray, out: str) -> DataFrame:
    """(id, out): the named array columns, side by side, times a matrix."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.concatenate([_lists(batch, n) for n in names], axis=1) @ by
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["id", out])

    return rows.select("id", *names).mapInArrow(work, f"id {dict(rows.dtypes)['id']}, {out} array<double>")


def _orthonormal(rows: DataFrame, name: str) -> DataFrame:
    """(id, q): an orthonormal base of the columns of an array column, by the eigenvalues of their products, twice for exactness."""
    for k in range(2):
        value, vector = np.linalg.eigh(_products(rows, name))
        good = value > 1e-13 * value[-1] if k == 0 else value > 0.5 * value[-1]
        new = materialize(_turned(rows, [name], vector[:, good] / np.sqrt(value[good]), "q"), "base")
        if k:
            release(rows)
        rows, name = new, "q"
    return rows


def leading_modes(pairs: DataFrame, ids: DataFrame, count: int, extra: int = 8, rounds: int = 40, tolerance: float = 1e-6, seed: int = 1) -> Modes:
    """The ``count`` leading eigenvalues and modes of a symmetric operator (i, j, v; both of i, j and j, i) over ``ids`` (id, each once).

    Block iteration from hashed random directions: the operator is applied to all of
    them in one join, their base made orthonormal by the matrix of their products, and
    the eigenvalues are those of the operator within the base. ``extra`` directions
    beyond the asked ones speed it up. It ends when the modes are off by less than
    ``tolerance`` of the largest eigenvalue, which is an error if it takes more than
    ``rounds``. An operator of lower rank gives fewer modes. Signs are fixed by a hash
    of the ids.
    """
    r = count + extra
    if r > MOST:
        raise ValueError(f"modes: more than {MOST - extra}")
    trace = pairs.filter("i = j").agg(F.sum("v")).first()[0] or 0.0
    names = ids.select("id")
    start = materialize(names.select("id", F.array(*[normal_draw(F.concat_ws(":", F.col("id").cast("string"), F.lit(k)), seed) for k in range(r)]).alias("x")), "start")
    if start.isEmpty():
        raise ValueError("modes: there are no ids")
    base = _orthonormal(start, "x")
    for _ in range(rounds):
        width = len(base.first()["q"])
        product = pairs.join(base.withColumnRenamed("id", "j"), "j").groupBy("i").agg(F.array(*[F.sum(F.col("v") * F.col("q")[k]) for k in range(width)]).alias("y"))
        zeros = F.array(*[F.lit(0.0)] * width)
        both = materialize(base.join(product.withColumnRenamed("i", "id"), "id", "left").withColumn("y", F.coalesce("y", zeros)), "both")
        g = _products(both, "q", "y")
        t, yy = g[:width, width:], g[width:, width:]
        value, vector = np.linalg.eigh((t + t.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        top = max(abs(value[0]), 1e-300)
        few = min(count, int((value > 1e-12 * top).sum()))
        off = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", vector[:, :few], yy, vector[:, :few]) - value[:few] ** 2, 0))
        release(base)
        if off.max(initial=0) <= tolerance * top:
            weights = both.select("q", normal_draw(F.col("id"), seed + 1).alias("w"))
            leaning = _total(weights, lambda b: b.column(1).to_numpy() @ _lists(b, "q"), width) @ vector[:, :few]
            turn = vector[:, :few] * np.where(leaning < 0, -1, 1)
            out = materialize(_turned(both, ["q"], turn, "modes"), "modes")
            release(both)
            return Modes(out, value[:few].tolist(), float(value[:few].sum() / trace) if trace else 0.0)
        base = _orthonormal(both.select("id", "y"), "y")
        release(both)
    raise ArithmeticError(f"modes: {rounds} rounds leave them off by {off.max() / top:.1e}")


def field_samples(modes: Modes, samples: int, seed: int = 1) -> DataFrame:
    """id, sample (from 1 on), value: normal fields with the covariance that the modes hold, the same for a seed wherever and in whatever order they are made."""
    spark, k = modes.rows.sparkSession, len(modes.values)
    # samples x modes deviates: what is asked for, whatever the number of points.
    drawn = spark.range(samples * k).select("id", normal_draw(F.col("id"), seed).alias("z")).orderBy("id").collect()
    by = np.array([r["z"] for r in drawn]).reshape(samples, k) * np.sqrt(np.maximum(modes.values, 0))
    each = _turned(modes.rows, ["modes"], by.T, "values")
    return each.select("id", F.posexplode("values").alias("sample", "value")).withColumn("sample", F.col("sample") + 1)
