"""Sparse matrices as (i, j, v) rows: assembly, products and matrix-free iterations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked_within
from tessera.scratch import materialize, release


def assemble(entries: DataFrame, symmetric: bool = True) -> DataFrame:
    """Sum of contributions per place; a symmetric matrix keeps its lower triangle (i >= j)."""
    if symmetric:
        entries = entries.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v")
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def scatter(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Element matrices (elem, a, b, v: between places of the element) as rows (i, j, v) between degrees of freedom, by (elem, pos, dof).

    Two joins by element and place; no element's matrix or list is gathered in a row,
    so one of any size is spread like all others.
    """
    left, right = places.select("elem", F.col("pos").alias("a"), F.col("dof").alias("i")), places.select("elem", F.col("pos").alias("b"), F.col("dof").alias("j"))
    return entries.join(left, ["elem", "a"]).join(right, ["elem", "b"]).select("i", "j", "v")


def structure(elements: DataFrame, fixed: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(i, j) places, i >= j, that elements (elem, dofs) fill; fixed dofs (dof) have none, and dependent ones (rules: dep, dof) those of the dofs they depend on."""
    d = elements.select("elem", F.explode(F.array_distinct("dofs")).alias("dof"))
    if rules is not None:
        d = d.join(rules.select(F.col("dep").alias("dof"), F.col("dof").alias("__to")), "dof", "left").select("elem", F.coalesce("__to", "dof").alias("dof")).distinct()
    if fixed is not None:
        d = d.join(fixed.select("dof"), "dof", "left_anti")
    d = d.distinct()
    return d.withColumnRenamed("dof", "i").join(d.withColumnRenamed("dof", "j"), "elem").filter("i >= j").select("i", "j").distinct()


def full(lower: DataFrame, sign: int = 1) -> DataFrame:
    """A lower triangle with its mirror image (sign -1: antisymmetric)."""
    return lower.unionByName(lower.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """y = A x for (i, j, v) and (j, x)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def atb(a: DataFrame, b: DataFrame) -> DataFrame:
    """A' B: entries meet on their common row."""
    left, right = a.select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def atv(a: DataFrame, b: DataFrame) -> DataFrame:
    """A' b for (i, j, v) and (i, x)."""
    return a.join(b, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """(i, r): A x - b for (i, j, v), (i, x) and (i, b)."""
    y = spmv(a, x.select(F.col("i").alias("j"), "x"))
    return b.join(y, "i", "left").select("i", (F.coalesce("y", F.lit(0.0)) - F.col("b")).alias("r"))


def dot(x: DataFrame, y: DataFrame, key: str, a: str, b: str) -> float:
    return x.join(y, key).agg(F.sum(F.col(a) * F.col(b))).first()[0] or 0.0


def split_fixed(a: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a full matrix (i, j, v): its entries between free degrees of freedom, and those in rows of free and columns of fixed ones (fixed: dof)."""
    marked = a.join(fixed.select(F.col("dof").alias("i")).distinct(), "i", "left_anti")
    columns = fixed.select(F.col("dof").alias("j")).distinct()
    return marked.join(columns, "j", "left_anti").select("i", "j", "v"), marked.join(columns, "j", "left_semi").select("i", "j", "v")


def boundary_load(boundary: DataFrame, values: DataFrame) -> DataFrame:
    """(i, y): what prescribed values (j, x) take off the right-hand side of the free rows, from ``split_fixed``'s second part."""
    return boundary.join(values.select("j", "x"), "j").groupBy("i").agg((-F.sum(F.col("v") * F.col("x"))).alias("y"))


def lump(a: DataFrame) -> DataFrame:
    """Row sums, as a diagonal."""
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def conjugate_gradient(a: DataFrame, b: DataFrame, rounds: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, int, float]:
    """x of A x = b for a full symmetric positive matrix (i, j, v) and (i, b), scaled by its diagonal.

    The matrix is written once; the vectors stay distributed. A round is one join with
    the matrix, written, and one aggregation: the new residual's size follows from the
    old one's sums. Only scalars come to the driver. Gives (i, x), the rounds and the
    residual's size against b's; where that is not within the tolerance after
    ``rounds``, or the matrix is not positive, there is an error.
    """
    a = materialize(assemble(a, symmetric=False), "matrix")
    r, y, d = F.col("r"), F.col("y"), F.col("d")
    diagonal = a.filter("i = j").select("i", F.col("v").alias("d"))
    state = b.join(diagonal, "i", "left").select("i", F.lit(0.0).alias("x"), F.col("b").cast("double").alias("r"), F.coalesce("d", F.lit(1.0)).alias("d")).withColumn("p", r / d)
    held, size, now, n = None, None, 0.0, 0
    while True:
        ap = spmv(a, state.select(F.col("i").alias("j"), F.col("p").alias("x")))
        full_ = materialize(state.join(ap, "i", "left").withColumn("y", F.coalesce("y", F.lit(0.0))), "cg")
        release(held)
        held = full_
        sums = held.agg(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in (F.col("p") * y, r * r / d, r * y / d, y * y / d, r * r)]).first()
        py, rr, ry, yy, now = sums
        size = now if size is None else size
        if not size or now <= tolerance**2 * size:
            return held.select("i", "x"), n, (now / size) ** 0.5 if size else 0.0
        if n >= rounds or not py > 0:
            raise ValueError(f"conjugate_gradient: residual {(now / size) ** 0.5:.1e} of b's after {n} rounds" + ("" if py > 0 else ", the matrix is not positive"))
        alpha = rr / py
        beta = max(0.0, rr - 2 * alpha * ry + alpha * alpha * yy) / rr
        moved = held.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (r - alpha * y).alias("r"), "d", "p")
        state, n = moved.withColumn("p", r / d + beta * F.col("p")), n + 1


def dominant_eigenpair(a: DataFrame, rounds: int = 500, tolerance: float = 1e-9) -> tuple[DataFrame, float]:
    """Largest eigenvalue in size, and its vector (i, x) of length 1, of a full symmetric matrix (i, j, v).

    A plain power step contracts by the ratio of the two largest eigenvalues, which
    is close to 1 in large graphs. So each round takes the best vector of the span
    of x, its residual and the step before (locally optimal conjugate gradients);
    it costs one product, as a power step does. The start is a hash of the keys. The
    end is |Ax - vx| <= tolerance |v||x|, from a product made anew; without it within
    ``rounds`` there is an error.
    """
    a = materialize(assemble(a, symmetric=False), "matrix")
    start = materialize(a.select("i").distinct().withColumn("x", F.pmod(F.xxhash64("i"), F.lit(1 << 20)) / float(1 << 19) - 1.0), "eigen")
    image = lambda v: spmv(a, v.toDF("j", "x"))
    none = F.lit(0.0)
    joined = lambda v: v.join(image(v.select("i", "x")), "i").select("i", "x", F.col("y").alias("ax"))
    held = materialize(joined(start), "eigen")
    release(start)
    xx, xa = held.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("ax"))).first()
    if not xx:
        return held.select("i", "x"), 0.0
    value, size = xa / xx, xx**0.5
    state = held.select("i", (F.col("x") / size).alias("x"), (F.col("ax") / size).alias("ax"), none.alias("p"), none.alias("ap"))
    names = ("x", "r", "p")
    for _ in range(rounds + 1):
        v = state.withColumn("r", F.col("ax") - value * F.col("x"))
        new = materialize(v.join(image(v.select("i", "r")), "i").withColumnRenamed("y", "ar"), "eigen")
        release(held)
        held = new
        pairs = [(k, m) for k in range(3) for m in range(k, 3)]
        sums = held.agg(*[F.sum(F.col(names[k]) * F.col(side + names[m])) for side in ("", "a") for k, m in pairs]).first()
        gram, form = np.zeros((3, 3)), np.zeros((3, 3))
        for at, (k, m) in enumerate(pairs):
            gram[k, m] = gram[m, k] = sums[at]
            form[k, m] = form[m, k] = sums[at + len(pairs)]
        if gram[1, 1] <= (tolerance * value) ** 2 * gram[0, 0]:
            # The images are carried along by sums, so the end is decided by a product made anew.
            exact = materialize(joined(held.select("i", "x")), "eigen")
            release(held)
            held = exact
            xx, xa = held.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("ax"))).first()
            value, size = xa / xx, xx**0.5
            rest = held.agg(F.sum((F.col("ax") - value * F.col("x")) ** 2)).first()[0]
            state = held.select("i", (F.col("x") / size).alias("x"), (F.col("ax") / size).alias("ax"), none.alias("p"), none.alias("ap"))
            if rest <= (tolerance * value) ** 2 * xx:
                return state.select("i", "x"), value
            continue
        # An orthonormal basis of what the three span: each scaled to 1, directions below rounding left out.
        scale = np.array([1 / d**0.5 if d > 0 else 0.0 for d in gram.diagonal()])
        e, w = np.linalg.eigh(gram * np.outer(scale, scale))
        basis = scale[:, None] * w[:, e > 1e-12] / np.sqrt(e[e > 1e-12])
        values, vectors = np.linalg.eigh(basis.T @ form @ basis)
        best = np.abs(values).argmax()
        value, c = float(values[best]), [float(k) for k in basis @ vectors[:, best]]
        step = lambda side: c[1] * F.col(side + "r") + c[2] * F.col(side + "p")  # noqa: B023, E731
        state = held.select("i", *[e for side in ("", "a") for e in ((c[0] * F.col(side + "x") + step(side)).alias(side + "x"), step(side).alias(side + "p"))])
    raise ValueError(f"dominant_eigenpair: residual {(gram[1, 1] / gram[0, 0]) ** 0.5 / (abs(value) or 1.0):.1e} after {rounds} rounds")


def by_column(a: DataFrame) -> DataFrame:
    """(j, pos, i, v): entries of each column in the order of their rows, pos from 1 on; partitions hold ranges of (column, row), so a full column is many tasks' work."""
    return ranked_within(a.select("j", "i", "v"), ["j"], ["i"], "pos").select("j", F.col("pos").cast("long").alias("pos"), "i", "v")


def smooth(values: DataFrame, lower: DataFrame, weight: float, tolerance: float = 1e-8) -> DataFrame:
    """Implicit filter: (I + weight L) x = values (i, b) for a graph given by edges (i, j); conjugate gradients."""
    both = lower.select("i", "j").unionByName(lower.select(F.col("j").alias("i"), F.col("i").alias("j")))
    degree = both.groupBy("i").agg(F.count("*").alias("n"))
    off = both.select("i", "j", F.lit(-float(weight)).alias("v"))
    on = values.select("i").join(degree, "i", "left").select("i", F.col("i").alias("j"), (1.0 + weight * F.coalesce("n", F.lit(0))).alias("v"))
    x, _, _ = conjugate_gradient(off.unionByName(on), values, tolerance=tolerance)
    return x
