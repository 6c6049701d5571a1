"""Complex numbers as struct<re, im> columns: algebra, Hermitian products, phases, and what is largest over a cycle."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(re: Column | float, im: Column | float = 0.0) -> Column:
    lit = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(re).alias("re"), lit(im).alias("im"))


def polar(size: Column, angle: Column) -> Column:
    return number(size * F.cos(angle), size * F.sin(angle))


def add(a: Column, b: Column) -> Column:
    return number(a["re"] + b["re"], a["im"] + b["im"])


def mul(a: Column, b: Column) -> Column:
    return number(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return number(a["re"], -a["im"])


def size(a: Column) -> Column:
    return F.sqrt(a["re"] * a["re"] + a["im"] * a["im"])


def turned(a: Column, angle: Column | float) -> Column:
    """``a`` times exp(i angle)."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    return mul(a, number(F.cos(angle), F.sin(angle)))


def total(a: Column) -> Column:
    """The sum of an aggregation."""
    return number(F.sum(a["re"]), F.sum(a["im"]))


def largest_over_cycle(parts: list[Column]) -> Column:
    """The largest length that the real vector Re(parts * exp(i p)) has over all phases p.

    Its square is (sum |u|^2 + |sum u^2| cos(2 p + ..)) / 2, so no phase needs to be tried.
    """
    plain = functools.reduce(lambda a, b: a + b, [p["re"] * p["re"] + p["im"] * p["im"] for p in parts])
    square = functools.reduce(add, [mul(p, p) for p in parts])
    return F.sqrt((plain + size(square)) / 2)


def mac(vectors: DataFrame, others: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """id_a, id_b, the columns ``same``, product (the Hermitian one, conjugate in the first) and mac = |product| / (|a| |b|), of vectors in rows (id, dof, value: struct<re, im>, same).

    Only vectors that agree in ``same`` (a nodal diameter) meet. Entries that a vector
    has not got are 0; one without any but zeros has mac null. Vectors may be of any
    length: their entries meet by dof, and are summed up before they are sent on.
    """
    norm = lambda d: d.groupBy("id", *same).agg(F.sqrt(F.sum(F.col("value.re") ** 2 + F.col("value.im") ** 2)).alias("n"))
    a, b = (d.select(F.col("id").alias(f"id_{s}"), *same, "dof", F.col("value").alias(f"v_{s}")) for d, s in ((vectors, "a"), (others, "b")))
    product = a.join(b, ["dof", *same]).groupBy("id_a", "id_b", *same).agg(total(mul(conj(F.col("v_a")), F.col("v_b"))).alias("product"))
    na, nb = (norm(d).withColumnsRenamed({"id": f"id_{s}", "n": f"n_{s}"}) for d, s in ((vectors, "a"), (others, "b")))
    # Every pair of vectors that may meet has a row, also where they share no dof.
    if same:
        pairs = na.join(nb, list(same))
    else:
        pairs = na.withColumn("__one", F.lit(0)).join(nb.withColumn("__one", F.lit(0)), "__one").drop("__one")
    found = pairs.join(product, ["id_a", "id_b", *same], "left").withColumn("product", F.coalesce("product", number(0.0)))
    return found.select("id_a", "id_b", *same, "product", F.try_divide(size(F.col("product")), F.col("n_a") * F.col("n_b")).alias("mac"))


def replicate(nodes: DataFrame, sectors: int, diameter: Column | int, scalars: list[str] = (), vectors: list[tuple[str, str]] = ()) -> DataFrame:
    """(node, x, y, z, complex columns) of one sector copied to all ``sectors`` about z: node, sector, turned x, y, z, and the real values there.

    A value changes by the phase of ``diameter`` waves around the circle; the two parts
    of a vector in x and y also turn with their sector.
    """
    step = F.col("sector") * (2 * math.pi / sectors)
    d = diameter if isinstance(diameter, Column) else F.lit(diameter)
    rows = nodes.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    c, s = F.cos(step), F.sin(step)
    real = lambda name: turned(F.col(name), step * d)["re"]
    out = [real(n).alias(n) for n in scalars]
    for a, b in vectors:
        out += [(real(a) * c - real(b) * s).alias(a), (real(a) * s + real(b) * c).alias(b)]
    return rows.select("node", "sector", (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"), "z", *out)
