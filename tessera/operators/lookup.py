"""Lookup in sorted tables: the last entry not beyond a value, and linear interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Tables of up to this many rows, and sorted keys of up to this many bytes, go to the tasks; for longer ones points and entries are sorted together.
SMALL_TABLE, SMALL_BYTES = 10_000, 16 << 20
#: A table is joined by range only if no group has more entries than this, since each point meets all of its group's.
FEW = 64


def intervals(table: DataFrame, by: list[str], x: str, ys: list[str]) -> DataFrame:
    """Each entry with the next one's x (__x1) and values (__y1), per ``by``, and whether it is the first."""
    order = W.partitionBy(*by).orderBy(x)
    out = table.select(*by, F.col(x).alias("__x0"), F.lead(x).over(order).alias("__x1"), (F.row_number().over(order) == 1).alias("__first"), F.row_number().over(order).alias("__pos"), *[F.col(y).alias(f"__{y}0") for y in ys], *[F.lead(y).over(order).alias(f"__{y}1") for y in ys])
    return out


def floor_position(points: DataFrame, x: str, table: DataFrame, key: str) -> DataFrame:
    """``points`` plus position: how many table keys (numbers or names) are not beyond x (0: none or no x), keys taken in order.

    A small table's sorted keys go to the tasks for a binary search. Else one sort of
    both together; the window's carry is per range of x, so that no task sees more
    than its share. Names are in the order of their code points.
    """
    named = dict(table.dtypes)[key] == "string"
    keys = table.select(F.col(key).alias("__k")).filter(F.col("__k").isNotNull()).groupBy("__k").count()
    size = keys.agg(F.sum(F.octet_length("__k") + 64) if named else F.count("*") * 16).first()[0] or 0
    if size <= SMALL_BYTES:
        found = sorted(tuple(r) for r in keys.collect())
        held = np.array([k for k, _ in found], object if named else None)
        upto = np.concatenate([[0], np.cumsum([n for _, n in found], dtype=np.int64)]).astype(np.int64)

        @F.pandas_udf("long")
        def position(v: pd.Series) -> pd.Series:
            if not len(held):
                return pd.Series(np.zeros(len(v), np.int64))
            known = v.fillna("") if named else v
            return pd.Series(np.where(v.isna(), 0, upto[np.searchsorted(held, known.to_numpy(), "right")]))

        return points.withColumn("position", position(x))
    both = points.select(F.col(x).alias("__k")).distinct().withColumn("count", F.lit(0).cast("long")).unionByName(keys)
    merged = materialize(both.groupBy("__k").agg(F.sum("count").alias("count")).repartitionByRange("__k").withColumn("__p", F.spark_partition_id()), "ranges")
    before = merged.groupBy("__p").agg(F.sum("count").alias("n")).select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = merged.withColumn("__run", F.sum("count").over(W.partitionBy("__p").orderBy("__k")))
    upto = within.join(F.broadcast(before), "__p").select(F.col("__k").alias(x), (F.col("__run") + F.col("__base")).alias("position"))
    return points.join(upto, x, "left").withColumn("position", F.coalesce("position", F.lit(0)))


def _lerp(x: Column, y: str) -> Column:
    x0, x1, y0, y1 = (F.col(c) for c in ("__x0", "__x1", f"__{y}0", f"__{y}1"))
    return F.when(x1.isNull() | (x <= x0), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def interpolate(points: DataFrame, table: DataFrame, by: list[str], x: str, ys: list[str], slope: bool = False) -> DataFrame:
    """``points`` (by, x, ...) plus each y, linear between entries of ``table`` (by, x, ys) and constant beyond them.

    With ``slope`` also d_<y>, 0 beyond the ends. A table of one entry is constant.
    A table of up to SMALL_TABLE entries, FEW of them in a group, is broadcast; for
    any other, points and entries are sorted together per group.
    """
    t = intervals(table, by, x, ys)
    at = F.col(x)
    rows, most = t.groupBy(*by).count().agg(F.sum("count"), F.max("count")).first()
    if (rows or 0) > SMALL_TABLE or (most or 0) > FEW:
        fields = ["__x0", "__x1", *[f"__{y}{i}" for y in ys for i in (0, 1)]]
        entries = t.withColumn(x, F.col("__x0")).withColumn("__e", F.struct(*fields))
        first = t.filter("__first").select(*by, F.struct(*fields).alias("__begin"))
        near = as_of(points, entries.select(*by, x, "__e"), by, x, ["__e"])
        near = near.join(first, by, "left") if by else near.crossJoin(F.broadcast(first))
        t = near.withColumn("__r", F.coalesce("__e_at", "__begin")).select(*points.columns, "__r.*")
        beyond = F.col("__x1").isNull() | (at < F.col("__x0"))
        slopes = [F.when(beyond, 0.0).otherwise((F.col(f"__{y}1") - F.col(f"__{y}0")) / (F.col("__x1") - F.col("__x0"))).alias(f"d_{y}") for y in ys if slope]
        return t.select(*points.columns, *[_lerp(at, y).alias(y) for y in ys], *slopes)
    t = F.broadcast(t.withColumnsRenamed({b: f"__by_{b}" for b in by}))
    hit = ((F.col("__first") & (at < F.col("__x0"))) | (at >= F.col("__x0"))) & (F.col("__x1").isNull() | (at < F.col("__x1")))
    for b in by:
        hit = (F.col(b) == F.col(f"__by_{b}")) & hit
    beyond = F.col("__x1").isNull() | (at < F.col("__x0"))
    slopes = [F.when(beyond, 0.0).otherwise((F.col(f"__{y}1") - F.col(f"__{y}0")) / (F.col("__x1") - F.col("__x0"))).alias(f"d_{y}") for y in ys if slope]
    out = points.join(t, hit, "left").select(*points.columns, *[_lerp(at, y).alias(y) for y in ys], *slopes)
    return out


def as_of(points: DataFrame, table: DataFrame, by: list[str], x: str, ys: list[str], tie: list[str] = ()) -> DataFrame:
    """``points`` plus, as <y>_at, the values of the last entry of ``table`` at or before x, per ``by``; null before the first.

    Of entries at one x (a jump) the last in the order of the columns ``tie`` counts,
    else the one with the greatest values, so that the answer is the same in every run.

    Points and entries are sorted together into ranges of (by, x) and values carried
    forward within a range; where a group goes on in the next range, the last entry
    of those before is handed on, one row per range and group. So a hot group, or
    no ``by`` at all, is many tasks' work.
    """
    # What orders entries at one x comes first in the struct, under names of its own.
    parts = [(f"__t{k}", t) for k, t in enumerate(tie)] + [(y, y) for y in ys]
    held = F.struct(*[F.col(c).alias(n) for n, c in parts])
    kind = "struct<" + ",".join(f"`{n}`:{dict(table.dtypes)[c]}" for n, c in parts) + ">"
    tagged = points.withColumn("__e", F.lit(None).cast(kind)).withColumn("__side", F.lit(1))
    source = table.select(*by, x, held.alias("__e")).withColumn("__side", F.lit(0))
    both = tagged.unionByName(source, allowMissingColumns=True)
    dealt = materialize(both.repartitionByRange(*by, x, "__side", "__e").withColumn("__p", F.spark_partition_id()), "ranges")
    last = dealt.filter("__side = 0").groupBy(*by, "__p").agg(F.max_by("__e", F.struct(x, "__e")).alias("__last"))
    groups = dealt.select(*by, "__p").distinct().join(last.withColumnsRenamed({b: f"__by_{b}" for b in by} | {"__p": "__q"}), _same(by) & (F.col("__p") == F.col("__q")), "left")
    handed = groups.withColumn("__handed", F.last("__last", ignorenulls=True).over(W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)))
    handed = handed.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__p").alias("__q"), "__handed")
    carried = dealt.withColumn("__own", F.last("__e", ignorenulls=True).over(W.partitionBy("__p", *by).orderBy(x, "__side", "__e").rowsBetween(W.unboundedPreceding, 0)))
    out = carried.filter("__side = 1").join(handed, _same(by) & (F.col("__p") == F.col("__q")), "left").withColumn("__at", F.coalesce("__own", "__handed"))
    return out.select(*points.columns, *[F.col(f"__at.{y}").alias(f"{y}_at") for y in ys])


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return out


CONSTANT, LINEAR, QUADRATIC = 0, 1, 2


def tabulated(points: DataFrame, table: DataFrame, by: list[str], x: str, y: str, order: int = LINEAR, low: int = CONSTANT, high: int = CONSTANT) -> DataFrame:
    """``points`` (by, x, ...) plus y from ``table`` (by, x, y): constant from the entry before, linear, or quadratic; beyond the first and last entry by ``low`` and ``high``.

    Quadratic means a parabola through three entries in the first and last interval,
    and between them the mean of the parabolas on both sides, weighted by nearness. A
    linear continuation has the slope at the end entry. An order that a group's
    entries are too few for, or a continuation of a higher order than the
    interpolation, is lowered.
    """
    within = W.partitionBy(*by).orderBy(x)
    near = {f"{n}{k}": (F.lag(n, -k) if k < 0 else F.lead(n, k)).over(within) for k in (-2, -1, 1, 2) for n in (x, y)}
    # lag(n, -k) with k below 0 looks back.
    count = F.count("*").over(W.partitionBy(*by))
    entry = F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), *[near[f"{n}{k}"].alias(f"{'x' if n == x else 'y'}{'m' if k < 0 else 'p'}{abs(k)}") for k in (-2, -1, 1, 2) for n in (x, y)], count.alias("n"))
    entries = table.select(*by, F.col(x), entry.alias("__entry"))
    first = entries.groupBy(*by).agg(F.min_by("__entry", x).alias("__begin"))
    found = as_of(points, entries, by, x, ["__entry"])
    found = found.join(first.withColumnsRenamed({b: f"__by_{b}" for b in by}), _same(by), "left")
    at, below = F.col(x), F.col("__entry_at").isNull()
    e = F.coalesce("__entry_at", "__begin")
    used = F.least(F.lit(order), e["n"] - 1)

    def line(xa, ya, xb, yb):
        return ya + (at - xa) * (yb - ya) / (xb - xa)

    def bend(xa, ya, xb, yb, xc, yc):
        return ((yc - ya) / (xc - xa) - (yb - ya) / (xb - xa)) / (xc - xb)

    def parabola(xa, ya, xb, yb, xc, yc):
        return line(xa, ya, xb, yb) + bend(xa, ya, xb, yb, xc, yc) * (at - xa) * (at - xb)

    def tangent(xa, ya, xb, yb, xc, yc):
        """At the first of the three."""
        return ya + (at - xa) * ((yb - ya) / (xb - xa) + bend(xa, ya, xb, yb, xc, yc) * (xa - xb))

    ends = {
        "low": [e["x0"], e["y0"], e["xp1"], e["yp1"], e["xp2"], e["yp2"]],
        "high": [e["x0"], e["y0"], e["xm1"], e["ym1"], e["xm2"], e["ym2"]],
    }

    def beyond(kind, three):
        k = F.least(F.lit(kind), used)
        return F.when(k == 0, three[1]).when((k == 1) & (used == 1), line(*three[:4])).when(k == 1, tangent(*three)).otherwise(parabola(*three))

    before, after = [e["xm1"], e["ym1"], e["x0"], e["y0"], e["xp1"], e["yp1"]], [e["x0"], e["y0"], e["xp1"], e["yp1"], e["xp2"], e["yp2"]]
    share = (at - e["x0"]) / (e["xp1"] - e["x0"])
    blend = parabola(*before) + (parabola(*after) - parabola(*before)) * share
    inside = F.when(used == 0, e["y0"]).when(used == 1, line(e["x0"], e["y0"], e["xp1"], e["yp1"])).when(e["xm1"].isNull(), parabola(*after)).when(e["xp2"].isNull(), parabola(*before)).otherwise(blend)
    value = F.when(below, beyond(low, ends["low"])).when(e["xp1"].isNull(), beyond(high, ends["high"])).otherwise(inside)
    return found.select(*points.columns, value.alias(y))


def tabulated_two(points: DataFrame, table: DataFrame, by: list[str], x: str, y: str, z: str, order: tuple[int, int] = (LINEAR, LINEAR), low: tuple[int, int] = (CONSTANT, CONSTANT), high: tuple[int, int] = (CONSTANT, CONSTANT)) -> DataFrame:
    """``points`` (by, x, y, ...) plus z from a grid (by, x, y, z): along x as ``tabulated`` in the grid's lines on both sides of y, then between the two.

    order, low and high are for x (any) and y (constant or linear). Beyond the first
    and last line the two nearest are continued, or the nearest is taken.
    """
    within = W.partitionBy(*by).orderBy(y)
    line = F.struct(F.lag(y).over(within).alias("before"), F.col(y).alias("here"), F.lead(y).over(within).alias("after"))
    entries = table.select(*by, y).distinct().select(*by, y, line.alias("__line"))
    first = entries.groupBy(*by).agg(F.min_by("__line", y).alias("__begin"))
    found = as_of(points, entries, by, y, ["__line"]).join(first.withColumnsRenamed({b: f"__by_{b}" for b in by}), _same(by))
    under, e = F.col("__line_at").isNull(), F.coalesce("__line_at", "__begin")
    over = ~under & e["after"].isNull()
    a, b = F.when(over, F.coalesce(e["before"], e["here"])).otherwise(e["here"]), F.when(over, e["here"]).otherwise(F.coalesce(e["after"], e["here"]))
    free = F.when(b > a, (F.col(y) - a) / (b - a)).otherwise(0.0)
    share = F.when(under, free if min(low[1], order[1]) else F.lit(0.0)).when(over, free if min(high[1], order[1]) else F.lit(1.0)).otherwise(free if order[1] else F.lit(0.0))
    out = found.select(*points.columns, a.alias("__a"), b.alias("__b"), share.alias("__share"))
    curve = table.withColumnRenamed(y, "__curve")
    for side in ("a", "b"):
        out = tabulated(out.withColumn("__curve", F.col(f"__{side}")), curve, [*by, "__curve"], x, z, order[0], low[0], high[0]).withColumnRenamed(z, f"__z{side}").drop("__curve")
    return out.select(*points.columns, (F.col("__za") + (F.col("__zb") - F.col("__za")) * F.col("__share")).alias(z))


def amplitude(points: DataFrame, table: DataFrame, name: str, step_time: str, total_time: str, t: str, y: str, shifts: DataFrame | None = None) -> DataFrame:
    """``points`` (name, step_time, total_time, ...) plus y, linear in the table (name, t, y) and constant beyond it.

    ``shifts`` (name, shift_x, shift_y, total): what is added to a table's times and
    values, and whether it goes by the total time instead of the step's.
    """
    if shifts is not None:
        moved = table.join(shifts.select(name, "shift_x", "shift_y"), name, "left")
        table = moved.withColumns({t: F.col(t) + F.coalesce("shift_x", F.lit(0.0)), y: F.col(y) + F.coalesce("shift_y", F.lit(0.0))}).select(*table.columns)
        points = points.join(shifts.select(name, F.col("total").alias("__total")), name, "left")
        clock = F.when(F.coalesce("__total", F.lit(False)), F.col(total_time)).otherwise(F.col(step_time))
    else:
        clock = F.col(step_time)
    out = interpolate(points.withColumn(t, clock.cast("double")), table, [name], t, [y])
    return out.drop(t, "__total")
