"""Points in elements, recovery over patches, polygons clipped against each other, and lists merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import levels, lookup
from tessera.scratch import materialize

AXES = ("x", "y", "z")


def _inverse(p: list[list[Column]]) -> list[Column]:
    """Of a tetrahedron of four corners the first one and the rows of the matrix that takes a place, seen from there, to its weights of the others; null where it is flat."""
    e = [[p[k][a] - p[0][a] for a in range(3)] for k in (1, 2, 3)]
    cross = lambda u, w: [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    rows = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    volume = e[0][0] * rows[0][0] + e[0][1] * rows[0][1] + e[0][2] * rows[0][2]
    return [*p[0], *[F.try_divide(c, volume) for row in rows for c in row]]


def locate(points: DataFrame, tets: DataFrame, size: float = 1.0, slack: float = 1e-9, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, y, z) and (elem, corners: four (x, y, z, value)) -> id, elem, value.

    Each tetrahedron stands on the grid level of its own size (see levels), so that
    large and small ones may be mixed at will; of several that hold a point the least
    elem counts. Points outside all have no row. ``size`` is the grid's unit; it does
    not matter to the outcome, and little to the work. With ``by``, columns of both
    tables (a set's name), a point is in elements of its own set alone.
    """
    ends = {f"__{n}{a}": f(F.transform("corners", lambda c: c[a])).cast("double") + by_ for n, f, by_ in (("lo", F.array_min, -slack), ("hi", F.array_max, slack)) for a in AXES}  # noqa: B023
    corner = [[F.col("corners")[k][a].cast("double") for a in AXES] for k in range(4)]
    # What a tetrahedron asks of a place is worked out once for each, before it meets any.
    ready = tets.select("elem", *by, F.array(*_inverse(corner)).alias("__inv"), F.transform("corners", lambda c: c["value"].cast("double")).alias("__values"), *[c.alias(n) for n, c in ends.items()])
    low, high = ([F.col(f"__{n}{a}") for a in AXES] for n in ("lo", "hi"))
    both = levels.by_levels(points.select("id", *AXES, *by), ready, low, high, size, by=by)
    for a in AXES:
        both = both.filter((F.col(a) >= F.col(f"__lo{a}")) & (F.col(a) <= F.col(f"__hi{a}")))
    d = [F.col(a).cast("double") - F.col("__inv")[k] for k, a in enumerate(AXES)]
    weights = [d[0] * F.col("__inv")[3 * k] + d[1] * F.col("__inv")[3 * k + 1] + d[2] * F.col("__inv")[3 * k + 2] for k in (1, 2, 3)]
    b = [F.col(f"__b{k}") for k in range(4)]
    weighed = both.withColumns({f"__b{k}": w for k, w in enumerate(weights, 1)}).withColumn("__b0", 1 - b[1] - b[2] - b[3])
    inside = weighed.filter((b[0] >= -slack) & (b[1] >= -slack) & (b[2] >= -slack) & (b[3] >= -slack))
    v = F.col("__values")
    value = b[0] * v[0] + b[1] * v[1] + b[2] * v[2] + b[3] * v[3]
    return inside.groupBy("id").agg(F.min_by(F.struct("elem", value.alias("value")), "elem").alias("r")).select("id", "r.elem", "r.value")


def _dot(a: list, b: list) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def on_segment(p: list, a: list, b: list) -> Column:
    """Weight of b at the point of the segment from a to b that is closest to p."""
    ab, ap = ([y - x for x, y in zip(a, q, strict=True)] for q in (b, p))
    length = _dot(ab, ab)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(ap, ab) / length))).otherwise(0.0)


def on_triangle(p: list, a: list, b: list, c: list) -> Column:
    """Barycentric weights (array of three) of the point of a triangle that is closest to p."""
    corner = [a, b, c]
    sub = lambda x, y: [i - j for i, j in zip(x, y, strict=True)]
    e1, e2, d = sub(b, a), sub(c, a), sub(p, a)
    d11, d12, d22, dp1, dp2 = _dot(e1, e1), _dot(e1, e2), _dot(e2, e2), _dot(d, e1), _dot(d, e2)
    det = d11 * d22 - d12 * d12
    v, w = (d22 * dp1 - d12 * dp2) / det, (d11 * dp2 - d12 * dp1) / det
    sides = []
    for i, j in ((0, 1), (1, 2), (2, 0)):
        t = on_segment(p, corner[i], corner[j])
        weights = [F.lit(0.0)] * 3
        weights[i], weights[j] = 1 - t, t
        at = [x + t * (y - x) for x, y in zip(corner[i], corner[j], strict=True)]
        off = sub(p, at)
        sides.append(F.struct(_dot(off, off).alias("d2"), F.array(*weights).alias("w")))
    edge = F.array_min(F.array(*sides))["w"]
    return F.when((det > 0) & (v >= 0) & (w >= 0) & (v + w <= 1), F.array(1 - v - w, v, w)).otherwise(edge)


def _corner(k: int) -> list:
    return [F.col("corners")[k][a].cast("double") for a in AXES]


def _on_face(points: DataFrame) -> DataFrame:
    """Adds weights, and distance from (x, y, z) to the closest point of ``corners``."""
    p = [F.col(a).cast("double") for a in AXES]
    out = points.withColumn("weights", on_triangle(p, *[_corner(k) for k in range(3)]))
    off = [sum((F.col("weights")[k] * _corner(k)[i] for k in (1, 2)), F.col("weights")[0] * _corner(0)[i]) - p[i] for i in range(3)]
    return out.withColumn("distance", F.sqrt(_dot(off, off)))


def attach(points: DataFrame, faces: DataFrame, within: float | None = None) -> DataFrame:
    """(id, x, y, z) and triangles (face, corners: three structs with x, y, z) -> id, x, y, z, face, corners, weights, distance: the closest point of the closest triangle, of equal ones the least face.

    The triangles' boxes are packed in a tree, which leaves each point those that may
    be closest, whatever the triangles' sizes and however far off the point is. Points
    with a null, infinite or NaN coordinate are attached to nothing; with ``within``
    points farther off than that from all faces may be left out, and so cost little.
    """
    ends = {f"__{n}{a}": f(F.transform("corners", lambda c: c[a])).cast("double") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for a in AXES}  # noqa: B023
    low, high = [f"__lo{a}" for a in AXES], [f"__hi{a}" for a in AXES]
    tree = levels.box_tree(faces.select("face", "corners").withColumns(ends), low, high)
    if tree is None:
        return _on_face(points.select("id", *AXES).limit(0).join(faces.select("face", "corners"), F.lit(True)))
    near = levels.nearest_boxes(points.select("id", *AXES), tree, 1, low, high, within=within)
    every = _on_face(near.select(F.col("q_id").alias("id"), *[F.col(f"q_{a}").alias(a) for a in AXES], F.col("p_face").alias("face"), F.col("p_corners").alias("corners")))
    best = every.groupBy("id").agg(F.min_by(F.struct(*AXES, "face", "corners", "weights", "distance"), F.struct("distance", "face")).alias("r"))
    return best.select("id", "r.*")


def transfer(points: DataFrame, tets: DataFrame, size: float, slack: float = 1e-9) -> DataFrame:
    """id, elem, value, distance: a field at all points, as for a submodel's boundary.

    Points in a tetrahedron (see ``locate``) get its value, with distance 0; others that
    of the closest point of the closest tetrahedron's surface.
    """
    inside = materialize(locate(points, tets, size, slack), "inside")
    outside = points.join(inside.select("id"), "id", "left_anti")
    faces = tets.select(F.col("elem"), F.explode(F.array(*[F.array(*[F.col("corners")[k] for k in f]) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))])).alias("corners"))
    faces = faces.select(F.struct("elem", "corners").alias("face"), "corners")
    near = attach(outside, faces)
    value = sum((F.col("weights")[k] * F.col("corners")[k]["value"] for k in (1, 2)), F.col("weights")[0] * F.col("corners")[0]["value"])
    return inside.withColumn("distance", F.lit(0.0)).unionByName(near.select("id", F.col("face.elem").alias("elem"), value.alias("value"), "distance"))


def patch_recovery(samples: DataFrame) -> DataFrame:
    """Least-squares plane of each node's samples (node, x, y, value; x, y relative to the node) -> node, its value at the node.

    Only the nine sums of the normal equations are gathered, so that a node with many
    samples costs no more; patches that don't span a plane get the least-norm fit.
    """
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y, v, x * v, y * v]
    sums = samples.groupBy("node").agg(F.array(*[F.sum(t) for t in terms]).alias("s"))

    @F.pandas_udf("double")
    def solve(s: pd.Series) -> pd.Series:
        m = np.stack(s.to_numpy()) if len(s) else np.zeros((0, 9))
        a = np.stack([m[:, [0, 1, 2]], m[:, [1, 3, 4]], m[:, [2, 4, 5]]], axis=1)
        return pd.Series(np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-10, hermitian=True), m[:, 6:])[:, 0])

    return sums.select("node", solve("s").alias("value"))


def patch_fit(samples: DataFrame, axes: tuple[str, ...] = AXES, degree: int = 1) -> DataFrame:
    """node, value, n_samples: at each node the least-squares polynomial of ``degree`` 1 or 2 over its samples (node, axes relative to the node, value), in any number of axes.

    The normal equations are summed up per node, whatever its number of samples.
    Patches that don't fix all terms get the fit with the least terms that remain;
    coordinates are scaled by each patch's reach first.
    """
    reach = samples.groupBy(F.col("node").alias("__node")).agg(F.greatest(*[F.max(F.abs(F.col(a))) for a in axes], F.lit(1e-300)).alias("__reach"))
    rows = samples.join(reach, F.col("node") == F.col("__node"))
    x = [F.col(a) / F.col("__reach") for a in axes]
    terms = [F.lit(1.0), *x] + ([x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))] if degree == 2 else [])
    n = len(terms)
    rows = rows.withColumn("__t", F.array(*terms))
    t = lambda k: F.col("__t")[k]
    products = [F.sum(t(i) * t(j)) for i in range(n) for j in range(i, n)]
    sums = rows.groupBy("node").agg(F.array(*products, *[F.sum(t(i) * F.col("value")) for i in range(n)]).alias("s"), F.count("*").alias("n_samples"))

    @F.pandas_udf("double")
    def solve(s: pd.Series) -> pd.Series:
        m = np.stack(s.to_numpy()) if len(s) else np.zeros((0, n * (n + 1) // 2 + n))
        i, j = np.triu_indices(n)
        a = np.zeros((len(m), n, n))
        a[:, i, j] = a[:, j, i] = m[:, : len(i)]
        return pd.Series(np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-10, hermitian=True), m[:, len(i) :])[:, 0])

    return sums.select("node", solve("s").alias("value"), "n_samples")


def patch_samples(elements: DataFrame, points: DataFrame, nodes: DataFrame, corners: int) -> DataFrame:
    """Samples for ``patch_fit``: for the corner nodes (the first ``corners``) of elements (elem, nodes) all integration points (elem, x, y, z, value) of the elements around, relative to the node (node, x, y, z)."""
    around = elements.select("elem", F.explode(F.slice("nodes", 1, corners)).alias("node")).distinct()
    at = nodes.select("node", *[F.col(a).alias(f"__{a}") for a in AXES])
    return around.join(points, "elem").join(at, "node").select("node", *[(F.col(a) - F.col(f"__{a}")).alias(a) for a in AXES], "value")


def clip_polygon(subject: Column, clip: Column) -> Column:
    """The part of a polygon (array of points) within a convex, counter-clockwise one: cut by the half-plane of each side in turn."""
    sides = F.transform(clip, lambda b, i: F.struct(F.element_at(clip, F.when(i == 0, F.size(clip)).otherwise(i)).alias("a"), b.alias("b")))

    def cut(left: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        inside = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

        def around(p: Column, i: Column) -> Column:
            q = F.element_at(left, F.when(i == 0, F.size(left)).otherwise(i))
            at, before = inside(p), inside(q)
            t = F.try_divide(before, before - at)
            crossed = F.when((at < 0) != (before < 0), F.array(q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            return F.filter(F.array(crossed, F.when(at >= 0, p)), lambda x: x.isNotNull())

        return F.flatten(F.transform(left, around))

    return F.aggregate(sides, subject, cut)


def polygon_area(p: Column) -> Column:
    """Shoelace area; 0 below three corners."""
    following = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, following, lambda a, b: a[0] * b[1] - a[1] * b[0])
    return F.when(F.size(p) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2)


def merge_sorted(lists: DataFrame, by: list[str], values: str) -> DataFrame:
    """The lists of each group as one, sorted and without repeats."""
    return lists.select(*by, F.explode(values).alias("__v")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("__v")).alias(values))


def two_way(points: DataFrame, table: DataFrame, by: list[str], t: str, x: str, y: str) -> DataFrame:
    """``points`` (by, t, x, ...) plus y from a table (by, t, x, y): linear in x at the temperatures on both sides, then linear between them; constant beyond."""
    temps = table.select(*by, t).distinct()
    order = W.partitionBy(*by).orderBy(t)
    entries = temps.select(*by, t, F.struct(F.col(t).alias("lo"), F.lead(t).over(order).alias("hi")).alias("__pair"))
    first = entries.groupBy(*by).agg(F.min_by("__pair", t).alias("__begin"))
    found = lookup.as_of(points, entries, by, t, ["__pair"])
    found = found.join(first.withColumnsRenamed({b: f"__by_{b}" for b in by}), lookup._same(by))
    pair = F.coalesce("__pair_at", "__begin")
    sided = found.select(*points.columns, pair["lo"].alias("__lo"), F.coalesce(pair["hi"], pair["lo"]).alias("__hi"))
    curve, at = table.withColumnRenamed(t, "__curve"), F.col(t)
    for side in ("lo", "hi"):
        sided = lookup.interpolate(sided.withColumn("__curve", F.col(f"__{side}")), curve, [*by, "__curve"], x, [y]).withColumnRenamed(y, f"__{side}_y").drop("__curve")
    share = F.when(F.col("__hi") > F.col("__lo"), F.least(F.greatest((at - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return sided.select(*points.columns, (F.col("__lo_y") + (F.col("__hi_y") - F.col("__lo_y")) * share).alias(y))
