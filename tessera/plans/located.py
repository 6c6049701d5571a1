"""Queries of point location, patch recovery, clipping, two-way tables and the remaining totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import locate, results, sparse
from tessera.plans.catalog import query
from tessera.plans.relational import table


@query("""
WITH p AS (SELECT DISTINCT (l_partkey % 80) / 8.0 AS x, (l_suppkey % 80) / 8.0 AS y, (l_linenumber % 8) / 8.0 AS z FROM lineitem)
SELECT x, y, z, s_suppkey AS elem, round(x + 2 * y + 3 * z, 6) AS value FROM p JOIN supplier ON s_suppkey = floor(y) * 10 + floor(x) + 1
WHERE x - floor(x) + y - floor(y) + z <= 1 AND (x - floor(x) > 0 AND y - floor(y) > 0)
""")
def locate_points(spark, sf_dir):
    """Points in tetrahedra (one per supplier, on a grid), and a nodal field at them."""
    at = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") % 80) / 8.0).alias("x"), ((F.col("l_suppkey") % 80) / 8.0).alias("y"), ((F.col("l_linenumber") % 8) / 8.0).alias("z")).distinct().filter("x > floor(x) and y > floor(y)")
    points = at.withColumn("id", F.struct("x", "y", "z"))
    k = F.col("s_suppkey") - 1
    ox, oy = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    corner = lambda dx, dy, dz: F.struct((ox + dx).alias("x"), (oy + dy).alias("y"), F.lit(float(dz)).alias("z"), (ox + dx + (oy + dy) * 2 + 3.0 * dz).alias("value"))
    tets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("elem"), F.array(corner(0, 0, 0), corner(1, 0, 0), corner(0, 1, 0), corner(0, 0, 1)).alias("corners"))
    # A point on a common face belongs to the tetrahedron of its own grid cell, which the SQL takes too.
    own = locate.locate(points, tets, 1.0, slack=0.0)
    return own.select("id.*", "elem", F.round("value", 6).alias("value"))


@query("""
WITH s AS (SELECT l_partkey AS node, count(*)::DOUBLE AS n, sum(10 * l_discount) AS x, sum(10 * l_tax) AS y, sum(100 * l_discount * l_discount) AS xx, sum(100 * l_discount * l_tax) AS xy, sum(100 * l_tax * l_tax) AS yy, sum(l_quantity) AS v, sum(10 * l_discount * l_quantity) AS xv, sum(10 * l_tax * l_quantity) AS yv FROM lineitem GROUP BY l_partkey)
SELECT node, round((v * (xx * yy - xy * xy) - x * (xv * yy - xy * yv) + y * (xv * xy - xx * yv)) / (n * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y)), 4) AS value FROM s
""")
def patch_recovery(spark, sf_dir):
    """Values at nodes from planes fitted over their elements' samples."""
    li = table(spark, sf_dir, "lineitem")
    return locate.patch_recovery(li.select(F.col("l_partkey").alias("node"), (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), F.col("l_quantity").alias("value"))).select("node", F.round("value", 4).alias("value"))


@query("""
SELECT p_partkey, round(greatest(0.0, least(1.0, (p_partkey % 7) / 4.0 + 1) - greatest(0.0, (p_partkey % 7) / 4.0)) * greatest(0.0, least(1.0, (p_size % 5) / 4.0 + 1) - greatest(0.0, (p_size % 5) / 4.0)), 6) AS area FROM part
""")
def polygon_clip(spark, sf_dir):
    """Areas that shifted squares share with one square."""
    x, y = (F.col("p_partkey") % 7) / 4.0, (F.col("p_size") % 5) / 4.0
    square = lambda a, b: F.array(*[F.array(a + i, b + j) for i, j in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    both = locate.clip_polygon(square(x, y), square(F.lit(0.0), F.lit(0.0)))
    return table(spark, sf_dir, "part").withColumn("p", both).select("p_partkey", F.round(locate.polygon_area(F.col("p")), 6).alias("area"))


@query("""
WITH q AS (SELECT p_brand, l_linenumber * 1.5 AS t, CAST(l_quantity AS DOUBLE) AS x, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, t, x, n, round(10 * (greatest(1.0, least(7.0, t))) + greatest(0.0, least(40.0, x)), 6) AS y FROM q
""")
def two_way_table(spark, sf_dir):
    """A table over temperature and strain, linear in both, constant beyond its ends."""
    part = table(spark, sf_dir, "part")
    grid = part.select("p_brand").distinct().withColumn("t", F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(7.0)))).withColumn("x", F.explode(F.array(F.lit(0.0), F.lit(8.0), F.lit(40.0))))
    curve = grid.withColumn("y", F.col("t") * 10 + F.col("x"))
    points = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", (F.col("l_linenumber") * 1.5).alias("t"), F.col("l_quantity").cast("double").alias("x")).agg(F.count("*").alias("n"))
    return locate.two_way(points, curve, ["p_brand"], "t", "x", "y").select("p_brand", "t", "x", "n", F.round("y", 6).alias("y"))


@query("SELECT o_custkey, list_sort(list_distinct(flatten(list([CAST(o_orderkey % 50 AS BIGINT), o_custkey])))) AS ids FROM orders GROUP BY o_custkey")
def merge_lists(spark, sf_dir):
    """Per-thread lists merged, sorted and without repeats."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.array(F.col("o_orderkey") % 50, F.col("o_custkey")).alias("ids"))
    return locate.merge_sorted(o, ["o_custkey"], "ids")


@query("""
SELECT l_returnflag, count(*) AS n_contacts, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS f_normal, count(*) FILTER (l_discount > 0.05) AS n_closed FROM lineitem GROUP BY l_returnflag
""")
def contact_totals(spark, sf_dir):
    """Contacts, those that are closed, and their normal force."""
    return results.contact_totals(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05, "l_quantity").withColumn("f_normal", F.round("f_normal", 2))


@query("""
SELECT l_linestatus, round(sum(0.5 * l_quantity * l_discount * l_discount), 5) AS kinetic, round(sum(l_quantity * l_tax), 4) AS internal, round(sum(0.5 * l_quantity * l_discount * l_discount) + sum(l_quantity * l_tax), 5) AS total FROM lineitem GROUP BY ROLLUP (l_linestatus)
""")
def energy_balance(spark, sf_dir):
    """Kinetic and internal energy by part of the model, and over all."""
    kinetic, internal = F.sum(F.col("l_quantity") * F.col("l_discount") * F.col("l_discount") * 0.5), F.sum(F.col("l_quantity") * F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").rollup("l_linestatus").agg(F.round(kinetic, 5).alias("kinetic"), F.round(internal, 4).alias("internal"), F.round(kinetic + internal, 5).alias("total"))


@query("""
WITH e AS (SELECT l_suppkey AS a, l_suppkey + l_linenumber AS b, l_quantity AS k FROM lineitem),
m AS (SELECT a AS i, a AS j, k AS v FROM e UNION ALL SELECT b, b, k FROM e UNION ALL SELECT b, a, -k FROM e UNION ALL SELECT b, a, -k FROM e)
SELECT i, j, round(sum(v), 2) AS v FROM m GROUP BY ALL
""")
def user_elements(spark, sf_dir):
    """Springs as user elements; as in a lower triangle, both off-diagonal contributions count."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("b"), F.col("l_quantity").alias("k"))
    return sparse.assemble(hooks.elements("spring", e)).withColumn("v", F.round("v", 2))


@query("""
SELECT j, row_number() OVER (PARTITION BY j ORDER BY i) AS pos, i, v FROM (SELECT l_linenumber::BIGINT AS j, l_suppkey AS i, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL)
""")
def column_sort(spark, sf_dir):
    """Entries column by column."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    return sparse.by_column(a)


@query("""
WITH RECURSIVE s AS (SELECT s_suppkey AS i, s_acctbal AS b, 1 + 0.5 * (SELECT count(*) FROM supplier o WHERE abs(o.s_suppkey - n.s_suppkey) = 1) AS d FROM supplier n),
f(i, c, y) AS (SELECT i, -0.5::DOUBLE / d, (b / d)::DOUBLE FROM s WHERE i = (SELECT min(i) FROM s) UNION ALL SELECT s.i, -0.5 / (s.d + 0.5 * f.c), (s.b + 0.5 * f.y) / (s.d + 0.5 * f.c) FROM f JOIN s ON s.i = f.i + 1),
g(i, x) AS (SELECT i, y FROM f WHERE i = (SELECT max(i) FROM f) UNION ALL SELECT f.i, f.y - f.c * g.x FROM g JOIN f ON f.i = g.i - 1)
SELECT i, round(x, 3) AS x FROM g
""")
def implicit_filter(spark, sf_dir):
    """Balances smoothed over the graph of suppliers with neighbouring keys; the SQL eliminates along the keys."""
    s = table(spark, sf_dir, "supplier")
    edges = s.select((F.col("s_suppkey") + 1).alias("i"), F.col("s_suppkey").alias("j")).join(s.select(F.col("s_suppkey").alias("i")), "i", "left_semi")
    return sparse.smooth(s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("b")), edges, 0.5, 1e-12).select("i", F.round("x", 3).alias("x"))
