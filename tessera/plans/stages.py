"""Queries of complex results, knots, multistage ties and table functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import complexes, hooks
from tessera.operators import knots
from tessera.plans.catalog import query
from tessera.plans.relational import table


@query("""
WITH v AS (SELECT l_linenumber AS id, l_returnflag AS flag, l_suppkey AS dof, sum(l_quantity) AS re, sum(l_discount * 100 - 5) AS im FROM lineitem GROUP BY ALL),
n AS (SELECT id, flag, sqrt(sum(re * re + im * im)) AS n FROM v GROUP BY ALL),
p AS (SELECT a.id AS id_a, b.id AS id_b, flag, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im FROM v a JOIN v b USING (flag, dof) GROUP BY ALL)
SELECT id_a, id_b, p.flag, round(re, 3) AS re, round(im, 3) AS im, round(sqrt(re * re + im * im) / (x.n * y.n), 8) AS mac FROM p JOIN n x ON x.id = id_a AND x.flag = p.flag JOIN n y ON y.id = id_b AND y.flag = p.flag
""")
def mac_complex(spark, sf_dir):
    """The modal assurance criterion of complex vectors, one per line number, among those of one flag."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("dof"))
    v = rows.agg(complexes.number(F.sum("l_quantity"), F.sum(F.col("l_discount") * 100 - 5)).alias("value"))
    out = complexes.mac(v, v, ("flag",))
    return out.select("id_a", "id_b", "flag", F.round("product.re", 3).alias("re"), F.round("product.im", 3).alias("im"), F.round("mac", 8).alias("mac"))


@query("""
WITH s AS (SELECT s_suppkey AS node, CAST(s_suppkey % 9 AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, s_acctbal / 7 AS re, s_nationkey - 12.0 AS im, s_suppkey % 5 AS d FROM supplier),
k AS (SELECT *, unnest(range(0, 12)) AS sector FROM s), t AS (SELECT *, sector * pi() / 6 AS a FROM k)
SELECT node, sector, round(x * cos(a) - y * sin(a), 6) AS x, round(x * sin(a) + y * cos(a), 6) AS y, round(re * cos(d * a) - im * sin(d * a), 5) AS temp,
  round((re * cos(d * a) - im * sin(d * a)) * cos(a) - (im * cos(d * a) - 2 * sin(d * a)) * sin(a), 5) AS ux,
  round(sqrt((re * re + im * im + im * im + 4 + sqrt(pow(re * re - im * im + im * im - 4, 2) + pow(2 * re * im + 4 * im, 2))) / 2), 5) AS largest FROM t
""")
def sectors_complex(spark, sf_dir):
    """Complex results of one sector in all twelve, by each node's own nodal diameter, and the largest displacement over a cycle."""
    s = table(spark, sf_dir, "supplier")
    re, im = F.col("s_acctbal") / 7, F.col("s_nationkey") - 12.0
    nodes = s.select(F.struct(F.col("s_suppkey").alias("node"), F.round(complexes.largest_over_cycle([complexes.number(re, im), complexes.number(im, F.lit(2.0))]), 5).alias("largest"), (F.col("s_suppkey") % 5).alias("d")).alias("node"), (F.col("s_suppkey") % 9).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"), complexes.number(re, im).alias("temp"), complexes.number(re, im).alias("ux"), complexes.number(im, F.lit(2.0)).alias("uy"))
    out = complexes.replicate(nodes, 12, F.col("node.d"), ["temp"], [("ux", "uy")])
    return out.select("node.node", "sector", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("temp", 5).alias("temp"), F.round("ux", 5).alias("ux"), "node.largest")


#: Knots of the nations: their suppliers at places in space, turned by a quarter about z, shifted, and larger by a tenth.
def _knots(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    nodes = s.select(F.col("s_nationkey").alias("knot"), F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 7).cast("double").alias("x"), (F.col("s_suppkey") % 5).cast("double").alias("y"), (F.col("s_suppkey") % 3).cast("double").alias("z"))
    knot = n.select(F.col("n_nationkey").alias("knot"), F.col("n_regionkey").cast("double").alias("rx"), F.lit(1.0).alias("ry"), F.lit(2.0).alias("rz"))
    state = knot.select("*", F.lit(3.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(-1.0).alias("uz"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), F.lit(math.pi / 2).alias("wz"), F.lit(0.1).alias("g"))
    return nodes, knot, state


_KNOT_NODES = "k AS (SELECT n_nationkey AS knot, s_suppkey AS node, CAST(s_suppkey % 7 AS DOUBLE) AS x, CAST(s_suppkey % 5 AS DOUBLE) AS y, CAST(s_suppkey % 3 AS DOUBLE) AS z, CAST(n_regionkey AS DOUBLE) AS rx FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""
WITH {_KNOT_NODES}
SELECT knot, node, round(3 + rx - 1.1 * (y - 1) - x, 6) AS ux, round(1 + 1.1 * (x - rx) - y, 6) AS uy, round(-1 + 2 + 1.1 * (z - 2) - z, 6) AS uz FROM k
""")
def knot_places(spark, sf_dir):
    """Where knots that turn by a quarter and grow take their nodes; by their linear terms at that very state."""
    nodes, _, state = _knots(spark, sf_dir)
    terms = knots.knot_terms(nodes, state).join(state, "knot")
    value = F.element_at(F.array("ux", "uy", "uz", "wx", "wy", "wz", "g"), F.col("term"))
    summed = terms.groupBy("knot", "node", "dof").agg((F.max("rest") + F.sum(F.col("coef") * value)).alias("u"))
    return summed.groupBy("knot", "node").agg(*[F.round(F.max(F.when(F.col("dof") == k + 1, F.col("u"))), 6).alias(f"u{a}") for k, a in enumerate("xyz")])


@query(f"""
WITH {_KNOT_NODES}
SELECT DISTINCT knot, true AS exact FROM k
""")
def knot_fit(spark, sf_dir):
    """Knots' states from their nodes' displacements: a quarter turn comes back within 1e-9."""
    nodes, knot, state = _knots(spark, sf_dir)
    moved = nodes.join(knots.knot_places(nodes, state), ["knot", "node"])
    found = knots.fit_knots(moved, knot)
    back = knots.knot_places(nodes, found).withColumnsRenamed({f"u{a}": f"b{a}" for a in "xyz"}).join(moved, ["knot", "node"])
    off = F.greatest(*[F.abs(F.col(f"u{a}") - F.col(f"b{a}")) for a in "xyz"])
    return back.groupBy("knot").agg((F.max(off) < 1e-9).alias("exact"))


@query("""
WITH s AS (SELECT s_suppkey AS face FROM supplier), p AS (SELECT DISTINCT l_suppkey AS face, l_linenumber % 4 AS sector, l_quantity::BIGINT % 3 + 1 AS a, l_partkey % 3 + 1 AS b FROM lineitem),
w AS (SELECT face, sector, a, b, unnest([0, 1, 2]) AS corner, unnest([1 - a / 20.0 - b / 20.0, a / 20.0, b / 20.0]) AS w FROM p JOIN s USING (face)),
t AS (SELECT *, CASE sector WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c, CASE sector WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS n FROM w),
d AS (SELECT *, unnest([1, 1, 2, 2, 3]) AS dof, unnest([1, 2, 1, 2, 3]) AS term, unnest([c, -n, n, c, 1]) AS f FROM t)
SELECT face, sector, a, b, face * 3 + corner AS node, dof, term, 0.125::DOUBLE AS gap, round(w * f * c, 6) AS re, round(w * f * n, 6) AS im FROM d
""")
def multistage_ties(spark, sf_dir):
    """Nodes all around tied to the one modelled quarter of the next stage, with the phase of one wave around the circle."""
    k = F.col("s_suppkey")
    corner = lambda n, x, y: F.struct((k * 3 + n).alias("node"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), (k * 10.0).alias("z"))
    faces = table(spark, sf_dir, "supplier").select(k.alias("face"), F.array(corner(0, 0, 0), corner(1, 20, 0), corner(2, 0, 20)).alias("corners"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("face"), (F.col("l_linenumber") % 4).cast("int").alias("sector"), (F.col("l_quantity").cast("long") % 3 + 1).alias("a"), (F.col("l_partkey") % 3 + 1).alias("b")).distinct().join(table(spark, sf_dir, "supplier").select(k.alias("face")), "face")
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    at = lambda values: F.element_at(F.array(*values), F.col("sector") + 1)
    nodes = p.select(F.struct("face", "sector", "a", "b").alias("id"), at([x, -y, -x, y]).alias("x"), at([y, x, -y, -x]).alias("y"), (F.col("face") * 10.0 + 0.125).alias("z"))
    out = knots.multistage(nodes, faces, 4, 0.5, diameter=1)
    return out.select("face", "sector", "id.a", "id.b", "node", "dof", "term", F.round("gap", 6).alias("gap"), (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("""
WITH e AS (SELECT l_suppkey AS a, l_suppkey + l_linenumber AS b, l_quantity AS k FROM lineitem),
m AS (SELECT a AS i, a AS j, k AS v FROM e UNION ALL SELECT a, b, -k FROM e UNION ALL SELECT b, a, -k FROM e UNION ALL SELECT b, b, k FROM e)
SELECT i, j, round(sum(v), 2) AS v FROM m GROUP BY ALL
""")
def spring_function(spark, sf_dir):
    """Springs by a table function of SQL."""
    hooks.register_elements(spark, "spring", ["a", "b", "k"])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("b"), F.col("l_quantity").cast("double").alias("k"))
    return spark.sql("SELECT i, j, round(sum(v), 2) AS v FROM spring(TABLE({rows}) PARTITION BY a) GROUP BY i, j", rows=rows)
