"""Queries of the mesh, spatial, sparse, constraint and result operators over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.spectrum import real_spectrum
from tessera.operators import constraints, results, sparse, spatial, topology
from tessera.plans import statics
from tessera.plans.catalog import query
from tessera.plans.relational import table


def _bricks(spark, sf_dir, span=1 << 10):
    """A brick per part, at places that follow from its key."""
    p = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(p.alias("elem"), (p % 16).alias("cx"), (F.floor(p / 16) % 16).alias("cy"), F.floor(p / 256).alias("cz"))
    return statics.brick_grid(cells, span)


_NODE = lambda d: f"(((p_partkey % 16 + {d[0]}) * 1024 + (p_partkey // 16) % 16 + {d[1]}) * 1024 + p_partkey // 256 + {d[2]})"
_CORNER = [tuple(int(c) for c in r) for r in ((statics.CORNERS + 1) / 2)]
_FACES = ", ".join("list_sort([" + ", ".join(_NODE(_CORNER[i]) for i in f) + "])" for f in topology.HEX_FACES)


@query(f"""
WITH f AS (SELECT p_partkey AS elem, unnest(range(1, 7)) AS face, unnest([{_FACES}]) AS key FROM part)
SELECT any_value(elem) AS elem, any_value(face) AS face FROM f GROUP BY key HAVING count(*) = 1
""")
def external_faces(spark, sf_dir):
    """Faces that belong to exactly one element."""
    elements, _ = _bricks(spark, sf_dir)
    return topology.external_faces(elements).select("elem", F.col("face").cast("long").alias("face"))


def _order_mesh(spark, sf_dir, key="l_partkey"):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("elem")).agg(F.collect_set(key).alias("nodes"))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS node FROM lineitem)
SELECT x.node AS a, y.node AS b, count(*) AS n_elems FROM m x JOIN m y ON x.elem = y.elem AND x.node < y.node GROUP BY ALL
""")
def unique_edges(spark, sf_dir):
    """Pairs of nodes that share an element, with the number of elements."""
    return topology.unique_edges(_order_mesh(spark, sf_dir)).select("a", "b", F.size("elems").cast("long").alias("n_elems"))


@query("SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS n_elems FROM lineitem GROUP BY l_partkey")
def node_adjacency(spark, sf_dir):
    """Elements per node."""
    return topology.adjacency(_order_mesh(spark, sf_dir))


_TRI = "t AS (SELECT p_partkey * 2 + k AS elem, CASE k WHEN 0 THEN [{a}, {b}, {c}] ELSE [{a}, {c}, {d}] END AS nodes FROM part, (SELECT unnest([0, 1]) AS k))".format(
    a="(p_partkey % 50) * 1000000 + p_partkey // 50", b="(p_partkey % 50 + 1) * 1000000 + p_partkey // 50", c="(p_partkey % 50 + 1) * 1000000 + p_partkey // 50 + 1", d="(p_partkey % 50) * 1000000 + p_partkey // 50 + 1"
)


@query(f"""
WITH {_TRI}, s AS (SELECT elem, unnest([1, 2, 3]) AS side, unnest([list_sort([nodes[1], nodes[2]]), list_sort([nodes[2], nodes[3]]), list_sort([nodes[3], nodes[1]])]) AS key FROM t)
SELECT s.elem, s.side::BIGINT AS side, o.elem AS neighbour FROM s LEFT JOIN s o ON o.key = s.key AND o.elem <> s.elem
""")
def triangle_neighbours(spark, sf_dir):
    """The triangle across each side, in a grid of two per part."""
    p = F.col("p_partkey")
    at = lambda i, j: (p % 50 + i) * 1000000 + F.floor(p / 50) + j
    t = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.array(at(0, 0), at(1, 0), at(1, 1)).alias("nodes")), F.struct(F.lit(1).alias("k"), F.array(at(0, 0), at(1, 1), at(0, 1)).alias("nodes")))).alias("t"))
    return topology.triangle_neighbours(t.select((p * 2 + F.col("t.k")).alias("elem"), "t.nodes")).select("elem", F.col("side").cast("long").alias("side"), "neighbour")


@query("""
WITH l AS (SELECT p_partkey, 1.0 + p_partkey % 7 AS a, 1.0 + p_partkey % 5 AS b, 1.0 + p_partkey % 3 AS c FROM part)
SELECT p_partkey, round(greatest(sqrt(a * a + b * b), sqrt(b * b + c * c), sqrt(a * a + c * c)) * (a * b + b * c + a * c + sqrt(a * a * b * b + b * b * c * c + a * a * c * c)) / 2 / (a * b * c / 2) * (sqrt(6) / 12), 6) AS quality FROM l
""")
def tet_quality(spark, sf_dir):
    """Longest edge over inscribed radius; 1 is regular, larger is worse."""
    p = F.col("p_partkey")
    zero = F.lit(0.0)
    a, b, c = ((p % n + 1).cast("double") for n in (7, 5, 3))
    q = topology.tet_quality([[zero, zero, zero], [a, zero, zero], [zero, b, zero], [zero, zero, c]])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(q, 6).alias("quality"))


@query(f"""
SELECT s_suppkey AS node, k AS sector, round(s_acctbal * cos(k * {math.pi / 2!r}) - s_suppkey * sin(k * {math.pi / 2!r}), 4) + 0.0 AS x, round(s_acctbal * sin(k * {math.pi / 2!r}) + s_suppkey * cos(k * {math.pi / 2!r}), 4) + 0.0 AS y, s_nationkey AS z
FROM supplier, (SELECT unnest(range(0, 4)) AS k)
""")
def sector_replicate(spark, sf_dir):
    """Points copied to four sectors about the z axis."""
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"), F.col("s_nationkey").alias("z"))
    return topology.replicate_sectors(n, 4).select("node", F.col("sector").cast("long").alias("sector"), (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"), "z")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS id FROM orders")
def dense_renumber(spark, sf_dir):
    """Ids without gaps."""
    return topology.dense_renumber(table(spark, sf_dir, "orders"), "o_custkey", "id").select("o_orderkey", "id")


@query("""
SELECT s_suppkey, round((s_acctbal * s_nationkey + s_suppkey * 2.0) / sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey), 6) AS radial, round((2.0 * s_acctbal - s_nationkey * s_suppkey) / sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey), 6) AS tangential FROM supplier
""")
def rect_to_cylindrical(spark, sf_dir):
    """Vectors in the cylindrical frame of their place."""
    r, t = spatial.to_cylindrical(F.col("s_acctbal"), F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), F.lit(2.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(r, 6).alias("radial"), F.round(t, 6).alias("tangential"))


@query("SELECT l_partkey AS node, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY l_partkey")
def nodal_average(spark, sf_dir):
    """Unweighted mean over element contributions."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_quantity").alias("value"))
    return results.nodal_average(rows, ["value"]).select("node", F.round("value", 6).alias("value"), F.col("n_contributions").alias("n"))


@query("""
WITH s AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS spread, max(abs(l_quantity)) AS size FROM lineitem GROUP BY l_orderkey)
SELECT l_partkey AS node, max(spread) AS spread, round(max(CASE WHEN size > 0 THEN spread / size ELSE 0.0 END), 6) AS relative FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_partkey
""")
def error_estimate(spark, sf_dir):
    """Per node the largest spread of its elements."""
    li = table(spark, sf_dir, "lineitem")
    out = results.error_estimate(li.select(F.col("l_orderkey").alias("elem"), F.col("l_quantity").alias("value")), li.select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node")))
    return out.select("node", "spread", F.round("relative", 6).alias("relative"))


@query("""
WITH s AS (SELECT l_returnflag, sum(l_quantity) AS m, sum(l_quantity * l_discount) AS sx, sum(l_quantity * l_tax) AS sy, sum(l_quantity * l_linenumber) AS sz, sum(l_quantity * l_discount * l_discount) AS sxx,
  sum(l_quantity * l_tax * l_tax) AS syy, sum(l_quantity * l_linenumber * l_linenumber) AS szz, sum(l_quantity * l_discount * l_tax) AS sxy FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(m, 2) AS mass, round(sx / m, 6) AS cg_x, round(sy / m, 6) AS cg_y, round(sz / m, 6) AS cg_z, round(syy - sy * sy / m + szz - sz * sz / m, 3) AS ixx, round(sxx - sx * sx / m + szz - sz * sz / m, 3) AS iyy,
  round(sxx - sx * sx / m + syy - sy * sy / m, 3) AS izz, round(-(sxy - sx * sy / m), 3) AS ixy FROM s
""")
def mass_cg_inertia(spark, sf_dir):
    """Mass, centre of gravity and inertia about it."""
    parts = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("m"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    out = results.mass_properties(parts, ["l_returnflag"])
    digits = {"mass": 2, "cg_x": 6, "cg_y": 6, "cg_z": 6, "ixx": 3, "iyy": 3, "izz": 3, "ixy": 3}
    return out.select("l_returnflag", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("""
SELECT l_linestatus, round(sum(l_quantity), 2) AS area, round(sum(l_quantity * l_tax), 4) AS fx, round(sum(l_quantity * l_discount), 4) AS fz, round(sum(l_quantity * (l_linenumber * l_discount - 2.0 * 1.0)), 4) AS mx, round(sum(l_quantity * l_discount), 4) AS f_normal
FROM lineitem GROUP BY l_linestatus
""")
def section_print(spark, sf_dir):
    """Force and moment of a section from its patches."""
    p = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("a"), F.lit(1.0).alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.lit(2.0).alias("z"), F.col("l_tax").alias("tx"), F.lit(1.0).alias("ty"), F.col("l_discount").alias("tz"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    out = results.section_resultants(p, ["l_linestatus"])
    return out.select("l_linestatus", F.round("area", 2).alias("area"), *[F.round(c, 4).alias(c) for c in ("fx", "fz", "mx", "f_normal")])


@query("SELECT l_returnflag, round(ln(sum(exp(5.0 * l_quantity / 50.0))) / 5.0, 6) AS ks FROM lineitem GROUP BY l_returnflag")
def ks_aggregate(spark, sf_dir):
    """A smooth maximum."""
    return results.ks_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 50.0, 5.0).select("l_returnflag", F.round("ks", 6).alias("ks"))


@query("SELECT l_suppkey, round(sum(l_discount * l_discount + l_tax * l_tax), 4) AS objective FROM lineitem GROUP BY l_suppkey")
def disp_objective(spark, sf_dir):
    """Sum of squared components."""
    return results.squared_displacements(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_discount", "l_tax"]).withColumn("objective", F.round("objective", 4))


@query("""
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(abs(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS mac
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0
""")
def mac_matrix(spark, sf_dir):
    """Assurance of every fiftieth vector against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return results.mac(v.filter("id % 50 = 0"), v).select("id_a", "id_b", F.round("mac", 5).alias("mac"))


def _points(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e"), "label").select("id", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"), F.col("e")[2].alias("z"), F.col("label").cast("double").alias("value"))


_POINTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label::DOUBLE AS value FROM embeddings), prs AS (SELECT q.id AS q_id, p.id AS p_id, q.value AS qv, p.value AS pv, q.z AS qz, p.z AS pz, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM pts q JOIN pts p ON q.id % 50 = 0)"
START = 0.05


@query(f"WITH {_POINTS} SELECT q_id, p_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, p_id) AS rank FROM prs) WHERE rank <= 5")
def knn3(spark, sf_dir):
    """The five nearest points of every fiftieth."""
    p = _points(spark, sf_dir)
    return spatial.nearest(p.filter("id % 50 = 0"), p, 5, START).select("q_id", "p_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_POINTS} SELECT q_id, count(*) AS n, round(sum(d2), 6) AS sum_d2 FROM prs WHERE d2 <= 0.2 * 0.2 GROUP BY q_id")
def radius_neighbours(spark, sf_dir):
    """Points within a radius."""
    p = _points(spark, sf_dir)
    return spatial.radius_pairs(p.filter("id % 50 = 0"), p, 0.2).groupBy("q_id").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("sum_d2"))


@query(f"WITH {_POINTS} SELECT q_id, round(sum((0.2 - sqrt(d2)) / 0.2 * pv) / sum((0.2 - sqrt(d2)) / 0.2), 5) AS filtered FROM prs WHERE d2 <= 0.2 * 0.2 GROUP BY q_id")
def hat_filter(spark, sf_dir):
    """A mean weighted by a linear hat."""
    p = _points(spark, sf_dir)
    return spatial.hat_filter(p.filter("id % 50 = 0"), p, 0.2, "value").select("q_id", F.round("filtered", 5).alias("filtered"))


@query(f"WITH {_POINTS} SELECT q_id, round(sum((qv + 1) * (pv + 1) * exp(-d2 / (0.05 * 0.05))), 5) AS cov FROM prs WHERE d2 <= 0.15 * 0.15 GROUP BY q_id")
def autocovariance(spark, sf_dir):
    """Row sums of an exponential autocovariance, cut at three lengths."""
    p = _points(spark, sf_dir).withColumn("s", F.col("value") + 1)
    q, p2 = p.filter("id % 50 = 0"), p
    pairs = spatial.radius_pairs(q, p2, 0.15000000000000002)
    cov = F.col("q_s") * F.col("p_s") * F.exp(-F.col("d2") / (0.05 * 0.05))
    return pairs.filter(F.col("d2") <= 0.15 * 0.15).groupBy("q_id").agg(F.round(F.sum(cov), 5).alias("cov"))


@query(f"WITH {_POINTS.replace('ON q.id % 50 = 0', 'ON true')} SELECT q_id AS id, round(sum((0.2 - sqrt(d2)) / 0.2 * pv) / sum((0.2 - sqrt(d2)) / 0.2), 5) AS filtered FROM prs WHERE d2 <= 0.2 * 0.2 GROUP BY q_id")
def hat_filter_all(spark, sf_dir):
    """The same mean for every point."""
    return spatial.hat_filter_all(_points(spark, sf_dir), 0.2, "value").select("id", F.round("filtered", 5).alias("filtered"))


@query(f"WITH {_POINTS.replace('ON q.id % 50 = 0', 'ON true')} SELECT q_id AS id, round(sum((qv + 1) * (pv + 1) * exp(-d2 / (0.05 * 0.05))), 5) AS cov FROM prs WHERE d2 <= 0.15 * 0.15 GROUP BY q_id")
def autocovariance_all(spark, sf_dir):
    """The same row sums for every point."""
    p = _points(spark, sf_dir).withColumn("s", F.col("value") + 1)
    return spatial.autocovariance_sums(p, 0.05, "s", 3.0).select("id", F.round("cov", 5).alias("cov"))


@query(f"WITH {_POINTS.replace('ON q.id % 50 = 0', 'ON true')} SELECT q_id AS id, round(sum((qv + 1) * (pv + 1) * exp(-d2 / (0.05 * 0.05))), 5) AS cov FROM prs GROUP BY q_id")
def autocovariance_exact(spark, sf_dir):
    """Row sums for every point, of all pairs whose covariance is not 0 as a double."""
    p = _points(spark, sf_dir).withColumn("s", F.col("value") + 1)
    return spatial.autocovariance_sums(p, 0.05, "s").select("id", F.round("cov", 5).alias("cov"))


@query(f"""
WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, p_id) AS rank FROM prs WHERE p_id % 50 <> 0)
SELECT q_id AS id, round(sqrt(d2), 6) AS size, sqrt(d2) < 0.1 AS violated FROM r WHERE rank = 1 AND pz - qz < 0
""")
def member_size(spark, sf_dir):
    """Distance to the nearest reference point, where that is on the inner side."""
    p = _points(spark, sf_dir)
    nodes = p.filter("id % 50 = 0").select("*", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return spatial.member_size(nodes, p.filter("id % 50 <> 0"), START, 0.1).select("id", F.round("size", 6).alias("size"), "violated")


@query("""
SELECT greatest(a.l_partkey, b.l_partkey) AS i, least(a.l_partkey, b.l_partkey) AS j, round(sum(a.l_quantity * b.l_quantity), 2) AS v
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY ALL
""")
def assemble_coo(spark, sf_dir):
    """Contributions of elements summed into a lower triangle."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("n"), F.col("l_quantity").alias("q"))).alias("e"))
    pairs = rows.select(F.explode("e").alias("a"), "e").select("a", F.explode("e").alias("b"))
    return sparse.assemble(pairs.select(F.col("a.n").alias("i"), F.col("b.n").alias("j"), (F.col("a.q") * F.col("b.q")).alias("v"))).withColumn("v", F.round("v", 2))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS d FROM lineitem WHERE l_suppkey % 10 <> 0)
SELECT DISTINCT a.d AS i, b.d AS j FROM m a JOIN m b ON a.e = b.e AND a.d >= b.d
""")
def sparse_structure(spark, sf_dir):
    """Places that elements fill, without fixed dofs."""
    e = _order_mesh(spark, sf_dir, "l_suppkey").withColumnRenamed("nodes", "dofs")
    fixed = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("dof"))
    return sparse.structure(e, fixed)


def _matrix(spark, sf_dir, value="l_quantity"):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum(value).alias("v"))


@query("SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 2) AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def spmv(spark, sf_dir):
    """Matrix times vector."""
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("x"))
    return sparse.spmv(_matrix(spark, sf_dir), x).select("i", F.round("y", 2).alias("y"))


@query("""
WITH m AS (SELECT greatest(l_suppkey, l_linenumber) AS i, least(l_suppkey, l_linenumber) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
f AS (SELECT * FROM m UNION ALL SELECT j, i, -v FROM m WHERE i <> j)
SELECT i, round(sum(v * j), 2) AS y FROM f GROUP BY i
""")
def spmv_antisymmetric(spark, sf_dir):
    """A lower triangle with its negative mirror image times a vector."""
    a = sparse.assemble(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("v")))
    full = sparse.full(a, -1)
    x = full.select("j").distinct().withColumn("x", F.col("j").cast("double"))
    return sparse.spmv(full, x).select("i", F.round("y", 2).alias("y"))


@query("""
SELECT i, j, round(sum(v), 4) AS v FROM (SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, l_quantity AS v FROM lineitem UNION ALL SELECT l_linenumber::BIGINT, l_suppkey, l_tax FROM lineitem) GROUP BY ALL
""")
def sparse_add(spark, sf_dir):
    """A sum of two matrices."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    a = li.select(F.col("l_suppkey").alias("i"), n.alias("j"), F.col("l_quantity").alias("v"))
    b = li.select(n.alias("i"), F.col("l_suppkey").alias("j"), F.col("l_tax").alias("v"))
    return sparse.add(a, b).withColumn("v", F.round("v", 4))


@query("""
WITH a AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS i, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_suppkey AS j, sum(l_discount) AS v FROM lineitem GROUP BY ALL)
SELECT i, j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b USING (k) GROUP BY ALL
""")
def sparse_atb(spark, sf_dir):
    """A'B: rows of both meet on the order."""
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_discount").alias("v"))
    return sparse.atb(a, b).withColumn("v", F.round("v", 4))


@query("SELECT l_partkey AS i, l_orderkey AS j, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL")
def transpose(spark, sf_dir):
    return sparse.transpose(_matrix(spark, sf_dir)).withColumn("v", F.round("v", 2))


@query("SELECT l_orderkey AS i, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL")
def lump(spark, sf_dir):
    """Row sums."""
    return sparse.lump(_matrix(spark, sf_dir)).withColumn("v", F.round("v", 2))


def _laplacian(spark, sf_dir):
    edges = topology.unique_edges(_order_mesh(spark, sf_dir, "l_suppkey")).select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    off = both.select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(-1.0).alias("v"))
    on = both.groupBy("a").agg(F.count("*").cast("double").alias("v")).select(F.col("a").alias("i"), F.col("a").alias("j"), (F.col("v") + 1).alias("v"))
    return off.unionByName(on)


@query()
def cg_solve(spark, sf_dir):
    """(L + I) x = b over the graph of suppliers that share orders, by conjugate gradients."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("b"))
    a = _laplacian(spark, sf_dir)
    x, _, _ = sparse.conjugate_gradient(a, b.join(a.select("i").distinct(), "i", "left_semi"))
    return x.select("i", F.round("x", 6).alias("x"))


@query()
def power_iteration(spark, sf_dir):
    """The largest eigenvalue's vector of the same matrix."""
    x, value = sparse.dominant_eigenpair(_laplacian(spark, sf_dir))
    return x.select("i", F.round(F.abs("x"), 4).alias("x"), F.lit(round(value, 3)).alias("value"))


_RULES = "r AS (SELECT s_suppkey AS dep, unnest([s_suppkey // 2, -1 - s_nationkey]) AS dof, unnest([0.5, 1.0]) AS coef FROM supplier WHERE s_suppkey >= 2)"


@query(f"""
WITH RECURSIVE {_RULES}, c AS (SELECT dep, dof, coef::DOUBLE AS coef FROM r UNION ALL SELECT c.dep, r.dof, c.coef * r.coef FROM c JOIN r ON r.dep = c.dof)
SELECT dep, dof, round(sum(coef), 9) AS coef FROM c WHERE dof NOT IN (SELECT dep FROM r) GROUP BY ALL
""")
def mpc_cascade(spark, sf_dir):
    """Constraints substituted into each other to the end."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey >= 2")
    lines = s.select(F.col("s_suppkey").alias("mpc"), F.array(F.struct(F.col("s_suppkey").alias("dof"), F.lit(-1.0).alias("coef")), F.struct(F.floor(F.col("s_suppkey") / 2).alias("dof"), F.lit(0.5).alias("coef")), F.struct((-1 - F.col("s_nationkey")).cast("long").alias("dof"), F.lit(1.0).alias("coef"))).alias("terms"))
    return constraints.cascade(constraints.explicit(constraints.equations(lines))).select("dep", "dof", F.round("coef", 9).alias("coef"))


@query("""
WITH ref AS (SELECT s_nationkey AS body, min(s_suppkey) AS r FROM supplier GROUP BY 1),
d AS (SELECT s_nationkey AS body, s_suppkey AS node, (s_suppkey - r)::DOUBLE AS dx, s_acctbal AS dy FROM supplier JOIN ref ON body = s_nationkey),
t AS (SELECT body, node, unnest([1, 1, 1, 2, 2, 2, 3, 3, 3]) AS dof, unnest([1, 5, 6, 2, 4, 6, 3, 4, 5]) AS term, unnest([1.0, 0.0, -dy, 1.0, -0.0, dx, 1.0, dy, -dx]) AS coef FROM d)
SELECT body, node, dof, term, round(coef, 4) + 0.0 AS coef FROM t
""")
def rigid_links(spark, sf_dir):
    """Terms that tie nodes to a body's reference point."""
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_nationkey").alias("body"), F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"), F.lit(0.0).alias("z"))
    ref = s.groupBy(F.col("s_nationkey").alias("body")).agg(F.min("s_suppkey").cast("double").alias("rx")).select("body", "rx", F.lit(0.0).alias("ry"), F.lit(0.0).alias("rz"))
    return constraints.rigid_body(nodes, ref).select("body", "node", "dof", "term", (F.round("coef", 4) + 0.0).alias("coef"))


@query("SELECT p_brand, p_partkey, round(p_size * 1.0 / sum(p_size) OVER (PARTITION BY p_brand), 8) AS coef FROM part")
def mean_coupling(spark, sf_dir):
    """Weights of a distributing coupling, scaled to sum 1."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("weight"))
    return constraints.mean_constraint(p).select(F.col("group").alias("p_brand"), F.col("node").alias("p_partkey"), F.round("coef", 8).alias("coef"))


_TENSOR = "s AS (SELECT l_suppkey, avg(l_quantity) AS xx, avg(l_linenumber) AS yy, avg(l_tax) * 100 AS zz, avg(l_discount) * 10 AS xy, avg(l_discount * l_quantity) AS xz, 1.0 AS yz FROM lineitem GROUP BY l_suppkey)"


@query(f"""
WITH {_TENSOR}, d AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s), e AS (SELECT *, xx - m AS a, yy - m AS b, zz - m AS c FROM d),
j AS (SELECT *, sqrt(((a * a + b * b + c * c) / 2 + xy * xy + xz * xz + yz * yz) / 3) AS r, a * b * c + 2 * xy * xz * yz - a * yz * yz - b * xz * xz - c * xy * xy AS j3 FROM e),
t AS (SELECT *, acos(greatest(-1.0, least(1.0, j3 / (2 * r * r * r)))) / 3 AS th FROM j)
SELECT l_suppkey, round(m + 2 * r * cos(th + 2 * pi() / 3), 4) AS p1, round(m + 2 * r * cos(th - 2 * pi() / 3), 4) AS p2, round(m + 2 * r * cos(th), 4) AS p3 FROM t
""")
def principal_values(spark, sf_dir):
    """Eigenvalues of symmetric tensors, ascending."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("xx"), F.avg("l_linenumber").alias("yy"), (F.avg("l_tax") * 100).alias("zz"), (F.avg("l_discount") * 10).alias("xy"), F.avg(F.col("l_discount") * F.col("l_quantity")).alias("xz"), F.lit(1.0).alias("yz"))
    p = results.principal_values({k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    return li.select("l_suppkey", *[F.round(c, 4).alias(f"p{i}") for i, c in enumerate(p, 1)])


@query("""
WITH s AS (SELECT l_linenumber::BIGINT AS mode, sum(l_quantity * l_discount) AS l, sum(l_quantity * l_discount * l_discount) AS g FROM lineitem GROUP BY 1)
SELECT mode, round(l / g, 5) AS participation, round(l * l / g, 3) AS effective_mass FROM s
""")
def effective_modal_mass(spark, sf_dir):
    """Participation and effective mass of modes."""
    li = table(spark, sf_dir, "lineitem").withColumn("i", F.xxhash64(*table(spark, sf_dir, "lineitem").columns))
    phi = li.groupBy("i", F.col("l_linenumber").cast("long").alias("mode")).agg(F.max("l_discount").alias("x")).withColumn("axis", F.lit(1))
    mass = li.groupBy("i").agg(F.max("l_quantity").alias("m"))
    return results.modal_mass(phi, mass).select("mode", F.round("participation", 5).alias("participation"), F.round("effective_mass", 3).alias("effective_mass"))


@query("""
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
w AS (SELECT *, unnest(range(0, m // 2 + 1)) AS k FROM s)
SELECT user_id, k, round(sum(value * cos(2 * pi() * k * n / m)), 4) + 0.0 AS re, round(-sum(value * sin(2 * pi() * k * n / m)), 4) + 0.0 AS im FROM w GROUP BY user_id, k
""")
def fft_spectrum(spark, sf_dir):
    """The spectrum of each user's values in time order."""
    return real_spectrum(table(spark, sf_dir, "events"), "user_id", "ts", "value").select("user_id", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("""
SELECT p_partkey AS elem, ip, round(269.230769230769, 6) AS sxx, round(115.384615384615, 6) AS syy, round(115.384615384615, 6) AS szz FROM part, (SELECT unnest(range(1, 9)) AS ip)
""")
def brick_stress(spark, sf_dir):
    """Stresses of the bricks under a uniform strain of 0.001 along x (Young 200000, Poisson 0.3)."""
    # Layers of 256 bricks each: beyond 1,023 of them ids need the wider span.
    elements, nodes = _bricks(spark, sf_dir, 1 << 20)
    elements = elements.select("elem", "nodes", F.lit(200000.0).alias("young"), F.lit(0.3).alias("poisson"))
    dofs = nodes.select("node", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("a"))
    u = dofs.select((F.col("node") * 3 + F.col("a")).alias("dof"), F.when(F.col("a") == 0, F.col("x") * 0.001).otherwise(0.0).alias("u"))
    s = statics.stresses(elements, nodes, u)
    return s.select("elem", F.col("ip").cast("long").alias("ip"), *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(("sxx", "syy", "szz"))])
