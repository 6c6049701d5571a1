"""Queries of global order, name lookup, loads, tables with continuations, frames, constraints, transfer and element results over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import constraints, locate, lookup, ordering, results, sparse, spatial, topology, upsert
from tessera.plans.catalog import query
from tessera.plans.fields import _laplacian, _matrix, _order_mesh, _points
from tessera.plans.relational import table
from tessera.sources import deck


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos, o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders")
def sorted_payload(spark, sf_dir):
    """Integer keys in order, with integer, real and text payload."""
    return ordering.ranked(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"), ["o_custkey", "o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY value, event_id) AS pos, value, event_id FROM events")
def real_sort(spark, sf_dir):
    """Real keys in order, with an integer payload."""
    return ordering.ranked(table(spark, sf_dir, "events").select("value", "event_id"), ["value", "event_id"])


@query("SELECT vec_id, array_to_string(list_transform(list_sort(embedding[1:6]), lambda x: printf('%.5f', x::DOUBLE)), ',') AS ordered FROM embeddings")
def tiny_sort(spark, sf_dir):
    """Short lists of reals in order, within their row."""
    e = F.transform(F.array_sort(F.slice("embedding", 1, 6)), lambda x: F.format_string("%.5f", x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(e, ",").alias("ordered"))


@query("SELECT label, row_number() OVER (PARTITION BY label ORDER BY sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE), vec_id) AS pos, vec_id FROM embeddings")
def eigen_order(spark, sf_dir):
    """Complex values in the order of their size, per group."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im"))
    return ordering.complex_order(e, ["label"], "re", "im", "vec_id").select("label", "pos", "vec_id")


@query("SELECT row_number() OVER (ORDER BY name) AS pos, name FROM (SELECT p_type AS name FROM part UNION SELECT p_brand FROM part)")
def catalogue_names(spark, sf_dir):
    """Names with those that are added, in alphabetical order."""
    p = table(spark, sf_dir, "part")
    return ordering.catalogue(p.select(F.col("p_type").alias("name")), p.select(F.col("p_brand").alias("name")), "name")


@query("""
WITH k AS (SELECT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS k FROM part), n AS (SELECT c_custkey, substr(md5(CAST(c_custkey * 3 AS VARCHAR)), 1, 6) AS name FROM customer)
SELECT c_custkey, count(k) AS position FROM n LEFT JOIN k ON k <= name GROUP BY c_custkey
""")
def name_lookup(spark, sf_dir):
    """How many sorted names are not beyond a name."""
    keys = table(spark, sf_dir, "part").select(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6).alias("k"))
    names = table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.md5((F.col("c_custkey") * 3).cast("string")), 1, 6).alias("name"))
    return lookup.floor_position(names, "name", keys, "k").select("c_custkey", "position")


@query("""
WITH s AS (SELECT l_partkey AS elem, l_returnflag || l_linestatus AS label, l_linenumber % 3 AS sector, year(l_shipdate)::INTEGER AS step, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT elem, label, sector::INTEGER AS sector, step, round(value, 2) AS value, elem % 4 AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY elem, label, sector ORDER BY step DESC) AS r FROM s) WHERE r = 1
""")
def face_loads(spark, sf_dir):
    """Face loads by element, label and sector: they add up within a step, the last step counts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("elem"), F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_linenumber") % 3).alias("sector"), F.year("l_shipdate").alias("step"), F.col("l_quantity").alias("value"), (F.col("l_partkey") % 4).alias("amplitude"))
    out = upsert.add_loads(li, "step", ["elem", "label", "sector"], "value", "amplitude")
    return out.select("elem", "label", "sector", "step", F.round("value", 2).alias("value"), "amplitude")


@query("""
WITH d AS (SELECT 'S' || (l_suppkey % 20) AS set_name, l_linestatus AS type, year(l_shipdate)::INTEGER AS step, l_extendedprice AS value, (l_linenumber % 3 + 1) * l_quantity AS x, l_quantity AS y FROM lineitem),
s AS (SELECT set_name, type, round(x / sqrt(x * x + y * y), 6) AS dx, round(y / sqrt(x * x + y * y), 6) AS dy, step, sum(value) AS value FROM d GROUP BY ALL)
SELECT set_name, type, dx, dy, step, round(value, 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY set_name, type, dx, dy ORDER BY step DESC) AS r FROM s) WHERE r = 1
""")
def body_loads(spark, sf_dir):
    """Body loads by set, type and direction."""
    li = table(spark, sf_dir, "lineitem")
    direction = upsert.direction_key((F.col("l_linenumber") % 3 + 1) * F.col("l_quantity"), F.col("l_quantity"), F.lit(0.0))
    rows = li.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("set_name"), F.col("l_linestatus").alias("type"), direction.alias("direction"), F.year("l_shipdate").alias("step"), F.col("l_extendedprice").alias("value"), F.lit(1).alias("amplitude"))
    out = upsert.add_loads(rows, "step", ["set_name", "type", "direction"], "value", "amplitude")
    return out.select("set_name", "type", F.col("direction")[0].alias("dx"), F.col("direction")[1].alias("dy"), "step", F.round("value", 1).alias("value"))


@query("SELECT l_partkey, year(l_shipdate)::INTEGER AS step FROM lineitem GROUP BY ALL HAVING min(l_linenumber % 2) < max(l_linenumber % 2)")
def load_conflicts(spark, sf_dir):
    """Keys that a step loads with different amplitudes."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("step"), (F.col("l_linenumber") % 2).alias("amplitude"))
    return upsert.amplitude_conflicts(li, "step", ["l_partkey"], "amplitude")


@query("""
WITH held AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber = 1),
added AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber > 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM held))
SELECT * FROM held UNION ALL SELECT a.* FROM added a JOIN (SELECT l_orderkey, min(l_linenumber) AS m FROM added GROUP BY l_orderkey) f ON f.l_orderkey = a.l_orderkey AND f.m = a.l_linenumber
""")
def mpc_add(spark, sf_dir):
    """Constraints that are there, and those added whose dependent key is free."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return upsert.add_constraints(li.filter("l_linenumber = 1"), li.filter("l_linenumber > 1"), "l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT user_id, arg_max(event_id % 3, event_id) AS k FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(k <> 0, true) AS active FROM customer LEFT JOIN c ON user_id = c_custkey
""")
def model_change_status(spark, sf_dir):
    """What the last change leaves active, of all."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("kind"))
    return upsert.active_status(table(spark, sf_dir, "customer").select("c_custkey"), e, "c_custkey", "event_id", "kind")


_TABLE = """
t AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, max(p_retailprice) AS y FROM part WHERE p_size % 6 = 1 AND p_size > 6 GROUP BY ALL),
i AS (SELECT p_brand, x AS x0, y AS y0, lag(x) OVER w AS xm, lag(y) OVER w AS ym, lag(x, 2) OVER w AS xmm, lag(y, 2) OVER w AS ymm, lead(x) OVER w AS xp, lead(y) OVER w AS yp, lead(x, 2) OVER w AS xpp, lead(y, 2) OVER w AS ypp,
  count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER w AS one FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
q AS (SELECT p_brand, l_quantity + 0.14285714285714285::DOUBLE AS u FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
j AS (SELECT q.u, i.*, q.u < x0 AS below FROM q JOIN i ON i.p_brand = q.p_brand AND ((one = 1 AND q.u < x0) OR q.u >= x0) AND (xp IS NULL OR q.u < xp))
"""


def _tabulated(spark, sf_dir, **how):
    part = table(spark, sf_dir, "part")
    curve = part.filter("p_size % 6 = 1 and p_size > 6").groupBy("p_brand", F.col("p_size").cast("double").alias("u")).agg(F.max("p_retailprice").alias("y"))
    points = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", (F.col("l_quantity") + 1 / 7).alias("u")).distinct()
    held = points.join(curve.select("p_brand").distinct(), "p_brand", "left_semi")
    return lookup.tabulated(held, curve, ["p_brand"], "u", "y", **how).select("p_brand", "u", F.round("y", 6).alias("y"))


def _line(a, b):
    return f"(y{a} + (u - x{a}) * (y{b} - y{a}) / (x{b} - x{a}))"


def _bend(a, b, c):
    return f"(((y{c} - y{a}) / (x{c} - x{a}) - (y{b} - y{a}) / (x{b} - x{a})) / (x{c} - x{b}))"


def _parabola(a, b, c):
    return f"({_line(a, b)} + {_bend(a, b, c)} * (u - x{a}) * (u - x{b}))"


@query(f"WITH {_TABLE} SELECT p_brand, u, round(CASE WHEN n = 1 THEN y0 WHEN below THEN {_line(0, 'p')} WHEN xp IS NULL THEN y0 ELSE {_line(0, 'p')} END, 6) AS y FROM j")
def table_linear(spark, sf_dir):
    """Linear between a table's entries, continued below the first and constant beyond the last."""
    return _tabulated(spark, sf_dir, order=lookup.LINEAR, low=lookup.LINEAR, high=lookup.CONSTANT)


@query(f"""
WITH {_TABLE} SELECT p_brand, u, round(CASE WHEN n = 1 THEN y0 WHEN n = 2 THEN {_line(0, 'p').replace('yp', 'coalesce(yp, ym)').replace('xp', 'coalesce(xp, xm)')}
  WHEN below THEN y0 + (u - x0) * ((yp - y0) / (xp - x0) + {_bend(0, 'p', 'pp')} * (x0 - xp)) WHEN xp IS NULL THEN {_parabola(0, 'm', 'mm')}
  WHEN xm IS NULL THEN {_parabola(0, 'p', 'pp')} WHEN xpp IS NULL THEN {_parabola('m', 0, 'p')}
  ELSE {_parabola('m', 0, 'p')} + ({_parabola(0, 'p', 'pp')} - {_parabola('m', 0, 'p')}) * (u - x0) / (xp - x0) END, 6) AS y FROM j
""")
def table_quadratic(spark, sf_dir):
    """Parabolas through a table's entries, continued by a tangent below and a parabola beyond."""
    return _tabulated(spark, sf_dir, order=lookup.QUADRATIC, low=lookup.LINEAR, high=lookup.QUADRATIC)


@query("""
WITH f AS (SELECT p_brand, (min(p_partkey) % 5)::DOUBLE AS sx, (min(p_partkey) % 3)::DOUBLE AS sy, min(p_partkey) % 2 = 0 AS total FROM part GROUP BY p_brand),
t AS (SELECT p_brand, p_size + any_value(sx) AS x0, max(p_retailprice) + any_value(sy) AS y0 FROM part JOIN f USING (p_brand) WHERE p_size % 4 = 1 GROUP BY p_brand, p_size),
i AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, row_number() OVER w = 1 AS one FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY x0)),
q AS (SELECT p_brand, l_quantity AS step_time, l_quantity + 10 * l_linenumber AS total_time, CASE WHEN any_value(total) THEN l_quantity + 10 * l_linenumber ELSE l_quantity END AS x FROM lineitem JOIN part ON p_partkey = l_partkey JOIN f USING (p_brand) GROUP BY p_brand, l_quantity, l_linenumber)
SELECT q.p_brand, step_time, total_time, round(CASE WHEN x1 IS NULL OR x <= x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 6) AS y
FROM q JOIN i ON i.p_brand = q.p_brand AND ((one AND x < x0) OR x >= x0) AND (x1 IS NULL OR x < x1)
""")
def amplitude_shifted(spark, sf_dir):
    """Amplitudes with shifted times and values, some by the total time."""
    part = table(spark, sf_dir, "part")
    least = part.groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    shifts = least.select("p_brand", (F.col("k") % 5).cast("double").alias("shift_x"), (F.col("k") % 3).cast("double").alias("shift_y"), (F.col("k") % 2 == 0).alias("total"))
    curve = part.filter("p_size % 4 = 1").groupBy("p_brand", F.col("p_size").cast("double").alias("t")).agg(F.max("p_retailprice").alias("y"))
    points = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", F.col("l_quantity").alias("step_time"), (F.col("l_quantity") + F.col("l_linenumber") * 10).alias("total_time")).distinct()
    points = points.join(curve.select("p_brand").distinct(), "p_brand", "left_semi")
    return lookup.amplitude(points, curve, "p_brand", "step_time", "total_time", "t", "y", shifts).withColumn("y", F.round("y", 6))


_XYZ = ", ".join(f"embedding[{k}]::DOUBLE AS {n}" for k, n in enumerate(("x", "y", "z", "nx", "ny", "nz"), 1))
_ALL = f"p AS (SELECT vec_id AS id, label::DOUBLE AS value, {_XYZ} FROM embeddings), prs AS (SELECT q.id AS q_id, p.id AS p_id, q.value AS qv, p.value AS pv, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2_flat, (q.nx * p.nx + q.ny * p.ny + q.nz * p.nz) / sqrt((q.nx * q.nx + q.ny * q.ny + q.nz * q.nz) * (p.nx * p.nx + p.ny * p.ny + p.nz * p.nz)) AS cosine, (p.x - q.x) * p.nx + (p.y - q.y) * p.ny + (p.z - q.z) * p.nz AS side, (p.z - q.z) AS dz FROM p q, p)"


def _directed(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value"), e.alias("e"))
    return at.select("id", "value", *[F.col("e")[k].alias(n) for k, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))])


@query(f"WITH {_ALL} SELECT q_id, p_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2_flat, p_id) AS rank FROM prs WHERE q_id % 50 = 0) WHERE rank <= 4")
def knn2(spark, sf_dir):
    """The four nearest points in the plane of every fiftieth."""
    p = _directed(spark, sf_dir).select("id", "x", "y")
    return spatial.nearest(p.filter("id % 50 = 0"), p, 4, 0.02, ("x", "y")).select("q_id", "p_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ALL} SELECT q_id, round(sum((0.2 - sqrt(d2)) / 0.2 * greatest(0.0, cosine) * pv) / sum((0.2 - sqrt(d2)) / 0.2), 5) AS filtered FROM prs WHERE d2 <= 0.2 * 0.2 GROUP BY q_id")
def hat_filter_directed(spark, sf_dir):
    """A hat filter by which values count with the cosine of the normals."""
    p = _directed(spark, sf_dir)
    return spatial.hat_filter(p, p, 0.2, "value", normals=("nx", "ny", "nz")).select("q_id", F.round("filtered", 5).alias("filtered"))


@query(f"WITH {_ALL}, w AS (SELECT q_id, p_id, (0.2 - sqrt(d2)) / 0.2 AS w, qv FROM prs WHERE d2 <= 0.2 * 0.2), t AS (SELECT q_id, sum(w) AS t FROM w GROUP BY q_id) SELECT p_id AS id, round(sum(w * qv / t), 5) AS filtered FROM w JOIN t USING (q_id) GROUP BY p_id")
def hat_filter_backward(spark, sf_dir):
    """The transposed hat filter."""
    return spatial.hat_filter_backward(_points(spark, sf_dir), 0.2, "value").select("id", F.round("filtered", 5).alias("filtered"))


@query(f"WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, p_id) AS rank FROM prs WHERE q_id % 2 = 0 AND p_id % 2 = 1) SELECT q_id AS id, round(sqrt(d2), 6) AS distance, round(side, 6) + 0.0 AS side, side >= 0 AS active FROM r WHERE rank = 1")
def packaging(spark, sf_dir):
    """Distance of nodes to the nearest reference point, and whether they are on its outer side."""
    p = _directed(spark, sf_dir)
    out = spatial.packaging(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 0.05)
    return out.select("id", F.round("distance", 6).alias("distance"), (F.round("side", 6) + 0.0).alias("side"), "active")


@query(f"WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, p_id) AS rank FROM prs WHERE q_id % 2 = 0 AND p_id % 2 = 1) SELECT q_id AS id, round(sqrt(d2), 6) AS size, sqrt(d2) < 0.1 AS violated FROM r WHERE rank = 1 AND dz < 0")
def member_size_all(spark, sf_dir):
    """Member size of all nodes against the other half of the points."""
    p = _points(spark, sf_dir)
    nodes = p.filter("id % 2 = 0").select("*", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return spatial.member_size(nodes, p.filter("id % 2 = 1"), 0.05, 0.1).select("id", F.round("size", 6).alias("size"), "violated")


@query("""
WITH s AS (SELECT l_suppkey, avg(l_quantity) AS xx, avg(l_linenumber) AS yy, avg(l_tax) AS zz, avg(l_discount) AS xy, avg(l_discount * l_quantity) AS xz, s_acctbal AS x, s_suppkey AS y, sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
t AS (SELECT *, x / r AS c, y / r AS n FROM s)
SELECT l_suppkey, round(xx * c * c + yy * n * n + 2 * xy * c * n, 5) AS rr, round(xx * n * n + yy * c * c - 2 * xy * c * n, 5) AS tt, round((yy - xx) * c * n + xy * (c * c - n * n), 5) AS rt, round(xz * c + n, 5) AS rz, round(c - xz * n, 5) AS tz FROM t
""")
def tensor_frames(spark, sf_dir):
    """Tensors in the cylindrical frame of their place."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("xx"), F.avg("l_linenumber").alias("yy"), F.avg("l_tax").alias("zz"), F.avg("l_discount").alias("xy"), F.avg(F.col("l_discount") * F.col("l_quantity")).alias("xz"), F.lit(1.0).alias("yz"))
    at = li.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    s = spatial.tensor_to_cylindrical(F.col("s_acctbal"), F.col("s_suppkey").cast("double"), {k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    return at.select("l_suppkey", *[F.round(s[k], 5).alias(k) for k in ("rr", "tt", "rt", "rz", "tz")])


@query("SELECT node, row_number() OVER (PARTITION BY node ORDER BY elem) AS pos, elem FROM (SELECT DISTINCT l_partkey AS node, l_orderkey AS elem FROM lineitem)")
def node_elements(spark, sf_dir):
    """The elements of each node, one after another."""
    return topology.node_elements(_order_mesh(spark, sf_dir))


@query("""
WITH d AS (SELECT DISTINCT l_orderkey AS e, CASE WHEN l_suppkey % 4 = 1 THEN l_suppkey + 1 ELSE l_suppkey END AS d FROM lineitem WHERE l_suppkey % 10 <> 0),
b AS (SELECT DISTINCT l_orderkey AS e, l_suppkey + 2 AS d FROM lineitem WHERE l_suppkey % 4 = 1 AND l_suppkey % 10 <> 0),
m AS (SELECT e, d FROM (SELECT * FROM d UNION SELECT * FROM b) WHERE d % 10 <> 0)
SELECT DISTINCT x.d AS i, y.d AS j FROM m x JOIN m y ON x.e = y.e AND x.d >= y.d
""")
def sparse_structure_spread(spark, sf_dir):
    """Places that elements fill where every fourth dof depends on the two after it, without fixed dofs."""
    e = _order_mesh(spark, sf_dir, "l_suppkey").withColumnRenamed("nodes", "dofs")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dof"))
    fixed = s.filter("dof % 10 = 0").unionByName(s.select((F.col("dof") + 2).alias("dof")).filter("dof % 10 = 0")).distinct()
    rules = s.filter("dof % 4 = 1 and dof % 10 <> 0").select(F.col("dof").alias("dep"), F.explode(F.array(F.col("dof") + 1, F.col("dof") + 2)).alias("dof"))
    e = e.select("elem", F.filter("dofs", lambda d: d % 10 != 0).alias("dofs"))
    return sparse.structure(e, fixed, rules)


@query("SELECT l_partkey AS i, round(sum(l_quantity * o_totalprice), 2) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def sparse_atv(spark, sf_dir):
    """A'b."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))
    return sparse.atv(_matrix(spark, sf_dir), b).select("i", F.round("y", 2).alias("y"))


@query("SELECT round(sum(p_retailprice * p_size), 2) AS dot FROM part")
def dot_product(spark, sf_dir):
    """The product of two vectors that meet on their keys."""
    p = table(spark, sf_dir, "part")
    value = sparse.dot(p.select("p_partkey", "p_retailprice"), p.select("p_partkey", "p_size"), "p_partkey", "p_retailprice", "p_size")
    return spark.range(1).select(F.round(F.lit(float(value)), 2).alias("dot"))


@query("SELECT s_suppkey AS i, 0.0::DOUBLE AS r FROM supplier WHERE s_suppkey IN (SELECT a.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)")
def cg_residual(spark, sf_dir):
    """A x - b of the conjugate gradients' solution, to five digits: nothing is left."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("b"))
    a = _laplacian(spark, sf_dir)
    b = b.join(a.select("i").distinct(), "i", "left_semi")
    x, _, _ = sparse.conjugate_gradient(a, b)
    return sparse.residual(a, x, b).select("i", (F.round("r", 5) + 0.0).alias("r"))


@query("SELECT s_suppkey AS i, 0.0::DOUBLE AS r FROM supplier WHERE s_suppkey IN (SELECT a.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)")
def power_residual(spark, sf_dir):
    """A x - v x of the largest eigenvalue's vector, to five digits."""
    a = _laplacian(spark, sf_dir)
    x, value = sparse.dominant_eigenpair(a)
    return sparse.residual(a, x, x.select("i", (F.col("x") * value).alias("b"))).select("i", (F.round("r", 5) + 0.0).alias("r"))


@query("SELECT s_suppkey AS i, 0.0::DOUBLE AS r FROM supplier")
def smooth_residual(spark, sf_dir):
    """What the implicit filter's equation leaves, to two digits of balances of thousands."""
    s = table(spark, sf_dir, "supplier")
    edges = s.select((F.col("s_suppkey") + 1).alias("i"), F.col("s_suppkey").alias("j")).join(s.select(F.col("s_suppkey").alias("i")), "i", "left_semi")
    b = s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("b"))
    x = sparse.smooth(b, edges, 0.5)
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    on = b.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")).unionByName(both.select("i", F.col("i").alias("j"), F.lit(0.5).alias("v")))
    return sparse.residual(on.unionByName(both.select("i", "j", F.lit(-0.5).alias("v"))), x, b).select("i", (F.round("r", 2) + 0.0).alias("r"))


_SPOTS = "n AS (SELECT s_nationkey AS g, s_suppkey AS node, [s_suppkey::DOUBLE, s_acctbal, (s_suppkey % 7)::DOUBLE] AS p FROM supplier)"


def _spots(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"))


def _named(spots, name, side):
    return spots.select("group", F.col("node").alias(side), *[F.col(c).alias(f"{side}{c}") for c in "xyz"]).join(name, ["group", side])


@query(f"""
WITH {_SPOTS}, e AS (SELECT g, min(node) AS a, max(node) AS b FROM n GROUP BY g HAVING min(node) < max(node)),
r AS (SELECT n.g, n.node, n.p, a, b, na.p AS pa, nb.p AS pb FROM n JOIN e USING (g) JOIN n na ON na.node = a JOIN n nb ON nb.node = b WHERE n.node NOT IN (a, b)),
l AS (SELECT *, list_transform(range(1, 4), lambda k: abs(pb[k] - pa[k])) AS d FROM r),
m AS (SELECT *, CASE WHEN d[1] >= d[2] AND d[1] >= d[3] THEN 1 WHEN d[2] >= d[3] THEN 2 ELSE 3 END AS m, unnest([1, 2, 3]) AS j FROM l)
SELECT g AS "group", node AS node_id, j AS eq, unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest([node, node, a, a, b, b]) AS node, unnest([j, m, j, m, j, m]) AS dof,
  unnest([round(pb[m] - pa[m], 4) + 0.0, round(pa[j] - pb[j], 4) + 0.0, round(p[m] - pb[m], 4) + 0.0, round(pb[j] - p[j], 4) + 0.0, round(pa[m] - p[m], 4) + 0.0, round(p[j] - pa[j], 4) + 0.0]) AS coef FROM m WHERE j <> m
""")
def straight_links(spark, sf_dir):
    """Terms that keep a group's nodes on the line through its first and last."""
    s = _spots(spark, sf_dir)
    e = s.groupBy("group").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    ends = _named(s, e.select("group", "a"), "a").join(_named(s, e.select("group", "b"), "b"), "group")
    rest = s.join(e, "group").filter("node not in (a, b)").select(*s.columns)
    return constraints.straight_links(rest, ends).withColumn("coef", F.round("coef", 4) + 0.0)


@query(f"""
WITH {_SPOTS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY node) AS r FROM n),
r AS (SELECT n.g, n.node, n.p AS pp, a.node AS a, b.node AS b, c.node AS c, a.p AS pa, b.p AS pb, c.p AS pc FROM k n JOIN k a ON a.g = n.g AND a.r = 1 JOIN k b ON b.g = n.g AND b.r = 2 JOIN k c ON c.g = n.g AND c.r = 3 WHERE n.r > 3),
v AS (SELECT *, list_transform(range(1, 4), lambda i: pp[i] - pc[i]) AS x, list_transform(range(1, 4), lambda i: pa[i] - pc[i]) AS u, list_transform(range(1, 4), lambda i: pb[i] - pc[i]) AS w FROM r),
s AS (SELECT *, list_transform(range(1, 4), lambda i: u[i % 3 + 1] * w[(i + 1) % 3 + 1] - u[(i + 1) % 3 + 1] * w[i % 3 + 1]) AS cp, list_transform(range(1, 4), lambda i: w[i % 3 + 1] * x[(i + 1) % 3 + 1] - w[(i + 1) % 3 + 1] * x[i % 3 + 1]) AS ca,
  list_transform(range(1, 4), lambda i: x[i % 3 + 1] * u[(i + 1) % 3 + 1] - x[(i + 1) % 3 + 1] * u[i % 3 + 1]) AS cb FROM v),
j AS (SELECT *, CASE WHEN abs(cp[1]) >= abs(cp[2]) AND abs(cp[1]) >= abs(cp[3]) THEN 1 WHEN abs(cp[2]) >= abs(cp[3]) THEN 2 ELSE 3 END AS j FROM s),
t AS (SELECT *, unnest(range(0, 12)) AS q FROM j)
SELECT g AS "group", node AS node_id, (q + 1)::INTEGER AS pos, [node, a, b, c][q // 3 + 1] AS node, ((j + q % 3 - 1) % 3 + 1)::INTEGER AS dof,
  round(CASE q // 3 WHEN 0 THEN cp[(j + q % 3 - 1) % 3 + 1] WHEN 1 THEN ca[(j + q % 3 - 1) % 3 + 1] WHEN 2 THEN cb[(j + q % 3 - 1) % 3 + 1] ELSE -(cp[(j + q % 3 - 1) % 3 + 1] + ca[(j + q % 3 - 1) % 3 + 1] + cb[(j + q % 3 - 1) % 3 + 1]) END, 2) + 0.0 AS coef FROM t
""")
def plane_links(spark, sf_dir):
    """Terms that keep a group's nodes in the plane of its first three."""
    s = _spots(spark, sf_dir)
    k = ordering.ranked_within(s, ["group"], ["node"], "r")
    corner = lambda r, side: _named(s, k.filter(F.col("r") == r).select("group", F.col("node").alias(side)), side)
    corners = corner(1, "a").join(corner(2, "b"), "group").join(corner(3, "c"), "group")
    return constraints.plane_links(k.filter("r > 3").drop("r"), corners).withColumn("coef", F.round("coef", 2) + 0.0)


@query("""
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS pair, l_partkey AS a, l_suppkey AS b, l_quantity - 10.0 AS dx, l_discount * 100 - 5 AS dy, l_tax * 100 - 4 AS dz, l_extendedprice / 2000 AS dist FROM lineitem),
r AS (SELECT pair, a, b, [dx, dy, dz] AS d, dx * dx + dy * dy + dz * dz - dist * dist AS f FROM (SELECT DISTINCT * FROM d))
SELECT pair, round(greatest(f, 0.0), 4) AS residual, f >= 0 AS linked, unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest([a, a, a, b, b, b]) AS node, unnest([1, 2, 3, 1, 2, 3]) AS dof,
  unnest([round(2 * d[1], 4), round(2 * d[2], 4), round(2 * d[3], 4), round(-2 * d[1], 4) + 0.0, round(-2 * d[2], 4) + 0.0, round(-2 * d[3], 4) + 0.0]) AS coef FROM r
""")
def distance_links(spark, sf_dir):
    """Terms that keep pairs of nodes no farther apart than a distance."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), F.col("l_partkey").alias("a"), (F.col("l_quantity") - 10.0).alias("ax"), (F.col("l_discount") * 100 - 5).alias("ay"), (F.col("l_tax") * 100 - 4).alias("az"), F.col("l_suppkey").alias("b"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(0.0).alias("bz"), (F.col("l_extendedprice") / 2000).alias("distance")).distinct()
    return constraints.distance_links(pairs).withColumns({"coef": F.round("coef", 4) + 0.0, "residual": F.round("residual", 4)})


@query(f"""
WITH {_SPOTS}, c AS (SELECT g, avg(p[1]) AS c1, avg(p[2]) AS c2, avg(p[3]) AS c3, count(*) AS n, var_pop(p[1]) + var_pop(p[2]) + var_pop(p[3]) AS v FROM n GROUP BY g),
d AS (SELECT n.g, node, n.p[1] - c1 AS x, n.p[2] - c2 AS y, c.n, v FROM n JOIN c USING (g)),
w AS (SELECT *, CASE WHEN x * x + y * y <= v * 1e-10 THEN 0.0 ELSE -y / (x * x + y * y) END AS wx, CASE WHEN x * x + y * y <= v * 1e-10 THEN 0.0 ELSE x / (x * x + y * y) END AS wy FROM d),
t AS (SELECT *, wx - sum(wx) OVER (PARTITION BY g) / n AS kx, wy - sum(wy) OVER (PARTITION BY g) / n AS ky FROM w)
SELECT g AS "group", node, unnest([1, 2, 3]) AS dof, unnest([round(kx, 7) + 0.0, round(ky, 7) + 0.0, 0.0]) AS coef FROM t
""")
def mean_rotation(spark, sf_dir):
    """Coefficients of the mean rotation of groups of nodes about the z axis."""
    s = _spots(spark, sf_dir)
    axes = s.select("group").distinct().select("group", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(2.0).alias("az"))
    return constraints.mean_rotation(s, axes).withColumn("coef", F.round("coef", 7) + 0.0)


@query(f"""
WITH {_SPOTS}, m AS (SELECT g, count(*) AS k FROM n GROUP BY g HAVING count(*) > 2)
SELECT g AS "group", unnest([1, 2, 3, 4, 5, 6]) AS term, unnest([round(1 + 2 * avg(p[3]) - 3 * avg(p[2]), 5), round(2 + 3 * avg(p[1]) - avg(p[3]), 5), round(3 + avg(p[2]) - 2 * avg(p[1]), 5), 1.0, 2.0, 3.0]) AS motion FROM n JOIN m USING (g) GROUP BY g
""")
def distributing_coupling(spark, sf_dir):
    """Mean displacement and rotation of groups of nodes that move as a rigid body, which is what comes back: shift (1, 2, 3), rotation (1, 2, 3)."""
    s = _spots(spark, sf_dir).withColumn("weight", F.lit(1.0))
    many = s.groupBy("group").count().filter("count > 2").select("group")
    s = s.join(many, "group")
    c = constraints.distributing_coupling(s)
    u = [F.lit(1.0) + 2 * F.col("z") - 3 * F.col("y"), F.lit(2.0) + 3 * F.col("x") - F.col("z"), F.lit(3.0) + F.col("y") - 2 * F.col("x")]
    moved = s.select("node", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("dof"), v.alias("u")) for k, v in enumerate(u)])).alias("m")).select("node", "m.*")
    return c.join(moved, ["node", "dof"]).groupBy("group", "term").agg(F.round(F.sum(F.col("coef") * F.col("u")), 5).alias("motion"))


def _triangles(spark, sf_dir):
    """Two triangles per part, in a grid of squares; see triangle_neighbours."""
    p = F.col("p_partkey")
    at = lambda i, j: F.struct(((p % 50 + i) * 1000000 + F.floor(p / 50) + j).alias("node"), (p % 50 + i).cast("double").alias("x"), (F.floor(p / 50) + j).cast("double").alias("y"), F.lit(0.0).alias("z"))
    both = F.array(F.struct(F.lit(0).alias("k"), F.array(at(0, 0), at(1, 0), at(1, 1)).alias("corners")), F.struct(F.lit(1).alias("k"), F.array(at(0, 0), at(1, 1), at(0, 1)).alias("corners")))
    return table(spark, sf_dir, "part").select(p, F.explode(both).alias("t")).select((p * 2 + F.col("t.k")).alias("face"), "t.corners")


_TIED = """
WITH s AS (SELECT p_partkey AS id, p_partkey % 50 AS i, p_partkey // 50 AS j, 0.25 + 0.2 * (p_partkey % 3) AS fx, 0.4 AS fy FROM part),
t AS (SELECT id, id * 2 + CASE WHEN fx > fy THEN 0 ELSE 1 END AS face, CASE WHEN fx > fy THEN [i * 1000000 + j, (i + 1) * 1000000 + j, (i + 1) * 1000000 + j + 1] ELSE [i * 1000000 + j, (i + 1) * 1000000 + j + 1, i * 1000000 + j + 1] END AS nodes,
  CASE WHEN fx > fy THEN [1 - fx, fx - fy, fy] ELSE [1 - fy, fx, fy - fx] END AS w FROM s)
SELECT id, face, 0.1::DOUBLE AS gap, unnest(nodes) AS node, unnest(list_transform(w, lambda x: round(x::DOUBLE, 6))) AS coef FROM t
"""


def _above(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("id"), (p % 50 + 0.25 + (p % 3) * 0.2).alias("x"), (F.floor(p / 50) + 0.4).cast("double").alias("y"), F.lit(0.1).alias("z"))


@query(_TIED)
def tied_contact(spark, sf_dir):
    """Slave nodes above a plane of triangles follow the corners below them."""
    out = constraints.tied(_above(spark, sf_dir), _triangles(spark, sf_dir), 0.2)
    return out.withColumns({"gap": F.round("gap", 6), "coef": F.round("coef", 6)})


@query(_TIED)
def cyclic_ties(spark, sf_dir):
    """The same nodes, a quarter turn away, tied to the plane as the next sector's."""
    turned = _above(spark, sf_dir).select("id", F.col("y").alias("x"), (-F.col("x")).alias("y"), "z")
    out = constraints.cyclic(turned, _triangles(spark, sf_dir), 4, 0.2)
    return out.withColumns({"gap": F.round("gap", 6), "coef": F.round("coef", 6)})


@query("""
WITH s AS (SELECT s_suppkey AS elem, (s_suppkey % 10)::DOUBLE AS ox, (s_suppkey // 10)::DOUBLE AS oy FROM supplier), k AS (SELECT unnest([0.2, -0.5]) AS z)
SELECT elem * 2 + CASE WHEN z > 0 THEN 0 ELSE 1 END AS id, elem, round((ox + 0.2) + 2 * (oy + 0.2) + 3 * greatest(z, 0.0), 6)::DOUBLE AS value, CASE WHEN z > 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS distance FROM s, k
""")
def submodel_boundary(spark, sf_dir):
    """A field of tetrahedra (one per supplier) at points within them and below them."""
    k = F.col("s_suppkey")
    ox, oy = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    corner = lambda dx, dy, dz: F.struct((ox + dx).alias("x"), (oy + dy).alias("y"), F.lit(float(dz)).alias("z"), (ox + dx + (oy + dy) * 2 + 3.0 * dz).alias("value"))
    s = table(spark, sf_dir, "supplier")
    tets = s.select(F.col("s_suppkey").alias("elem"), F.array(corner(0, 0, 0), corner(1, 0, 0), corner(0, 1, 0), corner(0, 0, 1)).alias("corners"))
    points = s.select(F.explode(F.array(*[F.struct((F.col("s_suppkey") * 2 + i).alias("id"), (ox + 0.2).alias("x"), (oy + 0.2).alias("y"), F.lit(z).alias("z")) for i, z in ((0, 0.2), (1, -0.5))])).alias("p")).select("p.*")
    return locate.transfer(points, tets, 1.0).withColumns({"value": F.round("value", 6), "distance": F.round("distance", 6)})


def _values(rows):
    return ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)


_SIDE = lambda c, p: f"(CASE WHEN {c} = {p} THEN {results.NEAR!r} ELSE {results.FAR!r} END)::DOUBLE"


@query(f"""
WITH e AS (SELECT p_partkey AS elem, p_partkey % 16 AS cx, (p_partkey // 16) % 16 AS cy, p_partkey // 256 AS cz FROM part),
c(c, sx, sy, sz) AS (VALUES {_values((i, *s) for i, s in enumerate(results.CORNER_SIGNS))}), q(ip, px, py, pz) AS (VALUES {_values((i + 1, *s) for i, s in enumerate(results.POINT_SIGNS))}),
v AS (SELECT elem, c, any_value(((cx + (sx + 1) // 2) * 1024 + cy + (sy + 1) // 2) * 1024 + cz + (sz + 1) // 2) AS node, sum(((elem * 7 + ip * 3) % 11)::DOUBLE * {_SIDE('sx', 'px')} * {_SIDE('sy', 'py')} * {_SIDE('sz', 'pz')}) AS v FROM e, c, q GROUP BY elem, c)
SELECT node, round(avg(v), 5) + 0.0 AS value, count(*) AS n FROM v GROUP BY node
""")
def extrapolated_nodes(spark, sf_dir):
    """Values at a brick's integration points taken to its corners, and the mean over bricks."""
    p = F.col("p_partkey")
    node = lambda s: ((p % 16 + (s[0] + 1) // 2) * 1024 + F.floor(p / 16) % 16 + (s[1] + 1) // 2) * 1024 + F.floor(p / 256) + (s[2] + 1) // 2
    elements = table(spark, sf_dir, "part").select(p.alias("elem"), F.array(*[node(s) for s in results.CORNER_SIGNS]).alias("nodes"))
    points = elements.select("elem", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ip")).withColumn("value", ((F.col("elem") * 7 + F.col("ip") * 3) % 11).cast("double"))
    return results.extrapolate(elements, points, results.brick_matrix()).select("node", (F.round("value", 5) + 0.0).alias("value"), F.col("n_contributions").alias("n"))


@query("""
WITH p AS (SELECT l_linestatus, l_quantity AS a, l_linenumber::DOUBLE AS x, l_tax * 10 AS y, l_discount * 10 AS z, l_tax AS tx, 1.0 AS ty, l_discount AS tz, CASE WHEN l_linenumber % 2 = 0 THEN 0.6 ELSE 0.0 END AS nx, 0.8 AS ny, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE 0.6 END AS nz FROM lineitem),
s AS (SELECT l_linestatus, sum(a) AS area, sum(a * tx) AS fx, sum(a * ty) AS fy, sum(a * tz) AS fz, sum(a * (y * tz - z * ty)) AS mx, sum(a * (z * tx - x * tz)) AS my, sum(a * (x * ty - y * tx)) AS mz, sum(a * x) / sum(a) AS cx, sum(a * y) / sum(a) AS cy, sum(a * z) / sum(a) AS cz,
  sum(a * nx) / sum(a) AS nx, sum(a * ny) / sum(a) AS ny, sum(a * nz) / sum(a) AS nz FROM p GROUP BY l_linestatus),
g AS (SELECT *, mx - cy * fz + cz * fy AS gx, my - cz * fx + cx * fz AS gy, mz - cx * fy + cy * fx AS gz, fx * nx + fy * ny + fz * nz AS fn FROM s),
t AS (SELECT *, gx * nx + gy * ny + gz * nz AS tq FROM g)
SELECT l_linestatus, round(area, 2) AS area, round(cx, 6) AS cg_x, round(ny, 6) AS n_y, round(gx, 3) AS mcg_x, round(fn, 3) AS normal_force, round(sqrt((fx - fn * nx) ** 2 + (fy - fn * ny) ** 2 + (fz - fn * nz) ** 2), 3) AS shear_force, round(tq, 3) AS torque,
  round(sqrt((gx - tq * nx) ** 2 + (gy - tq * ny) ** 2 + (gz - tq * nz) ** 2), 3) AS bending FROM t
""")
def section_statistics(spark, sf_dir):
    """A section's centre, mean normal, normal and shear force, torque and bending moment."""
    odd = F.col("l_linenumber") % 2
    p = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("a"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_discount") * 10).alias("z"), F.col("l_tax").alias("tx"), F.lit(1.0).alias("ty"), F.col("l_discount").alias("tz"), F.when(odd == 0, 0.6).otherwise(0.0).alias("nx"), F.lit(0.8).alias("ny"), F.when(odd == 0, 0.0).otherwise(0.6).alias("nz"))
    digits = {"area": 2, "cg_x": 6, "n_y": 6, "mcg_x": 3, "normal_force": 3, "shear_force": 3, "torque": 3, "bending": 3}
    return results.section_statistics(p, ["l_linestatus"]).select("l_linestatus", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("""
WITH s AS (SELECT l_orderkey AS elem, l_partkey AS node, l_quantity - 25 AS xx, l_linenumber::DOUBLE AS yy, l_tax * 100 AS zz, l_discount * 10 AS xy, l_discount * l_quantity AS xz, 1.0 AS yz FROM lineitem),
d AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s), e AS (SELECT *, xx - m AS a, yy - m AS b, zz - m AS c FROM d),
j AS (SELECT *, sqrt(((a * a + b * b + c * c) / 2 + xy * xy + xz * xz + yz * yz) / 3) AS r, a * b * c + 2 * xy * xz * yz - a * yz * yz - b * xz * xz - c * xy * xy AS j3 FROM e),
t AS (SELECT *, acos(greatest(-1.0, least(1.0, j3 / (2 * r * r * r)))) / 3 AS th FROM j),
p AS (SELECT elem, min(m + 2 * r * cos(th + 2 * pi() / 3)) AS lo1, max(m + 2 * r * cos(th + 2 * pi() / 3)) AS hi1, min(m + 2 * r * cos(th)) AS lo3, max(m + 2 * r * cos(th)) AS hi3 FROM t GROUP BY elem),
x AS (SELECT elem, CASE WHEN hi3 >= -lo1 THEN lo3 ELSE lo1 END AS lo, CASE WHEN hi3 >= -lo1 THEN hi3 ELSE hi1 END AS hi FROM p)
SELECT node, round(max(hi - lo), 4) AS spread, round(max((hi - lo) / greatest(abs(hi), abs(lo))), 6) AS relative FROM (SELECT DISTINCT elem, node FROM s) JOIN x USING (elem) GROUP BY node
""")
def principal_error(spark, sf_dir):
    """Per node the largest spread of its elements' dominant principal stress."""
    li = table(spark, sf_dir, "lineitem")
    tensors = li.select(F.col("l_orderkey").alias("elem"), (F.col("l_quantity") - 25).alias("xx"), F.col("l_linenumber").cast("double").alias("yy"), (F.col("l_tax") * 100).alias("zz"), (F.col("l_discount") * 10).alias("xy"), (F.col("l_discount") * F.col("l_quantity")).alias("xz"), F.lit(1.0).alias("yz"))
    out = results.principal_error(tensors, li.select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node")).distinct())
    return out.select("node", F.round("spread", 4).alias("spread"), F.round("relative", 6).alias("relative"))


@query("""
SELECT l_returnflag, round(sum(l_quantity), 2) AS volume, round(sum(l_quantity * (1 + l_tax)), 3) AS mass, round(sum(l_quantity * l_discount), 3) AS internal, round(sum(0.5 * l_quantity * (1 + l_tax) * l_tax * l_tax), 4) AS kinetic, round(sum(l_quantity * l_discount * 2), 3) AS heating FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def element_totals(spark, sf_dir):
    """Volume, mass, energies and heating of parts of the model and of all."""
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("v"), (F.col("l_tax") + 1).alias("density"), F.col("l_discount").alias("energy"), (F.col("l_tax") * F.col("l_tax")).alias("speed2"), (F.col("l_discount") * 2).alias("heat"))
    digits = {"volume": 2, "mass": 3, "internal": 3, "kinetic": 4, "heating": 3}
    return results.element_totals(p, ["l_returnflag"]).select("l_returnflag", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("SELECT s_suppkey, round(-0.3 * 2.5 * greatest(40 - s_suppkey % 50, 0), 6) + 0.0 AS sxx, round(-2.5 * greatest(40 - s_suppkey % 50, 0), 6) + 0.0 AS szz FROM supplier".replace("round(", "round((").replace(", 6)", ")::DOUBLE, 6)"))
def initial_stress(spark, sf_dir):
    """Initial stresses from a hook, at places."""
    s = table(spark, sf_dir, "supplier")
    out = hooks.initial_state("geostatic", s.select("s_suppkey"), ["sxx", "syy", "szz"], (F.col("s_suppkey") % 50).cast("double"), F.lit(40.0), F.lit(2.5), F.lit(0.3))
    return out.select("s_suppkey", (F.round("sxx", 6) + 0.0).alias("sxx"), (F.round("szz", 6) + 0.0).alias("szz"))


@query("SELECT DISTINCT l_discount, l_tax, round(CASE WHEN l_discount - 0.05 <= 0 THEN 200 * (1 + l_tax) ELSE 200 * exp(-(l_discount - 0.05) / 0.02) END, 5) AS conductance FROM lineitem")
def gap_conductance(spark, sf_dir):
    """The conductance of gaps from a hook."""
    pairs = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax").distinct()
    value = hooks.scalar("gap_conductance", F.col("l_discount") - 0.05, F.col("l_tax"), F.lit(200.0), F.lit(0.02))
    return pairs.select("l_discount", "l_tax", F.round(value, 5).alias("conductance"))


@query("""
WITH t AS (SELECT s_suppkey // 8 AS mpc, s_suppkey % 8 AS pos, s_suppkey AS dof, s_acctbal AS x FROM supplier),
f AS (SELECT *, first_value(x) OVER w AS x0, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY mpc ORDER BY pos)),
d AS (SELECT *, CASE WHEN r > 1 THEN 1 / (abs(x - x0) + 1) END AS k FROM f)
SELECT mpc, pos, dof, round(CASE WHEN r = 1 THEN 1.0 ELSE -k / sum(k) OVER (PARTITION BY mpc) END, 8) AS coef FROM d
""")
def user_constraint(spark, sf_dir):
    """Constraints whose coefficients a hook gives."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(F.floor(k / 8).alias("mpc"), (k % 8).alias("pos"), k.alias("dof"), F.col("s_acctbal").alias("x"))
    return hooks.constraint("nearest_shares", t, "mpc long, pos long, dof long, coef double").withColumn("coef", F.round("coef", 8))


@query("""
WITH m AS (SELECT s_nationkey AS deck, s_suppkey * 2 AS line, '*NODE' AS value FROM supplier UNION ALL SELECT s_nationkey, s_suppkey * 2 + 1, '*INCLUDE, INPUT=f' || (s_suppkey % 5) FROM supplier)
SELECT deck, CAST(line AS VARCHAR) AS path, value FROM m WHERE value = '*NODE'
UNION ALL SELECT deck, line || '.1', n_name FROM m JOIN nation ON value = '*INCLUDE, INPUT=f' || n_nationkey
UNION ALL SELECT deck, line || '.2.1', '9, ' || n_regionkey FROM m JOIN nation ON value = '*INCLUDE, INPUT=f' || n_nationkey
""")
def deck_include(spark, sf_dir):
    """Decks whose included files include others."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    lines = s.select(F.col("s_nationkey").alias("deck"), F.explode(F.array(F.struct((k * 2).alias("line"), F.lit("*NODE").alias("value")), F.struct((k * 2 + 1).alias("line"), F.concat(F.lit("*INCLUDE, INPUT=f"), (k % 5).cast("string")).alias("value")))).alias("l")).select("deck", "l.*")
    key = F.col("n_nationkey").cast("string")
    line = lambda name, at, value: F.struct(F.concat(F.lit(name), key).alias("name"), F.lit(at).alias("line"), value.alias("value"))
    files = n.select(F.explode(F.array(line("f", 1, F.col("n_name")), line("f", 2, F.concat(F.lit("*Include, input = g"), key)), line("g", 1, F.concat(F.lit("9, "), F.col("n_regionkey").cast("string"))))).alias("f")).select("f.*")
    return deck.include_all(lines, files).select("deck", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "value")


_CARDS = [("*RESTART", 18), ("*NODE", 1), ("*USERELEMENT", 2), ("*ELEMENT", 3), ("*MATRIXASSEMBLE", 4), ("*NSET", 5), ("*ELSET", 6), ("*SURFACE", 7), ("*TRANSFORM", 8), ("*ELASTIC", 9), ("*DISTRIBUTION", 10), ("*ORIENTATION", 11), ("*TIE", 12), ("*SURFACEINTERACTION", 13), ("*INITIALCONDITIONS", 14), ("*AMPLITUDE", 15), ("*CONTACTPAIR", 16), ("*COUPLING", 17), ("*STEP", 18), ("*NODEPRINT", 18), ("*ELEMENTOUTPUT", 18), ("*FRICTION", 13), ("*USERMATERIAL", 9), ("*EQUATION", 18)]


@query(f"""
WITH c(k, card, rank) AS (VALUES {', '.join(f"({k}, '{c}', {r})" for k, (c, r) in enumerate(_CARDS))})
SELECT p_partkey, card, CASE WHEN card = '*RESTART' AND p_partkey % 48 = 0 THEN 0 ELSE rank END AS rank FROM part JOIN c ON k = p_partkey % 24
""")
def card_classes(spark, sf_dir):
    """The place of every kind of card in the order in which cards are taken."""
    p = F.col("p_partkey")
    names = F.array(*[F.lit(c) for c, _ in _CARDS])
    rows = table(spark, sf_dir, "part").select(p, F.element_at(names, (p % 24 + 1).cast("int")).alias("card"), F.array(F.lit("X"), F.when(p % 48 == 0, "READ").otherwise("WRITE")).alias("fields"))
    return rows.select("p_partkey", "card", deck.card_rank(F.col("card"), F.col("fields")).alias("rank"))


@query("""
WITH q AS (SELECT DISTINCT p_brand, l_linenumber * 1.5::DOUBLE AS t, l_quantity::DOUBLE AS x FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT p_brand, t, x, round(10 * t + x, 6) AS y FROM q
""")
def table_two_ways(spark, sf_dir):
    """A grid over temperature and strain, linear in both, and continued beyond its ends."""
    part = table(spark, sf_dir, "part")
    grid = part.select("p_brand").distinct().withColumn("t", F.explode(F.array(F.lit(2.0), F.lit(3.0), F.lit(7.0)))).withColumn("x", F.explode(F.array(F.lit(4.0), F.lit(8.0), F.lit(40.0))))
    points = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", (F.col("l_linenumber") * 1.5).alias("t"), F.col("l_quantity").cast("double").alias("x")).distinct()
    out = lookup.tabulated_two(points, grid.withColumn("y", F.col("t") * 10 + F.col("x")), ["p_brand"], "x", "t", "y", low=(lookup.LINEAR, lookup.LINEAR), high=(lookup.LINEAR, lookup.LINEAR))
    return out.select("p_brand", "t", "x", F.round("y", 6).alias("y"))


@query("SELECT l_partkey AS i, l_suppkey AS j, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL")
def assemble_asymmetric(spark, sf_dir):
    """Contributions summed over a whole matrix."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    return sparse.assemble(rows, symmetric=False).withColumn("v", F.round("v", 2))


@query("""
WITH c AS (SELECT event_id, value * 1e-5 AS e, value * 1e-6 AS g FROM events)
SELECT event_id, round(200000 / 2.6 * 2 * e + 200000 * 0.3 / (1.3 * 0.4) * e, 6) AS sxx, round(200000 * 0.3 / (1.3 * 0.4) * e, 6) AS syy, round(200000 / 2.6 * 2 * g, 6) AS sxy FROM c
""")
def elastic_stress(spark, sf_dir):
    """Stresses of a material law, in batches of points."""
    e = table(spark, sf_dir, "events")
    zero = F.lit(0.0)
    points = e.select(F.col("event_id").alias("id"), F.lit(200000.0).alias("young"), F.lit(0.3).alias("poisson"), F.array(F.col("value") * 1e-5, zero, zero, F.col("value") * 1e-6, zero, zero).alias("e"))
    s = hooks.material("elastic", points, "id long, s array<double>")
    return s.select(F.col("id").alias("event_id"), *[F.round(F.col("s")[k], 6).alias(n) for k, n in ((0, "sxx"), (1, "syy"), (3, "sxy"))])


@query("SELECT s_suppkey, round(sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey), 6) AS size FROM supplier")
def loaded_hook(spark, sf_dir):
    """A hook loaded by the name of its module and function."""
    size = hooks.scalar(hooks.load("numpy:hypot"), F.col("s_acctbal"), F.col("s_suppkey").cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(size, 6).alias("size"))
