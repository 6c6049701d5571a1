"""Queries of errors, contact prints, frames, assembly by joins, and solvers with closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import constraints, results, sparse, spatial
from tessera.plans.catalog import query
from tessera.plans.fields import _POINTS, _points
from tessera.plans.relational import table


@query("""
WITH s AS (SELECT l_orderkey AS elem, max(l_quantity) - min(l_quantity) AS d, max(l_quantity) AS m FROM lineitem GROUP BY l_orderkey),
n AS (SELECT l_partkey AS node, max(d / m) AS relative FROM lineitem JOIN s ON elem = l_orderkey GROUP BY l_partkey),
t AS (SELECT DISTINCT l_partkey AS node, l_linenumber % 4 AS t FROM lineitem)
SELECT node, round(relative, 6) AS relative, round(max(CASE t WHEN 0 THEN 30 * relative WHEN 1 THEN CASE WHEN relative <= 0.26 THEN 5.115 * relative ELSE 27.792 * relative - 5.895 END WHEN 2 THEN 46.189 * relative END), 4) AS error FROM n JOIN t USING (node) GROUP BY node, relative
""")
def error_per_cent(spark, sf_dir):
    """Estimated errors in per cent at nodes, by the types of their elements; one type has no line."""
    li = table(spark, sf_dir, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node")).distinct()
    spread = results.error_estimate(li.select(F.col("l_orderkey").alias("elem"), F.col("l_quantity").alias("value")), nodes).select("node", "relative")
    kind = F.element_at(F.array(*map(F.lit, ("tet10", "brick20", "wedge15", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    out = results.error_per_cent(spread, li.select(F.col("l_partkey").alias("node"), kind.alias("type")))
    return out.select("node", F.round("relative", 6).alias("relative"), F.round("error", 4).alias("error"))


@query("""
WITH c AS (SELECT l_linestatus AS side, l_linenumber AS pair, l_quantity AS a, CAST(l_partkey % 11 AS DOUBLE) AS x, CAST(l_suppkey % 7 AS DOUBLE) AS y, 2.0 AS z, (l_discount - 0.03) * 100 AS p, l_tax AS tx, l_tax * 2 AS ty, l_tax - 0.02 AS clearance, l_discount AS energy FROM lineitem),
t AS (SELECT *, tx AS fx, ty AS fy, -p AS fz FROM c WHERE p > 0),
s AS (SELECT side, pair, sum(a) AS area, sum(a * fx) AS fx, sum(a * fy) AS fy, sum(a * fz) AS fz, sum(a * (y * fz - z * fy)) AS mx, sum(a * (z * fx - x * fz)) AS my, sum(a * x) / sum(a) AS cgx, sum(a * y) / sum(a) AS cgy FROM t GROUP BY ALL),
n AS (SELECT side, pair, count(*) AS n_contacts, count(*) FILTER (p > 0) AS n_closed, max(CASE WHEN p > 0 THEN p END) AS most, min(clearance) AS least, sum(CASE WHEN p > 0 THEN energy * a END) AS energy FROM c GROUP BY ALL)
SELECT side, pair, n_contacts, n_closed, round(most, 6) AS most_pressure, round(least, 6) AS least_clearance, round(energy, 3) AS energy, round(area, 2) AS area, round(fz, 2) AS fz, round(mx, 1) AS mx, round(my, 1) AS my, round(mx - cgy * fz + 2 * fy, 1) AS mcg_x, round(fz, 2) AS normal_force, round(sqrt(fx * fx + fy * fy), 3) AS shear_force FROM n JOIN s USING (side, pair)
""")
def contact_statistics(spark, sf_dir):
    """The print of contacts: forces, moments, centre, area, pressure, clearance and energy per pair."""
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_linestatus").alias("side"), F.col("l_linenumber").alias("pair"), F.col("l_quantity").alias("a"), (F.col("l_partkey") % 11).cast("double").alias("x"), (F.col("l_suppkey") % 7).cast("double").alias("y"), F.lit(2.0).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), ((F.col("l_discount") - 0.03) * 100).alias("pressure"), F.col("l_tax").alias("tx"), (F.col("l_tax") * 2).alias("ty"), F.lit(0.0).alias("tz"), (F.col("l_tax") - 0.02).alias("clearance"), F.col("l_discount").alias("energy"))
    digits = {"most_pressure": 6, "least_clearance": 6, "energy": 3, "area": 2, "fz": 2, "mx": 1, "my": 1, "mcg_x": 1, "normal_force": 2, "shear_force": 3}
    out = results.contact_print(c, ["side", "pair"])
    return out.select("side", "pair", "n_contacts", "n_closed", *[F.round(k, d).alias(k) for k, d in digits.items()])


@query("""
WITH v AS (SELECT c_custkey AS id, c_custkey % 3 AS frame, CAST(c_custkey % 7 AS DOUBLE) AS x, CAST(c_custkey % 5 - 2 AS DOUBLE) AS y, c_acctbal AS vx, CAST(c_nationkey AS DOUBLE) AS vy, 1.5 AS vz FROM customer),
r AS (SELECT *, sqrt(x * x + y * y) AS r FROM v)
SELECT id, frame, round(CASE frame WHEN 0 THEN vy WHEN 1 THEN CASE WHEN r > 0 THEN (x * vx + y * vy) / r ELSE vx END ELSE vx END, 4) AS v1, round(CASE frame WHEN 0 THEN -vx WHEN 1 THEN CASE WHEN r > 0 THEN (x * vy - y * vx) / r ELSE vy END ELSE vy END, 4) AS v2, round(vz, 4) AS v3 FROM r
""")
def local_frames(spark, sf_dir):
    """Vectors in a rectangular and a cylindrical frame, or in none, by a table of frames."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    v = c.select(k.alias("id"), (k % 3).alias("frame"), (k % 7).cast("double").alias("x"), (k % 5 - 2).cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("c_acctbal").alias("vx"), F.col("c_nationkey").cast("double").alias("vy"), F.lit(1.5).alias("vz"))
    frames = spark.createDataFrame([(0, "R", 0.0, 1.0, 0.0, -1.0, 1.0, 0.0), (1, "C", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "frame long, kind string, ax double, ay double, az double, bx double, by double, bz double")
    return spatial.in_frames(v, frames).select("id", "frame", *[F.round(f"v{k}", 4).alias(f"v{k}") for k in (1, 2, 3)])


@query("""
WITH m AS (SELECT l_orderkey AS elem, l_linenumber AS pos, min(l_partkey) AS dof, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT greatest(a.dof, b.dof) AS i, least(a.dof, b.dof) AS j, round(sum(a.q * b.q + CASE WHEN a.pos = b.pos THEN 10 ELSE 0 END), 2) AS v FROM m a JOIN m b USING (elem) GROUP BY ALL
""")
def assemble_elements(spark, sf_dir):
    """Element matrices summed into a lower triangle by joins."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("elem"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("dof"), F.sum("l_quantity").alias("q"))
    a, b = (m.select("elem", F.col("pos").alias(n), F.col("q").alias(f"q{n}")) for n in "ab")
    entries = a.join(b, "elem").select("elem", "a", "b", (F.col("qa") * F.col("qb") + F.when(F.col("a") == F.col("b"), 10).otherwise(0)).alias("v"))
    return sparse.assemble(sparse.scatter(entries, m.select("elem", "pos", "dof"))).withColumn("v", F.round("v", 2))


@query(f"WITH {_POINTS.replace('ON q.id % 50 = 0', 'ON true')} SELECT q_id AS id, round(sum((0.2 - sqrt(d2)) / 0.2 * (pv + 2) * pv) / sum((0.2 - sqrt(d2)) / 0.2 * (pv + 2)), 5) AS filtered FROM prs WHERE d2 <= 0.2 * 0.2 GROUP BY q_id")
def hat_filter_areas(spark, sf_dir):
    """The filter of every point, with values counted by the area that their points stand for."""
    p = _points(spark, sf_dir).withColumn("area", F.col("value") + 2)
    return spatial.hat_filter_all(p, 0.2, "value", area="area").select("id", F.round("filtered", 5).alias("filtered"))


def _star(spark, sf_dir):
    """All suppliers joined with one hub: a graph whose spectrum is 0, 1 and the number of its nodes."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").cast("double").alias("b"))
    hub = s.agg(F.min("i")).first()[0]
    edges = s.filter(F.col("i") != hub).select("i", F.lit(hub).alias("j"))
    return s, hub, edges


@query("SELECT count(*)::DOUBLE + 1 AS value, round(sqrt((count(*) - 1)::DOUBLE / count(*)), 6) AS at_hub FROM supplier")
def star_eigenpair(spark, sf_dir):
    """The largest eigenvalue of a star's Laplacian and the identity, and the size of its vector at the hub."""
    s, hub, edges = _star(spark, sf_dir)
    off = edges.select("i", "j", F.lit(-1.0).alias("v"))
    on = s.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")).unionByName(edges.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))).unionByName(edges.select(F.col("j").alias("i"), "j", F.lit(1.0).alias("v")))
    x, value = sparse.dominant_eigenpair(sparse.full(sparse.assemble(off)).unionByName(sparse.assemble(on)))
    return x.filter(F.col("i") == hub).select(F.round(F.lit(value), 6).alias("value"), F.round(F.abs("x"), 6).alias("at_hub"))


@query("""
WITH h AS (SELECT min(s_suppkey) AS hub, count(*) - 1 AS d FROM supplier), x AS (SELECT (sum(CASE WHEN s_suppkey = hub THEN s_acctbal ELSE s_acctbal / 2 END)) / (1 + max(d) - max(d) / 2.0) AS xh, max(hub) AS hub FROM supplier, h)
SELECT s_suppkey AS i, round(CASE WHEN s_suppkey = hub THEN xh ELSE (s_acctbal + xh) / 2 END, 4) AS x FROM supplier, x
""")
def star_solve(spark, sf_dir):
    """Conjugate gradients on the star's matrix against its closed form."""
    s, _, edges = _star(spark, sf_dir)
    return sparse.smooth(s, edges, 1.0, 1e-12).select("i", F.round("x", 4).alias("x"))


@query("SELECT DISTINCT l_partkey AS dep FROM lineitem WHERE l_linenumber = 1 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def fixed_and_dependent(spark, sf_dir):
    """Degrees of freedom that a constraint determines and that also have a prescribed value."""
    rules = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("dep"))
    return constraints.both_fixed_and_dependent(rules, table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("dof")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(0.9 * 0.3 * 0.4 * l_quantity * abs(l_discount - 0.05), 6) AS slave, round(0.9 * 0.7 * 0.4 * l_quantity * abs(l_discount - 0.05), 6) AS master, count(*) AS n FROM lineitem GROUP BY ALL
""")
def friction_heat(spark, sf_dir):
    """Heat of friction in contacts, in its parts for both sides."""
    args = [F.col("l_quantity"), F.lit(0.4), F.col("l_discount") - 0.05, F.lit(0.9), F.lit(0.3)]
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(hooks.scalar(f"friction_heat_{side}", *args), 6).alias(side) for side in ("slave", "master")])
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT s_suppkey % 4 AS mode, s_suppkey AS i, s_acctbal / 1000 AS x, s_suppkey % 3 AS axis FROM supplier),
m AS (SELECT i, j, m FROM (SELECT s_suppkey AS i, s_suppkey AS j, 2.0 AS m FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 12, 0.5 FROM supplier UNION ALL SELECT s_suppkey + 12, s_suppkey, 0.5 FROM supplier) WHERE i IN (SELECT s_suppkey FROM supplier) AND j IN (SELECT s_suppkey FROM supplier)),
y AS (SELECT p.mode, m.i, sum(m * x) AS y FROM m JOIN p ON p.i = m.j GROUP BY ALL),
s AS (SELECT y.mode, a.axis, sum(y) AS l, sum(CASE WHEN a.mode = y.mode THEN a.x * y ELSE 0 END) AS g FROM y JOIN p a USING (i) GROUP BY ALL)
SELECT mode, axis, round(l / sum(g) OVER (PARTITION BY mode), 6) AS participation, round(l * l / sum(g) OVER (PARTITION BY mode), 6) AS effective_mass FROM s
""")
def modal_mass_full(spark, sf_dir):
    """Participation of modes for a consistent mass."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    phi = s.select((k % 4).alias("mode"), k.alias("i"), (F.col("s_acctbal") / 1000).alias("x"), (k % 3).alias("axis"))
    keys = s.select(k.alias("i"))
    beside = keys.select("i", (F.col("i") + 12).alias("j")).join(keys.withColumnRenamed("i", "j"), "j", "left_semi")
    mass = keys.select("i", F.col("i").alias("j"), F.lit(2.0).alias("m")).unionByName(beside.select("i", "j", F.lit(0.5).alias("m"))).unionByName(beside.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.5).alias("m")))
    out = results.modal_mass_full(phi, mass)
    return out.select("mode", "axis", F.round("participation", 6).alias("participation"), F.round("effective_mass", 6).alias("effective_mass"))


@query("""
WITH p AS (SELECT l_orderkey AS pair, l_linenumber AS line, CAST(l_partkey % 13 AS DOUBLE) AS dx, CAST(l_suppkey % 11 AS DOUBLE) AS dy, CAST(l_quantity AS DOUBLE) AS dz, l_discount AS ux, l_tax AS uy FROM lineitem),
m AS (SELECT *, CASE WHEN dx >= dy AND dx >= dz THEN 1 WHEN dy >= dz THEN 2 ELSE 3 END AS m, [dx + ux, dy + uy, dz] AS now FROM p),
k AS (SELECT *, unnest([0, 1, 2]) AS k FROM m), t AS (SELECT *, (m - 1 + k) % 3 + 1 AS dof FROM k)
SELECT pair, line, dx, dy, dz, ux, uy, dof, round(2 * now[dof], 6) AS coef, round(2 * dx * ux + ux * ux + 2 * dy * uy + uy * uy, 6) AS residual, k + 1 AS pos, count(*) AS n FROM t GROUP BY ALL
""")
def beam_links(spark, sf_dir):
    """Links that keep their length: the terms of their first ends at displaced places."""
    li = table(spark, sf_dir, "lineitem")
    d = [(F.col("l_partkey") % 13).cast("double"), (F.col("l_suppkey") % 11).cast("double"), F.col("l_quantity").cast("double")]
    own = F.struct(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("line"), d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"), F.col("l_discount").alias("ux"), F.col("l_tax").alias("uy"))
    pairs = li.select(own.alias("pair"), F.lit(1).alias("a"), F.lit(2).alias("b"), *[(v + 1).alias(f"a{c}") for v, c in zip(d, "xyz", strict=True)], *[F.lit(1.0).alias(f"b{c}") for c in "xyz"], F.col("l_discount").alias("ux_a"), F.col("l_tax").alias("uy_a"))
    out = constraints.beam_links(pairs).filter("node = 1").select("pair.*", "dof", F.round("coef", 6).alias("coef"), F.round("residual", 6).alias("residual"), "pos")
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS node, 2.0 + l_partkey AS value, 2.0 + l_partkey AS curved, count(*) AS n_samples FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20")
def patch_recovery_solid(spark, sf_dir):
    """Values at nodes from polynomials of degree one and two in space over the samples around them, of fields that these hold exactly."""
    from tessera.operators import locate

    li = table(spark, sf_dir, "lineitem")
    x, y, z = F.col("l_discount") * 10, F.col("l_tax") * 10, F.sin(F.col("l_extendedprice"))
    linear, square = 2 + F.col("l_partkey") + x * 3 - y + z / 2, 2 + F.col("l_partkey") + x * y - z * z + x * 3
    at = li.select(F.col("l_partkey").alias("node"), x.alias("x"), y.alias("y"), z.alias("z"), linear.alias("value"), square.alias("square"))
    one = locate.patch_fit(at).filter("n_samples >= 20").select("node", F.round("value", 5).alias("value"), "n_samples")
    two = locate.patch_fit(at.drop("value").withColumnRenamed("square", "value"), degree=2).select("node", F.round("value", 4).alias("curved"))
    return one.join(two, "node").select("node", "value", "curved", "n_samples")


@query("""
WITH l AS (SELECT c_mktsegment AS segment, c_custkey AS k FROM customer)
SELECT segment, '*NODE' AS card, count(*) AS n_data, CAST(sum(k) AS BIGINT) AS total FROM l GROUP BY segment
""")
def deck_file(spark, sf_dir):
    """Decks written as text files, one per segment, and read block by block into cards and fields."""
    import uuid

    from tessera.scratch import shared_dir
    from tessera.sources import deck

    c = table(spark, sf_dir, "customer")
    lines = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k")).select("c_mktsegment", F.lit("*Node, nset=all").alias("value"), F.lit(-1).cast("long").alias("k")).unionByName(c.select("c_mktsegment", F.concat(F.col("c_custkey").cast("string"), F.lit(", 0., 1.5")).alias("value"), F.col("c_custkey").alias("k")))
    where = f"{shared_dir(spark)}/decks-{uuid.uuid4().hex}"
    ordered = lines.repartitionByRange("c_mktsegment").sortWithinPartitions("c_mktsegment", "k")
    ordered.select(F.col("c_mktsegment").alias("segment"), "value").write.partitionBy("segment").text(where)
    parsed = deck.parse(deck.read(spark, where)).filter("not is_card")
    named = parsed.withColumn("segment", F.regexp_extract("deck", "segment=([^/]*)", 1))
    return named.groupBy("segment", "card").agg(F.count("*").alias("n_data"), F.sum(F.col("fields")[0].cast("long")).alias("total"))


_G = "0.5854101966249685 AS p, 0.1381966011250105 AS q"


@query(f"""
WITH e AS (SELECT o_orderkey AS elem, o_custkey % 50 AS k, {_G} FROM orders),
c AS (SELECT elem, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS pos, k, unnest([k + 1.0, k + 5.0, k - 2.0, k + 8.0, k + 3.0, k + 1.5, k - 0.5, k + 4.5, k + 6.5, k + 3.0]) AS v FROM e)
SELECT elem * 10 + pos AS node, round(v, 6) AS value, 1 AS n_contributions FROM c
""")
def extrapolated_tets(spark, sf_dir):
    """Values of quadratic tetrahedra at their four integration points taken to all ten nodes."""
    k = F.col("o_custkey") % 50
    corner = [k + 1.0, k + 5.0, k - 2.0, k + 8.0]
    p, q = 0.5854101966249685, 0.1381966011250105
    o = table(spark, sf_dir, "orders")
    elements = o.select(F.col("o_orderkey").alias("elem"), F.array(*[F.col("o_orderkey") * 10 + n for n in range(10)]).alias("nodes"))
    at = [p * corner[i] + q * (corner[(i + 1) % 4] + corner[(i + 2) % 4] + corner[(i + 3) % 4]) for i in range(4)]
    points = o.select(F.col("o_orderkey").alias("elem"), F.posexplode(F.array(*at)).alias("ip", "value")).withColumn("ip", F.col("ip") + 1)
    from tessera.operators.curved import TETRAHEDRON_SIDES

    out = results.extrapolate(elements, points, results.tet_matrix(), TETRAHEDRON_SIDES)
    return out.select("node", F.round("value", 6).alias("value"), F.col("n_contributions").cast("int").alias("n_contributions"))


@query("""
WITH m AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), x AS (SELECT p_partkey AS j, p_retailprice / 1000 AS x FROM part WHERE p_size <= 10), f AS (SELECT o_orderkey AS dof FROM orders WHERE o_orderstatus = 'F' UNION SELECT j FROM x)
SELECT i, round(-sum(v * x), 4) AS y FROM m JOIN x USING (j) WHERE i NOT IN (SELECT dof FROM f) GROUP BY i
""")
def boundary_load(spark, sf_dir):
    """What prescribed values take off the right-hand side of free rows."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    values = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("j"), (F.col("p_retailprice") / 1000).alias("x"))
    fixed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dof")).unionByName(values.select(F.col("j").alias("dof")))
    _, boundary = sparse.split_fixed(m, fixed)
    return sparse.boundary_load(boundary, values).withColumn("y", F.round("y", 4))
