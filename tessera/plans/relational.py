"""Queries of the set, upsert, lookup, print and state operators over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import lookup, ordering, sets, spatial, upsert
from tessera.plans.catalog import query
from tessera.scratch import shared_dir
from tessera.sources import files


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 2) AS sum_qty
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
""")
def node_print_totals(spark, sf_dir):
    """Rows per group, with totals per flag and over all (TOTALS=YES)."""
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem")
def totals_only(spark, sf_dir):
    """Totals alone (TOTALS=ONLY)."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))


@query("""
WITH m AS (SELECT s_nationkey AS name, unnest(generate_series(s_suppkey, least(s_suppkey + 40, (SELECT max(s_suppkey) FROM supplier)), 3)) AS member FROM supplier),
d AS (SELECT name, count(*) AS n_members, count(DISTINCT member) AS n_distinct FROM m GROUP BY name),
l AS (SELECT m.name, count(*) AS n_rows FROM (SELECT DISTINCT name, member FROM m) m JOIN lineitem ON l_suppkey = member GROUP BY m.name)
SELECT name, n_members, n_distinct, coalesce(n_rows, 0) AS n_rows FROM d LEFT JOIN l USING (name)
""")
def set_generate(spark, sf_dir):
    """Ranges with a stride, clipped at the last id, and the rows within each set."""
    s = table(spark, sf_dir, "supplier")
    last = s.agg(F.max("s_suppkey")).first()[0]
    entries = s.select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("first"), (F.col("s_suppkey") + 40).alias("last"), F.lit(3).cast("long").alias("inc"))
    m = sets.expand(entries, last)
    counts = m.groupBy("name").agg(F.count("*").alias("n_members"), F.count_distinct("member").alias("n_distinct"))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("member")).agg(F.count("*").alias("n"))
    rows = m.select("name", "member").distinct().join(per, "member").groupBy("name").agg(F.sum("n").alias("n_rows"))
    return counts.join(rows, "name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


@query("""
WITH base AS (SELECT c_mktsegment AS name, c_custkey AS member FROM customer),
refs AS (SELECT DISTINCT c_nationkey % 5 AS name, c_mktsegment AS ref FROM customer),
all_sets AS (SELECT CAST(r.name AS VARCHAR) AS name, b.member FROM refs r JOIN base b ON b.name = r.ref UNION ALL SELECT name, member FROM base)
SELECT name, count(*) AS n_members, count(DISTINCT member) AS n_distinct, sum(member)::BIGINT AS sum_member FROM all_sets GROUP BY name
""")
def set_of_sets(spark, sf_dir):
    """Sets made of the current members of others, duplicates kept."""
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("member"))
    refs = c.select((F.col("c_nationkey") % 5).cast("string").alias("name"), F.col("c_mktsegment").alias("ref")).distinct()
    return sets.append(sets.set_of_sets(refs, base), base).groupBy("name").agg(F.count("*").alias("n_members"), F.count_distinct("member").alias("n_distinct"), F.sum("member").alias("sum_member"))


@query("""
WITH f AS (SELECT user_id, first(event_type ORDER BY ts, event_id) AS kind FROM events GROUP BY user_id)
SELECT user_id, event_type, event_id, value FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events e JOIN f ON f.user_id = e.user_id AND f.kind = e.event_type) WHERE rn = 1
""")
def spc_last_write(spark, sf_dir):
    """The last value per key wins; writes of another kind than the key's first are passed over."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return upsert.last_write_wins(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", "event_id", "value")


@query("""
WITH s AS (SELECT user_id, event_type, date_trunc('day', ts) AS step, sum(value) AS value FROM events GROUP BY ALL)
SELECT user_id, event_type, CAST(step AS DATE) AS step, round(value, 4) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step DESC) AS rn FROM s) WHERE rn = 1
""")
def cload_replace_accumulate(spark, sf_dir):
    """Loads add up within a step; the last step replaces what was before."""
    e = table(spark, sf_dir, "events").withColumn("step", F.to_date("ts"))
    return upsert.replace_then_accumulate(e, "step", ["user_id", "event_type"], "value").select("user_id", "event_type", "step", F.round("value", 4).alias("value"))


@query("""
WITH h AS (SELECT user_id, event_id % 2 AS half, max(value) AS value FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 0 GROUP BY ALL),
f AS (SELECT user_id, min(value) AS value FROM events WHERE user_id % 5 > 0 GROUP BY user_id)
SELECT n.user_id, n.value, coalesce(b.value, f.value, 0.0) AS start FROM h n LEFT JOIN h b ON b.user_id = n.user_id AND b.half = 1 LEFT JOIN f ON f.user_id = n.user_id WHERE n.half = 0
""")
def spc_match_steps(spark, sf_dir):
    """Values of this step, each with the one it starts from: the step before, or else the last field, or else 0."""
    e = table(spark, sf_dir, "events")
    h = e.filter("user_id % 3 > 0 or event_id % 2 = 0").groupBy("user_id", (F.col("event_id") % 2).alias("half")).agg(F.max("value").alias("value"))
    field = e.filter("user_id % 5 > 0").groupBy("user_id").agg(F.min("value").alias("value"))
    return upsert.match_steps(h.filter("half = 0").drop("half"), h.filter("half = 1").drop("half"), field, ["user_id"], "value")


@query("""
SELECT s_suppkey, s_name, s_nationkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = 0)
""")
def model_change_remove(spark, sf_dir):
    """Elements that no removal names."""
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return upsert.deactivate(table(spark, sf_dir, "supplier"), gone, "s_nationkey").select("s_suppkey", "s_name", "s_nationkey")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F')
""")
def mpc_remove(spark, sf_dir):
    """Constraint terms without those of removed dependent keys."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return upsert.remove_constraints(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


_CURVE = """
t AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x0, max(p_retailprice) AS y0 FROM part WHERE p_size % 4 = 1 GROUP BY ALL),
i AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, row_number() OVER w = 1 AS one FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY x0)),
q AS (SELECT p_brand, l_quantity + 0.5 AS x, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
j AS (SELECT q.p_brand, q.x, n, CASE WHEN x1 IS NULL OR q.x <= x0 THEN y0 ELSE y0 + (y1 - y0) * (q.x - x0) / (x1 - x0) END AS y,
  CASE WHEN x1 IS NULL OR q.x < x0 THEN 0.0 ELSE (y1 - y0) / (x1 - x0) END AS d
  FROM q LEFT JOIN i ON i.p_brand = q.p_brand AND ((one AND q.x < x0) OR q.x >= x0) AND (x1 IS NULL OR q.x < x1))
"""


def _curve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    curve = part.filter("p_size % 4 = 1").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.max("p_retailprice").alias("y"))
    points = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", (F.col("l_quantity") + 0.5).alias("x")).agg(F.count("*").alias("n"))
    return lookup.interpolate(points, curve, ["p_brand"], "x", ["y"], slope=True)


@query(f"WITH {_CURVE} SELECT p_brand, x, n, round(y, 6) AS y FROM j")
def amplitude_lerp(spark, sf_dir):
    """Linear between a table's points, constant beyond them."""
    return _curve(spark, sf_dir).select("p_brand", "x", "n", F.round("y", 6).alias("y"))


@query(f"WITH {_CURVE} SELECT p_brand, x, n, round(y, 6) AS y, round(d, 6) AS slope FROM j")
def hardening_slope(spark, sf_dir):
    """The same with its slope, 0 beyond the ends."""
    return _curve(spark, sf_dir).select("p_brand", "x", "n", F.round("y", 6).alias("y"), F.round("d_y", 6).alias("slope"))


@query("""
WITH k AS (SELECT p_retailprice AS k, sum(count(*)) OVER (ORDER BY p_retailprice) AS upto FROM part GROUP BY p_retailprice),
q AS (SELECT l_returnflag, l_extendedprice / 40 AS x FROM lineitem),
j AS (SELECT l_returnflag, coalesce(upto, 0)::BIGINT AS position FROM q ASOF LEFT JOIN k ON q.x >= k.k)
SELECT l_returnflag, position // 100 AS bin, count(*) AS n, sum(position)::BIGINT AS total FROM j GROUP BY ALL
""")
def material_step_lookup(spark, sf_dir):
    """How many sorted table entries are not beyond a value (0: none)."""
    q = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 40).alias("x"))
    p = lookup.floor_position(q, "x", table(spark, sf_dir, "part"), "p_retailprice")
    return p.groupBy("l_returnflag", F.floor(F.col("position") / 100).alias("bin")).agg(F.count("*").alias("n"), F.sum("position").alias("total"))


@query("""
SELECT o_orderkey, e.event_id AS event_id, e.value AS value FROM orders o ASOF LEFT JOIN events e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts
""")
def time_points(spark, sf_dir):
    """The last entry at or before each time point, per key."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    out = lookup.as_of(points, table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id", "value"])
    return out.select("o_orderkey", F.col("event_id_at").alias("event_id"), F.col("value_at").alias("value"))


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 3 = 0
""")
def output_frequency(spark, sf_dir):
    """Every third increment of each key."""
    e = ordering.ranked_within(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "rn")
    return e.filter("rn % 3 = 0").select("user_id", "event_id", "value")


@query("""
SELECT o_orderkey, printf('%10d%10d%14.6E', o_orderkey, o_custkey, floor(o_totalprice)) AS value FROM orders
""")
def dat_print(spark, sf_dir):
    """Fixed-width result lines."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.format_string("%10d%10d%14.6E", F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice").cast("double")).alias("value"))


@query("""
SELECT 'orders' AS name, o_orderstatus AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), count(*), round(sum(s_acctbal), 2) FROM supplier GROUP BY s_nationkey
""")
def restart_roundtrip(spark, sf_dir):
    """A model's tables written as a state and read again."""
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    files.write_state({"orders": table(spark, sf_dir, "orders"), "supplier": table(spark, sf_dir, "supplier")}, path)
    back = files.read_state(spark, path)
    sums = lambda name, part, value: back[name].groupBy(F.col(part).cast("string").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.lit(name).alias("name"), "part", "n", "total")
    return sums("orders", "o_orderstatus", "o_totalprice").unionByName(sums("supplier", "s_nationkey", "s_acctbal"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, (event_id % 100) / 40.0)), 6) AS amplitude FROM events")
def user_amplitude_udf(spark, sf_dir):
    """A registered Python hook, in Arrow batches."""
    e = table(spark, sf_dir, "events")
    t = (F.col("event_id") % 100).cast("double")
    return e.select("event_id", F.round(hooks.scalar("ramp", t, F.lit(40.0)), 6).alias("amplitude"))


@query("""
SELECT p_partkey, round(sqrt(-2 * ln((('0x' || substr(md5('7:' || p_partkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) * cos(2 * pi() * ('0x' || substr(md5('7:' || p_partkey), 14, 13))::BIGINT / 4503599627370496.0), 9) AS draw FROM part
""")
def random_field(spark, sf_dir):
    """Standard normal draws, of both signs, by a hash of the key, so that a row's draw is the same in every run."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(spatial.normal_draw(F.col("p_partkey"), 7), 9).alias("draw"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def replay_increments(spark, sf_dir):
    """A history replayed as a stream of increments; the state after the last one."""
    from tessera.streaming.replay import replay

    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    e.repartitionByRange(3, "event_id").write.mode("overwrite").parquet(f"{base}/in")
    replay(spark, f"{base}/in", "user_id long, event_type string, event_id long, value double", f"{base}/state", f"{base}/check", ["user_id", "event_type"], "event_id")
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{base}/state")
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    last = max(int(s.getPath().getName().split("=")[1]) for s in found)
    return spark.read.parquet(f"{base}/state/batch={last}").select("user_id", "event_type", "event_id", "value")


@query("""
SELECT doc_id, md5(translate(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest FROM documents
""".replace("\\\\", "\\"))
def text_normalize(spark, sf_dir):
    """Blanks out, ASCII letters in upper case."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.translate(bare, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("digest"))


_LINES = """
SELECT s_nationkey AS deck, s_suppkey * 10 + k AS line, CASE k WHEN 0 THEN '** supplier ' || s_name WHEN 1 THEN '*Node, nset = N' || (s_nationkey % 3) WHEN 2 THEN s_suppkey || ', 1.5D2, ' || (s_suppkey % 7) || '., 0.,'
  WHEN 3 THEN '' WHEN 4 THEN '*Material, name = m' || (s_suppkey % 5) WHEN 5 THEN '*Boundary, INPUT = Data' || s_suppkey || '.inp' ELSE s_suppkey || ', 1, 3' END AS value
FROM supplier, (SELECT unnest(range(0, 7)) AS k)
"""


def deck_lines(spark, sf_dir):
    """A keyword deck per nation, written from the suppliers."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    key = F.col("s_suppkey").cast("string")
    value = (
        F.when(F.col("k") == 0, F.concat(F.lit("** supplier "), "s_name"))
        .when(F.col("k") == 1, F.concat(F.lit("*Node, nset = N"), (F.col("s_nationkey") % 3).cast("string")))
        .when(F.col("k") == 2, F.concat(key, F.lit(", 1.5D2, "), (F.col("s_suppkey") % 7).cast("string"), F.lit("., 0.,")))
        .when(F.col("k") == 3, "")
        .when(F.col("k") == 4, F.concat(F.lit("*Material, name = m"), (F.col("s_suppkey") % 5).cast("string")))
        .when(F.col("k") == 5, F.concat(F.lit("*Boundary, INPUT = Data"), key, F.lit(".inp")))
        .otherwise(F.concat(key, F.lit(", 1, 3")))
    )
    return s.select(F.col("s_nationkey").alias("deck"), (F.col("s_suppkey") * 10 + F.col("k")).alias("line"), value.alias("value"))


_PARSED = f"""
lines AS ({_LINES}),
bare AS (SELECT deck, line, replace(value, ' ', '') AS v FROM lines WHERE replace(value, ' ', '') <> '' AND value NOT LIKE '**%'),
up AS (SELECT deck, line, CASE WHEN contains(v, 'INPUT=') THEN upper(split_part(v, 'INPUT=', 1)) || 'INPUT=' || split_part(v, 'INPUT=', 2) ELSE upper(v) END AS v FROM bare),
parsed AS (SELECT deck, line, v LIKE '*%' AS is_card, last_value(CASE WHEN v LIKE '*%' THEN split_part(v, ',', 1) END IGNORE NULLS) OVER (PARTITION BY deck ORDER BY line) AS card, string_split(rtrim(v, ','), ',') AS fields FROM up)
"""


@query(f"WITH {_PARSED} SELECT deck, line, card, is_card, len(fields) AS n_fields, array_to_string(fields, '|') AS fields FROM parsed")
def deck_parse(spark, sf_dir):
    """Lines to cards and fields."""
    from tessera.sources import deck

    return deck.parse(deck_lines(spark, sf_dir)).select("deck", "line", "card", "is_card", F.size("fields").cast("long").alias("n_fields"), F.array_join("fields", "|").alias("fields"))


@query(f"""
WITH {_PARSED}, b AS (SELECT deck, card, max(CASE WHEN is_card THEN line END) OVER (PARTITION BY deck ORDER BY line) AS first, is_card FROM parsed)
SELECT deck, card, first, CASE card WHEN '*NODE' THEN 1 WHEN '*MATERIAL' THEN 9 ELSE 18 END AS rank, count(*) FILTER (NOT is_card) AS n_data FROM b GROUP BY ALL
""")
def card_order(spark, sf_dir):
    """Blocks with their place in the order in which cards are taken."""
    from tessera.sources import deck

    return deck.blocks(deck.parse(deck_lines(spark, sf_dir)))
