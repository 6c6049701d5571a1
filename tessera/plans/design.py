"""Queries of design directions and random fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import optimize
from tessera.plans.catalog import query
from tessera.plans.relational import table


@query("""
WITH g AS (SELECT s_suppkey AS id, s_acctbal AS c, CAST(s_suppkey % 7 - 2 AS DOUBLE) AS a FROM supplier),
n AS (SELECT sqrt(sum(c * c)) AS nc, sqrt(sum(a * a)) AS na FROM g),
l AS (SELECT greatest(0.0, -sum(c / nc * a / na)) AS lam FROM g, n)
SELECT id, round(-(c / nc + lam * a / na), 6) AS direction FROM g, n, l
""")
def gradient_projection(spark, sf_dir):
    """Steepest descent of the balances that does not let one constraint grow."""
    s = table(spark, sf_dir, "supplier")
    both = s.select(F.col("s_suppkey").alias("id"), F.explode(F.create_map(F.lit("cost"), F.col("s_acctbal").cast("double"), F.lit("mass"), (F.col("s_suppkey") % 7 - 2).cast("double"))).alias("name", "value"))
    return optimize.feasible_direction(both, "cost", {"mass": "LE"}).rows.select("id", F.round("direction", 6).alias("direction"))


@query("""
SELECT name, kind, true AS allowed, true AS signed, true AS complementary, (SELECT count(*) FROM part WHERE p_size % 10 = 0) AS n_bounds, 0 AS n_crossed FROM (VALUES ('mass', 'LE'), ('size', 'GE'), ('spread', 'EQ'), ('stress', 'LE')) AS t(name, kind)
""")
def feasible_direction_conditions(spark, sf_dir):
    """Whether the direction of all parts under four constraints and bounds at every tenth size meets the conditions of optimality."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    values = {"cost": F.col("p_retailprice") - 900, "mass": F.col("p_size") - 20.0, "size": F.sin(k.cast("double")), "spread": F.cos(k * 2.0), "stress": F.col("p_retailprice") * F.sin(k * 0.5)}
    long = p.select(k.alias("id"), F.explode(F.create_map(*[c for n, v in values.items() for c in (F.lit(n), v.cast("double"))])).alias("name", "value"))
    bounds = p.filter("p_size % 10 = 0").select(k.alias("id"), F.when(k % 2 == 0, "lower").otherwise("upper").alias("sense"))
    kinds = {"mass": "LE", "size": "GE", "spread": "EQ", "stress": "LE"}
    found = optimize.feasible_direction(long, "cost", kinds, bounds)
    crossed = found.rows.join(bounds, "id").agg(F.count("*").alias("n_bounds"), F.count(F.when(F.when(F.col("sense") == "lower", F.col("direction") < 0).otherwise(F.col("direction") > 0), 1)).cast("int").alias("n_crossed"))
    rows = []
    for name, kind in kinds.items():
        slope, by = found.slopes[name], found.multipliers[name]
        turn = -1 if kind == "GE" else 1
        allowed = abs(slope) < 1e-7 if kind == "EQ" else turn * slope < 1e-7
        rows.append((name, kind, allowed, kind == "EQ" or turn * by >= 0, abs(slope * by) < 1e-5))
    told = spark.createDataFrame(rows, "name string, kind string, allowed boolean, signed boolean, complementary boolean")
    return told.join(F.broadcast(crossed), F.lit(True))


def _modes(spark, sf_dir):
    """Suppliers at the places of their nations, which are too far apart to have a part in each other's values."""
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    one, other = at.toDF("i", "s_nationkey"), at.toDF("j", "s_nationkey")
    return at, optimize.leading_modes(one.join(other, "s_nationkey").select("i", "j", F.lit(4.0).alias("v")), at, 25)


@query("SELECT row_number() OVER (ORDER BY n DESC) AS rank, round(4.0 * n, 4) AS value FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)")
def field_modes(spark, sf_dir):
    """The eigenvalues of a covariance over all suppliers."""
    _, modes = _modes(spark, sf_dir)
    return spark.createDataFrame([(k, v) for k, v in enumerate(modes.values, 1)], "rank long, value double").withColumn("value", F.round("value", 4))


@query("SELECT s_suppkey AS id, s_nationkey, 3 AS n, true AS alike, 4.0 AS variance FROM supplier")
def correlated_field(spark, sf_dir):
    """Fields from the covariance's modes: alike where the covariance is full, with its variance everywhere."""
    at, modes = _modes(spark, sf_dir)
    squares = F.zip_with("modes", F.array(*map(F.lit, modes.values)), lambda m, v: m * m * v)
    variance = modes.rows.select("id", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 6).alias("variance"))
    fields = optimize.field_samples(modes, 3).join(at, "id")
    spread = fields.groupBy("s_nationkey", "sample").agg((F.max("value") - F.min("value")).alias("spread")).groupBy("s_nationkey").agg(F.count("*").cast("int").alias("n"), (F.max("spread") < 1e-6).alias("alike"))
    return variance.join(at, "id").join(spread, "s_nationkey").select("id", "s_nationkey", "n", "alike", "variance")
