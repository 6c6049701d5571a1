"""Queries that write result files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.plans.relational import table
from tessera.scratch import shared_dir
from tessera.sources import resultfile


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"


@query("""
SELECT l_linenumber AS step, (l_linenumber % 2)::INTEGER AS increment, l_linenumber * 0.25::DOUBLE AS time, 'FLAG' || l_returnflag AS name, l_orderkey AS node, sum(l_quantity)::DOUBLE AS total, count(*)::DOUBLE AS n, max(l_discount)::DOUBLE AS most
FROM lineitem GROUP BY l_linenumber, l_returnflag, l_orderkey
""")
def result_file(spark, sf_dir):
    """Result sets per line number and flag, written to result files and read back, every row."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("step"), F.concat(F.lit("FLAG"), "l_returnflag").alias("name"), F.col("l_orderkey").alias("node"))
    values = F.array(F.sum("l_quantity").cast("double"), F.count("*").cast("double"), F.max("l_discount").cast("double")).alias("values")
    sets = rows.agg(values).withColumns({"increment": F.col("step") % 2, "time": F.col("step") * 0.25})
    where = _folder(spark)
    resultfile.write(sets, where, components={f"FLAG{k}": ["TOTAL", "N", "MOST"] for k in "ANR"})
    return resultfile.read(spark, where).select("step", "increment", "time", "name", "node", *[F.col("values")[k].alias(c) for k, c in enumerate(("total", "n", "most"))])


@query("""
SELECT l_linenumber AS step, 'FLAG' || l_returnflag AS name, count(DISTINCT l_orderkey) AS n_rows FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 AND l_returnflag <> 'N' GROUP BY ALL
""")
def result_file_blocks(spark, sf_dir):
    """Rows of each result set by the blocks alone: what the options rule out is not read, and no row is."""
    sets = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("step"), F.lit(1).alias("increment"), (F.col("l_linenumber") * 1.0).alias("time"), F.concat(F.lit("FLAG"), "l_returnflag").alias("name"), F.col("l_orderkey").alias("node")).distinct()
    where = _folder(spark)
    resultfile.write(sets.withColumn("values", F.array(F.lit(1.0))), where)
    blocks = resultfile.read(spark, where, "blocks", name="FLAGA,FLAGR", from_time=2, to_time=5)
    return blocks.groupBy("step", "name").agg(F.sum("n_rows").alias("n_rows"))


@query("""
WITH n AS (SELECT c_custkey AS node, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, 0.5 AS z FROM customer),
e AS (SELECT o_orderkey AS elem, unnest([o_custkey, o_custkey % 100 + 1, o_custkey % 10 + 1, 1]) AS node FROM orders)
SELECT elem, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM e JOIN n USING (node) GROUP BY elem
""")
def result_file_mesh(spark, sf_dir):
    """Nodes and elements, written to one folder and read back; the centre of each element's nodes."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 100).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.5).alias("z"))
    key = F.col("o_custkey")
    elements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("elem"), F.lit(3).alias("type"), F.lit("1").alias("material"), F.array(key, key % 100 + 1, key % 10 + 1, F.lit(1).cast("long")).alias("nodes"))
    where = _folder(spark)
    resultfile.write(nodes, where, "nodes")
    resultfile.write(elements, where, "elements")
    corners = resultfile.read(spark, where, "elements").select("elem", F.explode("nodes").alias("node"))
    both = corners.join(resultfile.read(spark, where, "nodes"), "node").groupBy("elem")
    return both.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("x", "y", "z")])
