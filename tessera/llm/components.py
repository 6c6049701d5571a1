"""Connected components by alternating stars: O(log n) rounds of joins and minima, no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or else its smaller) neighbours its least neighbour."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b") if large else edges
    near = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").withColumn("m", F.least("a", "m"))
    if large:  # b, where it is larger than a, gets the least of a's neighbourhood
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every edge points down: all of a's neighbours, and a, get the least of them
        out = near.select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


#: Tables of up to this many edges (under 2 MB) stay in one partition, so that no step shuffles them.
ONE_PARTITION = 100_000


def _sized(edges: DataFrame) -> DataFrame:
    return edges.coalesce(1) if edges.count() <= ONE_PARTITION else edges


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges`` (a, b) -> (node, component), component being the least node id; nodes without an edge have no row.

    Null ends and loops are left out, repeated edges count once. The result is a
    written table. More than ``rounds`` rounds raise an error (a path of 2**20
    nodes takes about 20).
    """
    held = materialize(_sized(materialize(edges, "links")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now, mark = _sized(held), None
    for _ in range(rounds):
        new = materialize(_star(_star(now, True), False), "edges")
        release(held)
        held, now = new, _sized(new)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
    raise RuntimeError("components: no fixpoint")
