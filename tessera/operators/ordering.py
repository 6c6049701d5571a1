"""Global order: positions of rows in a sort by any keys, with their payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.scratch import materialize


def ranked(rows: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """``rows`` plus their place, from 1 on, in the order of ``keys``; equal keys are ordered by all other columns.

    Partitions take ranges of the keys; each numbers its own rows and adds the sizes
    of those before, so that one number per partition is all that meets in a task.
    The ranges are written once, since a second evaluation may draw them differently.
    """
    order = [*keys, *(c for c in rows.columns if c not in keys)]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("__p").agg(F.count("*").alias("n"))
    base = size.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = dealt.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    out = within.join(F.broadcast(base), "__p").select(*rows.columns, (F.col("__r") + F.col("__base")).alias(position))
    out._tessera_dealt = dealt  # for those that write the result, and so need the ranges no longer
    return out


def ranked_within(rows: DataFrame, by: list[str], keys: list[str], position: str = "pos") -> DataFrame:
    """As ``ranked``, counted anew in each group; a hot group is spread over many partitions."""
    whole = materialize(ranked(rows, [*by, *keys], "__at"), "ranked")
    first = whole.groupBy(*by).agg(F.min("__at").alias("__first"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    joined = whole.join(first.withColumnsRenamed({b: f"__by_{b}" for b in by}), same)
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + 1).alias(position))


def complex_order(rows: DataFrame, by: list[str], re: str, im: str, tie: str, position: str = "pos") -> DataFrame:
    """Complex eigenvalues in the order of their size, per group (a nodal diameter); the other columns, as a vector's, go with them."""
    sized = rows.withColumn("__size", F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im)))
    return ranked_within(sized, by, ["__size", tie], position).drop("__size")


def catalogue(names: DataFrame, added: DataFrame, name: str) -> DataFrame:
    """The names of both, each once, with their place in the alphabet."""
    return ranked(names.select(name).unionByName(added.select(name)).distinct(), [name])
