"""State files and printed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a model, each as Parquet under ``path``; the list is written last, so that a broken write is never read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_tables")


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.parquet(f"{path}/_tables").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def print_lines(rows: DataFrame, order: list[str], ints: list[str], reals: list[str]) -> DataFrame:
    """Fixed-width lines (value): integers in 10 places, reals as %14.6E, ordered."""
    form = "".join(["%10d"] * len(ints) + ["%14.6E"] * len(reals))
    return rows.orderBy(*order).select(F.format_string(form, *[F.col(c).cast("long") for c in ints], *[F.col(c).cast("double") for c in reals]).alias("value"))


def compare(found: DataFrame, wanted: DataFrame, keys: list[str], block: str, value: str, tolerance: float = 1e-3, least: float = 1e-10) -> DataFrame:
    """Rows that differ by more than ``tolerance`` of their block's largest wanted size; wanted sizes below ``least`` are passed over."""
    want = wanted.select(*keys, block, F.col(value).alias("wanted"))
    top = want.groupBy(block).agg(F.max(F.abs("wanted")).alias("__top"))
    both = found.select(*keys, block, F.col(value).alias("found")).join(want, [*keys, block], "full").join(top, block, "left")
    far = F.abs(F.col("found") - F.col("wanted")) > F.col("__top") * tolerance
    return both.filter(F.col("found").isNull() | F.col("wanted").isNull() | (far & (F.abs("wanted") >= least))).drop("__top")
