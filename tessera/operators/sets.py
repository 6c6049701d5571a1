"""Named sets: ids stored singly or as ranges, appended in order, duplicates kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(entries: DataFrame, last_id: int | None = None) -> DataFrame:
    """(name, seq, first, last, inc) -> (name, seq, member).

    inc null means 1; a last that is off the stride is left out, as when printing.
    With ``last_id`` a range end beyond it is clipped, and a start beyond it is an
    error. So is an inc below 1 or an end before its start.
    """
    inc = F.coalesce(F.col("inc"), F.lit(1))
    end = F.least(F.col("last"), F.lit(last_id)) if last_id is not None else F.col("last")
    checked = F.when(inc < 1, F.raise_error(F.lit("set range: increment below 1"))).when(F.col("first") > F.col("last"), F.raise_error(F.lit("set range: end before start")))
    if last_id is not None:
        checked = checked.when(F.col("first") > last_id, F.raise_error(F.lit("set range: start beyond the last id")))
    return entries.select("name", "seq", F.explode(F.coalesce(checked.cast("array<bigint>"), F.when(F.col("first") <= end, F.sequence("first", end, inc)))).alias("member"))


def append(*parts: DataFrame) -> DataFrame:
    """Later mentions of a name append to it; nothing is made distinct."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_of_sets(names: DataFrame, members: DataFrame) -> DataFrame:
    """(name, ref) and the current members (name, member) -> (name, member): a copy, not a live link."""
    return names.join(members.withColumnRenamed("name", "ref"), "ref").select("name", "member")


def within(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows whose key is a member; duplicates in the set don't multiply rows."""
    return rows.join(members.select(F.col("member").alias(key)), key, "left_semi")
