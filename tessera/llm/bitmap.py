"""Rows of a set of hashes, picked out before they are shuffled.

A small set goes to the rows as a bitmap: it has BITS / 32768 rows of 4 kB at most,
8 MB in all, whatever the input, and is made by one shuffle: tasks send their part
of it and not the hashes. It may let a few rows pass that aren't meant, and never
drops one that is; a join that follows decides. A set that would fill more than
MOST of its bits is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

BITS = 1 << 26
#: Up to so many bits set at most one in eight of the other rows passes.
MOST = BITS // 8
#: Files of a bitmap, of 128 kB at most.
FILES = 64


def marked(rows: DataFrame, h: Column, keys: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` plus __set: whether the hash is among the values of ``h`` in ``keys``."""
    at = keys.select((F.pmod(F.col("h"), F.lit(BITS)) + 1).alias("at"))
    bits = at.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map"))
    bits = materialize(bits.coalesce(FILES), "bitmap")
    if (bits.agg(F.sum(F.bitmap_count("__map"))).first()[0] or 0) > most:
        held = keys.select(F.col("h").alias("__h")).distinct().withColumn("__set", F.lit(True))
        return rows.withColumn("__h", h).join(held, "__h", "left").drop("__h").withColumn("__set", F.coalesce("__set", F.lit(False)))
    joined = rows.withColumn("__at", F.pmod(h, F.lit(BITS))).withColumn("__bucket", F.bitmap_bucket_number(F.col("__at") + 1)).join(F.broadcast(bits), "__bucket", "left")
    byte = F.expr("cast(conv(hex(substring(__map, cast((__at % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0
    return joined.withColumn("__set", F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__map")


def among(rows: DataFrame, h: Column, keys: DataFrame, most: int = MOST) -> DataFrame:
    """The rows whose hash is among the values of ``h`` in ``keys``, and perhaps a few more."""
    return marked(rows, h, keys, most).filter("__set").drop("__set")
