"""Step-wise upserts of boundary values and loads, and activation of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write_wins(writes: DataFrame, keys: list[str], order: list[str], kind: str | None = None) -> DataFrame:
    """One row per key: the last write. With ``kind``, writes of another kind than the key's first one are ignored."""
    if kind:
        first = writes.groupBy(*keys).agg(F.min_by(kind, F.struct(*order)).alias("__kind"))
        writes = writes.join(first, keys).filter(F.col(kind) == F.col("__kind")).drop("__kind")
    rest = [c for c in writes.columns if c not in keys]
    best = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))  # combines before the shuffle
    return best.select(*keys, "__r.*")


def replace_then_accumulate(loads: DataFrame, step: str, keys: list[str], value: str) -> DataFrame:
    """Mentions within a step add up; a later step replaces what earlier steps gave a key."""
    sums = loads.groupBy(*keys, step).agg(F.sum(value).alias(value))
    return sums.groupBy(*keys).agg(F.max_by(value, step).alias(value), F.max(step).alias(step))


def amplitude_conflicts(loads: DataFrame, step: str, keys: list[str], amplitude: str) -> DataFrame:
    """Keys that one step loads with different amplitudes; any row is an input error."""
    seen = loads.groupBy(*keys, step).agg(F.min(amplitude).alias("lo"), F.max(amplitude).alias("hi"))
    return seen.filter("lo <> hi").select(*keys, step)


def add_loads(loads: DataFrame, step: str, keys: list[str], value: str, amplitude: str) -> DataFrame:
    """As ``replace_then_accumulate``, with the amplitude of the step that counts; different amplitudes of a key within a step raise an error.

    Point loads are keyed by node, dof and sector, face loads by element, label and
    sector, body loads by set, type and direction (see ``direction_key``).
    """
    sums = loads.groupBy(*keys, step).agg(F.sum(value).alias(value), F.min(amplitude).alias("__lo"), F.max(amplitude).alias("__hi"))
    one = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__lo")).otherwise(F.raise_error(F.lit("add_loads: different amplitudes in one step")).cast(dict(loads.dtypes)[amplitude]))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct(F.col(value), one.alias(amplitude), F.col(step)), step).alias("__r"))
    return best.select(*keys, "__r.*")


def direction_key(x, y, z):
    """A direction of length 1, to six digits: body loads of one set and type count as one where they agree."""
    size = F.sqrt(x * x + y * y + z * z)
    return F.array(*[F.round(c / size, 6) + 0.0 for c in (x, y, z)])


def add_constraints(held: DataFrame, added: DataFrame, key: str, order: str) -> DataFrame:
    """Terms of the constraints that are there, and of the added ones whose dependent key has none yet; of several for one key the first by ``order``."""
    new = added.join(held.select(key).distinct(), key, "left_anti")
    first = new.groupBy(key).agg(F.min(order).alias("__first"))
    return held.unionByName(new.join(first, key).filter(F.col(order) == F.col("__first")).select(*held.columns))


def active_status(items: DataFrame, changes: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """``items`` (elements or contact pairs) plus active: what the last change says, 'add' or 'remove'; active without any."""
    last = changes.groupBy(key).agg(F.max_by(kind, order).alias("__kind"))
    return items.join(last, key, "left").withColumn("active", F.coalesce(F.col("__kind") != "remove", F.lit(True))).drop("__kind")


def match_steps(now: DataFrame, before: DataFrame, field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each present value with its start: the same key's value a step before, else the last value of the field, else 0."""
    old = before.select(*keys, F.col(value).alias("__old"))
    last = field.select(*keys, F.col(value).alias("__field"))
    return now.join(old, keys, "left").join(last, keys, "left").withColumn("start", F.coalesce("__old", "__field", F.lit(0.0))).drop("__old", "__field")


def deactivate(elements: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The elements that no removal names."""
    return elements.join(removed.select(key), key, "left_anti")


def remove_constraints(terms: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Constraint terms without those of the removed dependent keys."""
    return terms.join(removed.select(key).distinct(), key, "left_anti")
