"""Feasible directions against all active sets, modes and fields against dense algebra."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import optimize


def long_rows(spark, g):
    rows = [(i, n, float(v)) for n, values in g.items() for i, v in enumerate(values) if v != 0]
    return spark.createDataFrame(rows, "id long, name string, value double").repartition(3)


def best_by_all_sets(g, a, kinds, lower, upper):
    """The projection of -g onto the cone by trying every set of active constraints and bounds."""
    n, m = len(g), len(a)
    sides = [np.eye(n)[i] * (-1 if side == "lower" else 1) for side, which in (("lower", lower), ("upper", upper)) for i in which]
    rows = np.array([*a, *sides])
    forced = [k for k in range(m) if kinds[k] == "EQ"]
    rest = [k for k in range(len(rows)) if k not in forced]
    best = None
    for size in range(len(rest) + 1):
        for some in itertools.combinations(rest, size):
            active = rows[[*forced, *some]]
            d = -g if not len(active) else -g + active.T @ np.linalg.lstsq(active @ active.T, active @ g, rcond=None)[0]
            slope = rows @ d
            if all(abs(slope[k]) < 1e-9 if k in forced else slope[k] < 1e-9 for k in range(len(rows))) and (best is None or np.linalg.norm(d + g) < np.linalg.norm(best + g) - 1e-12):
                best = d
    return best


@pytest.mark.parametrize("seed", range(6))
def test_direction_against_all_active_sets(spark, seed):
    rng = np.random.default_rng(seed)
    n, kinds = 6, {"a": "LE", "b": "GE", "c": "EQ" if seed % 2 else "LE"}
    g = {"cost": rng.normal(size=n), **{k: rng.normal(size=n) * 10**3 for k in kinds}}
    lower, upper = [0, 3], [1, 4] if seed != 2 else []
    bounds = spark.createDataFrame([(i, "lower") for i in lower] + [(i, "upper") for i in upper], "id long, sense string")
    got = optimize.feasible_direction(long_rows(spark, g), "cost", kinds, bounds)
    unit = {k: v / np.linalg.norm(v) * (-1 if kinds.get(k) == "GE" else 1) for k, v in g.items()}
    wanted = best_by_all_sets(unit["cost"], [unit[k] for k in sorted(kinds)], [kinds[k] for k in sorted(kinds)], lower, upper)
    d = {r["id"]: r["direction"] for r in got.rows.collect()}
    assert np.allclose([d[i] for i in range(n)], wanted, atol=1e-7)
    assert got.slopes["a"] < 1e-8 and got.slopes["b"] > -1e-8 and (kinds["c"] == "LE" or abs(got.slopes["c"]) < 1e-8)
    assert got.multipliers["a"] >= 0 and got.multipliers["b"] <= 0


def test_direction_without_constraints_and_with_useless_ones(spark):
    g = {"cost": [3.0, -4.0, 0.0], "zero": [0.0, 0.0, 0.0], "same": [3.0, -4.0, 0.0]}
    free = optimize.feasible_direction(long_rows(spark, g), "cost", {})
    assert {r["id"]: r["direction"] for r in free.rows.collect()} == {0: pytest.approx(-0.6), 1: pytest.approx(0.8)}
    held = optimize.feasible_direction(long_rows(spark, g), "cost", {"zero": "LE", "same": "GE"})
    assert all(abs(r["direction"]) < 1e-9 for r in held.rows.collect())
    with pytest.raises(ValueError, match="no gradient"):
        optimize.feasible_direction(long_rows(spark, g), "zero", {})
    with pytest.raises(ValueError, match="LE, GE or EQ"):
        optimize.feasible_direction(long_rows(spark, g), "cost", {"same": "<"})


def covariance(rng, n, length=0.6):
    x = rng.random((n, 3))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return np.exp(-d2 / length**2)


def as_pairs(spark, c):
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))], "i long, j long, v double")


def test_modes_and_fields_against_dense(spark):
    c = covariance(np.random.default_rng(5), 60)
    pairs, ids = as_pairs(spark, c).repartition(3), spark.range(60)
    modes = optimize.leading_modes(pairs, ids, 6)
    value, vector = np.linalg.eigh(c)
    assert np.allclose(modes.values, value[::-1][:6], rtol=1e-8)
    assert modes.share == pytest.approx(value[::-1][:6].sum() / np.trace(c))
    got = np.array([r["modes"] for r in modes.rows.orderBy("id").collect()])
    assert np.allclose(np.abs(got.T @ vector[:, ::-1][:, :6]), np.eye(6), atol=1e-4)
    again = optimize.leading_modes(pairs.repartition(5), ids, 6)
    assert np.allclose(got, np.array([r["modes"] for r in again.rows.orderBy("id").collect()]), atol=1e-5)
    field = optimize.field_samples(modes, 3000, seed=7)
    rows = field.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("v")).orderBy("id").collect()
    x = np.array([[s["value"] for s in r["v"]] for r in rows])
    held = (got * modes.values) @ got.T
    assert np.abs(x @ x.T / 3000 - held).max() < 0.15
    one = {(r["id"], r["sample"]): r["value"] for r in optimize.field_samples(modes, 3000, seed=7).filter("sample <= 2").collect()}
    assert one[(4, 2)] == pytest.approx(x[4, 1], abs=1e-9)


def test_modes_of_low_rank_and_of_ids_without_pairs(spark):
    c = np.zeros((12, 12))
    c[:5, :5], c[5:9, 5:9] = 2.0, 1.0
    modes = optimize.leading_modes(as_pairs(spark, c).filter("v <> 0"), spark.range(12), 6)
    assert modes.values == [pytest.approx(10), pytest.approx(4)] and modes.share == pytest.approx(1)
    assert all(abs(v) < 1e-9 for r in modes.rows.filter("id >= 9").collect() for v in r["modes"])
    with pytest.raises(ValueError, match="no ids"):
        optimize.leading_modes(as_pairs(spark, c), spark.range(0), 2)
