"""What larger tables bring up: plans that don't send exploded rows to all, ids beyond their span, searches within bounds, ties of equal numbers."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import constraints, curved, levels, results, spatial, topology
from tessera.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stresses_of_bricks_beyond_a_thousand_layers(spark, tmp_path):
    # With 10 bits a coordinate the corners of brick 262144 have the ids of brick 16's.
    spark.createDataFrame([(16,), (17,), (262144,), (262145,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["brick_stress"](spark, str(tmp_path))
    rows = df.collect()
    assert sorted((r["elem"], r["ip"]) for r in rows) == [(e, i) for e in (16, 17, 262144, 262145) for i in range(1, 9)]
    assert {(r["sxx"], r["syy"], r["szz"]) for r in rows} == {(269.230769, 115.384615, 115.384615)}
    assert "BroadcastHashJoin" not in plan_of(df)


def test_extrapolation_sends_one_row_per_element(spark):
    rng = np.random.default_rng(3)
    elements = spark.createDataFrame([(e, [int(n) for n in rng.choice(40, 20, replace=False)]) for e in range(30)], "elem long, nodes array<long>")
    values = [(e, i, float(v)) for e in range(30) for i, v in enumerate(rng.normal(size=8), 1)]
    df = results.extrapolate(elements, spark.createDataFrame(values, "elem long, ip int, value double"), results.brick_matrix(), results.MIDSIDES)
    at = {}
    for r in elements.collect():
        v = np.array(results.brick_matrix()) @ [x for e, _, x in values if e == r["elem"]]
        for n, w in zip(r["nodes"], [*v, *[(v[a] + v[b]) / 2 for a, b in results.MIDSIDES]], strict=True):
            at.setdefault(n, []).append(w)
    got = {r["node"]: (r["value"], r["n_contributions"]) for r in df.collect()}
    assert got.keys() == at.keys()
    assert all(abs(got[n][0] - np.mean(v)) < 1e-12 and got[n][1] == len(v) for n, v in at.items())
    assert "BroadcastHashJoin" not in plan_of(df)


def test_neighbours_without_a_join(spark):
    t = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4]), (2, [5, 6, 5])], "elem long, nodes array<long>")
    df = topology.triangle_neighbours(t)
    assert sorted((r["elem"], r["side"], r["neighbour"]) for r in df.filter("elem < 2").collect()) == [(0, 1, None), (0, 2, 1), (0, 3, None), (1, 1, 0), (1, 2, None), (1, 3, None)]
    assert sorted((r["side"], r["neighbour"]) for r in df.filter("elem = 2").collect()) == [(1, None), (2, None), (3, None)]
    assert "Join" not in plan_of(df)


def test_feet_on_bent_faces_are_exact_and_shuffle_nothing(spark):
    rng = np.random.default_rng(5)
    places = np.array([(0, 0), (1, 0), (0, 1), (0.5, 0), (0.5, 0.5), (0, 0.5)])
    faces = [(f, [(f * 4.0 + a, b, (a * a + b * b) / 2) for a, b in places.tolist()]) for f in range(3)]
    at = rng.random((90, 3)) * [0.5, 0.5, 0.2]
    s = np.sqrt(at[:, 0] ** 2 + at[:, 1] ** 2 + 1)
    f = np.arange(90) % 3
    points = np.stack([f * 4.0 + at[:, 0] - at[:, 2] * at[:, 0] / s, at[:, 1] - at[:, 2] * at[:, 1] / s, (at[:, 0] ** 2 + at[:, 1] ** 2) / 2 + at[:, 2] / s], 1).tolist()
    rows = [(i, *p) for i, p in enumerate(points)] + [(90, None, 0.0, 0.0), (91, float("nan"), 0.0, 0.0), (92, float("inf"), 0.0, 0.0)]
    df = curved.attach_curved(spark.createDataFrame(rows, "id long, x double, y double, z double"), spark.createDataFrame(faces, "face long, nodes array<struct<x: double, y: double, z: double>>"))
    got = df.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(90)) and [r["face"] for r in got] == f.tolist()
    assert np.abs(np.array([r["local"] for r in got]) - at[:, :2]).max() < 1e-11
    assert np.abs(np.array([r["distance"] for r in got]) - at[:, 2]).max() < 1e-11
    assert "Exchange" not in plan_of(df)


def test_ties_look_at_faces_within_the_tolerance(spark, monkeypatch):
    """The tree in tasks, and the same ending in joins, leave few faces to a node, and none to one too far off."""
    corners = "array<struct<node: long, x: double, y: double, z: double>>"
    faces = spark.createDataFrame([(f, [(f, float(f), 0.0, 0.0), (f + 1, f + 1.0, 0.0, 0.0), (f + 900, float(f), 1.0, 0.0)]) for f in range(400)], f"face long, corners {corners}")
    slaves = spark.createDataFrame([(i, i + 0.25, 0.25, 0.1 if i % 2 else 5.0) for i in range(400)], "id long, x double, y double, z double")
    for most in (levels.TASK_BOXES, 100, 16):
        monkeypatch.setattr(levels, "TASK_BOXES", most)
        df = constraints.tied(slaves, faces, 0.2)
        got = sorted((r["id"], r["face"], r["node"], round(r["gap"], 9), round(r["coef"], 9)) for r in df.collect())
        assert got == [(i, i, n, 0.1, c) for i in range(1, 400, 2) for n, c in ((i, 0.5), (i + 1, 0.25), (i + 900, 0.25))]
    monkeypatch.undo()
    tree = levels.box_tree(faces.select("face", *[F.lit(0.0).alias(c) for c in ("a", "b")]), ["a"], ["b"])
    places = np.array([[5.0], [0.1]])
    assert [row.tolist() for row, *_ in levels.descend(places, levels.task_levels(tree)[0], 1, 0.04)] == [[1] * 400]


def test_pairs_are_summed_without_rows_for_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(spatial, "PART", 40)
    at, value = rng.random((100, 3)), [None if i % 9 == 0 else float(i) for i in range(100)]
    points = spark.createDataFrame([(i, *map(float, p), v) for i, (p, v) in enumerate(zip(at, value, strict=True))] + [(100, None, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, value double")
    df = spatial.hat_filter_all(points, 0.4, "value")
    got = {r["id"]: r["filtered"] for r in df.collect()}
    assert got.pop(100) is None
    for i in range(100):
        w = np.maximum(0, 0.4 - np.linalg.norm(at - at[i], axis=1)) / 0.4
        assert abs(got[i] - sum(a * v for a, v in zip(w, value, strict=True) if v is not None) / w.sum()) < 1e-9
    assert "__cell" not in plan_of(df)
