"""Search among boxes of very different size, crowded points and far-off queries, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import levels, locate, spatial

XYZ = "id long, x double, y double, z double"


def frame(spark, xyz, first=0):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(xyz, first)], XYZ)


def test_curve_keys_are_one_to_one_and_keep_neighbours(spark):
    rows = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = spark.createDataFrame(rows, "x int, y int, z int").withColumn("k", levels.curve_key([F.col(c) for c in "xyz"], [0.0] * 3, [7.0] * 3))
    got = [r for r in df.orderBy("k").collect()]
    assert len({r["k"] for r in got}) == 512
    # Each eighth of the order is an eighth of the cube.
    for k in range(8):
        part = got[64 * k : 64 * k + 64]
        assert all(max(r[c] for r in part) - min(r[c] for r in part) == 3 for c in "xyz")


def crowd(seed=2):
    rng = np.random.default_rng(seed)
    # A crowd within a millionth of the whole, one place with many copies, and a few points far and wide.
    return np.concatenate([rng.random((400, 3)) * 1e-3, np.full((200, 3), 2e-4), rng.random((60, 3)) * 1e3])


@pytest.mark.parametrize("k", [1, 4, 30])
def test_nearest_in_crowds_and_far_off(spark, k):
    points = crowd()
    asked = np.concatenate([points[:5], points[400:403], np.array([[1e7, -1e7, 5.0], [500.0, 500.0, 500.0], [2e-4, 2e-4, 2e-4]])])
    got = levels.nearest_points(frame(spark, asked), frame(spark, points), k).collect()
    found = spatial.nearest(frame(spark, asked), frame(spark, points), k, 1e-5).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in (type(got[0])(**{c: r[c] for c in got[0].__fields__}) for r in found))
    for q, at in enumerate(asked):
        d = ((points - at) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(points)), d))[:k]
        mine = sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])
        assert [r["p_id"] for r in mine] == order.tolist()


def test_far_off_queries_meet_few_points(spark):
    """A query far beyond all points goes down the tree, and meets some leaves of it instead of every point."""
    points = np.random.default_rng(3).random((3000, 3))
    tree = levels.box_tree(frame(spark, points), list("xyz"), list("xyz"))
    assert tree.sizes == [188, 12]
    pairs = levels.nearest_boxes(frame(spark, [[1e6, 0.5, 0.5], [0.5, 0.5, 0.5]]), tree, 1, list("xyz"), list("xyz"))
    assert pairs.count() < 300


def test_tree_of_nothing_and_of_one(spark):
    assert levels.box_tree(frame(spark, []), list("xyz"), list("xyz")) is None
    one = levels.nearest_points(frame(spark, [[1, 2, 3]]), frame(spark, [[0, 0, 0]]), 5).collect()
    assert [(r["q_id"], r["p_id"], r["d2"]) for r in one] == [(0, 0, 14.0)]


def tets_of(rng, n):
    """Tetrahedra of sizes 1 to 10,000."""
    size = 10.0 ** rng.integers(0, 5, n)
    base = rng.random((n, 1, 3)) * 2e4
    return base + rng.random((n, 4, 3)) * size[:, None, None]


def test_elements_of_sizes_one_to_ten_thousand(spark):
    rng = np.random.default_rng(9)
    corners = tets_of(rng, 150)
    inner = rng.dirichlet(np.ones(4), 150)
    points = np.concatenate([np.einsum("nk,nka->na", inner, corners), rng.random((40, 3)) * 2e4, [[1e9, 0, 0]]])
    kind = "elem int, corners array<struct<x: double, y: double, z: double, value: double>>"
    tets = spark.createDataFrame([(e, [(*map(float, c), float(c.sum())) for c in t]) for e, t in enumerate(corners)], kind)
    got = {r["id"]: (r["elem"], r["value"]) for r in locate.locate(frame(spark, points), tets).collect()}
    for k, p in enumerate(points):
        inside = []
        for e, t in enumerate(corners):
            w = np.linalg.solve((t[1:] - t[0]).T, p - t[0])
            if min(w.min(), 1 - w.sum()) >= -1e-9:
                inside.append(e)
        assert (k in got) == bool(inside)
        if inside:
            assert got[k][0] == inside[0] and got[k][1] == pytest.approx(p.sum(), rel=1e-9)
    # An element is never written to more than eight cells, a point never looks into more than one a level.
    low = [F.array_min(F.transform("corners", lambda c: c[a])) for a in "xyz"]  # noqa: B023
    high = [F.array_max(F.transform("corners", lambda c: c[a])) for a in "xyz"]  # noqa: B023
    pairs = levels.by_levels(frame(spark, points), tets, low, high, 1.0)
    assert pairs.groupBy("id", "elem").count().agg(F.max("count")).first()[0] == 1
    assert pairs.count() < len(points) * len(corners) / 8


def test_attaching_to_faces_of_very_different_size(spark):
    rng = np.random.default_rng(4)
    small = rng.random((200, 1, 3)) + rng.normal(size=(200, 3, 3)) * 0.01
    large = np.array([[[-500.0, -500.0, -3.0], [900.0, -500.0, -3.0], [0.0, 900.0, -3.0]]])
    faces = np.concatenate([small, large])
    points = np.concatenate([rng.random((20, 3)), rng.random((5, 3)) * 100 - [0, 0, 300], [[1e6, 1e6, 0.0]]])
    table = spark.createDataFrame([(k, [tuple(map(float, c)) for c in t]) for k, t in enumerate(faces)], "face long, corners array<struct<x: double, y: double, z: double>>")

    def closest(p, t):
        best = np.inf
        for i, j in ((0, 1), (1, 2), (2, 0)):
            u = np.clip(np.dot(p - t[i], t[j] - t[i]) / np.dot(t[j] - t[i], t[j] - t[i]), 0, 1)
            best = min(best, np.linalg.norm(p - t[i] - u * (t[j] - t[i])))
        w, *_ = np.linalg.lstsq((t[1:] - t[0]).T, p - t[0], rcond=None)
        if w.min() >= 0 and w.sum() <= 1:
            best = min(best, np.linalg.norm(p - t[0] - w @ (t[1:] - t[0])))
        return best

    got = locate.attach(frame(spark, points), table).collect()
    assert len(got) == len(points)
    for r in got:
        d = [closest(points[r["id"]], t) for t in faces]
        assert r["distance"] == pytest.approx(min(d), rel=1e-6, abs=1e-9) and d[r["face"]] == pytest.approx(min(d), rel=1e-6, abs=1e-9)


def test_bin_sort_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, None, 1.0), (4, float("nan"), 0.0), (5, 1.0, 0.0), (6, 0.0, 1.0)] + [(k, 0.0, 0.0) for k in range(10, 24)], "id int, x double, y double")
    got = {r["id"]: (r["bin"], r["pos"]) for r in levels.bin_sort(df, "x", "y").collect()}
    assert got[3][0] is None and got[4][0] is None and {got[3][1], got[4][1]} == {1, 2}
    assert [got[k][0] for k in (1, 5, 2, 6)] == [1, 2, 3, 4]
    assert sorted(p for _, p in got.values()) == list(range(1, 21))
    assert levels.bin_sort(df.limit(0), "x", "y").collect() == []
    assert levels.bin_sort(df.filter("id = 1"), "x", "y").first()["bin"] == 1
