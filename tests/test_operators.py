"""Operators on small inline data: closed forms, dense algebra and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.functions.spectrum import real_spectrum
from tessera.operators import constraints, locate, lookup, ordering, results, sets, sparse, spatial, topology, upsert
from tessera.plans import statics
from tessera.sources import deck, files
from tessera.streaming import replay


def test_ranges_leave_out_an_off_stride_last_and_clip(spark):
    e = spark.createDataFrame([("a", 1, 1, 9, 3), ("b", 2, 8, 20, None)], "name string, seq int, first long, last long, inc int")
    got = sorted((r["name"], r["member"]) for r in sets.expand(e, 10).collect())
    assert got == [("a", 1), ("a", 4), ("a", 7), ("b", 8), ("b", 9), ("b", 10)]


def test_bad_range_is_an_error(spark):
    e = spark.createDataFrame([("a", 1, 5, 2, 1)], "name string, seq int, first long, last long, inc int")
    with pytest.raises(Exception, match="end before start"):
        sets.expand(e).collect()


def test_last_write_wins_and_other_kinds_are_ignored(spark):
    w = spark.createDataFrame([(1, 1, "B", 1.0), (2, 1, "M", 2.0), (3, 1, "B", 3.0), (4, 2, "M", 4.0)], "line int, key int, kind string, value double")
    got = {r["key"]: r["value"] for r in upsert.last_write_wins(w, ["key"], ["line"], "kind").collect()}
    assert got == {1: 3.0, 2: 4.0}


def test_loads_accumulate_within_and_replace_across_steps(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 2.0), (2, 7, 5.0), (2, 7, 6.0), (1, 8, 9.0)], "step int, node int, v double")
    assert {r["node"]: r["v"] for r in upsert.replace_then_accumulate(df, "step", ["node"], "v").collect()} == {7: 11.0, 8: 9.0}


@pytest.mark.parametrize("few", [64, 0])
def test_interpolation_is_constant_beyond_the_ends(spark, few, monkeypatch):
    monkeypatch.setattr(lookup, "FEW", few)
    t = spark.createDataFrame([("m", 1.0, 10.0), ("m", 3.0, 20.0), ("one", 5.0, 7.0)], "mat string, x double, y double")
    p = spark.createDataFrame([("m", 0.0), ("m", 1.0), ("m", 2.0), ("m", 3.0), ("m", 9.0), ("one", 1.0)], "mat string, x double")
    got = [(r["mat"], r["x"], r["y"], r["d_y"]) for r in lookup.interpolate(p, t, ["mat"], "x", ["y"], slope=True).orderBy("mat", "x").collect()]
    assert got == [("m", 0.0, 10.0, 0.0), ("m", 1.0, 10.0, 5.0), ("m", 2.0, 15.0, 5.0), ("m", 3.0, 20.0, 0.0), ("m", 9.0, 20.0, 0.0), ("one", 1.0, 7.0, 0.0)]


@pytest.mark.parametrize("small", [10_000, 0])
def test_floor_position_equals_searchsorted(spark, small, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_TABLE", small)
    keys, xs = [5, 1, 3, 3, 9], [0, 1, 2, 3, 4, 9, 10, None]
    t, p = spark.createDataFrame([(k,) for k in keys], "k int"), spark.createDataFrame([(x,) for x in xs], "x int")
    got = {r["x"]: r["position"] for r in lookup.floor_position(p, "x", t, "k").collect()}
    assert got == {x: int(np.searchsorted(sorted(keys), x, "right")) if x is not None else 0 for x in xs}


def test_two_bricks_have_ten_external_faces(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 0)], "elem long, cx long, cy long, cz long")
    elements, nodes = statics.brick_grid(cells)
    assert topology.external_faces(elements).count() == 10 and nodes.count() == 12


def test_regular_tetrahedron_has_quality_one(spark):
    h = math.sqrt(3) / 2
    points = [(0, 0, 0), (1, 0, 0), (0.5, h, 0), (0.5, h / 3, math.sqrt(2 / 3))]
    q = topology.tet_quality([[F.lit(float(c)) for c in p] for p in points])
    assert spark.range(1).select(q).first()[0] == pytest.approx(1.0)


def test_dense_renumber(spark):
    df = spark.createDataFrame([(k,) for k in (50, 7, 7, 900, 8)], "k long")
    assert {r["k"]: r["id"] for r in topology.dense_renumber(df, "k", "id").collect()} == {7: 1, 8: 2, 50: 3, 900: 4}


def test_nearest_against_brute_force_and_fewer_points_than_k(spark):
    rng = np.random.default_rng(3)
    xyz = rng.random((60, 3)) * 4
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xyz)], "id long, x double, y double, z double")
    got = spatial.nearest(p.filter("id < 5"), p, 4, 0.2).collect()
    for q in range(5):
        d = ((xyz - xyz[q]) ** 2).sum(1)
        assert [r["p_id"] for r in sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])] == np.argsort(d, kind="stable")[:4].tolist()
    assert spatial.nearest(p.filter("id < 2"), p.filter("id < 3"), 9, 0.2).count() == 6


def test_sparse_algebra_against_dense(spark):
    rng = np.random.default_rng(5)
    m = rng.random((6, 6))
    a = m @ m.T + 6 * np.eye(6)
    b = rng.random(6)
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(i + 1)], "i long, j long, v double")
    full = sparse.full(sparse.assemble(coo))
    x, rounds, rest = sparse.conjugate_gradient(full, spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, b double"))
    got = np.array([r["x"] for r in x.orderBy("i").collect()])
    assert np.allclose(got, np.linalg.solve(a, b)) and rounds <= 8 and rest < 1e-9
    _, value = sparse.dominant_eigenpair(full)
    assert value == pytest.approx(np.linalg.eigvalsh(a)[-1], rel=1e-6)
    t = sparse.atb(full, full).collect()
    assert np.allclose([r["v"] for r in sorted(t, key=lambda r: (r["i"], r["j"]))], (a.T @ a).ravel())


def test_cascade_reaches_a_fixpoint_and_finds_circles(spark):
    rules = spark.createDataFrame([(3, 2, 0.5), (2, 1, 0.5), (2, 10, 1.0), (1, 0, 2.0)], "dep long, dof long, coef double")
    got = {(r["dep"], r["dof"]): r["coef"] for r in constraints.cascade(rules).collect()}
    assert got == {(3, 0): 0.5, (3, 10): 0.5, (2, 0): 1.0, (2, 10): 1.0, (1, 0): 2.0}
    once = constraints.cascade(spark.createDataFrame([(*k, v) for k, v in got.items()], "dep long, dof long, coef double"))
    assert {(r["dep"], r["dof"]): r["coef"] for r in once.collect()} == got
    with pytest.raises(ValueError, match="circular"):
        constraints.cascade(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "dep long, dof long, coef double"), rounds=6)


def test_principal_values_against_numpy(spark):
    s = np.array([[3.0, 1, -2], [1, -4, 0.5], [-2, 0.5, 7]])
    c = {"xx": s[0, 0], "yy": s[1, 1], "zz": s[2, 2], "xy": s[0, 1], "xz": s[0, 2], "yz": s[1, 2]}
    got = spark.range(1).select(*results.principal_values({k: F.lit(float(v)) for k, v in c.items()})).first()
    assert np.allclose(list(got), np.linalg.eigvalsh(s))


def test_bar_under_tension_and_balance_of_forces(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 0)], "elem long, cx long, cy long, cz long")
    elements, nodes = statics.brick_grid(cells)
    elements = elements.select("elem", "nodes", F.lit(100.0).alias("young"), F.lit(0.0).alias("poisson"))
    fixed = nodes.filter("x = 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda a: F.col("node") * 3 + a)).alias("dof")).withColumn("value", F.lit(0.0))
    loads = nodes.filter("x = 2").select((F.col("node") * 3).alias("dof"), F.lit(0.25).alias("f"))
    u = statics.solve(elements, nodes, fixed, loads)
    tip = u.join(loads, "dof").select(F.avg("u")).first()[0]
    assert tip == pytest.approx(2 / 100)
    s = statics.stresses(elements, nodes, u).select(F.avg(F.col("s")[0])).first()[0]
    assert s == pytest.approx(1.0)
    assert statics.reactions(elements, nodes, u, fixed).agg(F.sum("rf")).first()[0] == pytest.approx(-1.0)


def test_hooks_and_material_law(spark):
    e = [1e-3, 0, 0, 0, 0, 0]
    got = hooks.material("elastic", spark.createDataFrame([(1, 200.0, 0.25, [float(x) for x in e])], "id long, young double, poisson double, e array<double>"), "id long, s array<double>").first()["s"]
    assert np.allclose(got, statics.elasticity(200.0, 0.25) @ e)


def test_spectrum_against_numpy(spark):
    v = [1.0, 3.0, -2.0, 0.5, 4.0]
    s = spark.createDataFrame([("a", t, x) for t, x in enumerate(v)], "g string, t int, v double")
    got = real_spectrum(s, "g", "t", "v").orderBy("k").collect()
    assert np.allclose([complex(r["re"], r["im"]) for r in got], np.fft.rfft(v))


def test_deck_reading_includes_and_numbers(spark, tmp_path):
    (tmp_path / "a.inp").write_text("** c\n*Node, nset=Nall\n1, 1.5D2,\n\n*INCLUDE, INPUT=b\n*Step, INPUT=Mixed.Case\n")
    lines = deck.read(spark, str(tmp_path))
    inner = spark.createDataFrame([("b", 1, "*Material"), ("b", 2, "7, 8")], "name string, line int, value string")
    flat = deck.include_all(lines, inner).withColumn("line", F.col("path")[0] * 100 + F.coalesce(F.get("path", F.lit(1)), F.lit(0))).drop("path")
    got = [(r["card"], r["is_card"], r["fields"]) for r in deck.parse(flat).orderBy("line").collect()]
    assert got == [("*NODE", True, ["*NODE", "NSET=NALL"]), ("*NODE", False, ["1", "1.5D2"]), ("*MATERIAL", True, ["*MATERIAL"]), ("*MATERIAL", False, ["7", "8"]), ("*STEP", True, ["*STEP", "INPUT=Mixed.Case"])]
    assert spark.range(1).select(deck.number(F.lit("1.5D2")), deck.number(F.lit("x"))).first()[:] == (150.0, None)


def test_state_round_trip_and_comparison(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 10.0), (2, 0, 1e-12), (3, 1, 5.0)], "id int, block int, v double")
    files.write_state({"t": df}, f"{tmp_path}/s")
    back = files.read_state(spark, f"{tmp_path}/s")["t"]
    assert files.compare(back, df, ["id"], "block", "v").count() == 0
    off = df.withColumn("v", F.col("v") + F.when(F.col("id") == 3, 0.1).otherwise(0.001))
    assert [r["id"] for r in files.compare(off, df, ["id"], "block", "v").collect()] == [3]


def test_ks_is_near_the_maximum_and_guards_its_exponent(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0)], "g string, v double")
    assert results.ks_aggregate(df, ["g"], "v", 10.0, 50.0).first()["ks"] == pytest.approx(0.9, abs=1e-3)
    with pytest.raises(Exception, match="above 600"):
        results.ks_aggregate(df, ["g"], "v", 1.0, 100.0).collect()


def test_clipping_of_triangles_and_recovery_of_a_plane(spark):
    tri = [[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]]
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(tri, square), (square, [[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]])], "s array<array<double>>, c array<array<double>>")
    got = [r[0] for r in df.select(locate.polygon_area(locate.clip_polygon("s", "c"))).collect()]
    assert got == [pytest.approx(1.0), 0.0]
    rng = np.random.default_rng(1)
    rows = [(n, float(x), float(y), 2.0 + n + 3 * float(x) - float(y)) for n in (1, 2) for x, y in rng.random((9, 2))] + [(3, 0.0, 0.0, 5.0)]
    fit = {r["node"]: r["value"] for r in locate.patch_recovery(spark.createDataFrame(rows, "node int, x double, y double, value double")).collect()}
    assert fit == {1: pytest.approx(3.0), 2: pytest.approx(4.0), 3: pytest.approx(5.0)}


def test_points_on_a_common_face_take_the_least_element(spark):
    corners = lambda s: [(0.0, 0.0, 0.0, 0.0), (s, 0.0, 0.0, s), (0.0, 1.0, 0.0, 2.0), (0.0, 0.0, 1.0, 3.0)]
    kind = "elem int, corners array<struct<x: double, y: double, z: double, value: double>>"
    tets = spark.createDataFrame([(2, corners(1.0)), (1, corners(-1.0))], kind)
    points = spark.createDataFrame([(1, 0.0, 0.25, 0.25), (2, 0.25, 0.25, 0.25), (3, 3.0, 3.0, 3.0)], "id int, x double, y double, z double")
    got = {r["id"]: (r["elem"], r["value"]) for r in locate.locate(points, tets, 1.0).collect()}
    assert got == {1: (1, 1.25), 2: (2, 1.5)}


def test_implicit_filter_against_dense(spark):
    b = [1.0, -2.0, 5.0, 0.0]
    lap = np.array([[1, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 1, 0], [0, 0, 0, 0]], float)
    edges = spark.createDataFrame([(1, 0), (2, 1)], "i long, j long")
    x = sparse.smooth(spark.createDataFrame(list(enumerate(b)), "i long, b double"), edges, 3.0)
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], np.linalg.solve(np.eye(4) + 3 * lap, b))


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, "a"), (5, 1.0, "a"), (62, 2.0, "b")], "s int, v double, k string").select(F.timestamp_seconds("s").alias("ts"), "v", "k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = replay.windowed(stream, "ts", "1 minute", "10 minutes", ["k"], "v")
    out.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(r["k"], r["total"], r["n"]) for r in spark.table("windows").collect()} == {("a", 11.0, 2), ("b", 2.0, 1)}


def test_dominant_eigenpair_of_a_graph_is_not_the_smallest_one(spark):
    """Rows of L + I sum to 1, so that the vector of ones belongs to its smallest eigenvalue."""
    rng = np.random.default_rng(8)
    near = np.triu(rng.random((60, 60)) < 0.3, 1)
    near = near | near.T
    a = np.diag(near.sum(1) + 1.0) - near
    rows = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    x, value = sparse.dominant_eigenpair(rows)
    v = np.array([r["x"] for r in x.orderBy("i").collect()])
    assert value == pytest.approx(np.linalg.eigvalsh(a)[-1], rel=1e-9) and np.linalg.norm(a @ v - value * v) <= 2e-9 * value
    with pytest.raises(ValueError, match="after 2 rounds"):
        sparse.dominant_eigenpair(rows, rounds=2)


def test_conjugate_gradient_that_has_not_converged_is_an_error(spark):
    a = spark.createDataFrame([(i, i, 2.0) for i in range(30)] + [(i, i + d, -1.0) for i in range(30) for d in (-1, 1) if 0 <= i + d < 30], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i == 0)) for i in range(30)], "i long, b double")
    with pytest.raises(ValueError, match="after 3 rounds"):
        sparse.conjugate_gradient(a, b, rounds=3)


def test_registered_power_iteration_finds_the_largest_eigenvalue(spark):
    from tessera.plans import catalog, fields

    sf = "/root/testdata/sf0.001"
    entries = fields._laplacian(spark, sf).collect()
    keys = sorted({r["i"] for r in entries})
    a = np.zeros((len(keys), len(keys)))
    for r in entries:
        a[keys.index(r["i"]), keys.index(r["j"])] += r["v"]
    assert catalog.queries()["power_iteration"](spark, sf).first()["value"] == pytest.approx(np.linalg.eigvalsh(a)[-1], abs=1e-3)


def test_filter_and_covariance_over_all_points(spark):
    from tessera.plans import catalog, fields

    sf = "/root/testdata/sf0.001"
    rows = fields._points(spark, sf).collect()
    xyz, value = np.array([[r["x"], r["y"], r["z"]] for r in rows]), np.array([r["value"] for r in rows])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    w = np.maximum(0, 0.2 - d) / 0.2
    cov = np.where(d <= 0.15, np.exp(-((d / 0.05) ** 2)), 0) * np.outer(value + 1, value + 1)
    for name, column, want in (("hat_filter_all", "filtered", (w @ value) / w.sum(1)), ("autocovariance_all", "cov", cov.sum(1))):
        got = {r["id"]: r[column] for r in catalog.queries()[name](spark, sf).collect()}
        assert got == {r["id"]: pytest.approx(x, abs=2e-5, rel=1e-6) for r, x in zip(rows, want, strict=True)}


def test_positions_in_a_global_and_a_grouped_order(spark):
    rows = spark.createDataFrame([(k * 7919 % 101, k % 3, f"p{k}") for k in range(300)], "key long, part long, payload string")
    got = [r["payload"] for r in ordering.ranked(rows, ["key"]).orderBy("pos").collect()]
    assert got == [r["payload"] for r in sorted(rows.collect(), key=lambda r: (r["key"], r["part"], r["payload"]))]
    each = ordering.ranked_within(rows, ["part"], ["key", "payload"]).collect()
    for part in range(3):
        mine = sorted((r for r in each if r["part"] == part), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(1, 101)) and [(r["key"], r["payload"]) for r in mine] == sorted((r["key"], r["payload"]) for r in mine)
    assert ordering.ranked(rows.limit(0), ["key"]).collect() == []


def test_loads_with_different_amplitudes_in_a_step_are_an_error(spark):
    df = spark.createDataFrame([(1, 7, 1.0, "a"), (1, 7, 2.0, "a"), (2, 7, 5.0, "b"), (1, 8, 1.0, "a")], "step int, node int, v double, amp string")
    got = {r["node"]: (r["v"], r["amp"], r["step"]) for r in upsert.add_loads(df, "step", ["node"], "v", "amp").collect()}
    assert got == {7: (5.0, "b", 2), 8: (1.0, "a", 1)}
    bad = df.unionByName(spark.createDataFrame([(2, 7, 1.0, "c")], df.schema))
    assert [(r["node"], r["step"]) for r in upsert.amplitude_conflicts(bad, "step", ["node"], "amp").collect()] == [(7, 2)]
    with pytest.raises(Exception, match="different amplitudes"):
        upsert.add_loads(bad, "step", ["node"], "v", "amp").collect()


def test_a_range_that_starts_beyond_the_last_id_is_an_error(spark):
    e = spark.createDataFrame([("a", 1, 12, 20, 1)], "name string, seq int, first long, last long, inc int")
    with pytest.raises(Exception, match="beyond the last id"):
        sets.expand(e, 10).collect()


def test_values_are_carried_through_a_hot_group_and_without_groups(spark):
    rng = np.random.default_rng(2)
    entries = [(0 if k % 10 else k % 7, float(t), k) for k, t in enumerate(rng.permutation(400))]
    points = [(g, float(x), n) for n, (g, x) in enumerate(zip(rng.integers(0, 8, 300).tolist(), (rng.random(300) * 420 - 10).tolist(), strict=True))]
    table = spark.createDataFrame(entries, "g long, t double, v long").repartition(6)
    got = {r["n"]: r["v_at"] for r in lookup.as_of(spark.createDataFrame(points, "g long, t double, n long"), table, ["g"], "t", ["v"]).collect()}
    want = {n: max(((t, v) for h, t, v in entries if h == g and t <= x), default=(0, None))[1] for g, x, n in points}
    assert got == want
    one = lookup.as_of(spark.createDataFrame([(x, n) for _, x, n in points], "t double, n long"), table.select("t", "v"), [], "t", ["v"])
    assert {r["n"]: r["v_at"] for r in one.collect()} == {n: max(((t, v) for _, t, v in entries if t <= x), default=(0, None))[1] for _, x, n in points}


def test_tables_with_continuations_follow_polynomials(spark):
    xs = [0.0, 1.0, 2.5, 4.0, 7.0]
    f = lambda x: 2 + 3 * x - 0.5 * x * x
    table = spark.createDataFrame([("q", x, f(x)) for x in xs] + [("two", 1.0, 5.0), ("two", 3.0, 9.0), ("one", 2.0, 4.0)], "name string, x double, y double")
    at = [-3.0, 0.0, 0.3, 1.7, 3.0, 6.9, 7.0, 9.0]
    points = spark.createDataFrame([(n, x) for n in ("q", "two", "one") for x in at], "name string, x double")
    run = lambda **how: {(r["name"], r["x"]): r["y"] for r in lookup.tabulated(points, table, ["name"], "x", "y", **how).collect()}
    got = run(order=2, low=2, high=2)
    assert all(got["q", x] == pytest.approx(f(x)) for x in at)
    assert all(got["two", x] == pytest.approx(3 + 2 * x) and got["one", x] == 4.0 for x in at)
    got = run(order=2, low=1, high=0)
    assert got["q", -3.0] == pytest.approx(f(0) + 3 * -3) and got["q", 9.0] == pytest.approx(f(7))
    got = run(order=0)
    assert [got["q", x] for x in at] == [f(0), f(0), f(0), f(1), f(2.5), f(4), f(7), f(7)]
    got = run(order=1, low=1, high=1)
    assert [got["q", x] for x in at] == [pytest.approx(np.interp(x, xs, [f(k) for k in xs]) if 0 <= x <= 7 else f(0) + x * (f(1) - f(0)) if x < 0 else f(7) + (x - 7) * (f(7) - f(4)) / 3) for x in at]


def test_nearest_passes_over_points_that_are_nowhere(spark):
    nan = float("nan")
    points = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(20)] + [(90, nan, 0.0, 0.0), (91, None, 1.0, 1.0), (92, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    queries = spark.createDataFrame([(1, 3.2, 0.0, 0.0), (2, nan, 0.0, 0.0), (3, None, 0.0, 0.0), (4, 1e6, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {(r["q_id"], r["rank"]): r["p_id"] for r in spatial.nearest(queries, points, 2, 0.5).collect()}
    assert got == {(1, 1): 3, (1, 2): 4, (4, 1): 19, (4, 2): 18}
    assert spatial.nearest(queries.filter("id in (2, 3)"), points, 2, 0.5).collect() == spatial.nearest(queries, points.limit(0), 2, 0.5).collect() == []


def _closest(p, tri):
    """By a fine search over the triangle's own coordinates."""
    a, b, c = (np.array(t) for t in tri)
    best = min(np.linalg.norm(p - (a + u * (b - a) + v * (c - a))) for u in np.linspace(0, 1, 101) for v in np.linspace(0, 1 - u, 101))
    return best


def test_points_are_attached_to_the_closest_triangle(spark):
    rng = np.random.default_rng(5)
    tris = [[tuple(x) for x in (c + rng.normal(size=(3, 3)) * 0.4).tolist()] for c in rng.random((12, 3)) * 4]
    faces = spark.createDataFrame([(k, t) for k, t in enumerate(tris)], "face long, corners array<struct<x: double, y: double, z: double>>")
    pts = rng.random((8, 3)) * 5
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "id long, x double, y double, z double")
    for r in locate.attach(points, faces).collect():
        d = [_closest(pts[r["id"]], t) for t in tris]
        assert r["distance"] == pytest.approx(min(d), abs=2e-2) and d[r["face"]] == pytest.approx(min(d), abs=2e-2)
        assert sum(r["weights"]) == pytest.approx(1) and min(r["weights"]) >= 0
    assert locate.attach(points.limit(0), faces).collect() == []


def test_brick_and_tetrahedron_matrices_reproduce_linear_fields():
    g = 1 / math.sqrt(3)
    field = lambda s: 2 + 3 * s[0] - s[1] + 0.5 * s[2]
    at = np.array([field([g * k for k in s]) for s in results.POINT_SIGNS])
    assert np.allclose(np.array(results.brick_matrix()) @ at, [field(s) for s in results.CORNER_SIGNS])
    a, b = (5 + 3 * math.sqrt(5)) / 20, (5 - math.sqrt(5)) / 20
    corners = np.array([1.0, 4.0, -2.0, 7.0])
    points = np.array([[a if i == j else b for j in range(4)] for i in range(4)]) @ corners
    assert np.allclose(np.array(results.tet_matrix()) @ points, corners)


def test_midside_nodes_get_the_mean_of_their_corners(spark):
    elements = spark.createDataFrame([(1, list(range(20))), (2, list(range(100, 120)))], "elem long, nodes array<long>")
    points = spark.createDataFrame([(e, ip, float(ip + 10 * e)) for e in (1, 2) for ip in range(1, 9)], "elem long, ip int, value double")
    got = {r["node"]: r["value"] for r in results.extrapolate(elements, points, results.brick_matrix(), results.MIDSIDES).collect()}
    corner = np.array(results.brick_matrix()) @ np.arange(11, 19)
    assert [got[k] for k in range(8)] == pytest.approx(list(corner))
    assert [got[8 + m] for m in range(12)] == pytest.approx([(corner[a] + corner[b]) / 2 for a, b in results.MIDSIDES])


def test_distributing_coupling_gives_a_rotation_back(spark):
    rng = np.random.default_rng(8)
    p, w, turn = rng.normal(size=(9, 3)), rng.random(9) + 0.5, np.array([0.3, -0.7, 1.1])
    rows = spark.createDataFrame([(1, k, *map(float, p[k]), float(w[k])) for k in range(9)] + [(2, k, float(k), 0.0, 0.0, 1.0) for k in range(3)], "group long, node long, x double, y double, z double, weight double")
    moved = np.cross(turn, p) + [1, 2, 3]
    out = constraints.distributing_coupling(rows).collect()
    got = np.zeros(6)
    for r in (r for r in out if r["group"] == 1):
        got[r["term"] - 1] += r["coef"] * moved[r["node"], r["dof"] - 1]
    assert np.allclose(got[3:], turn) and np.allclose(got[:3], (moved * w[:, None]).sum(axis=0) / w.sum())
    assert all(r["coef"] == 0 for r in out if r["group"] == 2 and r["term"] > 3)  # on a line


def test_mean_rotation_and_links_are_slopes(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(6, 3))
    rows = spark.createDataFrame([(1, k, *map(float, p[k])) for k in range(6)], "group long, node long, x double, y double, z double")
    axes = spark.createDataFrame([(1, 0.0, 0.0, 3.0)], "group long, ax double, ay double, az double")
    u = 1e-6 * np.cross([0, 0, 1.0], p)
    total = sum(r["coef"] * u[r["node"], r["dof"] - 1] for r in constraints.mean_rotation(rows, axes).collect())
    assert total / 6 == pytest.approx(1e-6)
    name = lambda k, s: {s: k} | {f"{s}{c}": float(v) for c, v in zip("xyz", p[k], strict=True)}
    corners = spark.createDataFrame([{"group": 1} | name(0, "a") | name(1, "b") | name(2, "c")])
    f = lambda q: float(np.dot(q[3] - q[2], np.cross(q[0] - q[2], q[1] - q[2])))
    for r in constraints.plane_links(rows.filter("node = 3"), corners).collect():
        step = np.zeros((6, 3))
        step[r["node"], r["dof"] - 1] = 1e-6
        assert (f(p + step) - f(p - step)) / 2e-6 == pytest.approx(r["coef"], abs=1e-6)
    ends = spark.createDataFrame([{"group": 1} | name(0, "a") | name(1, "b")])
    m = int(np.abs(p[1] - p[0]).argmax())
    h = lambda q, j: (q[3][j] - q[0][j]) * (q[1][m] - q[0][m]) - (q[3][m] - q[0][m]) * (q[1][j] - q[0][j])
    links = constraints.straight_links(rows.filter("node = 3"), ends).collect()
    assert len(links) == 12 and {r["eq"] for r in links} == {1, 2, 3} - {m + 1}
    for r in links:
        step = np.zeros((6, 3))
        step[r["node"], r["dof"] - 1] = 1e-6
        assert (h(p + step, r["eq"] - 1) - h(p - step, r["eq"] - 1)) / 2e-6 == pytest.approx(r["coef"], abs=1e-6)


def test_mac_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(40)], "id long, v array<double>")
    one, many = ({(r["id_a"], r["id_b"]): round(r["mac"], 12) for r in results.mac(rows, rows, small).collect()} for small in (1 << 20, 0))
    assert one == many and len(one) == 1600


def test_three_triangles_at_an_edge_are_an_error(spark):
    t = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 1, 4]), (3, [1, 2, 5])], "elem long, nodes array<long>")
    with pytest.raises(Exception, match="more than two triangles"):
        topology.triangle_neighbours(t).collect()


def test_decks_are_read_in_blocks_and_files_included_to_the_ninth_level(spark, tmp_path):
    lines = [f"line {k} of the deck, {'x' * (k % 40)}" for k in range(3000)]
    (tmp_path / "a.inp").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    (tmp_path / "b.inp").write_text("one\n\ntwo")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = deck.read(spark, str(tmp_path)).orderBy("deck", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    a, b = ([r for r in got if r["deck"].endswith(n)] for n in ("a.inp", "b.inp"))
    assert [r["value"] for r in a] == lines and [r["line"] for r in a] == list(range(1, 3001)) and [r["value"] for r in b] == ["one", "", "two"]
    chain = lambda n: spark.createDataFrame([(f"f{k}", 1, f"*INCLUDE, INPUT=f{k + 1}" if k + 1 < n else "end") for k in range(n)], "name string, line long, value string")
    first = spark.createDataFrame([("d", 1, "*include,input=f0"), ("d", 2, "last")], "deck string, line long, value string")
    assert [r["value"] for r in deck.include_all(first, chain(9)).orderBy("path").collect()] == ["end", "last"]
    with pytest.raises(ValueError, match="levels"):
        deck.include_all(first, chain(11))


def test_frictions_after_a_change_are_of_the_rest(spark):
    rows = [("d", k, v) for k, v in enumerate(["*FRICTION", "1,", "*Change Friction, Interaction=A", "*FRICTION", "*Restart, Read", "*RESTART, WRITE", "*Node Print", "*Surface Behavior"], 1)]
    got = [r["rank"] for r in deck.blocks(deck.parse(spark.createDataFrame(rows, "deck string, line long, value string"))).orderBy("first").collect()]
    assert got == [13, 18, 18, 0, 18, 18, 13]


def test_initial_states_and_creep_from_hooks(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 50.0)], "id long, z double")
    got = {r["id"]: (r["sxx"], r["szz"]) for r in hooks.initial_state("geostatic", rows, ["sxx", "syy", "szz"], F.col("z"), F.lit(40.0), F.lit(2.0), F.lit(0.5)).collect()}
    assert got == {1: (-30.0, -60.0), 2: (0.0, 0.0)}
    rate = rows.select(hooks.scalar("power_creep", F.col("z"), F.lit(2.0), F.lit(0.1), F.lit(2.0), F.lit(1.0)).alias("r")).collect()
    assert [r["r"] for r in rate] == pytest.approx([20.0, 500.0])


def test_as_of_takes_the_last_of_entries_at_one_place(spark):
    table = spark.createDataFrame([("a", 1.0, 3, "x"), ("a", 1.0, 5, "y"), ("a", 1.0, 4, "z"), ("a", 0.0, 9, "w"), (None, 1.0, 1, "n")], "g string, t double, n int, v string")
    points = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 0.5), ("a", -1.0), (None, 1.5), ("b", 1.0)], "g string, t double")
    got = {(r["g"], r["t"]): r["v_at"] for r in lookup.as_of(points, table.repartition(3), ["g"], "t", ["v"], ["n"]).collect()}
    assert got == {("a", 1.0): "y", ("a", 2.0): "y", ("a", 0.5): "w", ("a", -1.0): None, (None, 1.5): "n", ("b", 1.0): None}
    got = {(r["g"], r["t"]): r["v_at"] for r in lookup.as_of(points, table.repartition(4), ["g"], "t", ["v"]).collect()}
    assert got["a", 1.0] == got["a", 2.0] == "z"


def test_deck_diagnostics_and_their_counts(spark):
    lines = ["1, 2", "*NODE, NSET=ALL, COLOUR=RED", "1, 0., 1.5D0", "x, 1.", "2, 1.x", "-3, 0.", "*NSET", "1, 2", "*STRANGE, A=B", "what, ever", "*CLOAD", "SET1, 2, 5.", "3, two, 1.", "** a comment", ""]
    parsed = deck.parse(spark.createDataFrame([("d", k, v) for k, v in enumerate(lines)], "deck string, line long, value string"))
    checked = deck.check(parsed)
    issues = sorted((r["line"], r["severity"], r["reason"], r["field"]) for r in checked.issues.collect())
    assert issues == [
        (0, "error", "data before any card", None),
        (1, "warning", "parameter not recognized: COLOUR", 3),
        (3, "error", "not a positive whole number: X", 1),
        (4, "error", "not a number: 1.X", 2),
        (5, "error", "not a positive whole number: -3", 1),
        (6, "error", "parameter missing: NSET", None),
        (7, "error", "its card has an error", None),
        (12, "error", "not a whole number: TWO", 2),
    ]
    assert sorted(r["line"] for r in checked.rows.collect()) == [1, 2, 8, 9, 10, 11]
    assert checked.counts.get == {"lines": 13, "errors": 7, "warnings": 1, "unchecked": 2}


def test_long_decks_are_parsed_in_many_tasks(spark):
    lines = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "one").otherwise("two").alias("deck"), F.col("id").alias("line"), F.when(F.col("id") < 2, "*NODE").otherwise(F.concat(F.col("id").cast("string"), F.lit(", 1."))).alias("value"))
    parsed = deck.parse(lines)
    assert parsed.filter("card = '*NODE'").count() == 3000
    assert {(r["deck"], r["n_data"]) for r in deck.blocks(parsed).collect()} == {("one", 1499), ("two", 1499)}
