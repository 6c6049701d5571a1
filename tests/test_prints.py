"""Frames, contact prints, error lines, scatter, consistent modal mass and friction heat against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import constraints, locate, results, sparse, spatial


def test_vectors_in_tilted_frames(spark):
    rng = np.random.default_rng(3)
    frames = [(0, "R", *rng.normal(size=6)), (1, "C", *rng.normal(size=6)), (2, "R", *([1.0, 0.0, 0.0] * 2)), (3, "C", *([1.0, 2.0, 3.0] * 2))]
    rows = [(k, k % 5, *rng.normal(size=6)) for k in range(40)]
    axis = np.array(frames[1][5:8]) - np.array(frames[1][2:5])
    on = np.array(frames[1][2:5]) + 0.4 * axis
    rows.append((99, 1, *on, *rng.normal(size=3)))
    as_rows = lambda t: [tuple(v if isinstance(v, str) or n < 2 else float(v) for n, v in enumerate(r)) for r in t]
    v = spark.createDataFrame(as_rows(rows), "id int, frame int, x double, y double, z double, vx double, vy double, vz double")
    f = spark.createDataFrame(as_rows(frames), "frame int, kind string, ax double, ay double, az double, bx double, by double, bz double")
    got = {r["id"]: np.array([r["v1"], r["v2"], r["v3"]]) for r in spatial.in_frames(v, f).collect()}
    for k, frame, *c in rows:
        p, w = np.array(c[:3]), np.array(c[3:])
        if frame == 0:
            a, b = np.array(frames[0][2:5]), np.array(frames[0][5:8])
            e1, e3 = a / np.linalg.norm(a), np.cross(a, b) / np.linalg.norm(np.cross(a, b))
            wanted = [e1 @ w, np.cross(e3, e1) @ w, e3 @ w]
        elif frame == 1 and k != 99:
            a, e3 = np.array(frames[1][2:5]), axis / np.linalg.norm(axis)
            r = p - a - ((p - a) @ e3) * e3
            r /= np.linalg.norm(r)
            wanted = [r @ w, np.cross(e3, r) @ w, e3 @ w]
        elif k == 99:
            assert np.linalg.norm(got[k]) == pytest.approx(np.linalg.norm(w)) and got[k][2] == pytest.approx(axis @ w / np.linalg.norm(axis))
            continue
        else:
            wanted = w  # no frame, or one without a direction
        assert got[k] == pytest.approx(np.array(wanted))


def test_contact_print_by_hand(spark):
    row = "pair int, a double, x double, y double, z double, nx double, ny double, nz double, pressure double, tx double, ty double, tz double, clearance double, energy double"
    c = spark.createDataFrame([(1, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 3.0, 0.5, 0.0, 0.0, -0.1, 1.0), (1, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.4, 9.0), (2, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, 0.2, 0.0)], row)
    got = {r["pair"]: r for r in results.contact_print(c, ["pair"]).collect()}
    one = got[1]
    assert (one["n_contacts"], one["n_closed"], one["area"], one["energy"], one["most_pressure"], one["least_clearance"]) == (2, 1, 2.0, 2.0, 3.0, -0.1)
    assert (one["fx"], one["fz"], one["my"], one["normal_force"], one["shear_force"]) == (1.0, -6.0, 6.0, -6.0, 1.0)
    assert (got[2]["n_contacts"], got[2]["n_closed"], got[2]["fz"]) == (1, 0, None)
    assert results.contact_print(c, ["pair"], "shear").filter("pair = 1").first()["fz"] == 0
    assert results.contact_print(c, ["pair"], "normal").filter("pair = 1").first()["fx"] == 0


def test_error_lines_meet_and_unknown_types_have_none(spark):
    for kind, lines in results.ERROR_LINES.items():
        for name, (first, *more) in lines.items():
            assert first[0] > 0
            if more:
                assert first[0] * more[1] + first[1] == pytest.approx(more[0][0] * more[1] + more[0][1], rel=0.02), (kind, name)
    spread = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.2)], "node int, relative double")
    types = spark.createDataFrame([(1, "tet10"), (1, "tet10"), (1, "brick8"), (2, "what"), (3, "brick20r")], "node int, type string")
    got = {r["node"]: r["error"] for r in results.error_per_cent(spread, types).collect()}
    assert got == {1: pytest.approx(3.1847), 2: None, 3: pytest.approx(74.318 * 0.2 - 9.727)}


def test_scatter_and_structure_of_a_large_element(spark):
    rng = np.random.default_rng(5)
    dofs = {e: rng.choice(60, size=n, replace=False) for e, n in ((1, 4), (2, 50))}
    local = {e: rng.normal(size=(len(d), len(d))) for e, d in dofs.items()}
    dense = np.zeros((60, 60))
    for e, d in dofs.items():
        dense[np.ix_(d, d)] += local[e]
    entries = spark.createDataFrame([(e, a, b, float(m[a, b])) for e, m in local.items() for a in range(len(m)) for b in range(len(m))], "elem int, a int, b int, v double")
    places = spark.createDataFrame([(e, k, int(d)) for e, ds in dofs.items() for k, d in enumerate(ds)], "elem int, pos int, dof int")
    got = np.zeros((60, 60))
    for r in sparse.assemble(sparse.scatter(entries, places), symmetric=False).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, dense)
    there = sparse.structure(places.groupBy("elem").agg(F.collect_list("dof").alias("dofs")))
    assert {(r["i"], r["j"]) for r in there.collect()} == {(i, j) for i in range(60) for j in range(i + 1) if dense[i, j] != 0 or dense[j, i] != 0}


def test_consistent_modal_mass_against_dense_and_lumped(spark):
    rng = np.random.default_rng(6)
    n, axis = 9, np.arange(9) % 3
    m = rng.normal(size=(n, n))
    m = (m @ m.T) * (axis[:, None] == axis)
    x = rng.normal(size=(2, n))
    x[1, 4] = 0
    phi = spark.createDataFrame([(k, i, float(x[k, i]), int(axis[i])) for k in range(2) for i in range(n) if x[k, i]], "mode int, i int, x double, axis int")
    mass = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i int, j int, m double")
    for r in results.modal_mass_full(phi, mass).collect():
        v, unit = x[r["mode"]], (axis == r["axis"]).astype(float)
        lever, size = v @ m @ unit, v @ m @ v
        assert r["participation"] == pytest.approx(lever / size) and r["effective_mass"] == pytest.approx(lever**2 / size)


def test_friction_heat_is_shared(spark):
    df = spark.createDataFrame([(2.0, -3.0), (-1.0, 5.0)], "p double, v double")
    args = [F.col("p"), F.lit(0.5), F.col("v"), F.lit(0.9), F.lit(0.25)]
    got = df.select(hooks.scalar("friction_heat_slave", *args), hooks.scalar("friction_heat_master", *args)).collect()
    assert tuple(got[0]) == (pytest.approx(0.675), pytest.approx(2.025)) and tuple(got[1]) == (0.0, 0.0)


def test_beam_links_bring_lengths_back(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    ua, ub = np.zeros((6, 3)), rng.normal(size=(6, 3)) * 0.2
    wanted = ((a - b) ** 2).sum(axis=1)
    names = [f"{s}{c}" for s in "ab" for c in "xyz"] + [f"u{c}_{s}" for s in "ab" for c in "xyz"]
    for _ in range(6):  # each round makes the terms anew and moves the first dof of the first end
        rows = [(k, 1, 2, *map(float, [*a[k], *b[k], *ua[k], *ub[k]])) for k in range(6)]
        terms = constraints.beam_links(spark.createDataFrame(rows, "pair int, a int, b int, " + ", ".join(f"{n} double" for n in names))).collect()
        for r in terms:
            if r["pos"] == 1:
                assert r["node"] == 1 and r["dof"] == int(np.abs(a[r["pair"]] - b[r["pair"]]).argmax()) + 1
                ua[r["pair"], r["dof"] - 1] -= r["residual"] / r["coef"]
    assert np.allclose(((a + ua - b - ub) ** 2).sum(axis=1), wanted)


def test_patch_fits_in_space(spark):
    rng = np.random.default_rng(8)
    at = rng.normal(size=(3, 25, 3)) * np.array([1e-3, 1.0, 100.0])[:, None, None]
    field = lambda n, p: 4.0 + n + 2 * p[0] - p[1] * p[2] + 0.3 * p[0] ** 2
    rows = [(n, *map(float, p), float(field(n, p))) for n in range(3) for p in at[n]] + [(9, 0.5, 0.0, 0.0, 7.0), (9, -0.5, 0.0, 0.0, 3.0)]
    got = {r["node"]: r for r in locate.patch_fit(spark.createDataFrame(rows, "node int, x double, y double, z double, value double"), degree=2).collect()}
    assert [got[n]["value"] for n in range(3)] == pytest.approx([4.0, 5.0, 6.0], rel=1e-6) and got[9]["n_samples"] == 2
    elements = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [2, 3, 4, 6, 7])], "elem int, nodes array<int>")
    points = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 5.0), (2, 0.0, 1.0, 0.0, 6.0)], "elem int, x double, y double, z double, value double")
    nodes = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(8)], "node int, x double, y double, z double")
    samples = locate.patch_samples(elements, points, nodes, 4).collect()
    assert sorted((r["node"], r["x"], r["value"]) for r in samples) == [(1, 0.0, 5.0), (2, -2.0, 6.0), (2, -1.0, 5.0), (3, -3.0, 6.0), (3, -2.0, 5.0), (4, -4.0, 6.0), (4, -3.0, 5.0), (6, -6.0, 6.0)]


def test_closest_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id int, v array<double>")
    got = results.closest(results.mac(v.filter("id = 1"), v), 2).orderBy("rank").collect()
    assert [(r["id_b"], r["rank"]) for r in got] == [(1, 1), (4, 2)]
