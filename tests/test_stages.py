"""Complex algebra, knots with finite rotations, multistage ties and table functions against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import complexes, hooks
from tessera.operators import knots

Z = "struct<re: double, im: double>"


def rotation(w):
    t = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + (np.sin(t) / t if t else 1) * k + ((1 - np.cos(t)) / t**2 if t else 0.5) * k @ k


def test_complex_algebra_and_the_largest_over_a_cycle(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(30, 3)) + 1j * rng.normal(size=(30, 3))
    df = spark.createDataFrame([(k, *[(float(z.real), float(z.imag)) for z in r]) for k, r in enumerate(values)], f"id long, a {Z}, b {Z}, c {Z}")
    got = df.select("id", complexes.mul(F.col("a"), complexes.conj(F.col("b"))).alias("m"), complexes.turned(F.col("c"), 0.7).alias("t"), complexes.largest_over_cycle([F.col("a"), F.col("b"), F.col("c")]).alias("w"), complexes.polar(F.lit(2.0), F.lit(math.pi / 3)).alias("p")).collect()
    phases = np.exp(1j * np.linspace(0, 2 * math.pi, 20001))
    for r in got:
        a, b, c = values[r["id"]]
        assert complex(*r["m"]) == pytest.approx(a * b.conjugate()) and complex(*r["t"]) == pytest.approx(c * np.exp(0.7j))
        assert r["w"] == pytest.approx(np.sqrt((np.real(np.outer([a, b, c], phases)) ** 2).sum(axis=0)).max(), rel=1e-6)
        assert complex(*r["p"]) == pytest.approx(1 + math.sqrt(3) * 1j)


def test_complex_mac_with_groups_missing_entries_and_zeros(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4, 9)) + 1j * rng.normal(size=(4, 9))
    v[1, 3:], v[3] = 0, 0
    rows = [(k, k % 2, d, (float(z.real), float(z.imag))) for k in range(4) for d, z in enumerate(v[k]) if z != 0 or k == 3]
    df = spark.createDataFrame(rows, f"id int, diameter int, dof int, value {Z}")
    for same in ((), ("diameter",)):
        got = {(r["id_a"], r["id_b"]): r for r in complexes.mac(df, df, same).collect()}
        assert len(got) == (8 if same else 16)
        for (a, b), r in got.items():
            size = np.linalg.norm(v[a]) * np.linalg.norm(v[b])
            assert complex(*r["product"]) == pytest.approx(np.vdot(v[a], v[b])) and (r["mac"] is None if size == 0 else r["mac"] == pytest.approx(abs(np.vdot(v[a], v[b])) / size))


def knot_rows(rng, state, n=7, flat=False):
    r, u, w, g = state
    p = rng.normal(size=(n, 3)) * [1, 1, 0 if flat else 1] + r
    return p, (p - r) @ rotation(w).T * (1 + g) + r + u - p


KNOT = "knot int, rx double, ry double, rz double"
NODES = "knot int, node int, x double, y double, z double"


def test_knot_terms_are_the_slopes_of_knot_places(spark):
    rng = np.random.default_rng(4)
    state = rng.normal(size=10) * 0.8
    nodes = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(rng.normal(size=(3, 3)))], NODES)
    names = ["rx", "ry", "rz", "ux", "uy", "uz", "wx", "wy", "wz", "g"]
    made = lambda s: spark.createDataFrame([(1, *map(float, s))], "knot int, " + ", ".join(f"{n} double" for n in names))
    places = lambda s: {r["node"]: np.array(r[2:]) for r in knots.knot_places(nodes, made(s)).collect()}
    terms = {(r["node"], r["dof"], r["term"]): r for r in knots.knot_terms(nodes, made(state)).collect()}
    now, h = places(state), 1e-6
    for k in range(7):
        step = np.zeros(10)
        step[3 + k] = h
        up, down = places(state + step), places(state - step)
        for node in range(3):
            for dof in range(3):
                t = terms[node, dof + 1, k + 1]
                assert t["coef"] == pytest.approx((up[node][dof] - down[node][dof]) / (2 * h), abs=1e-7)
                whole = t["rest"] + sum(terms[node, dof + 1, j + 1]["coef"] * state[3 + j] for j in range(7))
                assert whole == pytest.approx(now[node][dof])


def test_fitted_knots_keep_large_rotations(spark):
    rng = np.random.default_rng(5)
    turns = [np.array([0, 0, math.pi / 2]), np.array([2.0, -1.0, 0.5]), np.zeros(3), np.array([0.0, 3.1, 0.0]), np.array([1e-7, 0, 0])]
    rows, states = [], []
    for k, w in enumerate(turns):
        state = rng.normal(size=3), rng.normal(size=3), w, 0.2 * k - 0.3
        states.append(state)
        p, u = knot_rows(rng, state, flat=k == 1)
        rows += [(k, j, *map(float, a), *map(float, b)) for j, (a, b) in enumerate(zip(p, u, strict=True))]
    nodes = spark.createDataFrame(rows, NODES + ", ux double, uy double, uz double")
    held = spark.createDataFrame([(k, *map(float, s[0])) for k, s in enumerate(states)] + [(9, 0.0, 0.0, 0.0)], KNOT)
    found = {r["knot"]: r for r in knots.fit_knots(nodes, held).collect()}
    for k, (_, u, w, g) in enumerate(states):
        r = found[k]
        assert r["off"] < 1e-9 and r["g"] == pytest.approx(g, abs=1e-9)
        assert [r["ux"], r["uy"], r["uz"]] == pytest.approx(u, abs=1e-9)
        assert np.allclose(rotation(np.array([r["wx"], r["wy"], r["wz"]])), rotation(w), atol=1e-9)
    assert all(found[9][c] == 0 for c in ("ux", "wx", "g", "off"))


def test_noise_leaves_a_least_square_and_one_node_no_turn(spark):
    rng = np.random.default_rng(6)
    p, u = knot_rows(rng, (np.zeros(3), np.ones(3), np.array([0.3, 0.4, -0.2]), 0.1), n=40)
    u = u + rng.normal(size=u.shape) * 0.01
    rows = [(1, j, *map(float, a), *map(float, b)) for j, (a, b) in enumerate(zip(p, u, strict=True))] + [(2, 0, 1.0, 2.0, 3.0, 0.5, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, NODES + ", ux double, uy double, uz double")
    found = {r["knot"]: r for r in knots.fit_knots(nodes, spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 2.0, 3.0)], KNOT)).collect()}
    assert 0.005 < found[1]["off"] < 0.03 and found[1]["wx"] == pytest.approx(0.3, abs=0.02)
    assert [found[2][c] for c in ("ux", "wx", "wy", "wz", "g")] == pytest.approx([0.5, 0, 0, 0, 0])


@pytest.mark.parametrize("diameter", [0, 2])
def test_multistage_ties_reproduce_turned_waves(spark, diameter):
    """A field that is linear in the modelled sector and turns with its phase: ties give each node all around its value."""
    sectors, rng = 6, np.random.default_rng(7)
    step = 2 * math.pi / sectors
    corners = [(0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (4 * math.cos(step), 4 * math.sin(step), 1.0)]
    faces = spark.createDataFrame([(5, [(k, *c) for k, c in enumerate(corners)])], "face int, corners array<struct<node: int, x: double, y: double, z: double>>")
    u = rng.normal(size=(3, 3)) + 1j * rng.normal(size=(3, 3))
    rows, wanted = [], {}
    for n in range(24):
        w, k = rng.dirichlet(np.ones(3)), n % sectors
        turn = rotation(np.array([0, 0, k * step]))
        rows.append((n, *map(float, turn @ (w @ np.array(corners)) + [0, 0, 0.01])))
        wanted[n] = np.exp(1j * diameter * k * step) * turn @ (w @ u)
    rows.append((99, 50.0, 0.0, 0.0))
    got = knots.multistage(spark.createDataFrame(rows, "id int, x double, y double, z double"), faces, sectors, 0.1, diameter).collect()
    assert {r["id"] for r in got} == set(range(24))
    for n, value in wanted.items():
        for dof in range(3):
            mine = sum(complex(r["re"], r["im"]) * u[r["node"], r["term"] - 1] for r in got if r["id"] == n and r["dof"] == dof + 1)
            assert mine == pytest.approx(value[dof], abs=1e-9)
        assert {r["sector"] for r in got if r["id"] == n} == {n % sectors}


def test_table_functions_take_tables_and_name_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(hooks, "UDTF_ROWS", 3)
    hooks.register_elements(spark, "spring", ["a", "b", "k"])
    rows = spark.createDataFrame([(k, k + 1, float(k), "more") for k in range(10)], "a long, b long, k double, other string").repartition(3)
    by_hook = hooks.elements("spring", rows).groupBy("i", "j").agg(F.sum("v").alias("v"))
    by_sql = spark.sql("SELECT i, j, sum(v) AS v FROM spring(TABLE({rows}) PARTITION BY a) GROUP BY i, j", rows=rows)
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_hook.collect()))
    assert spark.sql("SELECT * FROM spring(TABLE({rows}))", rows=rows.limit(0)).collect() == []
    with pytest.raises(Exception, match="no column k"):
        spark.sql("SELECT * FROM spring(TABLE({rows}))", rows=rows.drop("k")).collect()
    with pytest.raises(Exception, match="argument is a table"):
        spark.sql("SELECT * FROM spring(1)").collect()
