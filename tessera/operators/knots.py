"""Constraints whose coefficients follow the present geometry: knots that turn and grow, and ties of stages with different sectors.

A knot's nodes move with a reference: a shift u, a rotation vector w and a growth g,
so that a node at p goes to r + u + (1 + g) R(w) (p - r), R being Rodrigues' finite
rotation. Near a present state the constraint is linear, and its coefficients are
made anew from that state each round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import complexes
from tessera.operators.constraints import _cross
from tessera.operators.locate import attach
from tessera.scratch import materialize, release

TERMS = 7
#: Rounds of a fit at most, and the change of a state at which it ends.
ROUNDS, CLOSE = 50, 1e-12


def _sine_parts(w: list[Column]) -> tuple[Column, Column, Column]:
    """sin t / t, (1 - cos t) / t^2 and (t - sin t) / t^3 of the vector's length t, by their series near 0."""
    t2 = w[0] * w[0] + w[1] * w[1] + w[2] * w[2]
    t = F.sqrt(t2)
    small = t2 < 1e-6
    return (
        F.when(small, 1 - t2 / 6).otherwise(F.sin(t) / t),
        F.when(small, 0.5 - t2 / 24).otherwise((1 - F.cos(t)) / t2),
        F.when(small, 1 / 6 - t2 / 120).otherwise((t - F.sin(t)) / (t2 * t)),
    )


def _along(scale: Column, v: list[Column]) -> list[Column]:
    return [scale * c for c in v]


def _plus(*vectors: list[Column]) -> list[Column]:
    return [a + b for a, b in zip(*vectors, strict=True)] if len(vectors) == 2 else _plus(vectors[0], _plus(*vectors[1:]))


def rotated(w: list[Column], d: list[Column]) -> list[Column]:
    """R(w) d."""
    a, b, _ = _sine_parts(w)
    wd = _cross(w, d)
    return _plus(d, _along(a, wd), _along(b, _cross(w, wd)))


def _state(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Columns e_x.. (the turned arm), moved x.. (where the node is by the knot), and the arm's slope by each part of w."""
    d = [F.col(a) - F.col(f"r{a}") for a in "xyz"]
    w = [F.col(f"w{a}") for a in "xyz"]
    turned = rotated(w, d)
    out = rows.withColumns({f"__e{a}": v for a, v in zip("xyz", turned, strict=True)})
    _, b, c = _sine_parts(w)
    e = [F.col(f"__e{a}") for a in "xyz"]
    slopes = []
    for k in range(3):
        unit = [F.lit(1.0 if j == k else 0.0) for j in range(3)]
        wu = _cross(w, unit)
        turn = _plus(unit, _along(b, wu), _along(c, _cross(w, wu)))  # how the rotation turns when w grows along k
        slopes.append(_along(1 + F.col("g"), _cross(turn, e)))
    return out, slopes


def knot_places(nodes: DataFrame, knots: DataFrame) -> DataFrame:
    """knot, node, ux, uy, uz: where knots (knot, rx.., ux.., wx.., g) take their nodes (knot, node, x, y, z)."""
    rows, _ = _state(nodes.join(knots, "knot"))
    return rows.select("knot", "node", *[(F.col(f"u{a}") + F.col(f"r{a}") - F.col(a) + (1 + F.col("g")) * F.col(f"__e{a}")).alias(f"u{a}") for a in "xyz"])


def knot_terms(nodes: DataFrame, knots: DataFrame) -> DataFrame:
    """knot, node, dof, term, coef, and the rest, of u_dof = rest + sum coef * (state of the knot by term), linear around the present states.

    Terms 1 to 3 are the shift, 4 to 6 the rotation vector, 7 the growth; the rest is
    such that at the present state itself the constraint is exact.
    """
    rows, slopes = _state(nodes.join(knots, "knot"))
    states = [*(F.col(f"u{a}") for a in "xyz"), *(F.col(f"w{a}") for a in "xyz"), F.col("g")]
    each = []
    for i, a in enumerate("xyz"):
        coefs = [F.lit(1.0 if i == j else 0.0) for j in range(3)] + [slopes[k][i] for k in range(3)] + [F.col(f"__e{a}")]
        now = F.col(f"u{a}") + F.col(f"r{a}") - F.col(a) + (1 + F.col("g")) * F.col(f"__e{a}")
        rest = now
        for c, s in zip(coefs, states, strict=True):
            rest = rest - c * s
        each.append(F.struct(F.lit(i + 1).alias("dof"), rest.alias("rest"), F.array(*[F.struct(F.lit(k + 1).alias("term"), c.alias("coef")) for k, c in enumerate(coefs)]).alias("terms")))
    out = rows.select("knot", "node", F.explode(F.array(*each)).alias("x")).select("knot", "node", "x.dof", "x.rest", F.explode("x.terms").alias("t"))
    return out.select("knot", "node", "dof", "t.term", "t.coef", "rest")


def _composed(step: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rotation vectors of the rotations by ``step`` after those by ``w`` (rows), by quaternions; of one turn the shorter way."""

    def quaternion(v):
        t = np.linalg.norm(v, axis=1, keepdims=True)
        return np.concatenate([np.cos(t / 2), v * np.where(t > 1e-8, np.sin(t / 2) / np.maximum(t, 1e-300), 0.5)], axis=1)

    a, b = quaternion(step), quaternion(w)
    real = a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(axis=1, keepdims=True)
    part = a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])
    part, real = np.where(real < 0, -part, part), np.abs(real)
    size = np.linalg.norm(part, axis=1, keepdims=True)
    return part * np.where(size > 1e-12, 2 * np.arctan2(size, real) / np.maximum(size, 1e-300), 2.0)


def fit_knots(nodes: DataFrame, knots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """knot, rx.., ux.., wx.., g, off: the states that come closest to their nodes' displacements (knot, node, x, y, z, ux, uy, uz); ``knots`` are (knot, rx, ry, rz).

    Each round makes the coefficients anew from the present state, sums up the normal
    equations of each knot, seven unknowns whatever its number of nodes, and adds the
    step: the rotation's part by turning further, not by adding vectors. off is the
    root of the mean square that is left. Knots whose nodes leave a rotation or the
    growth open (one node, or all on a line) keep that part at 0. No end within
    ``rounds`` is an error.
    """
    zero = F.lit(0.0)
    state = materialize(knots.select("knot", "rx", "ry", "rz", *[zero.alias(c) for c in ("ux", "uy", "uz", "wx", "wy", "wz", "g")]), "knots")
    target = nodes.select("knot", *"xyz", *[F.col(f"u{a}").alias(f"t{a}") for a in "xyz"])

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        full, right, w = np.zeros((len(a), TERMS, TERMS)), np.stack(b.to_numpy()), np.stack(w.to_numpy())
        i, j = np.triu_indices(TERMS)
        full[:, i, j] = full[:, j, i] = np.stack(a.to_numpy())
        step = np.einsum("nij,nj->ni", np.linalg.pinv(full, rcond=1e-12, hermitian=True), right)
        turn = step[:, 3:6] * np.minimum(1, 1.5 / np.maximum(np.linalg.norm(step[:, 3:6], axis=1, keepdims=True), 1e-300))
        return pd.Series(list(np.concatenate([step[:, :3], _composed(turn, w), step[:, 6:], np.abs(step).max(axis=1, keepdims=True)], axis=1)))

    for _ in range(rounds):
        rows, _ = _state(target.join(state, "knot"))
        e = [F.col(f"__e{a}") * (1 + F.col("g")) for a in "xyz"]
        off = [F.col(f"t{a}") - (F.col(f"u{a}") + F.col(f"r{a}") - F.col(a) + e[i]) for i, a in enumerate("xyz")]
        one, none = F.lit(1.0), F.lit(0.0)
        # Slopes by the shift, by a further turn (its axis across the turned arm) and by the growth.
        columns = [[one if i == k else none for i in range(3)] for k in range(3)] + [_cross([one if i == k else none for i in range(3)], e) for k in range(3)] + [[F.col(f"__e{a}") for a in "xyz"]]
        dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
        sums = [F.sum(dot(columns[i], columns[j])) for i in range(TERMS) for j in range(i, TERMS)]
        per = rows.groupBy("knot").agg(F.array(*sums).alias("a"), F.array(*[F.sum(dot(c, off)) for c in columns]).alias("b"), F.sqrt(F.avg(dot(off, off))).alias("__off"))
        # Knots without nodes have sums of 0, and so stay as they are.
        held = [F.coalesce(c, F.array(*[zero] * n)) for c, n in (("a", len(sums)), ("b", TERMS))]
        stepped = state.join(per, "knot", "left").withColumn("s", solved(*held, F.array("wx", "wy", "wz")))
        s = F.col("s")
        moved = [(F.col(f"u{a}") + s[k]).alias(f"u{a}") for k, a in enumerate("xyz")] + [s[3 + k].alias(f"w{a}") for k, a in enumerate("xyz")]
        new = materialize(stepped.select("knot", "rx", "ry", "rz", *moved, (F.col("g") + s[6]).alias("g"), s[7].alias("moved"), F.coalesce("__off", zero).alias("off")), "knots")
        release(state)
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        state = new.drop("moved")
        state._tessera_path = new._tessera_path
        if moved < CLOSE:
            return state
    raise ArithmeticError(f"knots: {rounds} rounds leave a state moving by {moved:.1e}")


def multistage(slaves: DataFrame, faces: DataFrame, sectors: int, tolerance: float, diameter: int = 0, scale: float = 1.0) -> DataFrame:
    """Nodes (id, x, y, z) of one stage on the triangles (face, corners: three (node, x, y, z)) of one sector of another, which has ``sectors`` of them about z -> id, face, sector, gap, node, dof, term, re, im.

    A node is turned back by whole sectors of the other stage, to the sector that is
    modelled and to both beside it, as its faces may be slanted; the nearest face of the
    three counts. The turned displacement is shared among the corners, and its phase
    is that of ``diameter`` waves around the circle: dof of the node = the sum of
    (re + i im) * term of the corners' nodes. Nodes farther off than the tolerance
    have no rows. ``scale`` is the ratio of the two sectors' numbers, where loads are tied.
    """
    step = 2 * math.pi / sectors
    angle = lambda y, x: F.pmod(F.atan2(y, x), F.lit(2 * math.pi))
    # Where the modelled sector begins, by the mean direction of its corners.
    middle = faces.select(F.explode("corners").alias("c")).agg(F.sum("c.x"), F.sum("c.y")).first()
    if middle[0] is None:
        middle = (1.0, 0.0)
    begin = math.atan2(middle[1], middle[0]) - step / 2
    turns = F.floor(F.pmod(angle(F.col("y"), F.col("x")) - begin, F.lit(2 * math.pi)) / step)
    tried = slaves.withColumn("__k", F.explode(F.array(*[F.pmod(turns + k, F.lit(sectors)) for k in (-1, 0, 1)]))).distinct()
    back = -F.col("__k") * step
    c, s = F.cos(back), F.sin(back)
    places = tried.select(F.struct("id", F.col("__k").cast("int").alias("k")).alias("id"), (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"), "z")
    near = attach(places, faces, tolerance).filter(F.col("distance") <= tolerance)
    best = near.groupBy(F.col("id.id").alias("id")).agg(F.min_by(F.struct("face", "corners", "weights", F.col("distance").alias("gap"), F.col("id.k").alias("sector")), F.struct(F.round("distance", 9), F.col("id.k"), F.col("face"))).alias("r")).select("id", "r.*")
    turn = F.col("sector") * step
    r = [[F.cos(turn), -F.sin(turn), F.lit(0.0)], [F.sin(turn), F.cos(turn), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    phase = complexes.number(F.cos(turn * diameter), F.sin(turn * diameter))
    parts = [F.struct(F.lit(i + 1).alias("dof"), F.lit(j + 1).alias("term"), r[i][j].alias("by")) for i in range(3) for j in range(3) if (i < 2) == (j < 2)]
    rows = best.withColumn("phase", phase).select("*", F.explode(F.arrays_zip(F.transform("corners", lambda k: k["node"]).alias("node"), F.col("weights").alias("w"))).alias("x")).select("*", F.explode(F.array(*parts)).alias("p"))
    coef = F.col("x.w") * F.col("p.by") * scale
    return rows.select("id", "face", "sector", "gap", "x.node", "p.dof", "p.term", (coef * F.col("phase.re")).alias("re"), (coef * F.col("phase.im")).alias("im"))
