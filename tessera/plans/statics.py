"""A linear static analysis of eight-node bricks: from tables to displacements and stresses."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sparse

#: Local coordinates of the corners, bottom then top, counter-clockwise.
CORNERS = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float)
GAUSS = np.array(list(itertools.product((-1, 1), repeat=3)), float) / np.sqrt(3)


def slopes(at: np.ndarray) -> np.ndarray:
    """Derivatives of the eight shape functions by the local coordinates (3 x 8)."""
    f = 1 + CORNERS * at
    return np.stack([CORNERS[:, a] * f[:, (a + 1) % 3] * f[:, (a + 2) % 3] for a in range(3)]) / 8


def strain_matrix(xyz: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Strains (xx, yy, zz, xy, xz, yz; engineering shears) from the 24 displacements, and the volume factor."""
    local = slopes(at)
    jacobian = local @ xyz
    d = np.linalg.solve(jacobian, local)
    b = np.zeros((6, 24))
    for a in range(3):
        b[a, a::3] = d[a]
    for row, (p, q) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        b[row, p::3], b[row, q::3] = d[q], d[p]
    return b, float(np.linalg.det(jacobian))


def elasticity(young: float, nu: float) -> np.ndarray:
    mu, lam = young / (2 * (1 + nu)), young * nu / ((1 + nu) * (1 - 2 * nu))
    c = np.diag([2 * mu] * 3 + [mu] * 3)
    c[:3, :3] += lam
    return c


def stiffness(xyz: np.ndarray, young: float, nu: float) -> np.ndarray:
    c, k = elasticity(young, nu), np.zeros((24, 24))
    for g in GAUSS:
        b, det = strain_matrix(xyz, g)
        k += b.T @ c @ b * det
    return k


def _with_corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(elem, nodes, young, poisson) with xyz: 24 coordinates in the order of nodes."""
    each = elements.select("elem", F.posexplode("nodes").alias("pos", "node")).join(nodes, "node")
    packed = each.groupBy("elem").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y", "z").alias("p")))), lambda s: s["p"])).alias("xyz"))
    return elements.join(packed, "elem")


def element_entries(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stiffness contributions (i, j, v); dof number = 3 * node + axis."""

    def work(batches):
        for pdf in batches:
            i, j, v = [], [], []
            for r in pdf.itertuples():
                dofs = (3 * np.asarray(r.nodes)[:, None] + np.arange(3)).ravel()
                k = stiffness(np.asarray(r.xyz).reshape(8, 3), r.young, r.poisson)
                i.append(np.repeat(dofs, 24))
                j.append(np.tile(dofs, 24))
                v.append(k.ravel())
            if i:
                yield pd.DataFrame({"i": np.concatenate(i), "j": np.concatenate(j), "v": np.concatenate(v)})

    return _with_corners(elements, nodes).mapInPandas(work, "i long, j long, v double")


def solve(elements: DataFrame, nodes: DataFrame, fixed: DataFrame, loads: DataFrame) -> DataFrame:
    """Displacements (dof, u). fixed: (dof, value); loads: (dof, f).

    Prescribed dofs leave the matrix; their columns go to the right-hand side.
    """
    k = sparse.assemble(element_entries(elements, nodes), symmetric=False)
    free = k.join(fixed.select(F.col("dof").alias("i")), "i", "left_anti")
    inner = free.join(fixed.select(F.col("dof").alias("j")), "j", "left_anti").select("i", "j", "v")
    moved = free.join(fixed.select(F.col("dof").alias("j"), "value"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("value")).alias("pull"))
    b = inner.select("i").distinct().join(loads.groupBy(F.col("dof").alias("i")).agg(F.sum("f").alias("f")), "i", "left").join(moved, "i", "left")
    x, _, _ = sparse.conjugate_gradient(inner, b.select("i", (F.coalesce("f", F.lit(0.0)) - F.coalesce("pull", F.lit(0.0))).alias("b")))
    return x.select(F.col("i").alias("dof"), F.col("x").alias("u")).unionByName(fixed.select("dof", F.col("value").cast("double").alias("u")))


def _strain_matrices(xyz: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``strain_matrix`` of many elements (rows x 8 x 3) at once: rows x 6 x 24."""
    local = slopes(at)
    d = np.linalg.solve(local @ xyz, np.broadcast_to(local, (len(xyz), 3, 8)))
    b = np.zeros((len(xyz), 6, 24))
    for a in range(3):
        b[:, a, a::3] = d[:, a]
    for row, (p, q) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        b[:, row, p::3], b[:, row, q::3] = d[:, q], d[:, p]
    return b


def stresses(elements: DataFrame, nodes: DataFrame, u: DataFrame) -> DataFrame:
    """(elem, ip from 1 on, s: xx, yy, zz, xy, xz, yz) at the eight integration points.

    A node's place and displacement go together to the elements, as one row for each
    corner. The joins go by shuffles: sizes after an explode are guessed far too low.
    """
    moved = u.groupBy(F.floor(F.col("dof") / 3).alias("node")).agg(*[F.max(F.when(F.col("dof") % 3 == a, F.col("u"))).alias(f"u{x}") for a, x in enumerate("xyz")])
    at = nodes.select("node", "x", "y", "z").hint("merge").join(moved, "node", "left")
    each = elements.select("elem", F.posexplode("nodes").alias("pos", "node")).hint("merge").join(at, "node")
    packed = each.groupBy("elem").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y", "z", "ux", "uy", "uz").alias("p")))), lambda s: s["p"])).alias("at"))
    rows = elements.select("elem", F.col("young").cast("double").alias("young"), F.col("poisson").cast("double").alias("poisson")).hint("merge").join(packed, "elem")

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column(3)
            if not (lists.value_lengths().to_numpy() == 48).all() or lists.flatten().null_count:
                raise ValueError("stresses: a corner has no place, or a displacement is missing, or there are two")
            at = lists.flatten().to_numpy().reshape(n, 8, 6)
            xyz, ue = at[:, :, :3], at[:, :, 3:].reshape(n, 24)
            young, nu = (batch.column(k).to_numpy() for k in (1, 2))
            mu, lam = young / (2 * (1 + nu)), young * nu / ((1 + nu) * (1 - 2 * nu))
            out = np.empty((n, len(GAUSS), 6))
            for k, g in enumerate(GAUSS):
                e = np.einsum("rij,rj->ri", _strain_matrices(xyz, g), ue)
                out[:, k] = e * mu[:, None] * np.array([2.0] * 3 + [1.0] * 3)
                out[:, k, :3] += (lam * e[:, :3].sum(axis=1))[:, None]
            points = np.tile(np.arange(1, len(GAUSS) + 1, dtype=np.int32), n)
            s = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * 6), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), len(GAUSS)))), pa.array(points), s], names=["elem", "ip", "s"])

    return rows.mapInArrow(work, "elem long, ip int, s array<double>")


def reactions(elements: DataFrame, nodes: DataFrame, u: DataFrame, fixed: DataFrame) -> DataFrame:
    """Forces (dof, rf) at the prescribed dofs."""
    k = sparse.assemble(element_entries(elements, nodes), symmetric=False)
    y = sparse.spmv(k, u.select(F.col("dof").alias("j"), F.col("u").alias("x")))
    return y.join(fixed.select(F.col("dof").alias("i")), "i", "left_semi").select(F.col("i").alias("dof"), F.col("y").alias("rf"))


def brick_grid(cells: DataFrame, span: int = 1 << 10) -> tuple[DataFrame, DataFrame]:
    """Unit bricks at integer places (elem, cx, cy, cz) -> elements (elem, nodes) and nodes; node ids follow from the place, below ``span`` along y and z; places beyond share ids with others."""
    corner = ((CORNERS + 1) / 2).astype(int).tolist()
    at = lambda d: ((F.col("cx") + d[0]) * span + F.col("cy") + d[1]) * span + F.col("cz") + d[2]
    elements = cells.select("elem", F.array(*[at(d).cast("long") for d in corner]).alias("nodes"))
    each = cells.select(F.explode(F.array(*[F.struct(at(d).cast("long").alias("node"), *[(F.col(f"c{a}") + d[i]).cast("double").alias(a) for i, a in enumerate("xyz")]) for d in corner])).alias("n"))
    return elements, each.select("n.*").distinct()
