"""Search among things of very different size: space-filling order, a grid per size, and a packed tree of boxes.

The grid puts each element on the level whose cells are as wide as the element, so
that it stands in at most two cells along each axis, and a point looks into one
cell of every level that has elements. The tree sorts boxes along a space-filling
curve and packs them by their place in that order, FANOUT at a time, level upon
level; so its nodes are equally full wherever the boxes crowd. Each task goes down
its upper levels by itself; a tree of more boxes ends in equality joins on nodes,
however far off a query is.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked
from tessera.scratch import materialize, release

AXES = ("x", "y", "z")
#: Children of a node, and nodes of a level that are few enough to go to all tasks.
FANOUT, FEW_NODES = 16, 4096
#: Boxes of a tree's lowest level that still goes to all tasks (48 bytes each in space), and pairs that a task looks at together.
TASK_BOXES, TASK_PAIRS = 1 << 19, 1 << 19
#: Bits of each coordinate in the order along the curve, and the levels of the grid, as powers of two of its unit.
CURVE_BITS, LOWEST, HIGHEST = 20, -60, 60


def bin_sort(points: DataFrame, x: str, y: str, position: str = "pos") -> DataFrame:
    """``points`` plus bin and their place in its order: a grid of n ** 1/4 bins a side, row by row, every other row backwards, so that neighbours in the order are neighbours in space.

    Points of one bin are ordered by their other columns; rows without a number for x or y come first, without a bin.
    """
    a, b = (F.col(c).cast("double") for c in (x, y))
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    r = points.filter(known).agg(F.count("*"), F.min(a), F.max(a), F.min(b), F.max(b)).first()
    side = max(1, round((r[0] or 1) ** 0.25))
    spot = lambda v, low, high: F.floor((v - low) * side / ((high - low) * 1.01)) if high > low else F.lit(0).cast("long")
    if not r[0]:
        return points.withColumn("bin", F.lit(None).cast("long")).withColumn(position, F.lit(None).cast("long")).limit(0) if points.isEmpty() else ranked(points.withColumn("bin", F.lit(None).cast("long")), ["bin"], position)
    column, row = spot(a, r[1], r[2]), spot(b, r[3], r[4])
    number = F.when(row % 2 == 0, row * side + column + 1).otherwise((row + 1) * side - column)
    return ranked(points.withColumn("bin", F.when(known, number)), ["bin"], position)


def _spread(v: Column) -> Column:
    """The 21 low bits of v, each with two 0 bits before the next."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(at: list[Column], low: list[float], high: list[float]) -> Column:
    """Place along the Z-curve of a position within the box from low to high."""
    whole = (1 << CURVE_BITS) - 1
    spots = [F.when(F.lit(h > lo), F.floor((v - lo) * (whole / (h - lo) if h > lo else 0.0))).otherwise(0).cast("long") for v, lo, h in zip(at, low, high, strict=True)]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_spread(s), k) for k, s in enumerate(spots)])


@dataclass
class BoxTree:
    """items with their place along the curve (__pos, from 0 on) and their leaf (__node); levels: (node, parent, n, low, high) per level, the lowest first; low and high name the ends of the items' boxes."""

    items: DataFrame
    levels: list[DataFrame]
    sizes: list[int]
    count: int
    low: list[str]
    high: list[str]


def box_tree(items: DataFrame, low: list[str], high: list[str]) -> BoxTree | None:
    """A packed tree over boxes; low and high name the columns of their ends. None without items; all ends must be numbers."""
    ends = items.agg(F.count("*"), *[F.min(F.col(c).cast("double")) for c in low], *[F.max(F.col(c).cast("double")) for c in high]).first()
    if not ends[0]:
        return None
    d = len(low)
    least, most = list(ends[1 : d + 1]), list(ends[d + 1 : 2 * d + 1])
    middle = [(F.col(a).cast("double") + F.col(b).cast("double")) / 2 for a, b in zip(low, high, strict=True)]
    key = curve_key(middle, least, most) if d <= 3 else F.lit(0)
    order = ranked(items.withColumn("__key", key), ["__key"], "__pos")
    held = materialize(order.withColumn("__pos", F.col("__pos") - 1).withColumn("__node", F.floor(F.col("__pos") / FANOUT)).drop("__key"), "boxes")
    release(order._tessera_dealt)
    boxes = held.select(F.col("__node").alias("node"), F.lit(1).cast("long").alias("n"), F.array(*[F.col(c).cast("double") for c in low]).alias("low"), F.array(*[F.col(c).cast("double") for c in high]).alias("high"))
    levels, sizes, count = [], [], ends[0]
    while True:
        ends_of = [F.array(*[f(F.col(c)[k]) for k in range(d)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
        level = boxes.groupBy("node").agg(F.sum("n").alias("n"), *ends_of).withColumn("parent", F.floor(F.col("node") / FANOUT))
        level = materialize(level, "nodes")
        count = -(-count // FANOUT)
        levels.append(level)
        sizes.append(count)
        if count <= FANOUT:
            return BoxTree(held, levels, sizes, ends[0], low, high)
        boxes = level.select(F.col("parent").alias("node"), "n", "low", "high")


def task_levels(tree: BoxTree) -> tuple[list[tuple], int]:
    """(low, high, n) as arrays by node, of the levels that go to all tasks, the highest first; and which is the last: -1 the items themselves, else its number in ``levels``."""
    d = len(tree.low)
    items = tree.items.select(F.col("__pos").alias("node"), F.lit(1).cast("long").alias("n"), *[F.col(c).cast("double").alias(f"e{k}") for k, c in enumerate([*tree.low, *tree.high])])
    frames = [items, *[t.select("node", "n", *[F.col(side)[k].alias(f"e{i * d + k}") for i, side in enumerate(("low", "high")) for k in range(d)]) for t in tree.levels]]
    first = next(k for k, size in enumerate([tree.count, *tree.sizes]) if size <= TASK_BOXES)
    arrays = []
    for frame in frames[first:]:
        t = frame.toArrow()
        order = np.argsort(t.column("node").to_numpy())
        ends = np.stack([t.column(f"e{k}").to_numpy()[order] for k in range(2 * d)], 1)
        arrays.append((ends[:, :d].copy(), ends[:, d:].copy(), t.column("n").to_numpy()[order]))
    return arrays[::-1], first - 1


def _bounds(query: np.ndarray, far: np.ndarray, n: np.ndarray, k: int, rows: int) -> np.ndarray:
    """For each of ``rows`` queries the distance within which k items are for certain, from nodes with n items; infinite where there are fewer."""
    out = np.full(rows, np.inf)
    if k > 1:
        order = np.lexsort((far, query))
        query, far, so_far = query[order], far[order], np.cumsum(n[order])
        first = np.r_[True, query[1:] != query[:-1]]
        before = np.maximum.accumulate(np.where(first, so_far - n[order], 0))
        enough = so_far - before >= k
        query, far = query[enough], far[enough]
    np.minimum.at(out, query, far)
    return out


def descend(at: np.ndarray, levels: list[tuple], k: int, most: float = np.inf):
    """Batches (row, node, near, bound) of the nodes of the last level that may hold one of the k nearest items of places ``at`` (rows x axes), no farther than the squared distance ``most``; ``near`` is a node's squared distance, and all nodes of a row come together.

    Rows whose nodes are too many to be looked at together are halved; those with a
    coordinate that is null, infinite or NaN have none.
    """
    placed = np.flatnonzero(np.isfinite(at).all(axis=1))
    todo = [placed[s : s + 4096] for s in range(0, len(placed), 4096)][::-1]
    while todo:
        rows = todo.pop()
        query, node = np.repeat(np.arange(len(rows)), len(levels[0][0])), np.tile(np.arange(len(levels[0][0])), len(rows))
        bound = np.full(len(rows), most)
        for depth, (low, high, n) in enumerate(levels):
            if depth:
                query, node = np.repeat(query, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(low)
                query, node = query[real], node[real]
            near, far = np.zeros(len(node)), np.zeros(len(node))
            for a in range(low.shape[1]):
                x, lo, hi = at[rows[query], a], low[node, a], high[node, a]
                off, reach = np.maximum(np.maximum(lo - x, x - hi), 0.0), np.maximum(x - lo, hi - x)
                near, far = near + off * off, far + reach * reach
            bound = np.minimum(bound, _bounds(query, far, n[node], k, len(rows)))
            kept = near <= bound[query]
            query, node, near = query[kept], node[kept], near[kept]
            if len(query) * FANOUT > TASK_PAIRS and len(rows) > 1:
                todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
                break
        else:
            yield rows[query], node, near, bound[query]


def box_distance2(at: list[Column], low: Column, high: Column) -> tuple[Column, Column]:
    """Squared least and largest distance of a position from a box."""
    zero, near, far = F.lit(0.0), [], []
    for k, v in enumerate(at):
        off = F.greatest(low[k] - v, v - high[k], zero)
        reach = F.greatest(v - low[k], high[k] - v)
        near.append(off * off)
        far.append(reach * reach)
    total = lambda parts: functools.reduce(lambda a, b: a + b, parts)
    return total(near), total(far)


def _within_bound(pairs: DataFrame, k: int) -> DataFrame:
    """Of pairs (q_id, n, near, far) those that may hold one of a query's k nearest: no farther than where k are for certain."""
    if k == 1:
        bound = F.min("far").over(W.partitionBy("q_id"))
    else:
        so_far = F.sum("n").over(W.partitionBy("q_id").orderBy("far"))
        pairs = pairs.withColumn("__sum", so_far)
        bound = F.min(F.when(F.col("__sum") >= k, F.col("far"))).over(W.partitionBy("q_id"))
    return pairs.withColumn("__least", bound).filter(F.col("__least").isNull() | (F.col("near") <= F.col("__least"))).drop("__least", "__sum")


def nearest_boxes(queries: DataFrame, tree: BoxTree, k: int, low: list[str], high: list[str], axes=AXES, within: float | None = None) -> DataFrame:
    """Pairs of query (q_*) and item (p_*), with near, the squared distance of the item's box: all items that can be among a query's k nearest, and few others; with ``within`` none of a box farther off than that.

    Queries are (id, axes, any others), ids each once; those without a place have no
    rows (a filter would be pushed below whatever makes them, and be worked out for all
    of that). Each task
    goes down the upper part of the tree for its own queries; where that part ends
    above the items, the rest of the way goes by joins on nodes, without the nodes
    that are already too far.
    """
    spot = [F.col(f"q_{a}").cast("double") for a in axes]
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], *[F.col(a).cast("double").alias(f"__{a}") for a in axes])
    arrays, last = task_levels(tree)
    held = asked.sparkSession.sparkContext.broadcast(arrays)
    most = float("inf") if within is None else (within * (1 + 1e-9)) ** 2
    names, d = asked.columns[: -len(axes)], len(axes)

    def work(batches):
        for batch in batches:
            at = np.stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(d)], 1)
            rows = batch.select(names)
            for row, node, near, bound in descend(at, held.value, k, most):
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, pa.array(node), pa.array(near), pa.array(bound)], names=[*names, "node", "near", "__bound"])

    kinds = asked.select(*names).schema
    schema = kinds.add("node", "long").add("near", "double").add("__bound", "double")
    kept = asked.mapInArrow(work, schema)
    written = None
    for depth in range(last - 1, -1, -1):
        nodes = tree.levels[depth].withColumnRenamed("node", "__child")
        near, far = box_distance2(spot, F.col("low"), F.col("high"))
        open_ = kept.drop("near").hint("merge").join(nodes, F.col("node") == F.col("parent")).withColumns({"near": near, "far": far}).filter(F.col("near") <= F.col("__bound"))
        new = materialize(_within_bound(open_, k).select(*names, F.col("__child").alias("node"), "near", "__bound"), "open")
        release(written)
        written = kept = new
    items = tree.items.select(F.col("__node" if last >= 0 else "__pos").alias("node"), *[F.col(c).alias(f"p_{c}") for c in tree.items.columns if c not in ("__node", "__pos")])
    pairs = kept.hint("merge").join(items, "node")
    if last < 0:
        return pairs.drop("node", "__bound")
    near, far = box_distance2(spot, F.array(*[F.col(f"p_{c}").cast("double") for c in low]), F.array(*[F.col(f"p_{c}").cast("double") for c in high]))
    pairs = pairs.withColumns({"near": near, "far": far, "n": F.lit(1).cast("long")}).filter(F.col("near") <= F.col("__bound"))
    return _within_bound(pairs, k).drop("n", "far", "node", "__bound")


def nearest_points(queries: DataFrame, points: DataFrame, k: int, axes=AXES) -> DataFrame:
    """q_*, p_*, d2, rank: the k nearest of ``points`` (id, axes, any others) for each query, ties by id, however far off and however crowded.

    Of points at one place only the k least ids can be among the nearest; the rest is left out before the tree is built.
    """
    few = points.withColumn("__copy", F.row_number().over(W.partitionBy(*axes).orderBy("id"))).filter(F.col("__copy") <= k).drop("__copy")
    tree = box_tree(few, list(axes), list(axes))
    order = W.partitionBy("q_id").orderBy("d2", "p_id")
    if tree is None:
        raise ValueError("nearest: there are no points")
    pairs = nearest_boxes(queries, tree, k, list(axes), list(axes), axes)
    return pairs.withColumnRenamed("near", "d2").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def level_of(extent: Column, unit: float) -> Column:
    """The grid level whose cells are at least as wide as ``extent``: 0 for the unit, one more for twice that."""
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / unit)).cast("int")))


def by_levels(points: DataFrame, items: DataFrame, low: list[Column], high: list[Column], unit: float, axes=AXES, by: tuple[str, ...] = ()) -> DataFrame:
    """``points`` joined with all ``items`` whose box (low to high) their cell of the items' level touches; the boxes are still to be tested.

    An item stands in two cells along each axis at most, whatever its size; a point is
    looked up once on each level that there is (121 at most). With ``by`` only points
    and items that agree in these columns, of both, meet.
    """
    extent = functools.reduce(F.greatest, [h - a for a, h in zip(low, high, strict=True)])
    leveled = items.withColumn("__level", level_of(extent, unit))
    levels = [r[0] for r in leveled.select("__level").distinct().collect() if r[0] is not None]
    side = F.lit(float(unit)) * F.pow(F.lit(2.0), F.col("__level"))
    spread = leveled
    for k, (a, h) in enumerate(zip(low, high, strict=True)):
        first, last = F.floor(a / side), F.floor(h / side)
        spread = spread.withColumn(f"__c{k}", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))
    probes = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    for k, x in enumerate(axes):
        probes = probes.withColumn(f"__c{k}", F.floor(F.col(x) / side))
    cells = ["__level", *(f"__c{k}" for k in range(len(axes)))]
    # By shuffle: the size of items in all their cells is guessed far too low.
    return probes.hint("merge").join(spread, [*by, *cells]).drop(*cells)
