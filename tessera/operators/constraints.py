"""Linear multi-point constraints: substitution to a fixpoint, and generated terms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize, release


def equations(lines: DataFrame) -> DataFrame:
    """(mpc, terms: array of (dof, coef)) -> (mpc, pos from 1 on, dof, coef); the first term is the dependent one."""
    return lines.select("mpc", F.posexplode("terms").alias("p", "t")).select("mpc", (F.col("p") + 1).alias("pos"), "t.dof", "t.coef")


def explicit(terms: DataFrame) -> DataFrame:
    """(dep, dof, coef): each dependent dof as a sum over others, from equations that sum to 0."""
    head = terms.filter("pos = 1").select("mpc", F.col("dof").alias("dep"), F.col("coef").alias("c0"))
    return terms.filter("pos > 1").join(head, "mpc").groupBy("dep", "dof").agg(F.sum(-F.col("coef") / F.col("c0")).alias("coef"))


def cascade(rules: DataFrame, rounds: int = 50) -> DataFrame:
    """Substitute rules (dep, dof, coef) into each other until no right-hand dof is dependent.

    Each round squares the remaining chains: a rule is replaced by its terms' own
    rules, so that a chain of n takes log2(n) rounds. A circular set is an error.
    """
    now = materialize(rules, "rules")
    for _ in range(rounds):
        inner = now.select(F.col("dep").alias("dof"), F.col("dof").alias("__to"), F.col("coef").alias("__by"))
        if now.join(inner.select("dof").distinct(), "dof", "left_semi").isEmpty():
            return now
        joined = now.join(inner, "dof", "left")
        new = joined.groupBy("dep", F.coalesce("__to", "dof").alias("dof")).agg(F.sum(F.col("coef") * F.coalesce("__by", F.lit(1.0))).alias("coef"))
        new = materialize(new, "rules")
        release(now)
        now = new
    raise ValueError("cascade: circular constraints")


def both_fixed_and_dependent(rules: DataFrame, fixed: DataFrame) -> DataFrame:
    """Dependent dofs that also have a prescribed value; any row is an input error."""
    return rules.select("dep").distinct().join(fixed.select(F.col("dof").alias("dep")), "dep", "left_semi")


def rigid_body(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """Linearised rigid links: (node, x, y, z, body) and (body, rx, ry, rz) -> (body, node, dof, terms over the body's six).

    u = u_ref + w x (p - p_ref); terms 1 to 3 are translations, 4 to 6 rotations.
    """
    d = nodes.join(reference, "body").select("body", "node", (F.col("x") - F.col("rx")).alias("dx"), (F.col("y") - F.col("ry")).alias("dy"), (F.col("z") - F.col("rz")).alias("dz"))
    row = lambda dof, parts: F.struct(F.lit(dof).alias("dof"), F.array(*[F.struct(F.lit(t).alias("term"), c.cast("double").alias("coef")) for t, c in parts]).alias("terms"))
    one = F.lit(1.0)
    rows = F.array(row(1, [(1, one), (5, F.col("dz")), (6, -F.col("dy"))]), row(2, [(2, one), (4, -F.col("dz")), (6, F.col("dx"))]), row(3, [(3, one), (4, F.col("dy")), (5, -F.col("dx"))]))
    return d.select("body", "node", F.explode(rows).alias("r")).select("body", "node", "r.dof", F.explode("r.terms").alias("t")).select("body", "node", "dof", "t.term", "t.coef")


def mean_constraint(members: DataFrame) -> DataFrame:
    """Distributing coupling: (group, node, weight) -> (group, node, coef), weights scaled to sum 1."""
    total = members.groupBy("group").agg(F.sum("weight").alias("total"))
    return members.join(total, "group").select("group", "node", (F.col("weight") / F.col("total")).alias("coef"))


def _terms(rows: DataFrame, kept: list[str], terms: list) -> DataFrame:
    """One row per term; terms: (node, dof, coef) columns, or arrays of them."""
    each = F.array(*[F.struct(F.col(node).alias("node"), F.lit(dof).alias("dof") if isinstance(dof, int) else dof.alias("dof"), coef.cast("double").alias("coef")) for node, dof, coef in terms])
    return rows.select(*kept, F.posexplode(each).alias("p", "t")).select(*kept, (F.col("p") + 1).alias("pos"), "t.node", "t.dof", "t.coef")


def straight_links(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes (group, node, x, y, z) that stay on the line through two others (group, a, ax, ay, az, b, bx, by, bz) -> (group, node_id, eq, pos, node, dof, coef).

    eq is the direction of each of a node's two equations, the longest of the line's
    being left out (the first of equal ones); coefficients are the slopes of
    (p_j - a_j)(b_m - a_m) - (p_m - a_m)(b_j - a_j) by the displacements.
    """
    rows = nodes.join(ends, "group").withColumnRenamed("node", "node_id")
    length = [F.abs(F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"]
    longest = F.when((length[0] >= length[1]) & (length[0] >= length[2]), 1).when(length[1] >= length[2], 2).otherwise(3)
    rows = rows.withColumn("__m", longest).withColumn("eq", F.explode(F.array(*[F.lit(j) for j in (1, 2, 3)]))).filter("eq <> __m").withColumn("node", F.col("node_id"))
    pick = lambda stem, at: F.element_at(F.array(*[F.col(f"{stem}{c}") for c in "xyz"]), at)
    j, m = F.col("eq"), F.col("__m")
    p, a, b = ((lambda at, s=s: pick(s, at)) for s in ("", "a", "b"))
    terms = [("node", j, b(m) - a(m)), ("node", m, a(j) - b(j)), ("a", j, p(m) - b(m)), ("a", m, b(j) - p(j)), ("b", j, a(m) - p(m)), ("b", m, p(j) - a(j))]
    return _terms(rows, ["group", "node_id", "eq"], terms)


def _cross(u: list, v: list) -> list:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def plane_links(nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """Nodes (group, node, x, y, z) that stay in the plane of three others (group, a, ax.., b, bx.., c, cx..) -> (group, node_id, pos, node, dof, coef).

    Coefficients are the slopes of (p - c) . ((a - c) x (b - c)) by the displacements;
    the first dof is the one in which the plane's normal is largest.
    """
    rows = nodes.join(corners, "group").withColumnRenamed("node", "node_id").withColumn("node", F.col("node_id"))
    sub = lambda s, t: [F.col(f"{s}{k}") - F.col(f"{t}{k}") for k in "xyz"]
    pc, ac, bc = sub("", "c"), sub("a", "c"), sub("b", "c")
    by_p, by_a, by_b = _cross(ac, bc), _cross(bc, pc), _cross(pc, ac)
    by_c = [-(x + y + z) for x, y, z in zip(by_p, by_a, by_b, strict=True)]
    size = [F.abs(k) for k in by_p]
    first = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 1).when(size[1] >= size[2], 2).otherwise(3)
    rows = rows.withColumn("__j", first)
    order = [(F.col("__j") + k - 1) % 3 + 1 for k in range(3)]
    pick = lambda v, at: F.element_at(F.array(*v), at)
    return _terms(rows, ["group", "node_id"], [(node, d, pick(v, d)) for node, v in (("node", by_p), ("a", by_a), ("b", by_b), ("c", by_c)) for d in order])


def distance_links(pairs: DataFrame) -> DataFrame:
    """Pairs (pair, a, ax, ay, az, b, bx, by, bz, distance) kept no farther apart than distance -> (pair, residual, linked, pos, node, dof, coef).

    residual is |a - b|^2 - distance^2; a pair is linked where it is not below 0.
    """
    d = [F.col(f"a{k}") - F.col(f"b{k}") for k in "xyz"]
    residual = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - F.col("distance") * F.col("distance")
    rows = pairs.withColumn("linked", residual >= 0).withColumn("residual", F.when(residual < 0, 0.0).otherwise(residual))
    return _terms(rows, ["pair", "residual", "linked"], [*(("a", k + 1, d[k] * 2) for k in range(3)), *(("b", k + 1, d[k] * -2) for k in range(3))])


def beam_links(pairs: DataFrame) -> DataFrame:
    """Links that keep their length (pair, a, ax, ay, az, b, bx, by, bz, and where they are displaced ux_a.., ux_b..) -> (pair, residual, pos, node, dof, coef).

    Linear around the present places: coef are the slopes of the squared distance by the
    displacements of both ends, residual how much the squared length differs from that at
    first, to be made up by the next step. The first dof is the one along which the link
    is longest at first (the first of equal ones), the others follow in turn.
    """
    have = set(pairs.columns)
    moved = lambda side, c: F.col(f"{side}{c}") + (F.coalesce(f"u{c}_{side}", F.lit(0.0)) if f"u{c}_{side}" in have else F.lit(0.0))
    first = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    now = [moved("a", c) - moved("b", c) for c in "xyz"]
    square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    size = [F.abs(v) for v in first]
    longest = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 1).when(size[1] >= size[2], 2).otherwise(3)
    rows = pairs.withColumn("residual", square(now) - square(first)).withColumn("__m", longest)
    dof = lambda k: (F.col("__m") - 1 + k) % 3 + 1
    pick = lambda k: F.element_at(F.array(*now), dof(k))
    return _terms(rows, ["pair", "residual"], [*(("a", dof(k), pick(k) * 2) for k in range(3)), *(("b", dof(k), pick(k) * -2) for k in range(3))])


def mean_rotation(nodes: DataFrame, axes: DataFrame) -> DataFrame:
    """Coefficients (group, node, dof, coef) of the mean rotation of a cloud of nodes (group, node, x, y, z) about an axis (group, ax, ay, az) through its centre.

    The sum of coef times displacement, over the number of nodes, is the mean angle by
    which the nodes turn, to the first order. Nodes on the axis have no part in it.
    """
    centre = nodes.groupBy("group").agg(*[F.avg(k).alias(f"__c{k}") for k in "xyz"], F.count("*").alias("__n"), *[F.var_pop(k).alias(f"__v{k}") for k in "xyz"])
    size = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    unit = axes.select("group", *[(F.col(f"a{k}") / F.when(size > 1e-10, size).otherwise(F.raise_error(F.lit("mean_rotation: an axis has no length")).cast("double"))).alias(f"__a{k}") for k in "xyz"])
    rows = nodes.join(centre, "group").join(unit, "group")
    a, d = [F.col(f"__a{k}") for k in "xyz"], [F.col(k) - F.col(f"__c{k}") for k in "xyz"]
    along = sum((x * y for x, y in zip(a[1:], d[1:], strict=True)), a[0] * d[0])
    p = [x - along * y for x, y in zip(d, a, strict=True)]
    r2 = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    spread = F.col("__vx") + F.col("__vy") + F.col("__vz")
    own = [F.when(r2 <= spread * 1e-10, 0.0).otherwise(c / r2) for c in _cross(a, p)]
    held = rows.select("group", "node", "__n", *[c.alias(f"__w{k}") for k, c in enumerate(own)])
    total = held.groupBy("group").agg(*[F.sum(f"__w{k}").alias(f"__t{k}") for k in range(3)])
    out = held.join(total, "group")
    each = F.array(*[F.struct(F.lit(k + 1).alias("dof"), (F.col(f"__w{k}") - F.col(f"__t{k}") / F.col("__n")).alias("coef")) for k in range(3)])
    return out.select("group", "node", F.explode(each).alias("x")).select("group", "node", "x.dof", "x.coef")


def distributing_coupling(nodes: DataFrame) -> DataFrame:
    """Coefficients (group, node, term, dof, coef) by which a cloud of weighted nodes (group, node, x, y, z, weight) moves its reference point at the weighted centre.

    Terms 1 to 3 are the mean displacements, 4 to 6 the mean rotations, from the
    moments of the displacements over the cloud's inertia. Clouds on a line have none.
    """
    w = F.col("weight")
    centre = nodes.groupBy("group").agg(F.sum("weight").alias("__w"), *[(F.sum(w * F.col(k)) / F.sum("weight")).alias(f"__c{k}") for k in "xyz"])
    rows = nodes.join(centre, "group").select("group", "node", "weight", "__w", *[(F.col(k) - F.col(f"__c{k}")).alias(f"__d{k}") for k in "xyz"])
    dx, dy, dz = (F.col(f"__d{k}") for k in "xyz")
    second = {"xx": dy * dy + dz * dz, "yy": dx * dx + dz * dz, "zz": dx * dx + dy * dy, "xy": -dx * dy, "xz": -dx * dz, "yz": -dy * dz}
    inertia = rows.groupBy("group").agg(*[F.sum(w * c).alias(f"__i{k}") for k, c in second.items()])
    i = {k: F.col(f"__i{k}") for k in second}
    m = [[i["xx"], i["xy"], i["xz"]], [i["xy"], i["yy"], i["yz"]], [i["xz"], i["yz"], i["zz"]]]
    minor = lambda r, c: _cross(m[(r + 1) % 3], m[(r + 2) % 3])[c]
    det = sum((m[0][c] * minor(0, c) for c in (1, 2)), m[0][0] * minor(0, 0))
    # Displacement along dof k has the moment r x e_k.
    zero = F.lit(0.0)
    moments = [[zero, dz, -dy], [-dz, zero, dx], [dy, -dx, zero]]
    size = (i["xx"] + i["yy"] + i["zz"]) / 3
    turned = [[F.when(F.abs(det) > 1e-12 * size * size * size, w * sum((minor(r, c) * moments[k][c] for c in (1, 2)), minor(r, 0) * moments[k][0]) / det).otherwise(0.0) for k in range(3)] for r in range(3)]
    each = F.array(*[F.struct(F.lit(k + 1).alias("term"), F.lit(k + 1).alias("dof"), (w / F.col("__w")).alias("coef")) for k in range(3)], *[F.struct(F.lit(r + 4).alias("term"), F.lit(k + 1).alias("dof"), turned[r][k].alias("coef")) for r in range(3) for k in range(3)])
    return rows.join(inertia, "group").select("group", "node", F.explode(each).alias("x")).select("group", "node", "x.term", "x.dof", "x.coef")


def tied(slaves: DataFrame, faces: DataFrame, tolerance: float) -> DataFrame:
    """Slave nodes (id, x, y, z) on master triangles (face, corners: three (node, x, y, z)) -> (id, face, gap, node, coef).

    A slave within the tolerance of its nearest triangle follows its corners with the
    barycentric weights of the closest point; others have no rows.
    """
    from tessera.operators.locate import attach

    # Dealt by id, so that few large files of slaves are many tasks' work.
    near = attach(slaves.repartition("id"), faces, tolerance).filter(F.col("distance") <= tolerance)
    each = F.arrays_zip(F.transform("corners", lambda c: c["node"]).alias("node"), F.col("weights").alias("coef"))
    return near.select("id", "face", F.col("distance").alias("gap"), F.explode(each).alias("x")).select("id", "face", "gap", "x.node", "x.coef")


def cyclic(slaves: DataFrame, faces: DataFrame, sectors: int, tolerance: float) -> DataFrame:
    """As ``tied``, of the nodes of one sector face turned about z by one of ``sectors`` equal angles onto the other face's triangles."""
    from tessera.operators.spatial import rotate

    x, y = rotate(F.col("x"), F.col("y"), 2 * math.pi / sectors)
    return tied(slaves.select("id", x.alias("x"), y.alias("y"), "z"), faces, tolerance)
