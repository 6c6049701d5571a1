"""Aggregation of results: averages, totals, resultants, invariants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nodal_average(contributions: DataFrame, values: list[str]) -> DataFrame:
    """Unweighted mean over element contributions (node, values)."""
    return contributions.groupBy("node").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_contributions"))


#: Along each axis the weights with which the two integration points of a brick reach its two corners: linear, through the points at 1/sqrt(3).
NEAR, FAR = (1 + math.sqrt(3)) / 2, (1 - math.sqrt(3)) / 2
# Signs of the eight corners (and, in another order, integration points) of a brick, and the corners on both sides of its twelve midside nodes.
CORNER_SIGNS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
POINT_SIGNS = [(i, j, k) for k in (-1, 1) for j in (-1, 1) for i in (-1, 1)]
MIDSIDES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]


def brick_matrix() -> list[list[float]]:
    """Corner values of a brick from those at its eight integration points."""
    return [[math.prod(NEAR if c == p else FAR for c, p in zip(corner, point, strict=True)) for point in POINT_SIGNS] for corner in CORNER_SIGNS]


def tet_matrix() -> list[list[float]]:
    """Corner values of a tetrahedron from those at its four integration points, which lie at (5 + 3 sqrt 5) / 20 of a corner and (5 - sqrt 5) / 20 of the others."""
    a, b = (5 + 3 * math.sqrt(5)) / 20, (5 - math.sqrt(5)) / 20
    total = (a - b) * (a + 3 * b)
    return [[((a + 2 * b) if i == j else -b) / total for j in range(4)] for i in range(4)]


def extrapolate(elements: DataFrame, points: DataFrame, matrix: list[list[float]], midsides: list[tuple[int, int]] = ()) -> DataFrame:
    """node, value, n_contributions: values (elem, ip from 1 on, value) taken to the corners of elements (elem, nodes), midside nodes as the mean of their two corners, then the plain mean over elements.

    Nodes beyond the corners are midsides in the order of ``midsides``.
    """
    # One row per element with a sum for each corner; the nodes meet these rows, not one for each corner and point.
    sums = points.groupBy("elem").agg(*[F.sum(F.col("value") * F.element_at(F.array(*[F.lit(float(w)) for w in row]), F.col("ip"))).alias(f"__v{c}") for c, row in enumerate(matrix)])
    whole = sums.hint("merge").join(elements.select("elem", "nodes"), "elem")
    corner = whole.select("nodes", F.posexplode(F.array(*[F.col(f"__v{c}") for c in range(len(matrix))])).alias("c", "v"))
    spots = F.array(F.struct(F.element_at("nodes", F.col("c") + 1).alias("node"), F.col("v").alias("v"), F.lit(1.0).alias("share"), F.lit(-1).alias("m")))
    sides = [F.when((F.col("c") == a) | (F.col("c") == b), F.struct(F.get("nodes", F.lit(len(matrix) + m)).alias("node"), (F.col("v") / 2).alias("v"), F.lit(0.5).alias("share"), F.lit(m).alias("m"))) for m, (a, b) in enumerate(midsides)]
    if sides:
        spots = F.concat(spots, F.filter(F.array(*sides), lambda x: x.isNotNull()))
    each = corner.select(F.explode(spots).alias("x")).filter("x.node is not null")
    return each.groupBy("x.node").agg((F.sum("x.v") / F.sum("x.share")).alias("value"), F.sum("x.share").cast("long").alias("n_contributions"))


def error_estimate(points: DataFrame, node_elements: DataFrame) -> DataFrame:
    """Per node the largest spread, absolute and against the largest size, of its elements; points: (elem, value)."""
    spread = points.groupBy("elem").agg((F.max("value") - F.min("value")).alias("spread"), F.max(F.abs("value")).alias("size"))
    spread = spread.select("elem", "spread", F.when(F.col("size") > 0, F.col("spread") / F.col("size")).otherwise(0.0).alias("relative"))
    return node_elements.join(spread, "elem").groupBy("node").agg(F.max("spread").alias("spread"), F.max("relative").alias("relative"))


def principal_error(points: DataFrame, node_elements: DataFrame) -> DataFrame:
    """As error_estimate, of the principal stress that is larger in size, from tensors (elem, xx, yy, zz, xy, xz, yz).

    The first or the third counts, whichever reaches farther from 0 in the element.
    """
    low, _, high = principal_values({k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")})
    ends = points.select("elem", low.alias("lo"), high.alias("hi")).groupBy("elem").agg(*[f(c).alias(f"{n}_{c}") for c in ("lo", "hi") for n, f in (("min", F.min), ("max", F.max))])
    third = F.col("max_hi") >= -F.col("min_lo")
    least, most = F.when(third, F.col("min_hi")).otherwise(F.col("min_lo")), F.when(third, F.col("max_hi")).otherwise(F.col("max_lo"))
    size = F.greatest(F.abs(least), F.abs(most))
    spread = ends.select("elem", (most - least).alias("spread"), F.when(size < 1e-30, 0.0).otherwise((most - least) / size).alias("relative"))
    return node_elements.join(spread, "elem").groupBy("node").agg(F.max("spread").alias("spread"), F.max("relative").alias("relative"))


# Per kind of result and of element the line, or two lines and where the second begins, from the relative spread at a node to its error in per cent.
ERROR_LINES = {
    "stress": {
        "tet10": ((30.0, 0.0),),
        "brick20": ((5.115, 0.0), (27.792, -5.895), 0.26),
        "plane20": ((9.538, 0.0), (53.695, -14.351), 0.325),
        "brick20r": ((20.278, 0.0), (74.318, -9.727), 0.18),
        "plane20r": ((54.054, 0.0),),
        "brick8i": ((30.303, 0.0), (139.535, -18.023), 0.165),
        "brick8": ((31.847, 0.0), (85.324, -8.396), 0.157),
        "plane8": ((74.074, 0.0),),
        "wedge15": ((46.189, 0.0),),
    },
    "heat": {
        "tet4": ((12.5064, 0.62694),),
        "tet10": ((6.6739, 0.0668),),
        "brick20": ((3.0980, 0.0744),),
        "plane20": ((2.791, 0.146),),
        "brick20r": ((2.6085, 0.03934),),
        "shell20r": ((2.566, 0.0485),),
        "plane20r": ((2.337, 0.0985),),
        "brick8": ((8.069, 0.351), (3.858, 0.525), 0.0412),
        "wedge6": ((13.3096, 0.179),),
        "wedge15": ((3.5303, 0.15927),),
    },
}


def error_per_cent(spread: DataFrame, node_types: DataFrame, kind: str = "stress") -> DataFrame:
    """node, relative, error: the estimated error in per cent from the relative spread at nodes (node, relative), by the line of each type of element that a node has (node, type); the largest counts.

    Types without a line give none; a node of such alone has a null error.
    """
    line = None
    for name, (first, *more) in sorted(ERROR_LINES[kind].items()):
        value = F.col("relative") * first[0] + first[1]
        if more:
            value = F.when(F.col("relative") <= more[1], value).otherwise(F.col("relative") * more[0][0] + more[0][1])
        line = F.when(F.col("type") == name, value) if line is None else line.when(F.col("type") == name, value)
    return spread.join(node_types.select("node", "type").distinct(), "node").withColumn("e", line).groupBy("node", "relative").agg(F.max("e").alias("error"))


def contact_print(contacts: DataFrame, by: list[str], part: str = "all") -> DataFrame:
    """All that is printed of contacts that are closed, per group: the section statistics of their tractions, and n_contacts, n_closed, pressure and clearance ends and the elastic energy.

    Contacts are (a, x, y, z, nx, ny, nz: the slave's outward normal, pressure, tx, ty,
    tz: shear, clearance, energy per area); ``part`` "normal" or "shear" leaves the other
    force out. A group without a closed contact has the counts alone.
    """
    closed = F.col("pressure") > 0
    normal = F.lit(0.0 if part == "shear" else 1.0)
    shear = F.lit(0.0 if part == "normal" else 1.0)
    tractions = contacts.filter(closed).withColumns({f"t{c}": F.col(f"t{c}") * shear - F.col("pressure") * F.col(f"n{c}") * normal for c in "xyz"})
    counts = contacts.groupBy(*by).agg(
        F.count("*").alias("n_contacts"),
        F.count_if(closed).alias("n_closed"),
        F.max(F.when(closed, F.col("pressure"))).alias("most_pressure"),
        F.min("clearance").alias("least_clearance"),
        F.max("clearance").alias("most_clearance"),
        F.sum(F.when(closed, F.col("energy") * F.col("a"))).alias("energy"),
    )
    return counts.join(section_statistics(tractions, by), by, "left")


def element_totals(points: DataFrame, by: list[str]) -> DataFrame:
    """Volume, mass, internal and kinetic energy and body heating, per group and over all, from integration points (v, density, energy, speed2, heat; energies and heat per volume)."""
    sums = {"volume": F.col("v"), "mass": F.col("v") * F.col("density"), "internal": F.col("v") * F.col("energy"), "kinetic": F.col("v") * F.col("density") * F.col("speed2") * 0.5, "heating": F.col("v") * F.col("heat")}
    return points.rollup(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def contact_totals(contacts: DataFrame, by: list[str], closed: Column, force: str) -> DataFrame:
    """Contacts, those that are closed, and the force of these, per group."""
    return contacts.groupBy(*by).agg(F.count("*").alias("n_contacts"), F.sum(F.when(closed, F.col(force)).otherwise(0)).alias("f_normal"), F.count_if(closed).alias("n_closed"))


def squared_displacements(rows: DataFrame, by: list[str], components: list[str]) -> DataFrame:
    """Sum of the squares of the components named (one axis or all), per group."""
    return rows.groupBy(*by).agg(sum((F.sum(F.col(c) * F.col(c)) for c in components[1:]), F.sum(F.col(components[0]) * F.col(components[0]))).alias("objective"))


def mass_properties(parts: DataFrame, by: list[str]) -> DataFrame:
    """Mass, centre of gravity and inertia about it (parallel axis) from (m, x, y, z) per group."""
    sums = {f"s{a}": F.sum(F.col("m") * F.col(a)) for a in "xyz"} | {f"s{a}{b}": F.sum(F.col("m") * F.col(a) * F.col(b)) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    s = parts.groupBy(*by).agg(F.sum("m").alias("mass"), *[e.alias(n) for n, e in sums.items()])
    cg = {a: F.col(f"s{a}") / F.col("mass") for a in "xyz"}
    second = lambda a, b: F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("mass")
    return s.select(*by, "mass", *[c.alias(f"cg_{a}") for a, c in cg.items()], (second("y", "y") + second("z", "z")).alias("ixx"), (second("x", "x") + second("z", "z")).alias("iyy"), (second("x", "x") + second("y", "y")).alias("izz"), (-second("x", "y")).alias("ixy"))


def section_resultants(patches: DataFrame, by: list[str]) -> DataFrame:
    """Force, moment about the origin, area and mean normal force from patches (a, x, y, z, tx, ty, tz, nx, ny, nz)."""
    f = {a: F.sum(F.col("a") * F.col(f"t{a}")) for a in "xyz"}
    cross = [("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")]
    m = {a: F.sum(F.col("a") * (F.col(b) * F.col(f"t{c}") - F.col(c) * F.col(f"t{b}"))) for a, b, c in cross}
    normal = F.sum(F.col("a") * (F.col("tx") * F.col("nx") + F.col("ty") * F.col("ny") + F.col("tz") * F.col("nz")))
    return patches.groupBy(*by).agg(F.sum("a").alias("area"), *[v.alias(f"f{a}") for a, v in f.items()], *[v.alias(f"m{a}") for a, v in m.items()], normal.alias("f_normal"))


def section_statistics(patches: DataFrame, by: list[str]) -> DataFrame:
    """All that is printed of a section, from patches as in ``section_resultants``.

    Force and moment about the origin (f, m), area, centre of gravity (cg), mean normal
    (n), moment about the centre (mcg), and along the mean normal and across it: normal
    and shear force, torque and bending moment.
    """
    sums = {f"s{a}": F.sum(F.col("a") * F.col(a)) for a in "xyz"} | {f"sn{a}": F.sum(F.col("a") * F.col(f"n{a}")) for a in "xyz"}
    base = section_resultants(patches, by).drop("f_normal")
    more = patches.groupBy(*by).agg(F.sum("a").alias("__a"), *[c.alias(n) for n, c in sums.items()])
    out = base.join(more, by).select(*base.columns, *[(F.col(f"s{a}") / F.col("__a")).alias(f"cg_{a}") for a in "xyz"], *[(F.col(f"sn{a}") / F.col("__a")).alias(f"n_{a}") for a in "xyz"])
    for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")):
        out = out.withColumn(f"mcg_{a}", F.col(f"m{a}") - F.col(f"cg_{b}") * F.col(f"f{c}") + F.col(f"cg_{c}") * F.col(f"f{b}"))

    def split(names):
        along = sum((F.col(names[a]) * F.col(f"n_{a}") for a in "yz"), F.col(names["x"]) * F.col("n_x"))
        rest = [F.col(names[a]) - along * F.col(f"n_{a}") for a in "xyz"]
        return along, F.sqrt(rest[0] * rest[0] + rest[1] * rest[1] + rest[2] * rest[2])

    (normal, shear), (torque, bending) = split({a: f"f{a}" for a in "xyz"}), split({a: f"mcg_{a}" for a in "xyz"})
    return out.withColumns({"normal_force": normal, "shear_force": shear, "torque": torque, "bending": bending})


def principal_values(s: dict[str, Column]) -> list[Column]:
    """Eigenvalues of a symmetric tensor (xx, yy, zz, xy, xz, yz), ascending, by the trigonometric form of the cubic."""
    mean = (s["xx"] + s["yy"] + s["zz"]) / 3
    a, b, c = s["xx"] - mean, s["yy"] - mean, s["zz"] - mean
    j2 = (a * a + b * b + c * c) / 2 + s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]
    j3 = a * b * c + 2 * s["xy"] * s["xz"] * s["yz"] - a * s["yz"] * s["yz"] - b * s["xz"] * s["xz"] - c * s["xy"] * s["xy"]
    r = F.sqrt(j2 / 3)
    cosine = F.when(r > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), j3 / (2 * r * r * r)))).otherwise(0.0)
    theta = F.acos(cosine) / 3
    return [mean + 2 * r * F.cos(theta + t) for t in (2 * math.pi / 3, -2 * math.pi / 3, 0.0)]


def mises(s: dict[str, Column]) -> Column:
    a, b, c = s["xx"] - s["yy"], s["yy"] - s["zz"], s["zz"] - s["xx"]
    return F.sqrt((a * a + b * b + c * c) / 2 + 3 * (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]))


def ks_aggregate(rows: DataFrame, by: list[str], value: str, reference: float, rho: float) -> DataFrame:
    """ln(sum exp(rho v / reference)) / rho; an exponent above 600 is an error."""
    power = rho * F.col(value) / reference
    safe = F.when(power > 600, F.raise_error(F.lit("ks_aggregate: exponent above 600")).cast("double")).otherwise(F.exp(power))
    return rows.groupBy(*by).agg((F.log(F.sum(safe)) / rho).alias("ks"))


#: Bytes of stated vectors that go to the tasks; of more, blocks of BLOCK_ROWS meet the others in a shuffle.
SMALL_BYTES, BLOCK_ROWS = 16 << 20, 256


def mac(vectors: DataFrame, others: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """|<a, b>| / (|a| |b|), not squared, of each stated vector (id, v) against all others: all pairs of the two, which is what it is for; ``closest`` keeps a few.

    Stated vectors that are small together go to all tasks, others in blocks that meet
    every block of the rest. Complex vectors, in rows per entry: see functions.complexes.
    """
    unit = lambda d, side: d.select(F.col("id").alias(f"id_{side}"), F.col("v").alias(f"v_{side}"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)).alias(f"n_{side}"))
    a, b = unit(vectors, "a"), unit(others, "b")
    count, size = vectors.agg(F.count("*"), F.sum(F.size("v") * 8 + 32)).first()
    if (size or 0) <= small:
        pairs = F.broadcast(a.withColumn("__block", F.lit(0))).join(b.withColumn("__block", F.lit(0)), "__block")
    else:
        n = -(-count // BLOCK_ROWS)
        pairs = a.withColumn("__block", F.pmod(F.xxhash64("id_a"), F.lit(n))).join(b.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1)))), "__block")
    inner = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("id_a", "id_b", (F.abs(inner) / (F.col("n_a") * F.col("n_b"))).alias("mac"))


def closest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best matches of each stated vector among ``mac``'s pairs, with their rank; ties by id_b."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("id_a").orderBy(F.desc("mac"), "id_b"))).filter(F.col("rank") <= k)


def modal_mass(phi: DataFrame, mass: DataFrame) -> DataFrame:
    """Participation and effective mass of each mode (mode, i, x, axis) for a lumped mass (i, m), per axis."""
    s = phi.join(mass, "i").groupBy("mode", "axis").agg(F.sum(F.col("x") * F.col("m")).alias("l"), F.sum(F.col("x") * F.col("x") * F.col("m")).alias("g"))
    g = F.sum("g").over(W.partitionBy("mode"))  # a mode has three axes
    return s.withColumn("g", g).select("mode", "axis", (F.col("l") / F.col("g")).alias("participation"), (F.col("l") * F.col("l") / F.col("g")).alias("effective_mass"))


def modal_mass_full(phi: DataFrame, mass: DataFrame) -> DataFrame:
    """As modal_mass, for a consistent mass matrix: modes (mode, i, x, axis) and entries (i, j, m) between degrees of freedom of one axis, both of i, j and j, i.

    A mode's degrees of freedom i are those of its axis, each with one axis.
    """
    moved = mass.join(phi.select(F.col("i").alias("j"), "mode", F.col("x").alias("xj"), "axis"), "j")
    image = moved.groupBy("mode", "i").agg(F.sum(F.col("m") * F.col("xj")).alias("y"))
    axes = phi.select("i", "axis").distinct()
    all_rows = image.join(axes, "i").join(phi.select("mode", "i", "x"), ["mode", "i"], "left")
    s = all_rows.groupBy("mode", "axis").agg(F.sum("y").alias("l"), F.sum(F.coalesce("x", F.lit(0.0)) * F.col("y")).alias("g"))
    g = F.sum("g").over(W.partitionBy("mode"))  # a mode has three axes
    return s.withColumn("g", g).select("mode", "axis", (F.col("l") / F.col("g")).alias("participation"), (F.col("l") * F.col("l") / F.col("g")).alias("effective_mass"))
