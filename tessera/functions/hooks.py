"""Python hooks for loads, initial state and material laws: vectorised functions by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeResult

#: Rows that a table function hands to its hook at once.
UDTF_ROWS = 10_000
_HOOKS: dict[str, Callable] = {}


def register(name: str, hook: Callable[..., np.ndarray]) -> None:
    """A hook takes one array per argument and returns an array of values."""
    _HOOKS[name] = hook


def load(spec: str) -> str:
    """Register a function of an installed module, given as module:function, under @function; gives that name."""
    module, _, function = spec.partition(":")
    name = f"@{function}"
    register(name, getattr(importlib.import_module(module), function))
    return name


def scalar(name: str, *args: Column) -> Column:
    """The hook's value for each row, as an Arrow-batched function (amplitudes, boundary values, loads, film coefficients)."""
    hook = _HOOKS[name]

    @F.pandas_udf("double")
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(np.asarray(hook(*[c.to_numpy() for c in columns]), float))

    return call(*args)


def material(name: str, points: DataFrame, schema: str) -> DataFrame:
    """The law over batches of integration points: it takes and gives a pandas frame."""
    law = _HOOKS[name]

    def work(batches):
        for pdf in batches:
            yield law(pdf)

    return points.mapInPandas(work, schema)


def elastic(pdf: pd.DataFrame) -> pd.DataFrame:
    """Isotropic linear elasticity: (id, young, poisson, e: six strains, shear as tensor components) -> s."""
    e = np.stack(pdf["e"].to_numpy()).reshape(-1, 6)
    young, nu = pdf["young"].to_numpy()[:, None], pdf["poisson"].to_numpy()[:, None]
    mu, lam = young / (2 * (1 + nu)), young * nu / ((1 + nu) * (1 - 2 * nu))
    s = 2 * mu * e
    s[:, :3] += lam * e[:, :3].sum(axis=1, keepdims=True)
    return pd.DataFrame({"id": pdf["id"], "s": list(s)})


register("elastic", elastic)
register("ramp", lambda t, end: np.clip(t / np.where(end == 0, 1, end), 0, 1))


def elements(name: str, rows: DataFrame) -> DataFrame:
    """A user element: from batches of elements to rows (i, j, v) of the matrix, which ``sparse.assemble`` sums."""
    return material(name, rows, "i long, j long, v double")


def spring(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two dofs (a, b) and a stiffness k."""
    a, b, k = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["k"].to_numpy()
    return pd.DataFrame({"i": np.concatenate([a, a, b, b]), "j": np.concatenate([a, b, a, b]), "v": np.concatenate([k, -k, -k, k])})


register("spring", spring)


class UserElements:
    """The table function behind ``register_elements``: rows in, rows (i, j, v) of a matrix out, by the hook over batches."""

    columns: tuple[str, ...] = ()

    def __init__(self):
        self._rows = []

    def eval(self, row):
        self._rows.append(tuple(row[c] for c in self.columns))
        if len(self._rows) >= UDTF_ROWS:
            yield from self._flush()

    def terminate(self):
        yield from self._flush()

    def _flush(self):
        if self._rows:
            found = self.law(pd.DataFrame(self._rows, columns=list(self.columns)))
            self._rows = []
            yield from zip(found["i"].tolist(), found["j"].tolist(), found["v"].tolist(), strict=True)


def register_elements(spark, name: str, columns: list[str]) -> None:
    """The user element ``name`` as a table function for SQL: SELECT * FROM name(TABLE(..)), with PARTITION BY where its rows belong together.

    Its plan is checked against the columns that the element needs before anything runs.
    """

    def analyze(rows) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError(f"{name}: its argument is a table")
        there = {f.name.lower() for f in rows.dataType.fields}
        missing = [c for c in columns if c.lower() not in there]
        if missing:
            raise ValueError(f"{name}: the table has no column {', '.join(missing)}")
        return AnalyzeResult(StructType().add("i", LongType()).add("j", LongType()).add("v", DoubleType()))

    made = type(f"Elements_{name}", (UserElements,), {"columns": tuple(columns), "law": staticmethod(_HOOKS[name]), "analyze": staticmethod(analyze)})
    spark.udtf.register(name, F.udtf(made))


def initial_state(name: str, points: DataFrame, parts: list[str], *args: Column) -> DataFrame:
    """``points`` plus the hook's parts of an initial state (stresses, state variables), one column each; the hook gives a matrix of a column per part."""
    hook = _HOOKS[name]

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(list(np.asarray(hook(*[c.to_numpy() for c in columns]), float).reshape(-1, len(parts))))

    held = points.withColumn("__state", call(*args))
    return held.select(*points.columns, *[F.col("__state")[i].alias(p) for i, p in enumerate(parts)])


def constraint(name: str, terms: DataFrame, schema: str) -> DataFrame:
    """A user constraint: the hook takes one constraint's terms (mpc, ...) as a pandas frame and gives its coefficients; each has a few terms, and many share a task."""
    law = _HOOKS[name]
    return terms.groupBy("mpc").applyInPandas(lambda pdf: law(pdf), schema)


def dashpot_link(pdf: pd.DataFrame) -> pd.DataFrame:
    """A link along the line between its first two terms' places: (mpc, pos, dof, x) -> coef, the first 1, the others shares by distance that sum to -1."""
    pdf = pdf.sort_values("pos")
    far = np.abs(pdf["x"].to_numpy() - pdf["x"].iloc[0])[1:] + 1.0
    share = (1 / far) / (1 / far).sum() if len(far) else far
    return pd.DataFrame({"mpc": pdf["mpc"], "pos": pdf["pos"], "dof": pdf["dof"], "coef": np.concatenate([[1.0], -share])})


register("nearest_shares", dashpot_link)
#: Stresses at rest below a level: vertical from the weight above, sideways a share of it.
register("geostatic", lambda z, level, weight, share: np.stack([-share * weight * np.maximum(level - z, 0)] * 2 + [-weight * np.maximum(level - z, 0)], axis=1))
#: Conductance of a gap: full when closed, falling with the gap, raised by pressure.
register("gap_conductance", lambda gap, pressure, full, decay: np.where(gap <= 0, full * (1 + pressure), full * np.exp(-gap / decay)))
register("power_creep", lambda stress, time, a, n, m: a * np.abs(stress) ** n * time**m)
#: Heat of friction: the share ``kept`` of the work of shear over slip, in its parts for the slave (``share``) and the master.
register("friction_heat_slave", lambda pressure, friction, speed, kept, share: kept * share * friction * np.maximum(pressure, 0) * np.abs(speed))
register("friction_heat_master", lambda pressure, friction, speed, kept, share: kept * (1 - share) * friction * np.maximum(pressure, 0) * np.abs(speed))
