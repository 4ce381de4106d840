"""Temperature fits: one scalar per scope, minimising the mean NLL.

In a = 1/T the NLL is convex, with gradient E_p[z] - z_y and curvature Var_p[z].
Each Newton step is one grouped aggregation shared by all scopes; only a few
numbers per scope reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import total
from plumbline.functions.softmax import logit_items, valid_units

MIN_TEMPERATURE, MAX_TEMPERATURE, MAX_ITERATIONS = 0.05, 20.0, 100
FIT_SCHEMA = (
    "scope string, temperature double, initial_nll double, final_nll double, iterations int, evaluations int, "
    "converged boolean, valid_units bigint, at_boundary boolean, nll_improvement double, finite_result boolean"
)


def _true_logit(classes: int, label: str) -> Column:
    return F.coalesce(*[F.when(F.col(label) == k, z) for k, z in enumerate(logit_items(classes))])


def _with_moments(df: DataFrame, classes: int, inverse: Column, label: str) -> DataFrame:
    """Per unit ``_nll``, ``_grad`` and ``_curve`` at an inverse temperature."""
    zs = logit_items(classes)
    staged = df.withColumn("_top", F.greatest(*zs)).withColumn("_a", inverse)
    staged = staged.select("*", *[F.exp((z - F.col("_top")) * F.col("_a")).alias(f"_e{k}") for k, z in enumerate(zs)])
    es = [F.col(f"_e{k}") for k in range(classes)]
    ds = [z - F.col("_top") for z in zs]
    staged = staged.select(
        "*",
        total(es).alias("_m0"),
        total([e * d for e, d in zip(es, ds)]).alias("_m1"),
        total([e * d * d for e, d in zip(es, ds)]).alias("_m2"),
        (_true_logit(classes, label) - F.col("_top")).alias("_own"),
    )
    mean = F.col("_m1") / F.col("_m0")
    return staged.select(
        *df.columns,
        (F.log("_m0") - F.col("_own") * F.col("_a")).alias("_nll"),
        (mean - F.col("_own")).alias("_grad"),
        (F.col("_m2") / F.col("_m0") - mean * mean).alias("_curve"),
    )


def fit_temperature_grid(df: DataFrame, by: list[str], classes: int, grid: list[float], label: str = "label") -> DataFrame:
    """L2: the grid point of lowest mean NLL per scope; the first one on a tie."""
    rows = valid_units(df, classes, label).select(*by, label, "logits")
    fanned = rows.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    losses = _with_moments(fanned, classes, 1.0 / F.col("temperature"), label)
    means = losses.groupBy(*by, "temperature").agg(F.avg("_nll").alias("nll"))
    keys = by or [F.lit(0).alias("_all")]
    best = means.groupBy(*keys).agg(F.min(F.struct(F.round("nll", 10).alias("nll"), "temperature")).alias("_best"))
    return best.select(*by, F.col("_best.temperature").alias("temperature"), F.col("_best.nll").alias("nll"))


@dataclass
class _Search:
    """Safeguarded Newton on one scope."""

    a: float = 1.0
    low: float = 1.0 / MAX_TEMPERATURE
    high: float = 1.0 / MIN_TEMPERATURE
    initial: float | None = None
    nll: float = math.nan
    units: int = 0
    steps: int = 0
    evaluations: int = 0
    done: bool = False
    best_a: float = 1.0
    best_nll: float = math.inf

    def absorb(self, units: int, nll: float, grad: float, curve: float, tolerance: float) -> None:
        if self.evaluations and units != self.units:
            raise RuntimeError("the input changed between passes")
        self.units, self.nll, self.evaluations = units, nll, self.evaluations + 1
        if self.initial is None:
            self.initial = nll
        if nll < self.best_nll:
            self.best_nll, self.best_a = nll, self.a
        # The size of the Newton step, not of the gradient, says how far the
        # minimum is: on separable data both derivatives fade out together.
        settled = grad == 0.0 or (curve > 0 and abs(grad / curve) <= tolerance * self.a)
        if settled or self.high - self.low <= 1e-12:
            self.done = True
            return
        if grad > 0:
            self.high = self.a
        else:
            self.low = self.a
        step = self.a - grad / curve if curve > 0 else math.nan
        edge_low, edge_high = 1.0 / MAX_TEMPERATURE, 1.0 / MIN_TEMPERATURE
        if math.isfinite(step) and self.low < step < self.high:
            following = step
        elif self.low == edge_low and not (math.isfinite(step) and step >= self.high) and grad > 0:
            following = edge_low
        elif self.high == edge_high and grad < 0:
            following = edge_high
        else:
            following = (self.low + self.high) / 2.0
        if following == self.a:
            self.done = True
            return
        self.a, self.steps = following, self.steps + 1

    def row(self, scope: str) -> tuple:
        temperature = 1.0 / self.best_a
        edge = abs(temperature - MIN_TEMPERATURE) < 1e-8 or abs(temperature - MAX_TEMPERATURE) < 1e-8
        finite = math.isfinite(temperature) and math.isfinite(self.best_nll)
        if not self.best_nll <= self.initial + 1e-7:
            raise RuntimeError(f"the fit of {scope} worsened the NLL")
        converged = finite and not edge and self.done and self.steps < MAX_ITERATIONS
        gain = self.initial - self.best_nll
        return (scope, temperature, self.initial, self.best_nll, self.steps, self.evaluations, converged, self.units, edge, gain, finite)


def _lookup(values: dict[str, float], key: str) -> Column:
    pairs = [F.lit(x) for name, value in values.items() for x in (name, value)]
    return F.create_map(*pairs)[F.col(key)]


def _fit(units: DataFrame, scoped: Callable[[DataFrame], DataFrame], classes: int, tolerance: float) -> DataFrame:
    """Fit all scopes together over stored ``units`` (label, logits and what ``scoped`` makes ``scope`` of).

    Scopes that are settled drop out of the later passes.
    """
    units = units.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        searches = {r["scope"]: _Search() for r in scoped(units.drop("label", "logits").distinct()).select("scope").distinct().collect()}
        if not searches:
            raise ValueError("no valid units to fit")
        for _ in range(MAX_ITERATIONS):
            active = {s: search for s, search in searches.items() if not search.done}
            if not active:
                break
            rows = scoped(units)
            part = rows if len(active) == len(searches) else rows.filter(F.col("scope").isin(*active))
            inverse = _lookup({s: search.a for s, search in active.items()}, "scope")
            moments = _with_moments(part, classes, inverse, "label").groupBy("scope")
            stats = moments.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_{c}").alias(c) for c in ("nll", "grad", "curve")])
            for r in stats.collect():
                active[r["scope"]].absorb(r["n"], r["nll"], r["grad"], r["curve"], tolerance)
        out = [search.row(name) for name, search in sorted(searches.items())]
    finally:
        units.unpersist()
    return units.sparkSession.createDataFrame(out, FIT_SCHEMA)


def fit_temperature(df: DataFrame, scope: str, classes: int, label: str = "label", tolerance: float = 1e-9) -> DataFrame:
    """L1: fit every scope of the column ``scope`` (a bounded registry) together."""
    rows = valid_units(df, classes, label).select(F.col(scope).alias("scope"), F.col(label).alias("label"), "logits")
    return _fit(rows, lambda units: units, classes, tolerance)


def with_scopes(df: DataFrame, scopes: dict[str, list[str]], condition: str = "condition", out: str = "scope") -> DataFrame:
    """L3: fan a unit out to every scope its condition belongs to."""
    members: dict[str, list[str]] = {}
    for scope, conditions in scopes.items():
        for c in conditions:
            members.setdefault(c, []).append(scope)
    pairs = [x for c, names in members.items() for x in (F.lit(c), F.array(*[F.lit(n) for n in names]))]
    return df.withColumn(out, F.explode(F.create_map(*pairs)[F.col(condition)]))


def fit_scopes(df: DataFrame, scopes: dict[str, list[str]], classes: int, condition: str = "condition", label: str = "label", tolerance: float = 1e-9) -> DataFrame:
    """L3: clean, pooled and per-type temperatures in the same passes.

    Units are stored once, each pass fans them out anew.
    """
    rows = valid_units(df, classes, label).select(F.col(condition).alias("_condition"), F.col(label).alias("label"), "logits")
    return _fit(rows, lambda units: with_scopes(units, scopes, "_condition"), classes, tolerance)
