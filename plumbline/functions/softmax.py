"""Per-unit probability expressions over a ``logits ARRAY<DOUBLE>`` column.

The class count is a parameter, so the expressions are unrolled per class and
run inside whole-stage codegen instead of interpreted array lambdas. Staged
projections keep each exponential evaluated once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import ACCUMULATOR_CLAMP, EPS32, as_col, total

IGNORE = 255


def check_temperature(value: float) -> float:
    if not math.isfinite(value) or value <= 0:
        raise ValueError("temperature must be finite and positive")
    return float(value)


def _temperature(value: float | str | Column) -> Column:
    return F.lit(check_temperature(value)) if isinstance(value, (int, float)) else as_col(value)


def logit_items(classes: int, logits: str = "logits") -> list[Column]:
    return [F.col(logits)[k] for k in range(classes)]


def valid_units(df: DataFrame, classes: int, label: str = "label", ignore: int = IGNORE) -> DataFrame:
    """B1: rows whose label is a real class."""
    c = F.col(label)
    return df.filter((c != ignore) & (c >= 0) & (c < classes))


def first_argmax(items: list[Column]) -> Column:
    """Position of the maximum, the first one on a tie."""
    top = F.greatest(*items)
    return F.coalesce(*[F.when(z == top, F.lit(k)) for k, z in enumerate(items)])


def scale_logits(df: DataFrame, temperature: float | str | Column, classes: int, out: str = "scaled") -> DataFrame:
    """Logits divided by a positive temperature."""
    t = _temperature(temperature)
    return df.withColumn(out, F.array(*[z / t for z in logit_items(classes)]))


def with_exponentials(df: DataFrame, classes: int, temperature: float | str | Column = 1.0) -> DataFrame:
    """Stage columns ``_top`` (max logit), ``_e{k}`` and ``_mass`` at a temperature."""
    t, zs = _temperature(temperature), logit_items(classes)
    staged = df.withColumn("_top", F.greatest(*zs))
    staged = staged.select("*", *[F.exp((z - F.col("_top")) / t).alias(f"_e{k}") for k, z in enumerate(zs)])
    return staged.withColumn("_mass", total([F.col(f"_e{k}") for k in range(classes)]))


def stage_names(classes: int) -> list[str]:
    return ["_top", "_mass", *[f"_e{k}" for k in range(classes)]]


def probabilities(classes: int) -> list[Column]:
    return [F.col(f"_e{k}") / F.col("_mass") for k in range(classes)]


def softmax(df: DataFrame, classes: int, temperature: float | str | Column = 1.0, out: str = "probs") -> DataFrame:
    """Stable softmax as an array column."""
    staged = with_exponentials(df, classes, temperature)
    return staged.withColumn(out, F.array(*probabilities(classes))).drop(*stage_names(classes))


def unit_stats(df: DataFrame, classes: int, temperature: float | str | Column = 1.0, label: str = "label", keep: bool = False) -> DataFrame:
    """Per-unit ``pred, conf, correct, py, brier, nll`` (accumulator clamp).

    Ignored labels are dropped. ``keep`` retains the probability array.
    """
    staged = with_exponentials(valid_units(df, classes, label), classes, temperature)
    zs, ps = logit_items(classes), probabilities(classes)
    hit = [F.when(z == F.col("_top"), F.lit(k)) for k, z in enumerate(zs)]
    own = [F.when(F.col(label) == k, F.col(f"_e{k}")) for k in range(classes)]
    square = total([F.col(f"_e{k}") * F.col(f"_e{k}") for k in range(classes)])
    staged = staged.select(
        "*",
        F.coalesce(*hit).alias("pred"),
        (F.greatest(*[F.col(f"_e{k}") for k in range(classes)]) / F.col("_mass")).alias("conf"),
        (F.coalesce(*own) / F.col("_mass")).alias("py"),
        (square / (F.col("_mass") * F.col("_mass"))).alias("_square"),
    )
    if keep:
        staged = staged.withColumn("probs", F.array(*ps))
    return staged.select(
        *df.columns,
        "pred",
        "conf",
        "py",
        (F.col("pred") == F.col(label)).cast("bigint").alias("correct"),
        (F.col("_square") - 2.0 * F.col("py") + 1.0).alias("brier"),
        (-F.log(F.greatest(F.col("py"), F.lit(ACCUMULATOR_CLAMP)))).alias("nll"),
        *(["probs"] if keep else []),
    )


def probability_gap(probs: str = "probs") -> Column:
    """B2: distance of the row sum from one."""
    return F.abs(F.aggregate(F.col(probs), F.lit(0.0), lambda a, p: a + p) - 1.0)


def check_probabilities(df: DataFrame, tolerance: float = 1e-4, probs: str = "probs") -> DataFrame:
    """B2 as a gate: one aggregate; empty input or bad row sums are errors."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(probability_gap(probs)).alias("gap")).first()
    if row["n"] == 0:
        raise ValueError("no valid units remain")
    if row["gap"] is None or row["gap"] > tolerance:
        raise ValueError("expected probabilities, not logits")
    return df


SCORES = (
    "raw_msp",
    "calibrated_msp",
    "entropy",
    "probability_margin",
    "logit_margin",
    "energy",
)
#: With the one that needs neighbours (``operators.images``).
ALL_SCORES = (*SCORES, "local_disagreement")


def _second(items: list[Column], winner: Column) -> Column:
    """Largest of the others; a repeated maximum counts as its own runner-up."""
    return F.greatest(*[F.when(winner != k, item) for k, item in enumerate(items)])


def uncertainty_scores(df: DataFrame, classes: int, temperature: float | str | Column) -> DataFrame:
    """C1-C6 in one projection; every score is larger when less certain.

    Entropy, margin and energy use the calibrated temperature, ``raw_msp`` T=1.
    """
    t, zs = _temperature(temperature), logit_items(classes)
    es = [F.col(f"_e{k}") for k in range(classes)]
    staged = with_exponentials(df, classes, temperature)
    staged = staged.select(
        "*",
        first_argmax(zs).alias("_win"),
        total([F.exp(z - F.col("_top")) for z in zs]).alias("_raw_mass"),
    )
    staged = staged.select(
        "*",
        _second(zs, F.col("_win")).alias("_next_z"),
        (_second(es, F.col("_win")) / F.col("_mass")).alias("_next_p"),
        *[(e / F.col("_mass")).alias(f"_p{k}") for k, e in enumerate(es)],
    )
    ps = [F.col(f"_p{k}") for k in range(classes)]
    entropy = -total([p * F.log(F.greatest(p, F.lit(EPS32))) for p in ps])
    return staged.select(
        *df.columns,
        (1.0 - 1.0 / F.col("_raw_mass")).alias("raw_msp"),
        (1.0 - 1.0 / F.col("_mass")).alias("calibrated_msp"),
        entropy.alias("entropy"),
        (1.0 - (1.0 / F.col("_mass") - F.col("_next_p"))).alias("probability_margin"),
        (-(F.col("_top") - F.col("_next_z")) / t).alias("logit_margin"),
        (-(F.col("_top") / t + F.log("_mass"))).alias("energy"),
        F.col("_win").alias("pred"),
    )


def long_scores(df: DataFrame, names: list[str] | tuple[str, ...], name: str = "score_name", value: str = "score") -> DataFrame:
    """One row per (unit, score) from the wide form; scores become float32."""
    rest = [c for c in df.columns if c not in names]
    pairs = [F.struct(F.lit(n).alias(name), F.col(n).cast("float").alias(value)) for n in names]
    return df.select(*rest, F.inline(F.array(*pairs)))


def add_temperatures(df: DataFrame, rules: DataFrame, methods: list[str]) -> DataFrame:
    """Fan each unit out to the requested methods with their temperature.

    ``rules`` holds ``(method, degradation_type, temperature)``; a null type
    applies to every type. The table is bounded by methods x types.
    """
    fanned = df.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    general = rules.filter(F.col("degradation_type").isNull()).select("method", F.col("temperature").alias("_all"))
    typed = rules.filter(F.col("degradation_type").isNotNull()).select(
        "method", "degradation_type", F.col("temperature").alias("_typed")
    )
    joined = fanned.join(F.broadcast(general), "method", "left").join(
        F.broadcast(typed), ["method", "degradation_type"], "left"
    )
    chosen = F.coalesce("_typed", "_all")
    checked = F.when(chosen.isNull(), F.raise_error(F.concat(F.lit("no temperature for "), "method"))).otherwise(chosen)
    return joined.withColumn("temperature", checked).drop("_all", "_typed")


