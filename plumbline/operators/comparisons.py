"""Comparisons between result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def condition_deltas(metrics: DataFrame, reference: str, on: list[str], names: list[str]) -> DataFrame:
    """candidate minus the reference method per scope and metric, long."""
    long = metrics.unpivot(["method", *on], names, "metric", "value")
    base = long.filter(F.col("method") == reference).select(*on, "metric", F.col("value").alias("_ref"))
    joined = long.filter(F.col("method") != reference).join(base, [*on, "metric"])
    return joined.select(
        "method", F.lit(reference).alias("reference"), *on, "metric", (F.col("value") - F.col("_ref")).alias("delta")
    )


def pivot_delta(df: DataFrame, keys: list[str], pivot: str, value: str, left: str, right: str) -> DataFrame:
    """two pivot values as columns and their difference."""
    wide = df.groupBy(*keys).pivot(pivot, [left, right]).agg(F.first(value))
    return wide.withColumn("delta", F.col(left) - F.col(right))


def reconcile(a: DataFrame, b: DataFrame, on: list[str], tolerances: dict[str, float]) -> DataFrame:
    """One-to-one join; largest absolute difference per metric."""
    from plumbline.operators.protocol import join_one_to_one

    names = list(tolerances)
    left = a.select(*on, *[F.col(n).alias(f"_a_{n}") for n in names])
    right = b.select(*on, *[F.col(n).alias(f"_b_{n}") for n in names])
    joined = join_one_to_one(left, right, on)
    worst = joined.agg(*[F.max(F.abs(F.col(f"_a_{n}") - F.col(f"_b_{n}"))).alias(n) for n in names])
    rows = [
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("max_difference"), F.lit(float(t)).alias("tolerance"))
        for n, t in tolerances.items()
    ]
    return worst.select(F.inline(F.array(*rows))).withColumn("within", F.col("max_difference") <= F.col("tolerance"))


def severity_series(metrics: DataFrame, kinds: list[str]) -> DataFrame:
    """Per type the clean row as severity zero, then its own severities."""
    clean = metrics.filter((F.col("degradation_type") == "clean") & (F.col("severity") == 0))
    spread = clean.withColumn("degradation_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return spread.unionByName(metrics.filter(F.col("degradation_type").isin(*kinds)))


def condition_summary(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """mean of every metric per key; null keys form their own group."""
    return metrics.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
