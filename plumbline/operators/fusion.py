"""Logistic fusion of uncertainty scores into an error probability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import total
from plumbline.operators import ranking as rk
from plumbline.operators.rows import sample_per_group


@dataclass(frozen=True)
class FusionParameters:
    """Everything needed to score again."""

    feature_names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    sample_count: int
    error_rate: float
    c: float


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """L5 parameters: population mean and deviation per column, one row."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    return df.agg(*aggs)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(v - mean) / population deviation; a constant column divides by one."""
    one = moments(df, columns).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    rest = [c for c in df.columns if c not in columns]
    scaled = [
        ((F.col(c).cast("double") - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))).alias(c)
        for c in columns
    ]
    return joined.select(*rest, *scaled)


def fit_fusion(df: DataFrame, features: list[str], err: str = "err", c: float = 1.0, max_iter: int = 200) -> FusionParameters:
    """L2-penalised logistic regression of the error on the features.

    The penalty is stated per summed loss (C), the solver's per mean loss, hence
    ``regParam = 1 / (C n)``. Features are float32 on entry.
    """
    typed = df.select(*[F.col(f).cast("float").cast("double").alias(f) for f in features], F.col(err).cast("double").alias("label"))
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))
    checks = [F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.avg("label").alias("rate")]
    spread = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    row = typed.agg(*checks, *spread).first()
    if not row["n"] or row["bad"] or row["lo"] == row["hi"]:
        raise ValueError("fusion needs finite features and both correct and wrong units")
    mean = tuple(row[f"m_{f}"] for f in features)
    scale = tuple(row[f"s_{f}"] or 1.0 for f in features)
    scaled = typed.select("label", *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, scale)])
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(scaled)
    solver = LogisticRegression(regParam=1.0 / (c * row["n"]), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10)
    model = solver.fit(vectors)
    return FusionParameters(tuple(features), mean, scale, tuple(float(v) for v in model.coefficients), float(model.intercept), row["n"], row["rate"], c)


def fusion_score(p: FusionParameters) -> Column:
    """Error probability as float32."""
    terms = [(F.col(f).cast("float").cast("double") - m) / s * w for f, m, s, w in zip(p.feature_names, p.mean, p.scale, p.coefficients)]
    return (1.0 / (1.0 + F.exp(-(total(terms) + p.intercept)))).cast("float")


def evaluate_fusion(
    fit_rows: DataFrame, rows: DataFrame, features: list[str], by: list[str], group: list[str], unit: str, per_group: int, seed: int, c: float = 1.0
) -> DataFrame:
    """Seeded sample of the fit part, fit, then G12 on the evaluation part."""
    sample = sample_per_group(fit_rows, group, unit, per_group, seed)
    parameters = fit_fusion(sample, features, c=c)
    scored = rows.withColumn("score", fusion_score(parameters))
    return rk.ranking_by_region(scored, by).withColumn("score_name", F.lit("logistic_fusion"))
