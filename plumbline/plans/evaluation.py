"""Whole evaluations: one row per scope from a predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.softmax import ALL_SCORES, long_scores, uncertainty_scores, unit_stats, valid_units
from plumbline.operators import calibration as cal
from plumbline.operators import ranking as rk
from plumbline.session import cut_lineage


def evaluate_condition_splits(df: DataFrame, by: list[str], unit: str, classes: int, temperature=1.0) -> DataFrame:
    """Segmentation, calibration, confidence and error-detection metrics.

    One pass fills the mergeable state (bins, class counts); tie groups give the
    AUROC and the ordered curve the area.
    """
    units = unit_stats(df, classes, temperature, keep=True)
    merged = cal.merge_scopes(cal.merge_slots(cal.slot_sums(units, by, classes), by), by).withColumn("loss", F.col("nll"))
    score = (1.0 - F.col("conf")).cast("float").alias("score")
    errors = units.select(*by, unit, score, (1 - F.col("correct")).alias("err"))
    ranked = rk.ranking_metrics(errors, by).select(*by, "error_auroc")
    area = rk.aurc_simple(rk.risk_coverage_curve(errors, by, unit), by).withColumnRenamed("aurc_simple", "aurc")
    return merged.join(ranked, by).join(area, by)


def evaluate_condition_classes(df: DataFrame, by: list[str], classes: int, temperature=1.0) -> DataFrame:
    """F26 long form: IoU, Dice, accuracy and class-wise ECE per class."""
    units = unit_stats(df, classes, temperature, keep=True)
    slots = cal.merge_slots(cal.slot_sums(units, by, classes), by).filter(F.col("slot") >= 0)
    return slots.select(*by, F.col("slot").alias("class_id"), "iou", "dice", "accuracy", F.col("ece").alias("classwise_ece"))


def validate_predictions(df: DataFrame, by: list[str], unit: str, provenance: str, classes: int) -> DataFrame:
    """K9: violation counts per stored part of a predictions table."""
    ids = df.groupBy(*by, unit).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("label").isNull()).alias("_no_label"),
        F.count_if(F.col("logits").isNull() | (F.size("logits") != classes)).alias("_bad"),
        F.min(provenance).alias("_lo"),
        F.max(provenance).alias("_hi"),
    )
    same = F.min("_lo") == F.max("_hi")
    return ids.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(F.col("_rows") - 1).alias("duplicate_units"),
        F.when(same, 1).otherwise(2).cast("bigint").alias("provenance_values"),
        F.sum("_no_label").alias("missing_labels"),
        F.sum("_bad").alias("bad_logits"),
    )


def evaluate_conditions(df: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Every score x stratum x condition in one grouped job."""
    return rk.ranking_by_region(long_scores(df, scores), [*by, "score_name"])


def evaluate_images(units: DataFrame, by: list[str], classes: int, temperature: float, radius: int, digits: int | None = None) -> DataFrame:
    """G16 from logits: seven scores x strata x conditions of ``operators.images`` units, complete or an error.

    ``digits`` rounds scores before they form ties.
    """
    scored = uncertainty_scores(valid_units(units, classes), classes, temperature)
    region = F.when(F.col("distance") <= radius, "boundary").otherwise("interior")
    scores = [(F.col(n) if digits is None else F.round(n, digits)).alias(n) for n in ALL_SCORES]
    wide = scored.select(*by, region.alias("region"), (F.col("pred") != F.col("label")).cast("int").alias("err"), *scores)
    result = cut_lineage(rk.ranking_by_region(long_scores(wide, ALL_SCORES), [*by, "score_name"]))
    scopes = result.select(*by).distinct().count() if by else 1
    return check_complete(result, [*by, "score_name", "region"], scopes * len(ALL_SCORES) * 3)


def check_complete(result: DataFrame, keys: list[str], expected_rows: int) -> DataFrame:
    """Exact row count and unique keys, or an error."""
    row = result.groupBy(*keys).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if (row["n"] or 0) != expected_rows or (row["most"] or 0) > 1:
        raise ValueError(f"expected {expected_rows} unique rows, found {row['n']}")
    return result


