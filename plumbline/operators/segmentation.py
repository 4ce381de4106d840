"""Confusion matrices and the metrics derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.softmax import IGNORE


def _classes(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def confusion_counts(df: DataFrame, by: list[str], classes: int, label: str = "label", pred: str = "pred", ignore: int = IGNORE) -> DataFrame:
    """Non-zero cells of F1; rows out of range on either side are dropped.

    The range test sits in the aggregate: as a filter it would be pushed below
    the projection of ``pred`` and compute the prediction a second time.
    """
    t, p = F.col(label), F.col(pred)
    inside = (t != ignore) & (t >= 0) & (t < classes) & (p >= 0) & (p < classes)
    cells = df.groupBy(*by, t.cast("int").alias("target"), p.cast("int").alias("prediction"))
    return cells.agg(F.count_if(inside).alias("n")).filter(F.col("n") > 0)


def confusion_matrix(df: DataFrame, by: list[str], classes: int, **options) -> DataFrame:
    """zero-filled counts by (truth, prediction) per scope."""
    counts = confusion_counts(df, by, classes, **options)
    keys = by or ["_all"]
    counts = counts if by else counts.withColumn("_all", F.lit(0))
    domain = (
        counts.select(*keys)
        .distinct()
        .withColumn("target", _classes(classes))
        .withColumn("prediction", _classes(classes))
    )
    filled = domain.join(counts, [*keys, "target", "prediction"], "left")
    return filled.select(*by, "target", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def per_class_metrics(counts: DataFrame, by: list[str], classes: int) -> DataFrame:
    """F2 per class: IoU, Dice, accuracy; null where 0/0.

    Each cell feeds its row class and its column class, so one fan-out of the
    (small) count table replaces separate row and column sums.
    """
    t, p, n = F.col("target"), F.col("prediction"), F.col("n")
    roles = F.array(
        F.struct(t.alias("class_id"), n.alias("truth"), F.lit(0).cast("bigint").alias("guess"), F.when(t == p, n).otherwise(0).alias("hit")),
        F.struct(p.alias("class_id"), F.lit(0).cast("bigint").alias("truth"), n.alias("guess"), F.lit(0).cast("bigint").alias("hit")),
    )
    sums = (
        counts.select(*by, F.inline(roles))
        .groupBy(*by, "class_id")
        .agg(F.sum("truth").alias("truth"), F.sum("guess").alias("guess"), F.sum("hit").alias("hit"))
    )
    union = F.col("truth") + F.col("guess") - F.col("hit")
    return sums.select(
        *by,
        "class_id",
        F.try_divide(F.col("hit"), union).alias("iou"),
        F.try_divide(2 * F.col("hit"), F.col("truth") + F.col("guess")).alias("dice"),
        F.try_divide(F.col("hit"), F.col("truth")).alias("accuracy"),
        "truth",
        "hit",
    )


def summarize_classes(per_class: DataFrame, by: list[str]) -> DataFrame:
    """F2 per scope: means run over the defined classes only."""
    keys = by or [F.lit(0).alias("_all")]
    return (
        per_class.groupBy(*keys)
        .agg(
            F.try_divide(F.sum("hit"), F.sum("truth")).alias("pixel_accuracy"),
            F.avg("accuracy").alias("mean_accuracy"),
            F.avg("iou").alias("miou"),
            F.avg("dice").alias("mean_dice"),
        )
        .select(*by, "pixel_accuracy", "mean_accuracy", "miou", "mean_dice")
    )


def segmentation_metrics(df: DataFrame, by: list[str], classes: int, **options) -> DataFrame:
    """pixel accuracy, mean accuracy, mIoU and mean Dice per scope."""
    counts = confusion_counts(df, by, classes, **options)
    return summarize_classes(per_class_metrics(counts, by, classes), by)


def per_class_table(df: DataFrame, by: list[str], classes: int, **options) -> DataFrame:
    """F2 per class with a row for every class of the domain."""
    counts = confusion_matrix(df, by, classes, **options)
    return per_class_metrics(counts, by, classes).drop("truth", "hit")
