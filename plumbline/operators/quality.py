"""Label-quality columns, summaries and the manual review rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import exact_quantiles


def quality_columns(manifest: DataFrame) -> DataFrame:
    """Pixel totals, quantized share and the repair flag."""
    total = F.col("original_mask_width") * F.col("original_mask_height")
    return manifest.select(
        "*",
        total.alias("total_pixels"),
        F.col("non_exact").alias("quantized_pixels"),
        F.try_divide(F.col("non_exact"), total).alias("quantized_ratio"),
        (F.col("mask_resized_nearest") != 0).alias("size_repaired"),
        F.when(F.col("mask_resized_nearest") != 0, "class_index_nearest_resize").otherwise("none").alias("repair_method"),
    )


def quality_summary(quality: DataFrame) -> DataFrame:
    """sums, ratio of sums and the distribution of the ratios."""
    sums = quality.groupBy(F.lit(0).alias("_all")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("quantized_pixels").alias("quantized_pixels"),
        F.sum("total_pixels").alias("total_pixels"),
        F.try_divide(F.sum("quantized_pixels"), F.sum("total_pixels")).alias("overall_quantized_ratio"),
        F.avg("quantized_ratio").alias("mean_quantized_ratio"),
        F.max("quantized_ratio").alias("max_quantized_ratio"),
        F.count_if("size_repaired").alias("size_repaired_samples"),
    )
    keyed = quality.select(F.lit(0).alias("_all"), "quantized_ratio")
    ranks = exact_quantiles(keyed, ["_all"], "quantized_ratio", {"median_quantized_ratio": 0.5, "p95_quantized_ratio": 0.95})
    return sums.join(ranks, "_all").drop("_all")


def repaired_by_split(quality: DataFrame) -> DataFrame:
    return quality.filter("size_repaired").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def top_quantized(quality: DataFrame, k: int = 20) -> DataFrame:
    """H1: the k samples with the largest quantized share."""
    return quality.orderBy(F.desc("quantized_ratio"), "sample_id").limit(k)


def manual_review_rules(quality: DataFrame, excluded: DataFrame, reviewer: str, day: str, k: int = 20) -> DataFrame:
    """Decisions for the top list and for every size repair.

    ``excluded`` names the samples of the top list that a reviewer rejected.
    """
    top = top_quantized(quality, k).select("sample_id")
    marked = top.join(excluded.select("sample_id", F.lit(True).alias("_out")), "sample_id", "left")
    out = F.coalesce("_out", F.lit(False))
    first = marked.select(
        "sample_id",
        F.lit("quantization").alias("review"),
        F.when(out, "exclude").otherwise("include").alias("decision"),
        F.when(out, "excluded with the unresolved size repair").otherwise("regions kept and aligned").alias("notes"),
    )
    second = quality.filter("size_repaired").select(
        "sample_id",
        F.lit("size_repair").alias("review"),
        F.lit("exclude").alias("decision"),
        F.lit("no reliable alignment repair").alias("notes"),
    )
    return first.unionByName(second).select("*", F.lit(reviewer).alias("reviewer"), F.lit(day).alias("review_date"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def conflicting_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """keys with more than one distinct value.

    Minimum and maximum differ exactly when there are two values, and unlike a
    distinct count they combine on the map side, also for a hot key.
    """
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return ends.filter(F.col("_lo") != F.col("_hi")).select(key)
