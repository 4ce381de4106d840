"""Set checks and protocol gates. Each check is a violation-count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def assert_unique(df: DataFrame, on: list[str], what: str = "key") -> DataFrame:
    """Fail while running if a key repeats; the row itself passes unchanged."""
    grouped = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in on])
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what} repeats"))).otherwise(F.col(on[0]))
    return grouped.withColumn(on[0], guard).select(*df.columns)


def join_one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails if either side repeats a key.

    The uniqueness aggregation and the join hash on the same keys, so the check
    adds no shuffle of its own.
    """
    return assert_unique(a, on).join(assert_unique(b, on), on)


def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that appear in more than one split."""
    ends = df.groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return ends.filter(F.col("first_split") != F.col("last_split"))


def group_isolation(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """K6: groups that cross splits."""
    return split_overlap(df.select(group, split), group, split)


def coverage_check(source: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Keys missing from the parts and keys foreign to the source."""
    missing = source.select(key).join(parts.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    foreign = parts.select(key).join(source.select(key), key, "left_anti").withColumn("problem", F.lit("foreign"))
    return missing.unionByName(foreign)


def split_policy(df: DataFrame, allowed: list[str], split: str = "split") -> DataFrame:
    """K8: rows per split and whether the split may be read."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col(split).isin(*allowed))


def assert_allowed_splits(df: DataFrame, allowed: list[str], split: str = "split") -> DataFrame:
    """K8 as a gate in the plan: a locked split fails the job when it is read."""
    locked = ~F.col(split).isin(*allowed) | F.col(split).isNull()
    return df.withColumn(split, F.when(locked, F.raise_error(F.lit("a locked split was read"))).otherwise(F.col(split)))


DECISIONS = ("pending", "same_scene", "different_scene")


def review_violations(reviews: DataFrame) -> DataFrame:
    """Undefined decisions, and decided rows without reviewer or date."""
    from plumbline.sources.manifests import clean_text

    decision = clean_text("review_decision")
    decided = decision.isin(*DECISIONS[1:])
    unsigned = (clean_text("reviewer") == "") | (clean_text("review_date") == "")
    return reviews.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(~decision.isin(*DECISIONS)).alias("invalid_decisions"),
        F.count_if(decided & unsigned).alias("unsigned_decisions"),
    )


def validate_reviews(reviews: DataFrame) -> DataFrame:
    row = review_violations(reviews).first()
    if row["invalid_decisions"] or row["unsigned_decisions"]:
        raise ValueError(f"review table is invalid: {row.asDict()}")
    return reviews


def class_coverage(pixels: DataFrame, split: str, classes: int, label: str = "label") -> DataFrame:
    """I4: classes missing per split."""
    present = pixels.select(split, F.col(label).cast("int").alias("class_id")).distinct()
    domain = present.select(split).distinct().withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return domain.join(present, [split, "class_id"], "left_anti")


def _leak_checks(splits: DataFrame) -> DataFrame:
    """Overlap and leakage of ids, hashes and scenes in one pass.

    Every row contributes one entry per key kind; a key leaks when development
    and test both hold it, and overlaps when two development splits hold it.
    """
    kinds = {"sample_id": "ids", "sha": "hash", "scene": "scene"}
    entries = [F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key")) for column, kind in kinds.items()]
    dev = F.when(F.col("split") != "test", F.col("split"))
    keys = (
        splits.select("split", F.inline(F.array(*entries)))
        .groupBy("kind", "key")
        .agg(F.min(dev).alias("_lo"), F.max(dev).alias("_hi"), F.max(F.col("split") == "test").alias("_test"))
    )
    counts = keys.groupBy("kind").agg(
        F.count_if(F.col("_lo") != F.col("_hi")).alias("crosses_splits"),
        F.count_if(F.col("_test") & F.col("_lo").isNotNull()).alias("leaks_to_test"),
    )
    long = counts.unpivot("kind", ["crosses_splits", "leaks_to_test"], "problem", "violations")
    return long.select(F.concat_ws("_", "kind", "problem").alias("check"), "violations")


def _pixel_checks(pixels: DataFrame, classes: int) -> DataFrame:
    """Invalid labels and missing classes from one count per (split, label)."""
    cells = pixels.groupBy("split", "label").agg(F.count(F.lit(1)).alias("_n"))
    inside = (F.col("label") >= 0) & (F.col("label") < classes)
    per_split = cells.groupBy("split").agg(
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("_bad"),
        (F.lit(classes) - F.count_if(inside)).alias("_missing"),
    )
    totals = per_split.agg(
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_label"), F.coalesce(F.sum("_missing"), F.lit(0)).alias("class_missing")
    )
    return totals.unpivot([], ["invalid_label", "class_missing"], "check", "violations")


def _violations(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def validate_protocol(
    splits: DataFrame,
    excluded: DataFrame,
    reviews: DataFrame,
    pixels: DataFrame,
    expected: DataFrame,
    classes: int,
    fingerprint_columns: list[str],
) -> DataFrame:
    """K7: one violation count per check; the caller raises on any above zero.

    ``splits``: ``sample_id, split, sha, scene``; ``pixels``: ``split, label``;
    ``expected``: ``split, rows, digest`` as stored with the split.
    """
    from plumbline.sources.manifests import table_fingerprint

    splits = cut_lineage(splits)
    actual = table_fingerprint(splits, ["split"], fingerprint_columns)
    stored = expected.select("split", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    compared = actual.join(stored, "split", "full_outer").agg(
        F.count_if(~F.col("rows").eqNullSafe(F.col("_rows"))).alias("row_count_differs"),
        F.count_if(~F.col("digest").eqNullSafe(F.col("_digest"))).alias("fingerprint_differs"),
    )
    dev = splits.filter(F.col("split") != "test").select("sample_id")
    return (
        _leak_checks(splits)
        .unionByName(compared.unpivot([], ["row_count_differs", "fingerprint_differs"], "check", "violations"))
        .unionByName(_violations("excluded_sample_present", dev.join(excluded.select("sample_id"), "sample_id", "left_semi")))
        .unionByName(_violations("review_pending", reviews.filter(F.col("review_decision") == "pending")))
        .unionByName(_pixel_checks(pixels, classes))
    )


def require_clean(report: DataFrame) -> None:
    """Raise with the failing checks, if any."""
    bad = {r["check"]: r["violations"] for r in report.filter(F.col("violations") > 0).collect()}
    if bad:
        raise ValueError(f"protocol violations: {bad}")
