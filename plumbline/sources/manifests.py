"""Manifest and split tables: explicit schema, required columns, unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numerics import as_col
from plumbline.operators.protocol import assert_unique

MANIFEST_SCHEMA = (
    "partition string, sample_id string, image_path string, mask_path string, width int, height int, "
    "original_mask_width int, original_mask_height int, mask_resized_nearest int, classes_present string, "
    "mask_policy string, non_exact_rgb_pixels int"
)
REQUIRED = ("sample_id", "image_path", "mask_path")


def check_manifest(df: DataFrame, required: tuple[str, ...] = REQUIRED, key: str = "sample_id") -> DataFrame:
    """A1: missing columns fail at once, a repeated id fails while running."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    return assert_unique(df, [key], key)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A1: CSV manifest with a fixed schema; an empty file is an error."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    if df.isEmpty():
        raise ValueError(f"manifest {path} is empty")
    return check_manifest(df, required)


def pair_sources(left: DataFrame, right: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """A3: every key with ``side`` in both/left/right; ``expected`` pairs if given."""
    joined = (
        left.select(key, F.lit(1).alias("_l"))
        .join(right.select(key, F.lit(1).alias("_r")), key, "full_outer")
        .select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("side"))
    )
    if expected is not None:
        found = joined.filter(F.col("side") == "both").count()
        if found != expected:
            raise ValueError(f"expected {expected} pairs, found {found}")
    return joined


def content_hash(column: Column | str, upper: bool = False) -> Column:
    """A5: SHA-256 of the content; provenance columns use upper-case hex."""
    digest = F.sha2(as_col(column), 256)
    return F.upper(digest) if upper else digest


def row_digest(columns: list[str]) -> Column:
    """60-bit digest of a row in canonical text form."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def table_fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest per scope, mergeable across partitions.

    The XOR and the folded sum together also notice repeated rows.
    """
    hashed = df.select(*by, row_digest(columns).alias("_h"))
    return hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_h").alias("digest"),
        F.sum(F.col("_h") % 1_000_000_007).alias("folded_sum"),
    )


def clean_text(column: Column | str) -> Column:
    """Null becomes empty, anything else is trimmed."""
    return F.coalesce(F.trim(as_col(column)), F.lit(""))
