"""Image folders: listing by stem, content hashes and decoded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_extract(_name(path), r"^(.+)\.[^.]*$", 1)


def list_files(spark: SparkSession, folder: str, extensions: list[str], content: bool = False) -> DataFrame:
    """A2: files of a folder by stem, extensions compared without case.

    A repeated stem (also one under two extensions) fails while running. The
    content column is only read when asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    suffix = F.lower(F.regexp_extract(_name(F.col("path")), r"(\.[^.]*)$", 1))
    wanted = files.filter(suffix.isin(*[e.lower() for e in extensions]))
    named = wanted.select(_stem(F.col("path")).alias("sample_id"), "path", "length", *(["content"] if content else []))
    counts = named.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = F.raise_error(F.concat(F.lit("repeated stem "), F.col("sample_id")))
    guarded = counts.select(F.when(F.col("_n") > 1, repeated).otherwise(F.col("sample_id")).alias("sample_id"))
    return named.join(guarded, "sample_id")


def file_hashes(spark: SparkSession, folder: str, extensions: list[str], upper: bool = False) -> DataFrame:
    """A5 over files: SHA-256 of the stored bytes."""
    from plumbline.sources.manifests import content_hash

    return list_files(spark, folder, extensions, content=True).select("sample_id", content_hash("content", upper).alias("sha"))


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """A4: decoded pixels ``(sample_id, y, x, r, g, b)``.

    Spark's image source stores rows of blue, green, red; a one-channel image
    answers its level on all three.
    """
    images = spark.read.format("image").option("dropInvalid", "false").load(folder)
    fields = images.select(
        _stem(F.col("image.origin")).alias("sample_id"),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("c"),
        F.col("image.data").alias("data"),
        F.explode(F.sequence(F.lit(0), F.col("image.height") * F.col("image.width") - 1)).alias("i"),
    )

    def channel(offset: int) -> Column:
        at = F.col("i") * F.col("c") + F.when(F.col("c") == 1, 0).otherwise(offset)
        return F.conv(F.hex(F.substr(F.col("data"), at + 1, F.lit(1))), 16, 10).cast("int")

    return fields.select(
        "sample_id",
        F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
        (F.col("i") % F.col("w")).cast("int").alias("x"),
        channel(2).alias("r"),
        channel(1).alias("g"),
        channel(0).alias("b"),
    )
