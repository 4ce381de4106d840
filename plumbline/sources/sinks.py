"""Result tables: clean values, resume tests and atomic replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import finite_or_null


def nan_to_null(df: DataFrame) -> DataFrame:
    """Non-finite floating values become null."""
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[finite_or_null(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def resume_pending(conditions: DataFrame, stored: DataFrame, on: str, keys: list[str], expected_rows: int) -> DataFrame:
    """Conditions whose stored result is absent, short or has repeated keys."""
    per_key = stored.groupBy(on, *keys).agg(F.count(F.lit(1)).alias("_n"))
    done = (
        per_key.groupBy(on)
        .agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
        .filter((F.col("_rows") == expected_rows) & (F.col("_most") == 1))
    )
    return conditions.join(done.select(on), on, "left_anti")


def write_split(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write one folder per split and return count and fingerprint of each.

    The report is taken from the stored table, not from the frame, so it also
    proves what was written.
    """
    from plumbline.sources.manifests import table_fingerprint

    df.repartitionByRange("split", "sample_id").sortWithinPartitions("split", "sample_id").write.mode("overwrite").partitionBy("split").parquet(path)
    return table_fingerprint(df.sparkSession.read.parquet(path), ["split"], columns)


def write_parts(df: DataFrame, path: str, parts: list[str]) -> None:
    """A10: replace exactly the partitions present in ``df``.

    Files become visible when the job commits; a failed job leaves the old
    partitions as they were.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


# The columns of the experiment log.
LOG_FIELDS = (
    "experiment_id timestamp status git_branch git_commit model dataset_split seed image_size batch_size epochs "
    "learning_rate best_epoch val_miou val_ece val_nll val_brier cal_miou cal_ece cal_nll cal_brier test_miou "
    "checkpoint_path notes"
).split()


def append_experiment(spark, record: dict, path: str) -> None:
    """Append one record to the log; missing fields are empty."""
    unknown = sorted(set(record) - set(LOG_FIELDS))
    if unknown:
        raise ValueError(f"unknown log fields {unknown}")
    row = tuple("" if record.get(f) is None else str(record[f]) for f in LOG_FIELDS)
    spark.createDataFrame([row], ", ".join(f"`{f}` string" for f in LOG_FIELDS)).write.mode("append").parquet(path)
