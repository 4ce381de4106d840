"""Incremental forms of the mergeable metrics.

The batch operators keep their state as sums per (scope, bin) or (scope, cell).
The same aggregations run on a stream unchanged: the state store holds the sums
and the report is rolled up from the stored sums at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.softmax import unit_stats
from plumbline.operators import calibration as cal
from plumbline.operators import segmentation as seg
from plumbline.session import ensure_checkpoint_dir


def calibration_state(df: DataFrame, by: list[str], classes: int, temperature=1.0, bins: int = cal.BINS) -> DataFrame:
    """M1 state: overall and class-wise bin sums per scope of a stream (or batch) of predictions."""
    return cal.slot_sums(unit_stats(df, classes, temperature, keep=True), by, classes, bins)


def calibration_report(state: DataFrame, by: list[str]) -> DataFrame:
    """M1 result after any batch: NLL, Brier, ECE and the mean class-wise ECE."""
    return cal.merge_scopes(cal.merge_slots(state, by), by).select(*by, "pixels", "nll", "brier_score", "ece", "mean_classwise_ece")


def confusion_state(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """M2: running confusion counts; ``pred`` and ``label`` columns are needed."""
    return seg.confusion_counts(df, by, classes)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table, one file or a folder of part files, as a file stream with the schema of the stored files.

    A stream takes a plain path for a folder; as a pattern it may name either.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.[p]arquet")


def run_state(state: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Drain a streaming aggregation into a stored table and return it.

    Each micro-batch writes the complete state (bounded by scopes x bins) to a
    folder of its own number, so a replayed batch overwrites itself and a reader
    takes the last complete one.
    """
    spark = state.sparkSession
    root = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    query = (
        state.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    stored = spark.read.parquet(f"{root}/state")
    last = stored.agg(F.max("batch")).first()[0]
    return stored.filter(F.col("batch") == last).drop("batch").select(*keys, *[c for c in state.columns if c not in keys])
