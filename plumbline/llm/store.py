"""Tables that cut the lineage of a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Unlike ``checkpoint()``, which runs the last stage again to save it, this
    evaluates the plan once. A lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for table in tables:
        if table is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is stored inside sends a Python worker at most so many rows at once."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)
