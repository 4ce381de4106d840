"""Training-history queries. A history has one row per epoch of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_checkpoint(history: DataFrame, epoch: str, metric: str) -> DataFrame:
    """H6: first epoch of the highest validation metric, and the last value."""
    rows = history.filter(F.col(metric).isNotNull())
    return rows.agg(
        F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"),
        F.max(metric).alias("best_value"),
        F.max(epoch).alias("last_epoch"),
        F.max_by(metric, epoch).alias("last_value"),
    )


def early_stop(history: DataFrame, epoch: str, metric: str, patience: int, run: list[str] | None = None) -> DataFrame:
    """H7: validations since the last strict improvement, and the stopping row.

    ``run`` names the columns of one training run, the window's partition; a
    run's history is as long as its epochs.
    """
    scope = W.partitionBy(*(run or [F.lit(0)]))
    ordered = scope.orderBy(epoch)
    before = F.max(metric).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    rows = history.filter(F.col(metric).isNotNull()).withColumn("_before", before)
    better = F.col("_before").isNull() | (F.col(metric) > F.col("_before"))
    rows = rows.withColumn("_at", F.row_number().over(ordered)).withColumn("_better", F.when(better, F.col("_at")))
    rows = rows.withColumn("since_improvement", (F.col("_at") - F.max("_better").over(ordered)).cast("bigint"))
    stop = F.min(F.when(F.col("since_improvement") >= patience, F.col(epoch))).over(scope)
    return rows.select(
        *(run or []),
        epoch,
        metric,
        F.greatest(F.col(metric), F.coalesce("_before", metric)).alias("best_so_far"),
        "since_improvement",
        F.coalesce(F.col(epoch) == stop, F.lit(False)).alias("stops_here"),
    )
