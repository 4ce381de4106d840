"""Row selection: top lists, pages and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numerics import shuffle_key


def head_per_group(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """H3: first k rows per group.

    A filter on a row number is planned as a per-partition group limit before
    the shuffle, so a hot group sends at most k rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """H9: min(n, size) rows per group, seeded and without replacement."""
    keyed = df.withColumn("_key", shuffle_key(seed, key))
    return head_per_group(keyed, by, ["_key"], n).drop("_key")


def random_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """H8: n rows without replacement; planned as a top-n, not a full sort."""
    return df.withColumn("_key", shuffle_key(seed, key)).orderBy("_key").limit(n).drop("_key")
