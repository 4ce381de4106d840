"""Exact duplicates by content hash.

A hash shared by n rows has n(n-1)/2 pairs; they are never listed. Each group is
given as a star (its first member with every other one) plus the exact pair
count, and pair statistics come from group sizes.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    wide = n.cast("decimal(19,0)")
    return ((wide * (wide - 1)) / 2).cast("decimal(38,0)")


def duplicate_stars(df: DataFrame, key: str, unit: str) -> DataFrame:
    """First member with each other member of its hash group."""
    groups = df.groupBy(key).agg(F.min(unit).alias("first_id"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    joined = df.select(key, F.col(unit).alias("second_id")).join(groups, key)
    return joined.filter(F.col("first_id") < F.col("second_id")).select(
        key, "first_id", "second_id", F.col("_n").alias("group_size"), _pairs(F.col("_n")).alias("group_pairs")
    )


def exact_matches(a: DataFrame, b: DataFrame, key: str, unit: str) -> DataFrame:
    """Rows of two splits with the same hash, as two stars per hash.

    Every row of either side is listed against the first row of the other side;
    ``group_pairs`` is the number of pairs the hash stands for.
    """

    def ends(df, side):
        return df.groupBy(key).agg(F.min(unit).alias(f"_first_{side}"), F.count(F.lit(1)).alias(f"_n_{side}"))

    shared = ends(a, "a").join(ends(b, "b"), key)
    pairs = (F.col("_n_a") * F.col("_n_b")).alias("group_pairs")
    left = a.select(key, F.col(unit).alias("id_a")).join(shared, key).select(key, "id_a", F.col("_first_b").alias("id_b"), pairs)
    right = b.select(key, F.col(unit).alias("id_b")).join(shared, key).filter(F.col("id_b") != F.col("_first_b"))
    return left.unionByName(right.select(key, F.col("_first_a").alias("id_a"), "id_b", pairs))


def cross_split_groups(df: DataFrame, key: str, unit: str, split: str, comparisons: list[tuple[str, str]]) -> DataFrame:
    """Shared hashes per compared pair of splits, from one aggregation."""
    names = sorted({name for pair in comparisons for name in pair})
    aggs = []
    for name in names:
        here = F.col(split) == name
        aggs += [F.count_if(here).alias(f"_n_{name}"), F.min(F.when(here, F.col(unit))).alias(f"_first_{name}")]
    groups = df.groupBy(key).agg(*aggs)
    rows = [
        F.struct(
            F.lit(f"{left}_vs_{right}").alias("comparison"),
            F.col(f"_n_{left}").alias("n_a"),
            F.col(f"_n_{right}").alias("n_b"),
            F.col(f"_first_{left}").alias("first_a"),
            F.col(f"_first_{right}").alias("first_b"),
        )
        for left, right in comparisons
    ]
    spread = groups.select(key, F.inline(F.array(*rows)))
    return spread.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).withColumn("pairs", F.col("n_a") * F.col("n_b"))


def duplicate_consistency(df: DataFrame, key: str, part: str, split: str, mask: str) -> DataFrame:
    """pair counts by same/cross partition and identical/different masks.

    With f(S) the number of pairs that agree on the columns S, every figure is a
    sum or difference of six f values, so no pair is formed.
    """
    fine = df.groupBy(key, part, split, mask).agg(F.count(F.lit(1)).alias("_n"))
    subsets = {"all": [], "part": [part], "split": [split], "mask": [mask], "mask_part": [mask, part], "mask_split": [mask, split]}
    tagged = []
    for name, columns in subsets.items():
        tagged.append(
            F.struct(
                F.lit(name).alias("subset"),
                *[(F.col(c) if c in columns else F.lit(None).cast("string")).alias(f"_{i}") for i, c in enumerate((part, split, mask))],
            )
        )
    spread = fine.select(key, "_n", F.inline(F.array(*tagged)))
    sizes = spread.groupBy(key, "subset", "_0", "_1", "_2").agg(F.sum("_n").alias("_n"))
    sums = sizes.agg(*[F.coalesce(F.sum(F.when(F.col("subset") == s, _pairs(F.col("_n")))), F.lit(0)).alias(s) for s in subsets])
    figures = {
        "duplicate_pairs": F.col("all"),
        "cross_partition_pairs": F.col("all") - F.col("part"),
        "cross_partition_identical": F.col("mask") - F.col("mask_part"),
        "cross_partition_different": F.col("all") - F.col("part") - F.col("mask") + F.col("mask_part"),
        "cross_split_pairs": F.col("all") - F.col("split"),
        "cross_split_identical": F.col("mask") - F.col("mask_split"),
        "cross_split_different": F.col("all") - F.col("split") - F.col("mask") + F.col("mask_split"),
    }
    return sums.select(*[expr.cast("decimal(38,0)").alias(name) for name, expr in figures.items()])


def hash_leakage(dev: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Content hashes on both sides."""
    return dev.select(key).intersect(test.select(key))


