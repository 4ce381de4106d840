"""Seeded splits that any engine with md5 can reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import shuffle_key
from plumbline.operators.prefix import add_hashed_rank, hashed_cuts
from plumbline.session import cut_lineage

NAMES = ("train", "val", "calibration")


def attach_split(manifest: DataFrame, splits: DataFrame, on: str = "sample_id", default: str = "not_assigned") -> DataFrame:
    """Split name per sample, a default where none is assigned."""
    joined = manifest.join(splits.select(on, F.col("split").alias("_split")), on, "left")
    return joined.withColumn("split", F.coalesce("_split", F.lit(default))).drop("_split")


def fixed_count_split(df: DataFrame, key: str, counts: dict[str, int] | dict[str, float], seed: int) -> DataFrame:
    """K1: shuffled split by exact sizes; the last part takes the remainder.

    Sizes below one are shares of the row count.
    """
    ranked = add_hashed_rank(df.withColumn("_key", shuffle_key(seed, key)), "_key")
    bound, split = F.lit(0), None
    names = list(counts)
    for name in names[:-1]:
        size = counts[name]
        bound = bound + (F.floor(F.col("size") * F.lit(float(size))) if size < 1 else F.lit(int(size)))
        hit = F.col("rank") <= bound
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return ranked.withColumn("split", split.otherwise(names[-1])).drop("_key", "rank", "size")


def split_groups(groups: DataFrame, group: str, seed: int, train: float = 0.8) -> DataFrame:
    """Groups to train/val/calibration: floor(train * G), then the rest halved.

    The group list is read by both ranks, so it is stored once.
    """
    groups = cut_lineage(groups.withColumn("_key", shuffle_key(seed, group)))
    first = add_hashed_rank(groups, "_key")
    first = first.withColumn("_train", F.col("rank") <= F.floor(F.col("size") * F.lit(train)))
    chosen = first.filter("_train").select(group, F.lit("train").alias("split"))
    rest = first.filter(~F.col("_train")).select(group, shuffle_key(seed + 1, group).alias("_key"))
    second = add_hashed_rank(rest, "_key")
    half = F.when(F.col("rank") <= F.floor(F.col("size") / 2), "val").otherwise("calibration")
    return chosen.unionByName(second.select(group, half.alias("split")))


def grouped_split(df: DataFrame, group: str, seed: int, train: float = 0.8) -> DataFrame:
    """K2: split of groups, so no group crosses two parts."""
    return df.drop("split").join(split_groups(df.select(group).distinct(), group, seed, train), group)


def exclusions(dev: DataFrame, test: DataFrame, size_repair: bool = True, conflicts: bool = True) -> DataFrame:
    """K3: every applicable reason per row, joined in a fixed order."""
    from plumbline.operators.quality import conflicting_groups

    in_test = test.select("sha").distinct().withColumn("_in_test", F.lit(True))
    flagged = dev.join(in_test, "sha", "left")
    reasons = [F.when(F.col("_in_test"), "exact_duplicate_of_official_test")]
    if size_repair:
        reasons.append(F.when(F.col("mask_resized_nearest") != 0, "unresolved_mask_size_repair"))
    if conflicts:
        bad = conflicting_groups(dev, "sha", "mask_sha").withColumn("_conflict", F.lit(True))
        flagged = flagged.join(bad, "sha", "left")
        reasons.append(F.when(F.col("_conflict"), "conflicting_labels_for_exact_duplicate_image"))
    out = flagged.withColumn("reason", F.concat_ws(";", *reasons)).filter(F.col("reason") != "")
    return out.select("sample_id", "part", "sha", "reason")


def exclude_ids(df: DataFrame, excluded: DataFrame, on: str = "sample_id") -> DataFrame:
    """Rows whose key is not excluded."""
    return df.join(excluded.select(on), on, "left_anti")


def in_groups(df: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """Rows whose group is listed."""
    return df.join(groups.select(on), on, "left_semi")


def append_exclusions(excluded: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Reviewed neighbours of the test split join the exclusion list."""
    extra = exclude_ids(neighbours, excluded).select(
        "sample_id", "part", F.lit("").alias("sha"), F.lit("reviewed_near_duplicate_scene_of_official_test").alias("reason")
    )
    return excluded.unionByName(extra)


def _expected() -> list[tuple[str, float]]:
    return list(zip(NAMES, (0.8, 0.1, 0.1)))


def split_balance(sizes: DataFrame, by: list[str], classes: int) -> DataFrame:
    """K4 from ``(by, split, n, pixels array)``: size and class-share deviations."""
    sums = [F.sum(F.col("pixels")[k]).alias(f"_g{k}") for k in range(classes)]
    per_split = sizes.groupBy(*by, "split").agg(F.sum("n").alias("_n"), *sums)
    whole = per_split.groupBy(*by).agg(F.sum("_n").alias("_all"), *[F.sum(f"_g{k}").alias(f"_t{k}") for k in range(classes)])
    joined = per_split.join(whole, by)
    own = sum((F.col(f"_g{k}") for k in range(1, classes)), F.col("_g0")).cast("double")
    every = sum((F.col(f"_t{k}") for k in range(1, classes)), F.col("_t0")).cast("double")
    gaps = [F.abs(F.try_divide(F.col(f"_g{k}"), own) - F.try_divide(F.col(f"_t{k}"), every)) for k in range(classes)]
    target = F.coalesce(*[F.when(F.col("split") == name, F.lit(share)) for name, share in _expected()])
    size_gap = 3.0 * F.abs(F.col("_n") / F.col("_all") - target)
    class_gap = sum(gaps[1:], gaps[0]) / classes
    return joined.groupBy(*by).agg(F.sum(size_gap + class_gap).alias("score"))


def group_histograms(pixels: DataFrame, group: str, sample: str, classes: int, label: str = "label") -> DataFrame:
    """Samples and class pixels per group: the only input the search needs."""
    counts = [F.count_if(F.col(label) == k).alias(f"_c{k}") for k in range(classes)]
    per_sample = pixels.groupBy(group, sample).agg(*counts)
    return per_sample.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"_c{k}") for k in range(classes)]).alias("pixels")
    )


def candidate_splits(groups: DataFrame, group: str, first_seed: int, seeds: int, train: float = 0.8) -> DataFrame:
    """K2 for a range of seeds at once, on group rows.

    A seed's ranks are not needed, only the two digests that part its groups. Those are
    selected by counts per digest prefix (``prefix.hashed_cuts``), one row per seed, and
    every fanned-out row is compared with them where it is: no row of groups x seeds moves.
    """
    spread = groups.repartition(groups.sparkSession.sparkContext.defaultParallelism, group)
    groups = cut_lineage(spread)
    fanned = groups.withColumn("seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + seeds - 1))))
    keyed = fanned.withColumn("_key", F.md5(F.concat_ws(":", "seed", group)))
    first = cut_lineage(hashed_cuts(keyed, "_key", ["seed"], F.floor(F.col("size") * F.lit(train))).withColumnRenamed("cut", "_first"))
    marked = keyed.join(F.broadcast(first), "seed", "left").withColumn("_train", F.coalesce(F.col("_key") <= F.col("_first"), F.lit(False)))
    marked = marked.withColumn("_key", F.md5(F.concat_ws(":", F.col("seed") + 1, group)))
    second = cut_lineage(hashed_cuts(marked.filter(~F.col("_train")), "_key", ["seed"], F.floor(F.col("size") / 2)).withColumnRenamed("cut", "_second"))
    half = F.when(F.col("_key") <= F.col("_second"), "val").otherwise("calibration")
    both = marked.join(F.broadcast(second), "seed", "left")
    return both.select(*fanned.columns, F.when(F.col("_train"), "train").otherwise(half).alias("split"))


def select_balanced_split(groups: DataFrame, group: str, first_seed: int, seeds: int, classes: int) -> DataFrame:
    """K5: the best-balanced seed; the first one wins a tie."""
    scores = split_balance(candidate_splits(groups, group, first_seed, seeds), ["seed"], classes)
    rounded = scores.select("seed", F.round("score", 12).alias("score"))
    return rounded.agg(F.min_by("seed", F.struct("score", "seed")).alias("seed"), F.min("score").alias("score"))
