"""Bootstrap intervals with draws that any engine with md5 can reproduce."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from plumbline.functions.numerics import linear_quantile, shuffle_index
from plumbline.operators.prefix import add_hashed_rank
from plumbline.session import cut_lineage


def _interval(means: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """2.5 % and 97.5 % of the iteration means (a fixed number per scope)."""
    long = means.unpivot([*by, "iteration"], values, "metric", "value")
    return long.groupBy(*by, "metric").agg(
        linear_quantile("value", 0.025).alias("ci95_low"),
        linear_quantile("value", 0.975).alias("ci95_high"),
        F.count(F.lit(1)).alias("iterations"),
    )


def _centre(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    keys = by or [F.lit(0).alias("_all")]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), *[F.avg(v).alias(v) for v in values])
    return wide.unpivot([*(by or ["_all"]), "clusters"], values, "metric", "mean_difference")


#: Ranks of a pool block, iterations of a row of draws, and draws that one task makes.
BLOCK, STEP, DRAWS = 4_096, 100, 4_000_000
#: A draw on its way to its block: iteration and place in the block.
DRAW = np.dtype([("it", "<u2"), ("at", "<u2")])


def _dealt_draws(ranked: DataFrame, keys: list[str], iterations: int, seed: int) -> DataFrame:
    """Draws of every scope size, packed by pool block: size, block, draws (``DRAW`` records).

    A draw depends on size, iteration and rank alone, so scopes of one size share theirs:
    the first such scope lends its ranks.
    """
    scopes = ranked.groupBy(*keys, "size").agg(F.lit(1).alias("_one"))
    lenders = scopes.groupBy("size").agg(F.min(F.struct(*keys)).alias("_s")).select("size", *[F.col(f"_s.{k}").alias(k) for k in keys])
    total = lenders.agg(F.sum("size")).first()[0] or 0
    tasks = min(100_000, -(-total * iterations // DRAWS) or 1)
    same = [ranked["size"] == lenders["size"], *[ranked[k].eqNullSafe(lenders[k]) for k in keys]]
    own = ranked.join(F.broadcast(lenders), same, "left_semi").select("size", "rank").repartition(tasks, "size", "rank")
    start = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(STEP))).alias("start")
    picks = F.transform(F.sequence(F.col("start"), F.least(F.col("start") + STEP, F.lit(iterations)) - 1), lambda it: shuffle_index(seed, F.col("size"), it, F.col("rank")))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (size, first), rows in batch.groupby(["size", "start"]):
                picked = np.stack(list(rows["picks"])).astype(np.int64)
                flat = picked.ravel()
                records = np.zeros(len(flat), dtype=DRAW)
                records["it"] = np.tile(np.arange(first, first + picked.shape[1]), len(picked))
                records["at"] = flat % BLOCK
                order = np.argsort(flat // BLOCK, kind="stable")
                blocks, at = np.unique((flat // BLOCK)[order], return_index=True)
                yield pd.DataFrame({"size": size, "block": blocks, "draws": [part.tobytes() for part in np.split(records[order], at[1:])]})

    return own.select("size", "rank", start).select("size", "start", picks.alias("picks")).mapInPandas(deal, "size long, block long, draws binary")


def _iteration_means(ranked: DataFrame, keys: list[str], values: list[str], iterations: int, seed: int) -> DataFrame:
    """Mean of every value over the drawn rows, per scope and iteration; nulls don't count.

    Draws travel in four bytes to the block of ranks that they pick from, whose partial
    sums are added up.
    """
    n = len(values)
    schema = StructType(
        [*[ranked.schema[k] for k in keys], StructField("iteration", IntegerType()), *[StructField(f"_{kind}{i}", DoubleType()) for kind in "sn" for i in range(n)]]
    )

    def add(draws: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        scopes = list(pool.groupby(keys, dropna=False, sort=False)) if len(draws) else []
        sums = [np.zeros((2 * n, iterations)) for _ in scopes]
        tables = []
        for _, rows in scopes:
            table = np.zeros((2 * n, BLOCK))
            own = rows[values].to_numpy(dtype=float, na_value=np.nan)
            table[:n, rows["at"]] = np.nan_to_num(own, nan=0.0).T
            table[n:, rows["at"]] = ~np.isnan(own).T
            tables.append(table)
        for packed in draws["draws"]:
            drawn = np.frombuffer(packed, dtype=DRAW)
            for table, total in zip(tables, sums):
                for k in range(2 * n):
                    total[k] += np.bincount(drawn["it"], weights=table[k][drawn["at"]], minlength=iterations)
        parts = [pd.DataFrame({**{k: [rows[k].iloc[0]] * iterations for k in keys}, "iteration": range(iterations), **{f.name: total[i] for i, f in enumerate(schema.fields[len(keys) + 1 :])}}) for (_, rows), total in zip(scopes, sums)]
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema.fields})

    place = F.col("rank") - 1
    pool = ranked.select(*keys, "size", F.floor(place / BLOCK).alias("block"), (place % BLOCK).cast("int").alias("at"), *[F.col(v).cast("double").alias(v) for v in values])
    dealt = _dealt_draws(ranked, keys, iterations, seed).groupBy("size", "block")
    parts = dealt.cogroup(pool.groupBy("size", "block")).applyInPandas(add, schema)
    totals = parts.groupBy(*keys, "iteration").agg(*[F.sum(f"_{kind}{i}").alias(f"_{kind}{i}") for kind in "sn" for i in range(n)])
    return totals.select(*keys, "iteration", *[F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}")).alias(v) for i, v in enumerate(values)])


def paired_bootstrap(df: DataFrame, by: list[str], key: str, values: list[str], iterations: int, seed: int) -> DataFrame:
    """Resample the n rows of each scope with replacement.

    Every row makes one draw per iteration, so the draws spread like the rows;
    all value columns and all scopes of one size share the draws. The drawn index is
    uniform, which keeps the blocks balanced whatever the scopes look like. The draws are
    rows times iterations; where that is too much, call ``poisson_bootstrap``.
    """
    if iterations > 1 << 16:
        raise ValueError("at most 65,536 iterations")
    keys = by or ["_all"]
    base = cut_lineage((df if by else df.withColumn("_all", F.lit(0))).select(*keys, key, *values))
    ranked = cut_lineage(add_hashed_rank(base.withColumn("_key", F.md5(F.col(key).cast("string"))), "_key", keys, digits=2).drop("_key"))
    means = _iteration_means(ranked, keys, values, iterations, seed)
    out = _centre(base, keys, values).join(_interval(means, keys, values), [*keys, "metric"])
    return out if by else out.drop("_all")


def poisson_weight(u: Column, most: int = 20) -> Column:
    """Poisson(1) count for a uniform number of 60 bits: counts above 20 have less than 2^-60."""
    weight, reached, p = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(most):
        reached += p
        weight = weight + F.when(u >= reached, 1).otherwise(0)
        p /= k + 1
    return weight


def poisson_bootstrap(df: DataFrame, by: list[str], key: str, values: list[str], iterations: int, seed: int) -> DataFrame:
    """Weighted variant for very many clusters: no rank, no join, one
    pre-aggregated pass."""
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    drawn = base.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    uniform = shuffle_index(seed, F.lit(1 << 60), F.col("iteration"), F.col(key)) / float(1 << 60)
    weighted = drawn.withColumn("_w", poisson_weight(uniform))
    means = weighted.groupBy(*keys, "iteration").agg(
        *[F.try_divide(F.sum(F.col("_w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).cast("double")).alias(v) for v in values]
    )
    out = _centre(base, keys, values).join(_interval(means, keys, values), [*keys, "metric"])
    return out if by else out.drop("_all")


def cluster_differences(candidate: DataFrame, baseline: DataFrame, by: list[str], cluster: str, metrics: dict[str, float], require_same: bool = True) -> DataFrame:
    """Signed difference of cluster means; positive means the candidate is better.

    All conditions of a cluster are averaged first. Unless ``require_same`` is
    off, a cluster present on one side only is an error.
    """
    own = [c for c in by if c not in baseline.columns]
    shared = [c for c in by if c not in own]
    left = candidate.groupBy(*by, cluster).agg(*[F.avg(m).alias(m) for m in metrics])
    right = baseline.groupBy(*shared, cluster).agg(*[F.avg(m).alias(f"_b_{m}") for m in metrics], F.lit(1).alias("_there"))
    joined = left.join(right, [*shared, cluster], "left" if require_same else "inner")
    if require_same:
        sizes = right.groupBy(*(shared or [F.lit(0).alias("_all")])).agg(F.count(F.lit(1)).alias("_expected"))
        counted = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("_found"), F.count("_there").alias("_matched"))
        checked = counted.join(sizes, shared) if shared else counted.withColumn("_all", F.lit(0)).join(sizes, "_all").drop("_all")
        bad = (F.col("_found") != F.col("_expected")) | (F.col("_matched") != F.col("_expected"))
        guard = F.when(bad, F.raise_error(F.lit("both sides need the same clusters"))).otherwise(True)
        checked = checked.withColumn("_ok", guard).filter("_ok").select(*by)
        joined = joined.join(checked, by)
    return joined.select(*by, cluster, *[(sign * (F.col(m) - F.col(f"_b_{m}"))).alias(m) for m, sign in metrics.items()])


# Compared metrics and their signs (lower eAURC is better).
CLUSTER_METRICS = {"eaurc": -1.0, "error_auprc": 1.0, "top_10_uncertainty_recall": 1.0}


def clustered_bootstrap(per_sample: DataFrame, baseline: str, by: list[str], cluster: str, iterations: int, seed: int, score: str = "score_name") -> DataFrame:
    """Every score against the baseline score, clusters kept whole."""
    per_sample = cut_lineage(per_sample.select(*by, score, cluster, *CLUSTER_METRICS))
    base = per_sample.filter(F.col(score) == baseline).drop(score)
    diff = cluster_differences(per_sample, base, [*by, score], cluster, CLUSTER_METRICS)
    return paired_bootstrap(diff, [*by, score], cluster, list(CLUSTER_METRICS), iterations, seed)


def boundary_bootstrap(table: DataFrame, cluster: str, iterations: int, seed: int, calibrated: str = "clean_global", raw: str = "raw") -> DataFrame:
    """Boundary minus interior, and calibrated minus raw on the boundary.

    Only samples that have both sides enter a comparison.
    """
    table = cut_lineage(table.select("radius", "method", "region", cluster, "nll", "ece", "aurc", "eaurc"))

    def side(method, region):
        return table.filter((F.col("method") == method) & (F.col("region") == region)).drop("method", "region")

    wanted = {
        "boundary_minus_interior": (side(calibrated, "boundary"), side(calibrated, "interior"), ["nll", "ece", "aurc", "eaurc"]),
        "calibrated_minus_raw_boundary": (side(calibrated, "boundary"), side(raw, "boundary"), ["nll", "ece"]),
    }
    out = None
    for name, (left, right, metrics) in wanted.items():
        diff = cluster_differences(left, right, ["radius"], cluster, dict.fromkeys(metrics, 1.0), require_same=False)
        result = paired_bootstrap(diff, ["radius"], cluster, metrics, iterations, seed).withColumn("comparison", F.lit(name))
        out = result if out is None else out.unionByName(result)
    return out
