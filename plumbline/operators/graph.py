"""Connected components of the duplicate graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

MAX_ROUNDS = 100


def _neighbour_minimum(links: DataFrame) -> DataFrame:
    lows = links.groupBy("u").agg(F.min("v").alias("_m"))
    return links.join(lows.select("u", F.least("u", "_m").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest vertex around ``u``."""
    links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _neighbour_minimum(links)
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours and ``u`` itself are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _neighbour_minimum(down)
    others = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return others.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(vertices: DataFrame, edges: DataFrame, unit: str, left: str, right: str) -> DataFrame:
    """Component id = smallest member id.

    Alternates large-star and small-star until the edges are stars around the
    smallest members, in O(log^2 n) rounds. A hub meets only its minimum, one
    row, and never its other neighbours. State is checkpointed each round.
    """
    state = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    state = cut_lineage(state)
    before = _digest(state)
    for _ in range(MAX_ROUNDS):
        state = cut_lineage(_small_star(_large_star(state)))
        after = _digest(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = state.groupBy("u").agg(F.min("v").alias("_root"))
    joined = vertices.join(roots, vertices[unit] == roots["u"], "left")
    return joined.select(*vertices.columns, F.coalesce("_root", unit).alias("component"))


def scene_groups(manifest: DataFrame, reviews: DataFrame, unit: str = "sample_id", sha: str = "sha") -> DataFrame:
    """Components over equal hashes and confirmed pairs, with their source."""
    from plumbline.operators.exact import duplicate_stars

    stars = duplicate_stars(manifest, sha, unit).select(F.col("first_id").alias("u"), F.col("second_id").alias("v"))
    confirmed = reviews.filter(F.col("review_decision") == "same_scene")
    pairs = confirmed.select(F.col("sample_id_a").alias("u"), F.col("sample_id_b").alias("v"))
    found = connected_components(manifest.select(unit, sha), stars.unionByName(pairs), unit, "u", "v")
    named = pairs.select(F.col("u").alias(unit)).unionByName(pairs.select(F.col("v").alias(unit))).distinct()
    flagged = found.join(named.withColumn("_named", F.lit(True)), unit, "left")
    source = F.when(F.col("_named"), "exact_sha_plus_reviewed_near_duplicate").otherwise("exact_sha")
    return flagged.select(
        unit, sha, F.concat(F.lit("scene:"), "component").alias("scene_group_id"), source.alias("scene_group_source")
    )
