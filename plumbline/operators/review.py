"""Candidate pairs, their review table and the summary of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import near
from plumbline.operators.protocol import DECISIONS
from plumbline.operators.rows import head_per_group
from plumbline.session import cut_lineage
from plumbline.sources.manifests import clean_text

VERDICT = ("review_decision", "reviewer", "review_date", "notes")


def hash_candidates(df: DataFrame, unit: str, h: Column, max_d: int) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of different content within ``max_d`` bits, none across partitions lost.

    Members of one hash and partition stand together. Every pair of near hashes
    gives, for each combination of their partitions, its first pair of different
    content; so does every hash for two of its own partitions. Inside a hash and
    partition the first unit is linked with the first of every other content.
    The first unit of the first two contents is all that such a pair can need,
    so the output is linear in the members.
    """
    rows = df.select(F.col(unit).alias("unit"), "part", "sha", h.alias("h"))
    contents = rows.groupBy("h", "part", "sha").agg(F.min("unit").alias("unit"))
    firsts = head_per_group(contents, ["h", "part"], ["unit"], 2).groupBy("h", "part").agg(F.array_sort(F.collect_list(F.struct("unit", "sha"))).alias("members"))
    hashes = cut_lineage(firsts.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("part", "members"))).alias("parts")))

    def combined(pairs: DataFrame, wanted: Column) -> DataFrame:
        each = pairs.withColumn("pa", F.explode("parts_a")).withColumn("pb", F.explode("parts_b")).filter(wanted)
        both = F.flatten(F.transform("pa.members", lambda a: F.transform("pb.members", lambda b: F.struct(F.least(a["unit"], b["unit"]).alias("id_a"), F.greatest(a["unit"], b["unit"]).alias("id_b"), (a["sha"] != b["sha"]).alias("differ")))))
        return each.select(F.array_min(F.filter(both, lambda p: p["differ"])).alias("p")).filter("p IS NOT NULL").select("p.id_a", "p.id_b")

    near_hashes = near.hash_pairs(hashes, max_d)
    across = combined(near_hashes, F.lit(True))
    own = hashes.filter(F.size("parts") > 1).select(F.col("parts").alias("parts_a"), F.col("parts").alias("parts_b"))
    crossing = combined(own, F.col("pa.part") < F.col("pb.part"))
    centres = firsts.select("h", "part", F.col("members")[0]["unit"].alias("id_a"))
    star = cut_lineage(contents).join(cut_lineage(centres), ["h", "part"]).filter(F.col("unit") != F.col("id_a")).select("id_a", F.col("unit").alias("id_b"))
    return across.unionByName(crossing).unionByName(star).distinct()


def near_duplicate_candidates(
    df: DataFrame, unit: str, hashes: dict[str, Column], vector: str, dims: int, max_d: int = 4, k: int = 6, min_cos: float = 0.995
) -> DataFrame:
    """Union of close hashes and close embeddings, exact copies removed.

    ``df`` carries ``unit, part, sha``, the hash inputs and ``vector``. Pairs
    are named in manifest order (part, id).
    """
    df = cut_lineage(df)
    sources = []
    for column in hashes.values():
        pairs = hash_candidates(df, unit, column, max_d)
        sources.append(pairs.select("id_a", "id_b", F.lit("perceptual_hash").alias("source"), F.lit(None).cast("double").alias("cosine")))
    close = near.knn_cosine(df, unit, vector, dims, k, min_cos)
    sources.append(
        close.select(
            F.least("unit", "neighbour").alias("id_a"), F.greatest("unit", "neighbour").alias("id_b"), F.lit("embedding").alias("source"), "cosine"
        )
    )
    union = sources[0]
    for extra in sources[1:]:
        union = union.unionByName(extra)
    merged = union.groupBy("id_a", "id_b").agg(
        F.max("cosine").alias("embedding_cosine"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("candidate_sources")
    )
    facts = df.select(F.col(unit).alias("_id"), F.col("part"), F.col("sha"), *[c.alias(f"h_{n}") for n, c in hashes.items()])

    def side(name):
        return facts.select(F.col("_id").alias(f"id_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in facts.columns if c != "_id"])

    both = merged.join(side("a"), "id_a").join(side("b"), "id_b").filter(F.col("sha_a") != F.col("sha_b"))
    swap = (F.col("part_a") > F.col("part_b")) | ((F.col("part_a") == F.col("part_b")) & (F.col("id_a") > F.col("id_b")))
    crossing = F.col("part_a") != F.col("part_b")
    named = both.select(
        F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("sample_id_a"),
        F.when(swap, F.col("part_b")).otherwise(F.col("part_a")).alias("partition_a"),
        F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("sample_id_b"),
        F.when(swap, F.col("part_a")).otherwise(F.col("part_b")).alias("partition_b"),
        *[near.hamming(F.col(f"h_{n}_a"), F.col(f"h_{n}_b")).cast("bigint").alias(f"{n}_distance") for n in hashes],
        "embedding_cosine",
        "candidate_sources",
        F.when(crossing, 0).otherwise(1).cast("bigint").alias("priority"),
    )
    return named.select(F.concat_ws("__", "sample_id_a", "sample_id_b").alias("pair_key"), "*")


def carry_forward_reviews(new: DataFrame, old: DataFrame) -> DataFrame:
    """Human verdicts of surviving pairs are kept, the rest is pending."""
    kept = old.select("pair_key", *[clean_text(c).alias(f"_{c}") for c in VERDICT])
    joined = new.join(kept, "pair_key", "left")
    defaults = {"review_decision": "pending"}
    return joined.select(*new.columns, *[F.coalesce(f"_{c}", F.lit(defaults.get(c, ""))).alias(c) for c in VERDICT])


def candidate_order() -> list[Column]:
    """H2: priority, then cosine (missing last), distances and the pair key."""
    cosine = F.coalesce("embedding_cosine", F.lit(-1.0))
    return [F.asc("priority"), F.desc(cosine), F.asc("phash_distance"), F.asc("dhash_distance"), F.asc("pair_key")]


def order_candidates(df: DataFrame) -> DataFrame:
    return df.orderBy(*candidate_order())


def review_batch(df: DataFrame, size: int, index: int = 1) -> DataFrame:
    """H4: one page of the pending rows; pages do not overlap."""
    if size < 1 or index < 1:
        raise ValueError("batch size and index must be positive")
    decision = clean_text("review_decision")
    checked = F.when(decision.isin(*DECISIONS), decision).otherwise(F.raise_error(F.lit("unknown review decision")))
    page = cut_lineage(df.filter(checked == "pending").orderBy(*candidate_order()).offset((index - 1) * size).limit(size))
    if page.isEmpty():
        raise ValueError(f"no pending candidates in batch {index}")
    return page.orderBy(*candidate_order())


def scene_summary(groups: DataFrame, reviews: DataFrame) -> DataFrame:
    """group counts, review progress and the protocol status."""
    left = groups.agg(F.countDistinct("sha").alias("exact_groups"), F.countDistinct("scene_group_id").alias("scene_groups"))
    right = reviews.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("review_decision") == "pending").alias("pending"),
        F.count_if(F.col("review_decision") == "same_scene").alias("confirmed"),
    )
    status = F.when(F.col("pending") > 0, "pending_manual_near_duplicate_review").otherwise("review_complete")
    key = F.lit(0).alias("_one")
    return left.select(key, "*").join(right.select(key, "*"), "_one").drop("_one").withColumn("protocol_status", status)
