"""Near-duplicate, review and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.views import HASHED, PX, r6, with_
from plumbline.operators import graph as gr
from plumbline.operators import near
from plumbline.operators import protocol as pr
from plumbline.operators import review as rv
from plumbline.operators import rows as rw
from plumbline.plans import fixtures as fx

TOP = 20


def hashed(spark, sf):
    """V5 with a content hash: copies whose bits did not change are exact copies."""
    original = F.col("vec_id") % 1_000_000
    exact = F.floor(original / 10) % 6 == 0
    sha = F.md5(F.when((F.col("part") == "test") & exact, original).otherwise(F.col("vec_id")).cast("string"))
    return fx.hashed(spark, sf).withColumn("sha", sha)


def phash():
    return near.join_halves("hi", "lo")


def dhash():
    return near.join_halves("dhi", "dlo")


def q_hamming_topk(spark, sf):
    h = hashed(spark, sf)
    out = near.hamming_topk(h.filter(F.col("part") == "train_val"), h.filter(F.col("part") == "test"), "sample_id", phash(), TOP)
    return out.select("id_a", "id_b", "distance")


def q_hamming_pairs(spark, sf):
    return near.hamming_pairs(hashed(spark, sf), "sample_id", phash(), 4)


def q_hamming_pairs_hot(spark, sf):
    """The same search with every bucket treated as hot (second banding level)."""
    return near.hamming_pairs(hashed(spark, sf), "sample_id", phash(), 4, hot_bucket=0)


def q_knn_cosine(spark, sf):
    return rounded(near.knn_cosine(hashed(spark, sf), "sample_id", "e", fx.DIMS, 3, 0.99), "cosine")


def candidates(spark, sf):
    return rv.near_duplicate_candidates(hashed(spark, sf), "sample_id", {"phash": phash(), "dhash": dhash()}, "e", fx.DIMS, 4, 6, 0.995)


def q_candidates(spark, sf):
    return rounded(candidates(spark, sf), "embedding_cosine")


def reviews(spark, sf):
    """Planted pairs with a verdict by hash distance."""
    h = hashed(spark, sf)
    copies = h.filter(F.col("part") == "test").select((F.col("vec_id") - 1_000_000).alias("vec_id"), F.col("sample_id").alias("sample_id_a"), phash().alias("ha"))
    originals = h.filter(F.col("part") == "train_val").select("vec_id", F.col("sample_id").alias("sample_id_b"), phash().alias("hb"))
    joined = copies.join(originals, "vec_id")
    d = near.hamming(F.col("ha"), F.col("hb"))
    decision = F.when(d <= 3, "same_scene").when(d == 4, "different_scene").otherwise("pending")
    signed = F.when(decision != "pending", F.when(F.col("vec_id") % 100 != 0, "reviewer_a"))
    return joined.select(
        F.concat_ws("__", "sample_id_a", "sample_id_b").alias("pair_key"),
        "sample_id_a",
        "sample_id_b",
        decision.alias("review_decision"),
        signed.alias("reviewer"),
        F.when(decision != "pending", "2026-01-01").alias("review_date"),
        F.concat(F.lit(" distance "), d, F.lit(" ")).alias("notes"),
        d.cast("bigint").alias("phash_distance"),
    )


def q_carry_forward(spark, sf):
    return rounded(rv.carry_forward_reviews(candidates(spark, sf).select("pair_key", "priority", "embedding_cosine"), reviews(spark, sf)), "embedding_cosine")


def q_order_candidates(spark, sf):
    return rounded(rv.order_candidates(candidates(spark, sf)).select("pair_key", "priority", "embedding_cosine", "phash_distance", "dhash_distance"), "embedding_cosine")


def pending_table(spark, sf):
    carried = rv.carry_forward_reviews(candidates(spark, sf), reviews(spark, sf))
    return carried.withColumn("review_decision", F.when(F.col("phash_distance") >= 2, "pending").otherwise(F.col("review_decision")))


def q_review_batch(spark, sf):
    return rounded(rv.review_batch(pending_table(spark, sf), 10, 2).select("pair_key", "priority", "embedding_cosine"), "embedding_cosine")


def comparison_pairs(spark, sf):
    """The 15 closest pairs of each two splits; ids of train_val are dealt to three of them."""
    dealt = F.when(F.col("part") == "test", "test").when(F.col("vec_id") % 10 < 8, "train").when(F.col("vec_id") % 10 == 8, "val").otherwise("calibration")
    return near.compare_splits(hashed(spark, sf).withColumn("split", dealt), "split", "sample_id", phash(), 15)


def q_head_per_group(spark, sf):
    return rw.head_per_group(comparison_pairs(spark, sf), ["comparison"], ["distance", "id_a", "id_b"], 5).select("comparison", "id_a", "id_b", "distance")


def q_distance_summary(spark, sf):
    return near.distance_summary(comparison_pairs(spark, sf))


def label_chain(spark, sf):
    """Neighbouring ids with the same label, and planted copies, as edges."""
    ids = fx.table(spark, sf, "embeddings").select("vec_id", "label")
    following = ids.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("_next"))
    chain = ids.join(following, "vec_id").filter(F.col("label") == F.col("_next"))
    far = ids.filter(F.col("vec_id") % 9 == 0).select(F.col("vec_id").alias("u"), (F.floor(F.col("vec_id") / 2)).alias("v"))
    return ids, chain.select(F.col("vec_id").alias("u"), (F.col("vec_id") + 1).alias("v")).unionByName(far)


def q_components(spark, sf):
    vertices, edges = label_chain(spark, sf)
    return gr.connected_components(vertices.select("vec_id"), edges, "vec_id", "u", "v")


def scenes(spark, sf):
    return gr.scene_groups(hashed(spark, sf), reviews(spark, sf))


def q_scene_groups(spark, sf):
    return scenes(spark, sf)


SHA = """h5 AS (SELECT *, md5(CAST(CASE WHEN part='test' AND ((vec_id%1000000)//10)%6=0 THEN vec_id%1000000 ELSE vec_id END AS VARCHAR)) AS sha FROM hashed)"""
BASE = [PX, HASHED, SHA]
DIST = "bit_count(xor(a.hi,b.hi)) + bit_count(xor(a.lo,b.lo))"
DDIST = "bit_count(xor(a.dhi,b.dhi)) + bit_count(xor(a.dlo,b.dlo))"
# representatives of equal hashes with their sizes; stars inside a group
REPS = "reps AS (SELECT hi, lo, min(sample_id) sample_id, count(*) n FROM h5 GROUP BY hi, lo)"
PAIRS = f"""pairs AS (SELECT a.sample_id id_a, b.sample_id id_b, CAST({DIST} AS BIGINT) AS distance, a.n*b.n AS pairs FROM reps a JOIN reps b ON a.sample_id < b.sample_id AND {DIST} <= {{d}}
  UNION ALL SELECT r.sample_id, m.sample_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM reps r JOIN h5 m ON m.hi=r.hi AND m.lo=r.lo AND m.sample_id > r.sample_id)"""


def near_units(name, hi, lo, distance):
    """Every pair of units by a nested loop, then one pair for two sets of equal hash and partition."""
    return [
        f"{name}_u AS (SELECT *, min(sample_id) OVER (PARTITION BY {hi}, {lo}, part) AS first_id, {hi}||':'||{lo}||':'||part AS node FROM h5)",
        f"{name}_p AS (SELECT a.sample_id id_a, b.sample_id id_b, least(a.node, b.node) k1, greatest(a.node, b.node) k2, b.sha sha_b, a.first_id FROM {name}_u a JOIN {name}_u b ON a.sample_id < b.sample_id AND a.sha <> b.sha AND {distance} <= 4)",
        f"{name} AS (SELECT id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY id_a, id_b) rn FROM {name}_p WHERE k1 <> k2) WHERE rn = 1 UNION SELECT id_a, min(id_b) FROM {name}_p WHERE k1 = k2 AND id_a = first_id GROUP BY k1, id_a, sha_b)",
    ]


VEC = """vec AS (SELECT 'v'||lpad(CAST(vec_id AS VARCHAR),8,'0') AS sample_id, list(v ORDER BY pos) e FROM (
  SELECT vec_id, pos, v FROM px UNION ALL SELECT vec_id+1000000, pos, CASE WHEN pos=1 THEN 0e0 ELSE v END FROM px WHERE vec_id%10=0) GROUP BY vec_id)"""
COS = "list_cosine_similarity(a.e, b.e)"
KNN = f"""nn AS (SELECT unit, neighbour, cosine FROM (SELECT a.sample_id unit, b.sample_id neighbour, {COS} AS cosine,
  row_number() OVER (PARTITION BY a.sample_id ORDER BY {COS} DESC, b.sample_id) rn FROM vec a JOIN vec b ON a.sample_id<>b.sample_id) WHERE rn <= {{k}} AND cosine >= {{c}})"""
CAND = [
    *BASE, *near_units("pnear", "hi", "lo", DIST), *near_units("dnear", "dhi", "dlo", DDIST), VEC, KNN.format(k=6, c="0.995e0"),
    """u AS (SELECT id_a, id_b, 'perceptual_hash' s, CAST(NULL AS DOUBLE) c FROM pnear UNION ALL SELECT id_a, id_b, 'perceptual_hash', NULL FROM dnear
  UNION ALL SELECT least(unit, neighbour), greatest(unit, neighbour), 'embedding', cosine FROM nn)""",
    "mg AS (SELECT id_a, id_b, max(c) c, array_to_string(list_sort(list(DISTINCT s)), ';') src FROM u GROUP BY id_a, id_b)",
    f"""cand AS (SELECT CASE WHEN sw THEN yb ELSE ya END AS sample_id_a, CASE WHEN sw THEN pb ELSE pa END AS partition_a, CASE WHEN sw THEN ya ELSE yb END AS sample_id_b, CASE WHEN sw THEN pa ELSE pb END AS partition_b,
   phash_distance, dhash_distance, c AS embedding_cosine, src AS candidate_sources, CAST(CASE WHEN pa<>pb THEN 0 ELSE 1 END AS BIGINT) AS priority FROM (
   SELECT a.sample_id ya, b.sample_id yb, a.part pa, b.part pb, (a.part > b.part OR (a.part=b.part AND a.sample_id>b.sample_id)) sw, CAST({DIST} AS BIGINT) phash_distance, CAST({DDIST} AS BIGINT) dhash_distance, c, src
   FROM mg JOIN h5 a ON a.sample_id=id_a JOIN h5 b ON b.sample_id=id_b WHERE a.sha<>b.sha))""",
    "cands AS (SELECT sample_id_a||'__'||sample_id_b AS pair_key, * FROM cand)",
]
REVIEWS = f"""reviews AS (SELECT a.sample_id||'__'||b.sample_id AS pair_key, a.sample_id AS sample_id_a, b.sample_id AS sample_id_b, b.vec_id,
  CASE WHEN {DIST} <= 3 THEN 'same_scene' WHEN {DIST} = 4 THEN 'different_scene' ELSE 'pending' END AS review_decision,
  CASE WHEN {DIST} <= 4 AND b.vec_id%100<>0 THEN 'reviewer_a' END AS reviewer, CASE WHEN {DIST} <= 4 THEN '2026-01-01' END AS review_date,
  ' distance '||({DIST})||' ' AS notes FROM h5 a JOIN h5 b ON a.part='test' AND b.part='train_val' AND a.vec_id=b.vec_id+1000000)"""
CARRY = "cf AS (SELECT c.*, coalesce(trim(r.review_decision),'pending') review_decision, CASE WHEN r.pair_key IS NULL THEN '' ELSE coalesce(trim(r.reviewer),'') END reviewer, CASE WHEN r.pair_key IS NULL THEN '' ELSE coalesce(trim(r.review_date),'') END review_date, coalesce(trim(r.notes),'') notes FROM cands c LEFT JOIN reviews r USING (pair_key))"
CO = "priority, coalesce(embedding_cosine,-1) DESC, phash_distance, dhash_distance, pair_key"
SPLIT = "CASE WHEN part='test' THEN 'test' WHEN vec_id%10<8 THEN 'train' WHEN vec_id%10=8 THEN 'val' ELSE 'calibration' END"
COMP = f"""sp AS (SELECT *, {SPLIT} AS split FROM h5),
cmp AS (SELECT a.split||'_vs_'||b.split AS comparison, a.sample_id id_a, b.sample_id id_b, CAST({DIST} AS BIGINT) AS distance
  FROM sp a JOIN sp b ON (a.split, b.split) IN (('train','val'),('train','calibration'),('train','test'),('val','test')))"""
HEAD = "SELECT comparison, id_a, id_b, distance FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY distance, id_a, id_b) rn FROM cmp) WHERE rn <= {k}"


def closure(vertices, edges):
    return [
        f"e2 AS (SELECT u, v FROM ({edges}) UNION SELECT v, u FROM ({edges}))",
        f"reach AS (SELECT id, id AS r FROM ({vertices}) UNION SELECT e2.v, reach.r FROM reach JOIN e2 ON e2.u=reach.id)",
        "comp AS (SELECT id, min(r) component FROM reach GROUP BY id)",
    ]


CHAIN = "SELECT a.vec_id u, b.vec_id v FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1 AND a.label=b.label UNION ALL SELECT vec_id, vec_id//2 FROM embeddings WHERE vec_id%9=0"
SCENE = [
    *BASE, REVIEWS,
    *closure("SELECT sample_id id FROM h5", "SELECT a.sample_id u, b.sample_id v FROM h5 a JOIN h5 b ON a.sha=b.sha AND a.sample_id<b.sample_id UNION ALL SELECT sample_id_a, sample_id_b FROM reviews WHERE review_decision='same_scene'"),
    "scn AS (SELECT h5.sample_id, h5.sha, 'scene:'||component AS scene_group_id, CASE WHEN h5.sample_id IN (SELECT sample_id_a FROM reviews WHERE review_decision='same_scene' UNION SELECT sample_id_b FROM reviews WHERE review_decision='same_scene') THEN 'exact_sha_plus_reviewed_near_duplicate' ELSE 'exact_sha' END AS scene_group_source FROM h5 JOIN comp ON comp.id=h5.sample_id)",
]

ENTRIES = {
    "hamming_topk": (q_hamming_topk, with_(*BASE, f"SELECT a.sample_id id_a, b.sample_id id_b, CAST({DIST} AS BIGINT) AS distance FROM h5 a JOIN h5 b ON a.part='train_val' AND b.part='test' ORDER BY distance, id_a, id_b LIMIT {TOP}")),
    "hamming_pairs": (q_hamming_pairs, with_(*BASE, REPS, PAIRS.format(d=4), "SELECT id_a, id_b, distance, pairs FROM pairs")),
    "hamming_pairs_hot": (q_hamming_pairs_hot, with_(*BASE, REPS, PAIRS.format(d=4), "SELECT id_a, id_b, distance, pairs FROM pairs")),
    "knn_cosine": (q_knn_cosine, with_(*BASE, VEC, KNN.format(k=3, c="0.99e0"), f"SELECT unit, neighbour, {r6('cosine')} cosine FROM nn")),
    "near_dup_candidates": (q_candidates, with_(*CAND, f"SELECT pair_key, sample_id_a, partition_a, sample_id_b, partition_b, phash_distance, dhash_distance, {r6('embedding_cosine')} embedding_cosine, candidate_sources, priority FROM cands")),
    "connected_components": (q_components, with_(*closure("SELECT vec_id id FROM embeddings", CHAIN), "SELECT id AS vec_id, component FROM comp")),
    "scene_groups": (q_scene_groups, with_(*SCENE, "SELECT sample_id, sha, scene_group_id, scene_group_source FROM scn")),
    "scene_summary": (
        lambda spark, sf: rv.scene_summary(scenes(spark, sf), reviews(spark, sf)),
        with_(*SCENE, "SELECT (SELECT count(DISTINCT sha) FROM scn) exact_groups, (SELECT count(DISTINCT scene_group_id) FROM scn) scene_groups, count(*) candidates, count(*) FILTER (WHERE review_decision='pending') pending, count(*) FILTER (WHERE review_decision='same_scene') confirmed, CASE WHEN count(*) FILTER (WHERE review_decision='pending')>0 THEN 'pending_manual_near_duplicate_review' ELSE 'review_complete' END AS protocol_status FROM reviews"),
    ),
    "carry_forward_reviews": (q_carry_forward, with_(*CAND, REVIEWS, CARRY, f"SELECT pair_key, priority, {r6('embedding_cosine')} embedding_cosine, review_decision, reviewer, review_date, notes FROM cf")),
    "order_candidates": (q_order_candidates, with_(*CAND, f"SELECT pair_key, priority, {r6('embedding_cosine')} embedding_cosine, phash_distance, dhash_distance FROM cands ORDER BY priority, pair_key")),
    "review_batch": (
        q_review_batch,
        with_(*CAND, REVIEWS, CARRY, f"SELECT pair_key, priority, {r6('embedding_cosine')} embedding_cosine FROM (SELECT *, row_number() OVER (ORDER BY {CO}) rn FROM cf WHERE phash_distance >= 2 OR review_decision='pending') WHERE rn BETWEEN 11 AND 20"),
    ),
    "head_per_group": (q_head_per_group, with_(*BASE, COMP, HEAD.format(k=5))),
    "distance_summary": (
        q_distance_summary,
        with_(*BASE, COMP, f"SELECT comparison, min(distance) min_distance, median(distance) median_distance, max(distance) max_distance, count(*) n FROM ({HEAD.format(k=15)}) GROUP BY comparison"),
    ),
    "validate_reviews": (
        lambda spark, sf: pr.review_violations(reviews(spark, sf)),
        with_(*BASE, REVIEWS, "SELECT count(*) reviews, count(*) FILTER (WHERE review_decision NOT IN ('pending','same_scene','different_scene')) invalid_decisions, count(*) FILTER (WHERE review_decision IN ('same_scene','different_scene') AND (coalesce(trim(reviewer),'')='' OR coalesce(trim(review_date),'')='')) unsigned_decisions FROM reviews"),
    ),
}
