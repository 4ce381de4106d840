"""Split and protocol queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.manifests import EXCL, SPLIT, exclusion_rows, parts, with_row_split
from plumbline.catalog.views import GRID, GRID_IGNORE, MANIFEST, PX, r6, with_
from plumbline.functions.numerics import shuffle_key
from plumbline.operators import exact as ex
from plumbline.operators import protocol as pr
from plumbline.operators import splits as sp
from plumbline.plans import fixtures as fx
from plumbline.sources import manifests as mf

SEED = 20260721
SHARES = {"train": 0.8, "val": 0.1, "calibration": 0.1}
SEEDS = 300


def q_append_exclusions(spark, sf):
    dev, test = parts(spark, sf)
    return sp.append_exclusions(exclusion_rows(spark, sf), sp.in_groups(dev, test, "mask_sha"))


def q_split_overlap(spark, sf):
    m = fx.manifest(spark, sf)
    other = m.withColumn("split", F.when(F.substring(shuffle_key(12, "sample_id"), 1, 1) < "c", "train").otherwise("val"))
    both = with_row_split(m).select("sample_id", "split").unionByName(other.select("sample_id", "split"))
    return pr.split_overlap(both, "sample_id")


def q_hash_leakage(spark, sf):
    dev, test = parts(spark, sf)
    return ex.hash_leakage(dev, test, "sha")


def q_coverage_check(spark, sf):
    return pr.coverage_check(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id")


def q_fixed_count_split(spark, sf):
    dev, _ = parts(spark, sf)
    return sp.fixed_count_split(dev.select("sample_id"), "sample_id", SHARES, SEED)


def retained(spark, sf):
    dev, _ = parts(spark, sf)
    return sp.exclude_ids(dev, exclusion_rows(spark, sf))


def q_grouped_split(spark, sf):
    return sp.grouped_split(retained(spark, sf).select("sample_id", "sha"), "sha", SEED)


def q_group_isolation(spark, sf):
    return pr.group_isolation(with_row_split(fx.manifest(spark, sf)), "sha").select("sha")


def q_allowed_splits(spark, sf):
    return pr.split_policy(with_row_split(fx.manifest(spark, sf)), ["val", "calibration"])


def scene_pixels(spark, sf):
    return fx.grid(spark, sf).withColumn("scene", F.concat(F.lit("g"), F.floor(F.col("sample_id") / 5)))


def q_split_balance(spark, sf):
    groups = sp.group_histograms(scene_pixels(spark, sf), "scene", "sample_id", 8)
    scores = sp.split_balance(sp.candidate_splits(groups, "scene", SEED, SEEDS), ["seed"], 8)
    return rounded(scores.withColumn("seed", F.col("seed").cast("bigint")), "score")


def q_select_balanced(spark, sf):
    groups = sp.group_histograms(scene_pixels(spark, sf), "scene", "sample_id", 8)
    best = sp.select_balanced_split(groups, "scene", SEED, SEEDS, 8)
    return rounded(best.withColumn("seed", F.col("seed").cast("bigint")), "score")


def grid_splits(spark, sf):
    """V3 samples joined to the retained documents' split by position."""
    return fx.grid(spark, sf, ignore=True).withColumn("split", F.when(F.col("sample_id") % 10 < 8, "train").when(F.col("sample_id") % 10 == 8, "val").otherwise("calibration"))


def q_class_coverage(spark, sf):
    scenes = scene_pixels(spark, sf).select(F.col("scene").alias("split"), "label")
    return pr.class_coverage(scenes, "split", 8)


def q_validate_protocol(spark, sf):
    _, test = parts(spark, sf)
    kept = sp.grouped_split(retained(spark, sf).select("sample_id", "sha"), "sha", SEED)
    splits = kept.unionByName(test.select("sample_id", "sha", F.lit("test").alias("split")))
    splits = splits.withColumn("scene", F.concat(F.lit("scene:"), F.substring("sha", 1, 3)))
    # stored before the test rows ending in 5 were added: both comparisons have to fire
    expected = mf.table_fingerprint(splits.filter(~((F.col("split") == "test") & F.col("sample_id").like("%5"))), ["split"], ["sample_id", "sha"])
    reviews = fx.table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "pending").otherwise("same_scene").alias("review_decision"))
    return pr.validate_protocol(splits, exclusion_rows(spark, sf), reviews, grid_splits(spark, sf), expected, 8, ["sample_id", "sha"])


def grouped_cte(key, src, out, seed="20260721"):
    return f"""{out}_r AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:'||{key})) r, count(*) OVER () n FROM (SELECT DISTINCT {key} FROM {src})),
{out}_h AS (SELECT {key}, row_number() OVER (ORDER BY md5('{int(seed)+1}:'||{key})) r, count(*) OVER () n FROM {out}_r WHERE r > floor(n*0.8e0)),
{out} AS (SELECT {key}, 'train' AS split FROM {out}_r WHERE r <= floor(n*0.8e0) UNION ALL SELECT {key}, CASE WHEN r <= n//2 THEN 'val' ELSE 'calibration' END FROM {out}_h)"""


RETAINED = "kept AS (SELECT * FROM dev WHERE sample_id NOT IN (SELECT sample_id FROM exclusions))"
GSPLIT = grouped_cte("sha", "kept", "gs")
SCENES = [PX, GRID, "scn AS (SELECT *, 'g'||(sample_id//5) AS scene FROM grid)"]


def balance_ctes(seeds):
    hist = ", ".join(f"sum(c{k}) g{k}" for k in range(8))
    cells = ", ".join(f"count(*) FILTER (WHERE label={k}) c{k}" for k in range(8))
    tot = "+".join(f"g{k}" for k in range(8))
    tt = "+".join(f"t{k}" for k in range(8))
    gap = "+".join(f"abs(g{k}::DOUBLE/({tot}) - t{k}::DOUBLE/({tt}))" for k in range(8))
    return [
        f"gh AS (SELECT scene, count(DISTINCT sample_id) n, {cells} FROM scn GROUP BY scene)",
        f"cand AS (SELECT gh.*, {SEED}+s.k AS seed FROM gh CROSS JOIN range({seeds}) s(k))",
        "c1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed||':'||scene)) r, count(*) OVER (PARTITION BY seed) gn FROM cand)",
        "c2 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5((seed+1)||':'||scene)) r2, count(*) OVER (PARTITION BY seed) hn FROM c1 WHERE r > floor(gn*0.8e0))",
        "c3 AS (SELECT seed, 'train' split, n, c0,c1,c2,c3,c4,c5,c6,c7 FROM c1 WHERE r <= floor(gn*0.8e0) UNION ALL SELECT seed, CASE WHEN r2 <= hn//2 THEN 'val' ELSE 'calibration' END, n, c0,c1,c2,c3,c4,c5,c6,c7 FROM c2)",
        f"c4 AS (SELECT seed, split, sum(n) n, {hist} FROM c3 GROUP BY seed, split)",
        "c5 AS (SELECT *, " + ", ".join(f"sum(g{k}) OVER (PARTITION BY seed) t{k}" for k in range(8)) + ", sum(n) OVER (PARTITION BY seed) nn FROM c4)",
        f"c6 AS (SELECT seed, sum(3e0*abs(n::DOUBLE/nn - CASE WHEN split='train' THEN 0.8e0 ELSE 0.1e0 END) + ({gap})/8e0) AS score FROM c5 GROUP BY seed)",
    ]


GS_SPLIT = "gsp AS (SELECT *, CASE WHEN sample_id%10<8 THEN 'train' WHEN sample_id%10=8 THEN 'val' ELSE 'calibration' END AS split FROM gridi)"
COVER = "SELECT s.split, CAST(k AS INT) AS class_id FROM (SELECT DISTINCT split FROM gsp WHERE label<>255) s CROSS JOIN range(8) t(k) WHERE NOT EXISTS (SELECT 1 FROM gsp WHERE gsp.split=s.split AND label=k)"
PROTOCOL = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", {count} AS violations"
    for name, count in [
        ("ids_crosses_splits", "(SELECT count(*) FROM (SELECT sample_id FROM sp WHERE split<>'test' GROUP BY sample_id HAVING count(DISTINCT split)>1))"),
        ("ids_leaks_to_test", "(SELECT count(*) FROM (SELECT sample_id FROM sp WHERE split<>'test' INTERSECT SELECT sample_id FROM sp WHERE split='test'))"),
        ("row_count_differs", "CAST((SELECT count(*) > 0 FROM sp WHERE split='test' AND CAST(sample_id AS VARCHAR) LIKE '%5') AS BIGINT)"),
        ("fingerprint_differs", "CAST((SELECT count(*) > 0 FROM sp WHERE split='test' AND CAST(sample_id AS VARCHAR) LIKE '%5') AS BIGINT)"),
        ("scene_crosses_splits", "(SELECT count(*) FROM (SELECT scene FROM sp WHERE split<>'test' GROUP BY scene HAVING count(DISTINCT split)>1))"),
        ("hash_crosses_splits", "(SELECT count(*) FROM (SELECT sha FROM sp WHERE split<>'test' GROUP BY sha HAVING count(DISTINCT split)>1))"),
        ("hash_leaks_to_test", "(SELECT count(*) FROM (SELECT sha FROM sp WHERE split<>'test' INTERSECT SELECT sha FROM sp WHERE split='test'))"),
        ("scene_leaks_to_test", "(SELECT count(*) FROM (SELECT scene FROM sp WHERE split<>'test' INTERSECT SELECT scene FROM sp WHERE split='test'))"),
        ("excluded_sample_present", "(SELECT count(*) FROM sp WHERE split<>'test' AND sample_id IN (SELECT sample_id FROM exclusions))"),
        ("review_pending", "(SELECT count(*) FROM labels WHERE toxic=1)"),
        ("invalid_label", "(SELECT count(*) FROM gsp WHERE label NOT BETWEEN 0 AND 7)"),
        ("class_missing", f"(SELECT count(*) FROM ({COVER}))"),
    ]
)

ENTRIES = {
    "append_exclusions": (
        q_append_exclusions,
        with_(*EXCL, "SELECT sample_id, part, sha, reason FROM exclusions UNION ALL SELECT sample_id, part, '', 'reviewed_near_duplicate_scene_of_official_test' FROM dev WHERE mask_sha IN (SELECT mask_sha FROM manifest WHERE part='test') AND sample_id NOT IN (SELECT sample_id FROM exclusions)"),
    ),
    "split_overlap": (
        q_split_overlap,
        with_(MANIFEST, SPLIT, "u AS (SELECT sample_id, split FROM spl UNION ALL SELECT sample_id, CASE WHEN substr(md5('12:'||sample_id),1,1) < 'c' THEN 'train' ELSE 'val' END FROM manifest)", "SELECT sample_id, min(split) first_split, max(split) last_split FROM u GROUP BY sample_id HAVING count(DISTINCT split)>1"),
    ),
    "hash_leakage": (q_hash_leakage, with_(MANIFEST, "SELECT sha FROM manifest WHERE part='train_val' INTERSECT SELECT sha FROM manifest WHERE part='test'")),
    "coverage_check": (q_coverage_check, "SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'foreign' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "fixed_count_split": (
        q_fixed_count_split,
        with_(MANIFEST, f"r AS (SELECT sample_id, row_number() OVER (ORDER BY md5('{SEED}:'||sample_id)) r, count(*) OVER () n FROM manifest WHERE part='train_val')", "SELECT sample_id, CASE WHEN r <= floor(n*0.8e0) THEN 'train' WHEN r <= floor(n*0.8e0)+floor(n*0.1e0) THEN 'val' ELSE 'calibration' END AS split FROM r"),
    ),
    "grouped_split": (q_grouped_split, with_(*EXCL, RETAINED, GSPLIT, "SELECT sample_id, sha, split FROM kept JOIN gs USING (sha)")),
    "group_isolation": (q_group_isolation, with_(MANIFEST, SPLIT, "SELECT sha FROM spl GROUP BY sha HAVING count(DISTINCT split)>1")),
    "allowed_splits": (q_allowed_splits, with_(MANIFEST, SPLIT, "SELECT split, count(*) n, split IN ('val','calibration') AS allowed FROM spl GROUP BY split")),
    "split_balance_score": (q_split_balance, with_(*SCENES, *balance_ctes(SEEDS), f"SELECT CAST(seed AS BIGINT) seed, {r6('score')} score FROM c6")),
    "select_balanced_split": (q_select_balanced, with_(*SCENES, *balance_ctes(SEEDS), f"SELECT CAST(seed AS BIGINT) seed, {r6('s')} score FROM (SELECT seed, round(score, 12) s FROM c6 ORDER BY s, seed LIMIT 1)")),
    "class_coverage": (q_class_coverage, with_(*SCENES, "SELECT s.scene AS split, CAST(k AS INT) AS class_id FROM (SELECT DISTINCT scene FROM scn) s CROSS JOIN range(8) t(k) ANTI JOIN (SELECT DISTINCT scene, label FROM scn) p ON p.scene=s.scene AND p.label=k")),
    "validate_protocol": (
        q_validate_protocol,
        with_(*EXCL, PX, GRID, GRID_IGNORE, GS_SPLIT, RETAINED, GSPLIT, "sp AS (SELECT *, 'scene:'||substr(sha,1,3) AS scene FROM (SELECT sample_id, sha, split FROM kept JOIN gs USING (sha) UNION ALL SELECT sample_id, sha, 'test' FROM manifest WHERE part='test'))", PROTOCOL),
    ),
}
