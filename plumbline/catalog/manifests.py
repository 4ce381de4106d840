"""Manifest and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.views import MANIFEST, r6, with_
from plumbline.functions.numerics import shuffle_key
from plumbline.operators import exact as ex
from plumbline.operators import protocol as pr
from plumbline.operators import quality as ql
from plumbline.operators import rows as rw
from plumbline.operators import splits as sp
from plumbline.plans import fixtures as fx
from plumbline.sources import manifests as mf

COMPARISONS = [("train", "val"), ("train", "calibration"), ("train", "test"), ("val", "test")]


def with_row_split(manifest):
    """A row-level split by one md5 digit, blind to duplicates on purpose."""
    digit = F.substring(shuffle_key(11, "sample_id"), 1, 1)
    dev = F.when(digit < "c", "train").when(digit < "e", "val").otherwise("calibration")
    return manifest.withColumn("split", F.when(F.col("part") == "test", "test").otherwise(dev))


SPLIT = """spl AS (SELECT *, CASE WHEN part='test' THEN 'test' WHEN substr(md5('11:'||sample_id),1,1) < 'c' THEN 'train'
  WHEN substr(md5('11:'||sample_id),1,1) < 'e' THEN 'val' ELSE 'calibration' END AS split FROM manifest)"""


def parts(spark, sf):
    m = fx.manifest(spark, sf)
    return m.filter(F.col("part") == "train_val"), m.filter(F.col("part") == "test")


def q_manifest_scan(spark, sf):
    return mf.check_manifest(fx.manifest(spark, sf), ("sample_id", "sha", "mask_sha")).select("sample_id", "part", "sha", "mask_sha", "width", "height")


def q_pair_sources(spark, sf):
    return mf.pair_sources(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id")


def q_content_hash(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", mf.content_hash("text").alias("sha256"), mf.content_hash("text", upper=True).alias("provenance"))


def q_split_fingerprint(spark, sf):
    return mf.table_fingerprint(with_row_split(fx.manifest(spark, sf)), ["split"], ["sample_id", "sha", "mask_sha", "width"])


def q_quality_columns(spark, sf):
    out = ql.quality_columns(fx.manifest(spark, sf))
    return rounded(out.select("sample_id", "total_pixels", "quantized_pixels", "quantized_ratio", "size_repaired", "repair_method"), "quantized_ratio")


def q_clean_text(spark, sf):
    docs = fx.table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    return docs.select("doc_id", mf.clean_text(raw).alias("source"), mf.clean_text("text").alias("text"))


def q_exact_matches(spark, sf):
    dev, test = parts(spark, sf)
    return ex.exact_matches(dev, test, "sha", "sample_id")


def q_cross_split_exact(spark, sf):
    return ex.cross_split_groups(with_row_split(fx.manifest(spark, sf)), "sha", "sample_id", "split", COMPARISONS)


def q_dup_pairs_within(spark, sf):
    out = ex.duplicate_stars(fx.manifest(spark, sf), "sha", "sample_id")
    return out.withColumn("group_pairs", F.col("group_pairs").cast("bigint"))


def q_attach_split(spark, sf):
    m = fx.manifest(spark, sf)
    known = with_row_split(m).filter(F.col("split") != "calibration").select("sample_id", "split")
    return sp.attach_split(m.select("sample_id", "part"), known)


def q_join_one_to_one(spark, sf):
    m = fx.manifest(spark, sf)
    scenes = m.select("sample_id", F.concat(F.lit("scene:"), "sha").alias("scene"))
    return pr.join_one_to_one(m.select("sample_id", "part"), scenes, ["sample_id"])


def exclusion_rows(spark, sf):
    dev, test = parts(spark, sf)
    return sp.exclusions(dev, test)


def q_exclude_anti(spark, sf):
    dev, _ = parts(spark, sf)
    return sp.exclude_ids(dev, exclusion_rows(spark, sf)).select("sample_id", "sha")


def q_test_neighbours(spark, sf):
    dev, test = parts(spark, sf)
    return sp.in_groups(dev, test, "sha").select("sample_id", "sha")


def quality_split(spark, sf):
    return ql.quality_columns(with_row_split(fx.manifest(spark, sf)))


def q_quality_summary(spark, sf):
    return rounded(ql.quality_summary(quality_split(spark, sf)), "overall_quantized_ratio", "mean_quantized_ratio", "max_quantized_ratio", "median_quantized_ratio", "p95_quantized_ratio")


def q_duplicate_consistency(spark, sf):
    out = ex.duplicate_consistency(with_row_split(fx.manifest(spark, sf)), "sha", "part", "split", "mask_sha")
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


def q_top_quantized(spark, sf):
    return rounded(ql.top_quantized(quality_split(spark, sf)).select("sample_id", "part", "split", "quantized_ratio"), "quantized_ratio")


def q_random_sample(spark, sf):
    return rw.random_sample(fx.manifest(spark, sf), "sample_id", 50, 3).select("sample_id", "part")


def q_manual_review_rules(spark, sf):
    quality = quality_split(spark, sf)
    return ql.manual_review_rules(quality, quality.filter("size_repaired"), "manual_review", "2026-01-01")


EXCL = [
    MANIFEST,
    "dev AS (SELECT * FROM manifest WHERE part='train_val')",
    "tst AS (SELECT DISTINCT sha FROM manifest WHERE part='test')",
    "conf AS (SELECT sha FROM dev GROUP BY sha HAVING count(DISTINCT mask_sha) > 1)",
    """excl AS (SELECT sample_id, part, sha, concat_ws(';', CASE WHEN sha IN (SELECT sha FROM tst) THEN 'exact_duplicate_of_official_test' END,
  CASE WHEN mask_resized_nearest<>0 THEN 'unresolved_mask_size_repair' END,
  CASE WHEN sha IN (SELECT sha FROM conf) THEN 'conflicting_labels_for_exact_duplicate_image' END) AS reason FROM dev)""",
    "exclusions AS (SELECT * FROM excl WHERE reason <> '')",
]
QUALITY = "quality AS (SELECT *, original_mask_width*original_mask_height AS total_pixels, non_exact AS quantized_pixels, non_exact::DOUBLE/nullif(original_mask_width*original_mask_height,0) AS quantized_ratio, mask_resized_nearest<>0 AS size_repaired FROM spl)"
QPATH = [MANIFEST, SPLIT, QUALITY]
DIGEST = "CAST('0x' || substr(md5(sample_id||'|'||sha||'|'||mask_sha||'|'||width),1,15) AS BIGINT)"
CROSS = " UNION ALL ".join(
    f"SELECT '{a}_vs_{b}' AS comparison, sha, count(*) FILTER (WHERE split='{a}') n_a, count(*) FILTER (WHERE split='{b}') n_b, min(sample_id) FILTER (WHERE split='{a}') first_a, min(sample_id) FILTER (WHERE split='{b}') first_b FROM spl GROUP BY sha"
    for a, b in COMPARISONS
)

ENTRIES = {
    "manifest_scan": (q_manifest_scan, with_(MANIFEST, "SELECT sample_id, part, sha, mask_sha, width, height FROM manifest")),
    "pair_sources": (q_pair_sources, "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM documents d FULL JOIN labels l ON d.doc_id=l.doc_id"),
    "content_hash": (q_content_hash, "SELECT doc_id, sha256(text) AS sha256, upper(sha256(text)) AS provenance FROM documents"),
    "split_fingerprint": (q_split_fingerprint, with_(MANIFEST, SPLIT, f"SELECT split, count(*) AS rows, bit_xor({DIGEST}) AS digest, CAST(sum({DIGEST} % 1000000007) AS BIGINT) AS folded_sum FROM spl GROUP BY split")),
    "quality_columns": (q_quality_columns, with_(*QPATH, f"SELECT sample_id, total_pixels, quantized_pixels, {r6('quantized_ratio')} quantized_ratio, size_repaired, CASE WHEN size_repaired THEN 'class_index_nearest_resize' ELSE 'none' END repair_method FROM quality")),
    "clean_text": (q_clean_text, "SELECT doc_id, coalesce(trim(CASE WHEN doc_id%5<>0 THEN '  '||source||' ' END),'') AS source, coalesce(trim(text),'') AS text FROM documents"),
    "exact_matches": (
        q_exact_matches,
        with_(
            MANIFEST,
            "p AS (SELECT a.sha, a.sample_id id_a, b.sample_id id_b, min(a.sample_id) OVER (PARTITION BY a.sha) fa, min(b.sample_id) OVER (PARTITION BY a.sha) fb, count(*) OVER (PARTITION BY a.sha) group_pairs FROM manifest a JOIN manifest b ON a.sha=b.sha WHERE a.part='train_val' AND b.part='test')",
            "SELECT sha, id_a, id_b, group_pairs FROM p WHERE id_a=fa OR id_b=fb",
        ),
    ),
    "cross_split_exact": (q_cross_split_exact, with_(MANIFEST, SPLIT, f"SELECT comparison, sha, n_a, n_b, first_a, first_b, n_a*n_b AS pairs FROM ({CROSS}) WHERE n_a>0 AND n_b>0")),
    "dup_pairs_within": (
        q_dup_pairs_within,
        with_(MANIFEST, "g AS (SELECT sha, min(sample_id) first_id, count(*) group_size FROM manifest GROUP BY sha HAVING count(*)>1)", "SELECT g.sha, first_id, m.sample_id AS second_id, group_size, group_size*(group_size-1)//2 AS group_pairs FROM g JOIN manifest m ON m.sha=g.sha AND m.sample_id>first_id"),
    ),
    "attach_split": (q_attach_split, with_(MANIFEST, SPLIT, "SELECT sample_id, part, CASE WHEN split='calibration' THEN 'not_assigned' ELSE split END AS split FROM spl")),
    "join_one_to_one": (q_join_one_to_one, with_(MANIFEST, "SELECT sample_id, part, 'scene:'||sha AS scene FROM manifest")),
    "exclude_anti": (q_exclude_anti, with_(*EXCL, "SELECT sample_id, sha FROM dev WHERE sample_id NOT IN (SELECT sample_id FROM exclusions)")),
    "test_neighbours_semi": (q_test_neighbours, with_(*EXCL, "SELECT sample_id, sha FROM dev WHERE sha IN (SELECT sha FROM tst)")),
    "quality_summary": (
        q_quality_summary,
        with_(
            *QPATH,
            f"SELECT count(*) samples, CAST(sum(quantized_pixels) AS BIGINT) quantized_pixels, CAST(sum(total_pixels) AS BIGINT) total_pixels, {r6('sum(quantized_pixels)::DOUBLE/sum(total_pixels)')} overall_quantized_ratio, {r6('avg(quantized_ratio)')} mean_quantized_ratio, {r6('max(quantized_ratio)')} max_quantized_ratio, count(*) FILTER (WHERE size_repaired) size_repaired_samples, {r6('quantile_cont(quantized_ratio, 0.5)')} median_quantized_ratio, {r6('quantile_cont(quantized_ratio, 0.95)')} p95_quantized_ratio FROM quality",
        ),
    ),
    "repaired_by_split": (lambda spark, sf: ql.repaired_by_split(quality_split(spark, sf)), with_(*QPATH, "SELECT split, count(*) n FROM quality WHERE size_repaired GROUP BY split")),
    "duplicate_consistency": (
        q_duplicate_consistency,
        with_(
            MANIFEST, SPLIT,
            "p AS (SELECT a.part<>b.part AS cp, a.split<>b.split AS cs, a.mask_sha=b.mask_sha AS same FROM spl a JOIN spl b ON a.sha=b.sha AND a.sample_id<b.sample_id)",
            "SELECT count(*) duplicate_pairs, count(*) FILTER (WHERE cp) cross_partition_pairs, count(*) FILTER (WHERE cp AND same) cross_partition_identical, count(*) FILTER (WHERE cp AND NOT same) cross_partition_different, count(*) FILTER (WHERE cs) cross_split_pairs, count(*) FILTER (WHERE cs AND same) cross_split_identical, count(*) FILTER (WHERE cs AND NOT same) cross_split_different FROM p",
        ),
    ),
    "exclusion_summary": (lambda spark, sf: ql.value_counts(exclusion_rows(spark, sf), "reason"), with_(*EXCL, "SELECT reason, count(*) n FROM exclusions GROUP BY reason")),
    "conflicting_groups": (lambda spark, sf: ql.conflicting_groups(fx.manifest(spark, sf), "sha", "mask_sha"), with_(MANIFEST, "SELECT sha FROM manifest GROUP BY sha HAVING count(DISTINCT mask_sha)>1")),
    "top_quantized": (q_top_quantized, with_(*QPATH, f"SELECT sample_id, part, split, {r6('quantized_ratio')} quantized_ratio FROM (SELECT * FROM quality ORDER BY quality.quantized_ratio DESC NULLS LAST, sample_id LIMIT 20) q")),
    "random_sample": (q_random_sample, with_(MANIFEST, "SELECT sample_id, part FROM (SELECT * FROM manifest ORDER BY md5('3:'||sample_id) LIMIT 50)")),
    "manual_review_rules": (
        q_manual_review_rules,
        with_(
            *QPATH,
            "SELECT sample_id, 'quantization' AS review, CASE WHEN size_repaired THEN 'exclude' ELSE 'include' END AS decision, CASE WHEN size_repaired THEN 'excluded with the unresolved size repair' ELSE 'regions kept and aligned' END AS notes, 'manual_review' AS reviewer, '2026-01-01' AS review_date FROM (SELECT * FROM quality ORDER BY quantized_ratio DESC NULLS LAST, sample_id LIMIT 20) UNION ALL SELECT sample_id, 'size_repair', 'exclude', 'no reliable alignment repair', 'manual_review', '2026-01-01' FROM quality WHERE size_repaired",
        ),
    ),
    "exclusions": (exclusion_rows, with_(*EXCL, "SELECT sample_id, part, sha, reason FROM exclusions")),
}
