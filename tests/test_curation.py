import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import exact as ex
from plumbline.operators import protocol as pr
from plumbline.operators import quality as ql
from plumbline.operators import review as rv
from plumbline.operators import rows as rw
from plumbline.operators import splits as sp
from plumbline.sources import manifests as mf


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(120):
        sha = "hot" if i % 3 == 0 else f"h{int(rng.integers(0, 30))}"
        data.append((f"s{i:03d}", sha, str(rng.choice(["a", "b"])), str(rng.choice(["train_val", "test"])), f"m{int(rng.integers(0, 2))}", int(rng.integers(0, 2))))
    return data, spark.createDataFrame(data, "sample_id string, sha string, split string, part string, mask_sha string, mask_resized_nearest int")


def test_pair_statistics_without_pairs(rows):
    data, df = rows
    got = ex.duplicate_consistency(df, "sha", "part", "split", "mask_sha").first()
    pairs = [(a, b) for a, b in itertools.combinations(data, 2) if a[1] == b[1]]
    assert got.duplicate_pairs == len(pairs)
    assert got.cross_partition_identical == sum(a[3] != b[3] and a[4] == b[4] for a, b in pairs)
    assert got.cross_partition_different == sum(a[3] != b[3] and a[4] != b[4] for a, b in pairs)
    assert got.cross_split_identical == sum(a[2] != b[2] and a[4] == b[4] for a, b in pairs)


def test_stars_stay_linear_and_keep_the_pair_count(rows):
    data, df = rows
    stars = ex.duplicate_stars(df, "sha", "sample_id").collect()
    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append(r[0])
    assert len(stars) == sum(len(g) - 1 for g in groups.values())
    for s in stars:
        n = len(groups[s.sha])
        assert s.group_pairs == n * (n - 1) // 2 and s.first_id == min(groups[s.sha])


def test_exact_matches_cover_both_sides(rows):
    data, df = rows
    a, b = df.filter("split = 'a'"), df.filter("split = 'b'")
    got = ex.exact_matches(a, b, "sha", "sample_id").collect()
    left = {r[0] for r in data if r[2] == "a" and any(q[1] == r[1] and q[2] == "b" for q in data)}
    right = {r[0] for r in data if r[2] == "b" and any(q[1] == r[1] and q[2] == "a" for q in data)}
    assert {g.id_a for g in got} == left and {g.id_b for g in got} == right
    assert len(got) == len({(g.id_a, g.id_b) for g in got})
    everything = sum(a[1] == b[1] for a in data for b in data if a[2] == "a" and b[2] == "b")
    assert sum({g.sha: g.group_pairs for g in got}.values()) == everything


def test_fixed_counts(rows):
    _, df = rows
    out = sp.fixed_count_split(df, "sample_id", {"train": 100, "val": 15, "calibration": 5}, 1)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 100, "val": 15, "calibration": 5}
    again = sp.fixed_count_split(df.repartition(5), "sample_id", {"train": 100, "val": 15, "calibration": 5}, 1)
    assert out.select("sample_id", "split").exceptAll(again.select("sample_id", "split")).isEmpty()


def test_groups_stay_whole_and_counts_are_of_groups(rows):
    data, df = rows
    out = sp.grouped_split(df, "sha", 4)
    assert pr.group_isolation(out, "sha").isEmpty()
    groups = len({r[1] for r in data})
    per = {r.split: r.g for r in out.groupBy("split").agg(F.countDistinct("sha").alias("g")).collect()}
    assert per["train"] == int(groups * 0.8)
    assert per.get("val", 0) == (groups - per["train"]) // 2


def test_isolation_reports_the_crossing_group(spark):
    df = spark.createDataFrame([("g1", "train"), ("g1", "val"), ("g2", "val")], "g string, split string")
    assert [r.g for r in pr.group_isolation(df, "g").collect()] == ["g1"]


def test_exclusion_reasons_keep_their_order_and_switches(spark):
    dev = spark.createDataFrame(
        [("a", "train_val", "x", 1, "m1"), ("b", "train_val", "x", 0, "m2"), ("c", "train_val", "y", 1, "m1"), ("d", "train_val", "z", 0, "m1")],
        "sample_id string, part string, sha string, mask_resized_nearest int, mask_sha string",
    )
    test = dev.filter("sample_id = 'a'").withColumn("sample_id", F.lit("t"))
    got = {r.sample_id: r.reason for r in sp.exclusions(dev, test).collect()}
    assert got["a"] == "exact_duplicate_of_official_test;unresolved_mask_size_repair;conflicting_labels_for_exact_duplicate_image"
    assert got["c"] == "unresolved_mask_size_repair" and "d" not in got
    fewer = {r.sample_id: r.reason for r in sp.exclusions(dev, test, size_repair=False, conflicts=False).collect()}
    assert fewer == {"a": "exact_duplicate_of_official_test", "b": "exact_duplicate_of_official_test"}


def test_one_to_one_join_rejects_a_repeated_key(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="repeats"):
        pr.join_one_to_one(a, b, ["k"]).collect()
    assert pr.join_one_to_one(a.filter("v = 'x'"), b, ["k"]).count() == 1


def test_locked_split_fails_when_read(spark):
    df = spark.createDataFrame([("val",), ("test",)], "split string")
    assert pr.assert_allowed_splits(df.filter("split = 'val'"), ["val"]).count() == 1
    with pytest.raises(Exception, match="locked"):
        pr.assert_allowed_splits(df, ["val"]).collect()


def test_review_rules(spark):
    schema = "review_decision string, reviewer string, review_date string"
    pr.validate_reviews(spark.createDataFrame([("pending", None, None), ("same_scene", "r", "2026-01-01")], schema))
    for bad in [("maybe", "r", "d"), ("same_scene", " ", "2026-01-01"), ("different_scene", "r", None)]:
        with pytest.raises(ValueError):
            pr.validate_reviews(spark.createDataFrame([bad], schema))


def test_protocol_finds_each_violation(spark):
    splits = spark.createDataFrame(
        [("a", "train", "h1", "g1"), ("b", "val", "h1", "g1"), ("c", "calibration", "h2", "g2"), ("d", "test", "h2", "g3")],
        "sample_id string, split string, sha string, scene string",
    )
    pixels = spark.createDataFrame([("train", 0), ("train", 9), ("val", 1)], "split string, label int")
    expected = mf.table_fingerprint(splits.filter("split <> 'val'"), ["split"], ["sample_id"])
    reviews = spark.createDataFrame([("pending",)], "review_decision string")
    report = pr.validate_protocol(splits, splits.filter("sample_id = 'a'"), reviews, pixels, expected, 2, ["sample_id"])
    got = {r.check: r.violations for r in report.collect()}
    assert got == {
        "ids_crosses_splits": 0,
        "ids_leaks_to_test": 0,
        "hash_crosses_splits": 1,
        "hash_leaks_to_test": 1,
        "scene_crosses_splits": 1,
        "scene_leaks_to_test": 0,
        "row_count_differs": 1,
        "fingerprint_differs": 1,
        "excluded_sample_present": 1,
        "review_pending": 1,
        "invalid_label": 1,
        "class_missing": 2,
    }
    with pytest.raises(ValueError, match="hash_leaks"):
        pr.require_clean(report)


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([("k", i, f"v{i}") for i in range(50)], "k string, i int, v string")
    a = mf.table_fingerprint(df, ["k"], ["i", "v"]).first()
    assert a == mf.table_fingerprint(df.repartition(7).orderBy(F.desc("i")), ["k"], ["i", "v"]).first()
    changed = df.withColumn("v", F.when(F.col("i") == 3, "other").otherwise(F.col("v")))
    assert a != mf.table_fingerprint(changed, ["k"], ["i", "v"]).first()
    assert a != mf.table_fingerprint(df.unionByName(df.filter("i < 2")), ["k"], ["i", "v"]).first()


def test_manifest_reader(spark, tmp_path):
    header = "partition,sample_id,image_path,mask_path,width,height,original_mask_width,original_mask_height,mask_resized_nearest,classes_present,mask_policy,non_exact_rgb_pixels"
    good = tmp_path / "m.csv"
    good.write_text(header + "\ntrain_val,a,i/a,m/a,4,3,4,3,0,0|4,x,0\ntest,b,i/b,m/b,4,3,4,3,1,2,x,5\n")
    rows = mf.read_manifest(spark, str(good)).collect()
    assert {r.sample_id: r.width for r in rows} == {"a": 4, "b": 4}
    repeated = tmp_path / "r.csv"
    repeated.write_text(good.read_text() + "test,b,i/b,m/b,4,3,4,3,1,2,x,5\n")
    with pytest.raises(Exception, match="repeats"):
        mf.read_manifest(spark, str(repeated)).collect()
    empty = tmp_path / "e.csv"
    empty.write_text(header + "\n")
    with pytest.raises(ValueError, match="empty"):
        mf.read_manifest(spark, str(empty))
    with pytest.raises(ValueError, match="lacks"):
        mf.check_manifest(spark.range(1), ("sample_id",))


def test_pairing(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {r.k: r.side for r in mf.pair_sources(a, b, "k").collect()} == {"x": "left", "y": "both", "z": "right"}
    with pytest.raises(ValueError):
        mf.pair_sources(a, b, "k", expected=2)


def test_quality_numbers(spark):
    df = spark.createDataFrame([("a", 10, 2, 5, 0), ("b", 10, 1, 5, 1), ("c", 4, 1, 0, 0)], "sample_id string, original_mask_width long, original_mask_height long, non_exact long, mask_resized_nearest int")
    row = ql.quality_summary(ql.quality_columns(df)).first()
    ratios = np.array([0.25, 0.5, 0.0])
    assert row.overall_quantized_ratio == pytest.approx(10 / 34)
    assert row.median_quantized_ratio == pytest.approx(np.median(ratios))
    assert row.p95_quantized_ratio == pytest.approx(np.quantile(ratios, 0.95))
    assert row.size_repaired_samples == 1


def test_balance_prefers_the_proportional_split(spark):
    def score(parts):
        df = spark.createDataFrame(parts, "seed int, split string, n long, pixels array<long>")
        return sp.split_balance(df, ["seed"], 2).first().score

    assert score([(1, "train", 8, [80, 8]), (1, "val", 1, [10, 1]), (1, "calibration", 1, [10, 1])]) == pytest.approx(0.0)
    assert score([(1, "train", 6, [80, 8]), (1, "val", 3, [10, 1]), (1, "calibration", 1, [10, 1])]) == pytest.approx(3 * 0.4)


def test_samples_per_group_are_bounded_and_stable(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").unionByName(spark.range(5000, 5002).select(F.lit(9).cast("long").alias("g"), "id"))
    out = rw.sample_per_group(df, ["g"], "id", 7, 5)
    assert {r.g: r["count"] for r in out.groupBy("g").count().collect()} == {0: 7, 1: 7, 2: 7, 9: 2}
    assert out.exceptAll(rw.sample_per_group(df.repartition(9), ["g"], "id", 7, 5)).isEmpty()


def test_review_pages_do_not_overlap(spark):
    rows = [(f"p{i:02d}", 1, None, i, 0, "pending" if i % 2 else "same_scene") for i in range(20)]
    df = spark.createDataFrame(rows, "pair_key string, priority int, embedding_cosine double, phash_distance int, dhash_distance int, review_decision string")
    pages = [[r.pair_key for r in rv.review_batch(df, 4, i).collect()] for i in (1, 2, 3)]
    assert sum(pages, []) == [f"p{i:02d}" for i in range(20) if i % 2]
    with pytest.raises(ValueError):
        rv.review_batch(df, 4, 4)
    with pytest.raises(ValueError):
        rv.review_batch(df, 0, 1)


def test_verdicts_survive(spark):
    new = spark.createDataFrame([("a",), ("b",)], "pair_key string")
    old = spark.createDataFrame([("a", "same_scene", " me ", "2026-01-01", None), ("gone", "pending", "", "", "")], "pair_key string, review_decision string, reviewer string, review_date string, notes string")
    got = {r.pair_key: tuple(r)[1:] for r in rv.carry_forward_reviews(new, old).collect()}
    assert got == {"a": ("same_scene", "me", "2026-01-01", ""), "b": ("pending", "", "", "")}


@pytest.mark.parametrize("count", [1, 3, 700])
def test_candidate_splits_move_no_group_per_seed(spark, count):
    groups = spark.range(count).select(F.concat(F.lit("g"), "id").alias("scene"), F.lit(1).alias("n"))
    out = sp.candidate_splits(groups, "scene", 5, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    got = {(r["seed"], r["scene"]): r["split"] for r in out.collect()}
    for seed in range(5, 9):
        def order(names, s):
            return sorted(names, key=lambda g: hashlib.md5(f"{s}:{g}".encode()).hexdigest())

        names = order([f"g{i}" for i in range(count)], seed)
        rest = order(names[int(count * 0.8):], seed + 1)
        want = {g: "train" for g in names[: int(count * 0.8)]} | {g: "val" if i < len(rest) // 2 else "calibration" for i, g in enumerate(rest)}
        assert {g: got[seed, g] for g in names} == want
