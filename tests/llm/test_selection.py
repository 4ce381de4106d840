"""Decontamination, mixing, sharding and the pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontamination, mixing, sharding
from test_near_copies import plain_groups, plain_set


def unique_rows(hard):
    return hard.filter(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(3, 4)).select("doc_id", "text", "lang", "source")


def test_contamination_equals_sql(hard, tests_table, duck, same):
    docs, items = unique_rows(hard), tests_table.filter("item_id IS NOT NULL")
    got = decontamination.contamination(docs, items).collect()
    assert sum(r["contaminated"] for r in got) >= 2
    same(got, duck(decontamination.HITS_SQL, documents=docs, benchmark=items))


def test_contamination_in_slices(hard, tests_table):
    whole = decontamination.find_hits(hard, tests_table).select("_id", "_h1", "n_hit")
    sliced = decontamination.find_hits(hard, tests_table, slice_windows=7).select("_id", "_h1", "n_hit")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_hits_are_never_broadcast(hard, tests_table):
    """Repeated windows make files of hits small, so their size says little of the rows."""
    found = decontamination.find_hits(hard, tests_table)
    assert found.count() > 0
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "strategy=merge" in joins[0]


def test_removal_keeps_the_rest(hard, tests_table):
    left = decontamination.remove_contaminated(hard, tests_table)
    bad = decontamination.contamination(hard, tests_table).filter("contaminated").count()
    assert left.columns == hard.columns and bad and left.count() == hard.count() - bad
    assert decontamination.contamination(left, tests_table).filter("contaminated").count() == 0


def test_mixture_equals_sql(hard, duck, same):
    docs = unique_rows(hard)
    same(mixing.mixture(docs).collect(), duck(mixing.mixture_sql(), documents=docs))


def test_raked_margins_and_budget(spark):
    cells = spark.createDataFrame([(s, lang, t, 10 * (i + 1) + 7 * j + 3 * k) for i, s in enumerate("abc") for j, lang in enumerate("xy") for k, t in enumerate("pq")], "_source string, _lang string, _topic string, _mass long")
    raked = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.25, "y": 0.75}, "topic": 0.0}).collect()
    whole = sum(r["_mass"] for r in raked)
    for name, want in (("_source", {"a": 0.5, "b": 0.3, "c": 0.2}), ("_lang", {"x": 0.25, "y": 0.75}), ("_topic", {"p": 0.5, "q": 0.5})):
        for category, share in want.items():
            assert abs(sum(r["_raked"] for r in raked if r[name] == category) / whole - share) < 1e-6


def skewed(spark, rest):
    """Each source is mostly one language; ``rest`` is the mass of the other cells, which may be missing."""
    rows = [(s, lang, "p", 100_000 if s == lang else rest) for s in "abc" for lang in "abc" if s == lang or rest]
    return spark.createDataFrame(rows, "_source string, _lang string, _topic string, _mass long")


def test_margins_of_a_skewed_table(spark):
    """A nearly block-diagonal table needs more than 40 rounds, and all margins hold at the end."""
    shares = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"a": 0.2, "b": 0.3, "c": 0.5}}
    targets = {**shares, "topic": 1.0}
    with pytest.warns(UserWarning, match="did not settle"):
        assert mixing.rake(skewed(spark, 1), targets, mixing.ROUNDS).first()["_margin_error"] > 1e-5
    raked = mixing.rake(skewed(spark, 1), targets).collect()
    whole = sum(r["_mass"] for r in raked)
    for name, wanted in shares.items():
        for category, share in wanted.items():
            assert abs(sum(r["_raked"] for r in raked if r[f"_{name}"] == category) / whole - share) < 1e-6
    assert raked[0]["_margin_error"] < 1e-6
    with pytest.warns(UserWarning, match="did not settle"):
        assert mixing.rake(skewed(spark, 0), targets, 500).first()["_margin_error"] > 0.1


def test_raking_in_spark_equals_the_driver(spark):
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": 0.7, "topic": 1.0}
    by_driver, by_spark = (sorted(mixing.rake(skewed(spark, 30_000), targets, driver_cells=n).collect()) for n in (100, 0))
    assert all(a[:3] == b[:3] and abs(a["_raked"] - b["_raked"]) < 1e-3 for a, b in zip(by_driver, by_spark)) and len(by_driver) == len(by_spark) == 9
    with pytest.warns(UserWarning, match="did not settle"):
        assert mixing.rake(skewed(spark, 0), {**targets, "lang": {"a": 0.1, "b": 0.1, "c": 0.8}}, 2, driver_cells=0).first()["_margin_error"] > 0.1


def test_expected_mass_is_the_budget(hard):
    rows = mixing.mixture(hard).collect()
    mass = sum(r["tokens"] for r in rows)
    assert len(rows) == hard.count() and abs(sum(r["tokens"] * r["probability"] for r in rows) / mass - mixing.BUDGET) < 1e-3
    kept = mixing.sample_mixture(hard)
    assert kept.columns == hard.columns and kept.count() == sum(r["kept"] for r in rows)


def least_capacity(sizes, shards):
    def fits(capacity):
        used, left = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > left:
                used, left = used + 1, capacity
            left -= size
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def check_shards(rows, shards):
    places, sizes = {}, {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values())
    assert set(places) <= set(range(shards))
    return sizes


def test_sharding(hard, hard_rows):
    """Few blocks, so that the summary has to be refined again and again."""
    ordered = {}
    for r in hard_rows:
        key = r[1] or ""
        size = len(key.encode()) + 16
        rep, held = ordered.get(key, (sharding.LAST_ID, 0))
        ordered[key] = (min(rep, sharding.LAST_ID if r[0] is None else r[0]), held + size)
    groups = {}
    for rep, size in ordered.values():
        groups[rep] = groups.get(rep, 0) + size
    want = {k: least_capacity([groups[g] for g in sorted(groups)], k) for k in (3, 7)}
    for shards, blocks in ((3, 4), (7, 16), (7, sharding.BLOCKS)):
        rows = sharding.shard_documents(hard, shards, blocks).collect()
        assert len(rows) == len(hard_rows)
        sizes = check_shards(rows, shards)
        assert max(sizes.values()) == want[shards]
    shard_of = {}
    for r in rows:
        shard_of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in shard_of.values())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_sharding_without_ids(spark):
    """Texts without an id are groups of their own; copies of one stay together."""
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("z" * 100), (F.col("id") % 700).cast("string")).alias("text"))
    for blocks in (16, sharding.BLOCKS):
        rows = sharding.shard_documents(docs, 8, blocks).collect()
        sizes = check_shards(rows, 8)
        assert len(rows) == 900 and len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
        shard_of = {}
        for r in rows:
            shard_of.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert all(len(v) == 1 for v in shard_of.values())
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    sizes = check_shards(sharding.shard_documents(nameless, 8, 16).collect(), 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_sharding_even_sizes(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int")).alias("text")).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    sizes = check_shards(sharding.shard_documents(docs, blocks=512).collect(), 40)
    assert len(sizes) == 40 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_one_text_beyond_its_share(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("x" * 300)).otherwise(F.concat(F.lit("y" * 280), F.col("id").cast("string"))).alias("text"))
    sizes = check_shards(sharding.shard_documents(docs, 8, 16).collect(), 8)
    assert len(sizes) == 8 and max(sizes.values()) >= 133 * 316


def test_rows_without_an_id_have_draws_of_their_own(spark, duck, same):
    """A third of the rows lacks ids; the budget holds for them too, and the SQL draws alike."""
    docs = spark.range(6_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("a text of number "), F.col("id").cast("string"), F.repeat(F.lit(" more"), (F.col("id") % 7).cast("int"))).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = mixing.mixture(docs).collect()
    for nameless in (True, False):
        rows = [r for r in got if (r["doc_id"] is None) == nameless]
        assert abs(sum(r["tokens"] for r in rows if r["kept"]) / sum(r["tokens"] * r["probability"] for r in rows) - 1) < 0.05
    same(got, duck(mixing.mixture_sql(), documents=docs))


def test_empty_tables(empty, tests_table):
    assert decontamination.contamination(empty, tests_table).count() == 0
    assert decontamination.contamination(tests_table.select(F.col("item_id").alias("doc_id"), "text"), tests_table.limit(0)).filter("contaminated").count() == 0
    assert mixing.mixture(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0


def test_pipeline(spark, tmp_path, sf_dir):
    """Every stage's decisions, applied by hand; near copies by brute force over all pairs."""
    from plumbline.llm import language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r["doc_id"] for r in language_id.identify(docs).collect() if not r["rejected"]}
    first = docs.filter(F.col("doc_id").isin(sorted(known)))
    texts = {r["doc_id"]: plain_set(r["text"]) for r in first.collect()}
    groups, least = plain_groups(texts.values()), {}
    for doc_id in sorted(texts):
        least.setdefault(groups[texts[doc_id]], doc_id)
    second = set(least.values())
    left = first.filter(F.col("doc_id").isin(sorted(second)))
    bad = {r["doc_id"] for r in decontamination.contamination(left, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r["contaminated"]}
    third = left.filter(~F.col("doc_id").isin(sorted(bad)))
    fourth = {r["doc_id"] for r in mixing.mixture(third).collect() if r["kept"]}
    assert bad and second < known
    assert {r["doc_id"] for r in result} == fourth and len(result) == len(fourth)
    check_shards(result, 40)


def test_stages_keep_columns(spark, hard, tests_table, tmp_path):
    tests_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == hard.columns, name
        docs.count()
