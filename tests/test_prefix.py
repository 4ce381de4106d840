import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.prefix import add_hashed_rank, add_prefix, exact_quantiles


@pytest.mark.parametrize("heavy", [0, 10**9])
def test_prefix_with_hot_value_and_ties(spark, heavy):
    rng = np.random.default_rng(2)
    values = np.where(rng.random(3000) < 0.5, 7, rng.integers(0, 100, 3000))
    df = spark.createDataFrame([("k", float(v), i, 1) for i, v in enumerate(values)], "k string, v double, id long, one long")
    out = add_prefix(df, ["k"], "v", {"n": F.col("one"), "v2": F.col("v")}, tie="id", ranges=17, heavy=heavy)
    rows = sorted(out.collect(), key=lambda r: (r.v, r.id))
    assert [r.n_before for r in rows] == list(range(3000))
    sums = np.concatenate([[0], np.cumsum([r.v for r in rows])])
    assert [r.v2_before for r in rows] == pytest.approx(sums[:-1])
    assert rows[0].n_total == 3000


def test_prefix_is_cut_into_many_tasks(spark):
    df = spark.range(20_000).select((F.col("id") % 1).alias("k"), (F.col("id") % 5).cast("double").alias("v"), "id")
    out = add_prefix(df, ["k"], "v", {"n": F.lit(1)}, tie="id", ranges=16, heavy=100)
    assert out.select("v", "id").count() == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_hashed_rank(spark):
    df = spark.range(500).withColumn("key", F.md5(F.col("id").cast("string")))
    rows = add_hashed_rank(df, "key", digits=1).orderBy("key").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501))
    assert {r["size"] for r in rows} == {500}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_interpolate(spark, n):
    values = np.round(np.random.default_rng(n).random(n), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = exact_quantiles(df, [], "v", {"a": 0.5, "b": 0.95}, ranges=5, heavy=0).first()
    assert (row.a, row.b) == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.95)))


def test_text_ties_are_cut_too(spark):
    df = spark.range(3000).select((F.col("id") % 1).alias("k"), F.lit(1.0).alias("v"), F.format_string("sample_%05d", "id").alias("name"))
    out = add_prefix(df, ["k"], "v", {"n": F.lit(1)}, tie="name", ranges=16, heavy=100)
    assert [r.n_before for r in out.orderBy("name").collect()] == list(range(3000))


def test_ranges_and_totals_share_stored_cuts(spark):
    """Approximate quantiles computed twice may differ, and rows then get a wrong range's totals."""
    df = spark.range(500).select((F.col("id") % 50).alias("v"), "id")
    out = add_prefix(df, [], "v", {"n": F.lit(1)}, tie="id", ranges=16, heavy=0)
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["n_before"] for r in out.collect()) == list(range(500))
