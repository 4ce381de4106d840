import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import softmax as sm
from plumbline.operators import bootstrap as bs
from plumbline.operators import fusion as fu
from plumbline.operators import history as hi
from plumbline.operators import temperature as tp


def nll(rows, t):
    out = []
    for _, label, z in rows:
        z = np.array(z) / t
        out.append(np.log(np.exp(z - z.max()).sum()) + z.max() - z[label])
    return float(np.mean(out))


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(21)
    rows = []
    for scope, gain in (("sharp", 4.0), ("soft", 0.5)):
        for _ in range(300):
            z = rng.normal(size=4)
            p = np.exp(z) / np.exp(z).sum()
            rows.append((scope, int(rng.choice(4, p=p)), [float(v) for v in gain * z]))
    return rows, spark.createDataFrame(rows, "scope string, label int, logits array<double>")


def test_fit_is_stationary_and_no_worse(predictions):
    rows, df = predictions
    for r in tp.fit_temperature(df, "scope", 4).collect():
        mine = [x for x in rows if x[0] == r.scope]
        assert r.initial_nll == pytest.approx(nll(mine, 1.0))
        assert r.final_nll == pytest.approx(nll(mine, r.temperature))
        assert r.final_nll <= min(nll(mine, r.temperature * f) for f in (0.99, 1.01)) + 1e-12
        assert r.converged and r.valid_units == 300 and not r.at_boundary
        assert r.temperature == pytest.approx({"sharp": 4.0, "soft": 0.5}[r.scope], rel=0.35)


def test_grid_brackets_the_fit(predictions):
    rows, df = predictions
    grid = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
    for r in tp.fit_temperature_grid(df, ["scope"], 4, grid).collect():
        mine = [x for x in rows if x[0] == r.scope]
        assert r.temperature == min(grid, key=lambda t: nll(mine, t))


def test_boundary_solution_is_flagged(spark):
    rows = [("s", 0, [0.5, 0.0]), ("s", 1, [0.0, 0.5])] * 5
    r = tp.fit_temperature(spark.createDataFrame(rows, "scope string, label int, logits array<double>"), "scope", 2).first()
    assert r.at_boundary and not r.converged and r.temperature == pytest.approx(0.05)


def test_empty_fit_fails(predictions):
    _, df = predictions
    with pytest.raises(ValueError):
        tp.fit_temperature(df.withColumn("label", F.lit(255)), "scope", 4)


def test_scopes_fan_out(predictions):
    rows, df = predictions
    scopes = {"sharp_only": ["sharp"], "pooled": ["sharp", "soft"]}
    got = {r.scope: r for r in tp.fit_scopes(df.withColumnRenamed("scope", "condition"), scopes, 4).collect()}
    assert {s: r.valid_units for s, r in got.items()} == {"sharp_only": 300, "pooled": 600}
    assert got["pooled"].initial_nll == pytest.approx(nll(rows, 1.0))


def test_temperature_keeps_predictions(predictions):
    _, df = predictions
    scaled = sm.scale_logits(df, 3.7, 4).withColumn("a", sm.first_argmax(sm.logit_items(4)))
    assert scaled.filter(F.col("a") != sm.first_argmax(sm.logit_items(4, "scaled"))).isEmpty()


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(500, 2)) * [2.0, 0.1] + [1.0, 5.0]
    logit = 0.8 * (x[:, 0] - 1.0) / 2.0 - 0.5
    y = (rng.random(500) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, float(a), float(b), int(e)) for i, ((a, b), e) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, u double, v double, err int")


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_fusion_gradient_is_zero(features, c):
    x, y, df = features
    p = fu.fit_fusion(df, ["u", "v"], c=c)
    x32 = x.astype(np.float32).astype(float)
    z = (x32 - p.mean) / p.scale
    assert p.mean == pytest.approx(x32.mean(axis=0)) and p.scale == pytest.approx(x32.std(axis=0))
    prob = 1 / (1 + np.exp(-(z @ np.array(p.coefficients) + p.intercept)))
    gradient = c * z.T @ (prob - y) + np.array(p.coefficients)
    assert np.abs(gradient).max() < 2e-3 * c * len(y) / 100 + 1e-3
    assert abs((prob - y).mean()) < 1e-4
    scored = df.withColumn("s", fu.fusion_score(p)).orderBy("id").collect()
    assert [r.s for r in scored] == pytest.approx(prob, abs=1e-6)


def test_fusion_needs_both_outcomes(features):
    _, _, df = features
    with pytest.raises(ValueError):
        fu.fit_fusion(df.filter("err = 0"), ["u", "v"])
    with pytest.raises(ValueError):
        fu.fit_fusion(df.withColumn("u", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("u"))), ["u", "v"])


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in fu.standardize(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("draw", [bs.paired_bootstrap, bs.poisson_bootstrap])
def test_interval_has_the_right_width(spark, draw):
    rng = np.random.default_rng(1)
    values = rng.normal(2.0, 1.0, 400)
    df = spark.createDataFrame([("g", f"c{i}", float(v)) for i, v in enumerate(values)], "g string, c string, v double")
    r = draw(df, ["g"], "c", ["v"], 300, 3).first()
    error = values.std() / math.sqrt(400)
    assert r.mean_difference == pytest.approx(values.mean())
    assert (r.clusters, r.iterations) == (400, 300)
    assert r.ci95_low == pytest.approx(values.mean() - 1.96 * error, abs=0.6 * error)
    assert r.ci95_high == pytest.approx(values.mean() + 1.96 * error, abs=0.6 * error)


def test_bootstrap_does_not_depend_on_partitioning_or_broadcast(spark):
    df = spark.range(60).select((F.col("id") % 2).alias("g"), F.col("id").alias("c"), F.sqrt("id").alias("v"))
    a = sorted(map(tuple, bs.paired_bootstrap(df, ["g"], "c", ["v"], 50, 9).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted(map(tuple, bs.paired_bootstrap(df.repartition(11), ["g"], "c", ["v"], 50, 9).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3:] for x in a], [x[3:] for x in b])


def test_clusters_must_agree(spark):
    rows = [("full", s, c, 0.1, 0.2, 0.3) for s in ("base", "other") for c in ("x", "y")]
    schema = "region string, score_name string, sample_id string, eaurc double, error_auprc double, top_10_uncertainty_recall double"
    out = bs.clustered_bootstrap(spark.createDataFrame(rows, schema), "base", ["region"], "sample_id", 10, 1)
    assert {r.mean_difference for r in out.collect()} == {0.0}
    with pytest.raises(Exception, match="same clusters"):
        bs.clustered_bootstrap(spark.createDataFrame(rows[:-1], schema), "base", ["region"], "sample_id", 10, 1).collect()


def test_history(spark):
    values = [None, 0.3, 0.5, 0.5, 0.4, 0.6, 0.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "epoch int, m double")
    best = hi.best_checkpoint(df, "epoch", "m").first()
    assert (best.best_epoch, best.best_value, best.last_epoch, best.last_value) == (5, 0.6, 6, 0.1)
    rows = hi.early_stop(df, "epoch", "m", 2).orderBy("epoch").collect()
    assert [r.since_improvement for r in rows] == [0, 0, 1, 2, 0, 1]
    assert [r.epoch for r in rows if r.stops_here] == [4]


def test_paired_bootstrap_joins_no_draw(spark):
    """Draws travel packed; scopes of one size share them, nulls don't count and the means are those of the index draws."""
    rows = [(g, f"c{i:03d}", None if i % 4 == 0 else float(i * (k + 1)), float(i)) for k, g in enumerate("ab") for i in range(23)]
    df = spark.createDataFrame(rows, "g string, c string, v double, w double")
    out = bs.paired_bootstrap(df, ["g"], "c", ["v", "w"], 130, 9)
    got = {(r["g"], r["metric"]): r for r in out.collect()}
    order = sorted((f"c{i:03d}" for i in range(23)), key=lambda c: hashlib.md5(c.encode()).hexdigest())
    for (g, metric), r in got.items():
        value = {c: (v if metric == "v" else w) for h, c, v, w in rows if h == g}
        means = []
        for it in range(130):
            picks = [int(hashlib.md5(f"9:{it}:{rank}".encode()).hexdigest()[:15], 16) % 23 for rank in range(1, 24)]
            drawn = [value[order[p]] for p in picks if value[order[p]] is not None]
            means.append(np.mean(drawn))
        assert r["iterations"] == 130 and r["clusters"] == 23
        assert np.allclose([r["ci95_low"], r["ci95_high"]], np.quantile(means, [0.025, 0.975]))
    assert len(got) == 4
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
