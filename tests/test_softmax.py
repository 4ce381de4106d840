import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import softmax as sm
from plumbline.functions.numerics import harmonic_gap


@pytest.fixture(scope="module")
def logits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), [float(v) for v in rng.normal(0, 3, 4)]) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id long, label int, logits array<double>")


def reference(z, t):
    z = np.array(z) / t
    p = np.exp(z - z.max())
    return p / p.sum()


def test_scores_match_numpy(logits):
    rows, df = logits
    got = {r.id: r for r in sm.uncertainty_scores(df, 4, 2.0).collect()}
    for i, _, z in rows:
        p, raw = np.sort(reference(z, 2.0))[::-1], reference(z, 1.0)
        zs = np.sort(z)[::-1]
        r = got[i]
        assert r.raw_msp == pytest.approx(1 - raw.max())
        assert r.calibrated_msp == pytest.approx(1 - p[0])
        assert r.entropy == pytest.approx(-(p * np.log(p)).sum(), abs=1e-6)
        assert r.probability_margin == pytest.approx(1 - (p[0] - p[1]))
        assert r.logit_margin == pytest.approx(-(zs[0] - zs[1]) / 2.0)
        assert r.energy == pytest.approx(-np.log(np.exp(np.array(z) / 2.0).sum()))


def test_unit_stats_match_numpy(logits):
    rows, df = logits
    got = {r.id: r for r in sm.unit_stats(df, 4, 1.5).collect()}
    for i, label, z in rows:
        p = reference(z, 1.5)
        onehot = np.eye(4)[label]
        assert got[i].pred == int(np.argmax(z))
        assert got[i].brier == pytest.approx(((p - onehot) ** 2).sum())
        assert got[i].nll == pytest.approx(-math.log(p[label]))


def test_first_index_wins_a_tie_and_margin_is_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0])], "label int, logits array<double>")
    row = sm.uncertainty_scores(df, 3, 1.0).first()
    assert row.pred == 1
    assert row.logit_margin == 0.0


@pytest.mark.parametrize("bad", [0.0, -1.0, math.inf, math.nan])
def test_temperature_is_checked(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 3.0])], "label int, logits array<double>")
    with pytest.raises(ValueError):
        sm.scale_logits(df, bad, 2)


def test_unit_temperature_is_identity(logits):
    _, df = logits
    assert sm.scale_logits(df, 1.0, 4).filter(~(F.col("scaled") == F.col("logits"))).count() == 0


def test_probability_gate(spark):
    good = spark.createDataFrame([([0.4, 0.6],)], "probs array<double>")
    bad = spark.createDataFrame([([2.0, 3.0],)], "probs array<double>")
    assert sm.check_probabilities(good) is good
    with pytest.raises(ValueError):
        sm.check_probabilities(bad)
    with pytest.raises(ValueError):
        sm.check_probabilities(good.filter("false"))


def test_missing_temperature_fails(spark):
    df = spark.createDataFrame([("fog",)], "degradation_type string")
    rules = spark.createDataFrame([("typed", "blur", 2.0)], "method string, degradation_type string, temperature double")
    with pytest.raises(Exception, match="no temperature"):
        sm.add_temperatures(df, rules, ["typed"]).collect()


@pytest.mark.parametrize("before,width", [(0, 1), (0, 5), (3, 40), (10_000_000, 3), (999, 123_456)])
def test_harmonic_gap(spark, before, width):
    exact = math.fsum(1.0 / i for i in range(before + 1, before + width + 1))
    got = spark.range(1).select(harmonic_gap(F.lit(before), F.lit(float(width)))).first()[0]
    assert got == pytest.approx(exact, rel=1e-10)
