import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranking as rk


def frame(spark, scores, errors, scope="s"):
    return spark.createDataFrame([(scope, i, float(s), int(e)) for i, (s, e) in enumerate(zip(scores, errors))], "scope string, id long, score double, err int")


def area(errors):
    risk = np.cumsum(errors) / np.arange(1, len(errors) + 1)
    return np.trapezoid(risk, np.arange(1, len(errors) + 1) / len(errors))


PATTERNS = [
    ([0.1, 0.2, 0.3, 0.4, 0.5], [0, 0, 1, 0, 1]),
    ([0.1, 0.1, 0.1, 0.4, 0.4], [0, 1, 0, 1, 1]),
    ([0.7, 0.7, 0.7, 0.7], [1, 0, 0, 1]),
    ([0.9, 0.1, 0.9, 0.1, 0.5, 0.5], [1, 1, 0, 0, 0, 1]),
]


@pytest.mark.parametrize("scores,errors", PATTERNS)
def test_aurc_is_the_mean_over_all_tie_orders(spark, scores, errors):
    pairs = list(zip(scores, errors))
    areas = [area([e for _, e in p]) for p in itertools.permutations(pairs) if list(s for s, _ in p) == sorted(scores)]
    row = rk.ranking_metrics(frame(spark, scores, errors), ["scope"]).first()
    assert row.aurc == pytest.approx(np.mean(areas), abs=1e-9)
    assert row.oracle_aurc == pytest.approx(area(sorted(errors)), abs=1e-9)
    assert row.eaurc >= -1e-12


@pytest.mark.parametrize("scores,errors", PATTERNS)
def test_auroc_and_precision_by_definition(spark, scores, errors):
    row = rk.ranking_metrics(frame(spark, scores, errors), ["scope"]).first()
    s, e = np.array(scores), np.array(errors)
    wins = [(a > b) + 0.5 * (a == b) for a in s[e == 1] for b in s[e == 0]]
    assert row.error_auroc == pytest.approx(np.mean(wins))
    steps = [((s >= v) & (e == 1)).sum() / (s >= v).sum() * ((s == v) & (e == 1)).sum() for v in np.unique(s)]
    assert row.error_auprc == pytest.approx(sum(steps) / e.sum())


def test_selection_inside_a_tie_group_is_shared(spark):
    # ten units on one score, four of them wrong: every cut sees 40 %
    row = rk.ranking_metrics(frame(spark, [0.5] * 10, [1] * 4 + [0] * 6), ["scope"]).first()
    assert row.risk_at_90_coverage == pytest.approx(0.4)
    assert row.top_10_uncertainty_precision == pytest.approx(0.4)
    assert row.top_20_uncertainty_recall == pytest.approx(0.2)
    assert (row.tie_group_count, row.largest_tie_group, row.tied_pixel_fraction) == (1, 10, 1.0)


def test_undefined_metrics_are_null(spark):
    row = rk.ranking_metrics(frame(spark, [0.1, 0.2], [0, 0]), ["scope"]).first()
    assert row.error_auroc is None and row.error_auprc is None and row.top_5_uncertainty_recall is None
    assert row.aurc == 0.0


def test_discrete_groups_agree_with_plain_groups(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.integers(0, 10, 300) / 9.0, rng.integers(0, 2, 300))
    a = {(r.w, r.e) for r in rk.score_groups(df, ["scope"]).collect()}
    b = {(r.w, r.e) for r in rk.score_groups_discrete(df, ["scope"]).collect()}
    assert a == b
    with pytest.raises(Exception, match="lattice"):
        rk.score_groups_discrete(frame(spark, [0.5], [0]), ["scope"]).collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_scores_fail(spark, bad):
    with pytest.raises(Exception, match="finite"):
        rk.score_groups(frame(spark, [bad, 0.1], [0, 1]), ["scope"]).collect()


def test_range_cuts_do_not_change_anything(spark):
    """One scope with a hot score: plain window, range cuts and few partitions agree."""
    rng = np.random.default_rng(3)
    scores = np.where(rng.random(4000) < 0.4, 0.25, rng.random(4000)).round(3)
    df = frame(spark, scores, rng.integers(0, 2, 4000))
    plain = rk.ranking_metrics(df, ["scope"]).first()
    cut = rk.ranking_metrics_ranged(df.repartition(3), ["scope"], ranges=37).first()
    for name in plain.asDict():
        assert cut[name] == pytest.approx(plain[name], abs=1e-12) if name != "scope" else True
    curve = rk.risk_coverage_curve(df, ["scope"], "id")
    ranged = rk.risk_coverage_curve(df, ["scope"], "id", ranges=29, heavy=0)
    left = [tuple(r) for r in curve.orderBy("rank").collect()]
    right = [tuple(r) for r in ranged.orderBy("rank").collect()]
    assert left == right
    order = np.lexsort((np.arange(4000), scores.astype(np.float32)))
    assert [r[1] for r in left] == order.tolist()


def test_monotone_transform_keeps_ranking(spark):
    rng = np.random.default_rng(4)
    scores, errors = rng.integers(0, 40, 500) / 64.0, rng.integers(0, 2, 500)
    a = rk.ranking_metrics(frame(spark, scores, errors), ["scope"]).first().asDict()
    b = rk.ranking_metrics(frame(spark, scores * 2 + 1, errors), ["scope"]).first().asDict()
    assert a == pytest.approx(b)


def test_strata_are_full_plus_own(spark):
    df = frame(spark, [0.1, 0.2, 0.3], [0, 1, 1]).withColumn("region", F.when(F.col("id") < 1, "boundary").otherwise("interior"))
    out = {r.region: r.pixels for r in rk.ranking_by_region(df, ["scope"]).collect()}
    assert out == {"full": 3, "boundary": 1, "interior": 2}
