import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import softmax as sm
from plumbline.operators import calibration as cal


def numpy_ece(conf, hit, bins, right):
    index = np.maximum(np.ceil(conf * bins) - 1, 0) if right else np.minimum(np.floor(conf * bins), bins - 1)
    return sum(abs(hit[index == b].sum() - conf[index == b].sum()) for b in range(bins)) / len(conf)


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else "b", int(rng.integers(0, 3)), [float(v) for v in rng.normal(0, 2, 3)]) for i in range(200)]
    return sm.unit_stats(spark.createDataFrame(rows, "scope string, label int, logits array<double>"), 3, keep=True)


@pytest.mark.parametrize("edges", ["left", "right"])
def test_ece_conventions(units, edges):
    got = {r.scope: r.ece for r in cal.ece(units, ["scope"], edges=edges).collect()}
    rows = units.collect()
    for scope in "ab":
        conf = np.array([r.conf for r in rows if r.scope == scope])
        hit = np.array([r.correct for r in rows if r.scope == scope])
        assert got[scope] == pytest.approx(numpy_ece(conf, hit, 15, edges == "right"))


def test_conventions_differ_on_an_edge(spark):
    df = spark.createDataFrame([(0.2, 1), (0.25, 0)], "conf double, correct long")
    left = cal.ece(df, [], bins=5, edges="left").first().ece
    right = cal.ece(df, [], bins=5, edges="right").first().ece
    assert left == pytest.approx(abs(1 - 0.45) / 2)
    assert right == pytest.approx((0.8 + 0.25) / 2)


def test_summary_equals_its_parts(units):
    whole = {r.scope: r for r in cal.calibration_summary(units, ["scope"], 3).collect()}
    ece = {r.scope: r.ece for r in cal.ece(units, ["scope"]).collect()}
    single = {}
    for r in cal.classwise_ece(units, ["scope"], 3).collect():
        single.setdefault(r.scope, []).append(r.classwise_ece)
    for scope, row in whole.items():
        assert row.ece == pytest.approx(ece[scope])
        assert row.mean_classwise_ece == pytest.approx(np.mean(single[scope]))
        mine = [r for r in units.collect() if r.scope == scope]
        assert row.nll == pytest.approx(np.mean([r.nll for r in mine]))
        assert row.brier_score == pytest.approx(np.mean([r.brier for r in mine]))


def test_certain_and_right_is_perfect(spark):
    df = spark.createDataFrame([(0, [60.0, 0.0]), (1, [0.0, 60.0])], "label int, logits array<double>")
    row = cal.calibration_summary(sm.unit_stats(df, 2, keep=True), [], 2).first()
    assert (row.nll, row.brier_score, row.ece) == (pytest.approx(0), pytest.approx(0), pytest.approx(0))


def test_bin_sums_merge(units):
    halves = [units.filter(F.col("conf") < 0.6), units.filter(F.col("conf") >= 0.6)]
    merged = cal.bin_sums(halves[0], ["scope"]).unionByName(cal.bin_sums(halves[1], ["scope"]))
    sums = [c for c in merged.columns if c not in ("scope", "bin")]
    merged = merged.groupBy("scope", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    a = {r.scope: r for r in cal.merge_bins(merged, ["scope"]).collect()}
    b = {r.scope: r for r in cal.merge_bins(cal.bin_sums(units, ["scope"]), ["scope"]).collect()}
    for scope in b:
        assert a[scope].nll == pytest.approx(b[scope].nll)
        assert a[scope].ece == pytest.approx(b[scope].ece)


def test_empty_side_of_the_confidence_summary(spark):
    df = spark.createDataFrame([("x", 0.9, 1)], "scope string, conf double, correct long")
    row = cal.confidence_summary(df, ["scope"]).first()
    assert row.mean_wrong_confidence is None and row.mean_correct_confidence == 0.9


def test_class_slots_equal_the_confusion_matrix(units):
    from plumbline.operators import segmentation as seg

    slots = {r.slot: r for r in cal.merge_slots(cal.slot_sums(units, [], 3), []).collect()}
    for r in seg.per_class_table(units, [], 3).collect():
        mine = slots[r.class_id]
        assert (mine.iou, mine.dice, mine.accuracy) == pytest.approx((r.iou, r.dice, r.accuracy))


def test_prediction_is_not_computed_inside_a_filter(units):
    """No filter may carry the softmax: it would be evaluated twice per row."""
    from plumbline.operators import segmentation as seg

    for df in (cal.classwise_ece(units, ["scope"], 3), cal.calibration_summary(units, ["scope"], 3), seg.segmentation_metrics(units, ["scope"], 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and ("EXP" in line or "greatest" in line)]
