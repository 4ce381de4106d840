import pytest
from pyspark.sql import functions as F

from plumbline.operators import segmentation as seg


def cells(spark, truth, guess):
    return spark.createDataFrame([("s", t, p) for t, p in zip(truth, guess)], "scope string, label int, pred int")


def test_counts_are_zero_filled_and_ignore_both_sides(spark):
    df = cells(spark, [0, 0, 1, 255, 1], [0, 1, 1, 0, 9])
    rows = {(r.target, r.prediction): r.n for r in seg.confusion_matrix(df, ["scope"], 3).collect()}
    assert len(rows) == 9
    assert rows[(0, 0)] == rows[(0, 1)] == rows[(1, 1)] == 1
    assert sum(rows.values()) == 3


def test_metrics_by_hand(spark):
    # cells (truth, guess): three right of four
    df = cells(spark, [0, 1, 1, 2], [0, 1, 2, 2])
    row = seg.segmentation_metrics(df, ["scope"], 3).first()
    assert row.pixel_accuracy == pytest.approx(0.75)
    assert row.miou == pytest.approx((1.0 + 0.5 + 0.5) / 3)
    assert row.mean_dice == pytest.approx((1.0 + 2 / 3 + 2 / 3) / 3)


def test_absent_class_is_null_and_left_out_of_the_mean(spark):
    df = cells(spark, [0, 1], [0, 0])
    table = {r.class_id: r for r in seg.per_class_table(df, ["scope"], 3).collect()}
    assert table[2].iou is None and table[2].accuracy is None
    assert table[1].iou == 0.0
    assert seg.segmentation_metrics(df, ["scope"], 3).first().miou == pytest.approx(0.25)


def test_no_scope(spark):
    df = cells(spark, [0, 1], [0, 1])
    assert seg.segmentation_metrics(df, [], 2).first().miou == 1.0
    assert seg.confusion_matrix(df, [], 2).agg(F.sum("n")).first()[0] == 2
