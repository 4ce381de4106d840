"""Image blocks against the pixel-table operators and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.softmax import ALL_SCORES
from plumbline.operators import images as im
from plumbline.operators import regions as rg
from plumbline.operators import spatial as sp
from plumbline.plans import evaluation as ev


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (6, 1), (9, 11)])
def test_label_distance(shape):
    rng = np.random.default_rng(shape[1])
    labels = np.where(rng.random(shape) < 0.8, 0, rng.integers(0, 3, shape)).astype(np.int32)
    got = im.label_distance(labels, 4)
    for y in range(shape[0]):
        for x in range(shape[1]):
            far = [max(abs(v - y), abs(u - x)) for v in range(shape[0]) for u in range(shape[1]) if labels[v, u] != labels[y, x]]
            assert got[y, x] == min([*far, 5])


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    logits = [(s, c, y, x, [float(round(v, 4)) for v in rng.normal(0, 2, 3)]) for s in ("a", "b") for c in ("u", "v") for y in range(3) for x in range(4)]
    labels = [(s, y, x, 255 if (y, x) == (0, 0) else int(min(2, (y // 4) + (x > 5)))) for s in ("a", "b") for y in range(8) for x in range(9)]
    return spark.createDataFrame(logits, "id string, condition string, y int, x int, logits array<double>"), spark.createDataFrame(labels, "id string, y int, x int, label int")


@pytest.fixture(scope="module")
def units(tables):
    low, labels = tables
    return im.image_units(im.gather_images(low, ["id", "condition"], {"logits": F.col("logits")}), im.gather_images(labels, ["id"], {"label": F.col("label")}), ["id", "condition"], "id", 3, 5).cache()


def test_units_equal_pixel_operators(tables, units):
    low, labels = tables
    keys = ["id", "condition"]
    fine = sp.bilinear_upsample(low, keys, 8, 9, {f"z{k}": F.col("logits")[k] for k in range(3)})
    items = [F.col(f"z{k}") for k in range(3)]
    fine = fine.withColumn("pred", F.array_position(F.array(*items), F.greatest(*items)).cast("int") - 1)
    want = {(r.id, r.condition, r.y, r.x): r for r in sp.local_disagreement(fine, keys).collect()}
    marks = {r: {(m.id, m.y, m.x): m.boundary for m in sp.boundary_mask(labels, ["id"], r).collect()} for r in (1, 3, 5)}
    rows = units.collect()
    assert len(rows) == 2 * 2 * 72 == len(want)
    for r in rows:
        other = want[r.id, r.condition, r.y, r.x]
        assert r.logits == pytest.approx([other.z0, other.z1, other.z2])
        assert r.local_disagreement == pytest.approx(other.local_disagreement)
        for radius, mark in marks.items():
            assert (r.distance <= radius) == mark[r.id, r.y, r.x]


def test_region_metrics_equal_per_pixel_regions(units):
    """Radii regroup bins and tie groups; the result is that of pixels copied for every radius."""
    methods = rg.method_units(units, 3, {"raw": 1.0, "soft": 2.0})
    rows = [F.struct(F.lit(r).alias("radius"), F.when(F.col("distance") <= r, "boundary").otherwise("interior").alias("region")) for r in (1, 3)]
    by = ["condition", "method", "radius", "region"]
    want = {tuple(r[c] for c in by): r.asDict() for r in rg.region_calibration(methods.select("*", F.inline(F.array(*rows))), by).collect()}
    got = rg.region_metrics(methods, ["condition", "method"], [1, 3]).collect()
    assert len(got) == len(want) == 2 * 2 * 2 * 2
    for r in got:
        for name, value in want[tuple(r[c] for c in by)].items():
            assert r[name] == (value if isinstance(value, (str, int)) or value is None else pytest.approx(value))


def test_scopes_of_an_image_are_measured_in_place(units, monkeypatch):
    """The same metrics without moving a pixel, whatever the batches cut; null keys and a scope without errors count."""
    methods = rg.method_units(units, 3, {"raw": 1.0, "soft": 2.0})
    methods = methods.withColumn("correct", F.when(F.col("condition") == "u", 1).otherwise(F.col("correct"))).withColumn("condition", F.nullif("condition", F.lit("u")))
    by = ["condition", "method", "id"]
    spark = units.sparkSession
    plain = rg.region_metrics(methods.na.fill("u", ["condition"]), by, [1, 3])
    want = {tuple(r[c] for c in [*by, "radius", "region"]): r for r in plain.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(rg, "ROWS", 50)
    try:
        out = rg.region_metrics(methods, by, [1, 3], within=["condition", "id"])
        assert out.columns == plain.columns and [t for _, t in out.dtypes] == [t for _, t in plain.dtypes]
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) > 0
    for r in got:
        key = (r["condition"] or "u", *(r[c] for c in [*by[1:], "radius", "region"]))
        for name in (c for c in out.columns if c != "condition"):
            value = want[key][name]
            assert r[name] == (value if isinstance(value, (str, int)) or value is None else pytest.approx(value, abs=1e-12))
    # no pixel is moved
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")
    assert len(plan) == 2 and not any(step in plan[0] for step in ("Aggregate", "Join", "Window", "Repartition"))
    with pytest.raises(Exception, match="stand in a row"):
        rg.region_metrics(methods.coalesce(1).orderBy("y", "x", "id", "condition"), by, [1], within=["condition", "id"]).collect()


def test_gathered_images_are_never_broadcast(tables):
    """The files of their cells say little of their size."""
    logits, labels = tables
    images = im.gather_images(labels, ["id"], {"label": F.col("label")})
    low = im.gather_images(logits, ["id", "condition"], {"logits": F.col("logits")})
    joins = [line for line in im.image_units(low, images, ["id", "condition"], "id", 3, 1)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "strategy=merge" in joins[0]


def test_seven_scores_are_complete(units):
    out = ev.evaluate_images(units, ["condition"], 3, 2.0, 1).collect()
    assert {r.score_name for r in out} == set(ALL_SCORES) and len(out) == 2 * 7 * 3
    sizes = {r.region: r.pixels for r in out if r.condition == "u" and r.score_name == "energy"}
    assert sizes["full"] == sizes["boundary"] + sizes["interior"] == 2 * 71
    with pytest.raises(ValueError, match="expected"):
        ev.evaluate_images(units.filter("distance > 1"), ["condition"], 3, 2.0, 1)


def test_broken_images_raise(tables):
    _, labels = tables
    for broken in (labels.filter("NOT (y = 2 AND x = 3)"), labels.unionByName(labels.limit(1))):
        with pytest.raises(Exception, match="full grid"):
            im.gather_images(broken, ["id"], {"label": F.col("label")}).collect()


def test_units_of_many_images_share_arrow_batches(spark):
    """Images are worked on by shape, not one frame each; the gather counts no distinct pixels."""
    cells = spark.range(40).select(F.floor(F.col("id") / 4).alias("s"), F.floor(F.col("id") % 4 / 2).alias("y"), (F.col("id") % 2).alias("x"), F.array(F.lit(0.0), F.lit(1.0)).alias("z"))
    low = im.gather_images(cells, ["s"], {"logits": F.col("z")})
    labels = im.gather_images(cells, ["s"], {"label": F.lit(0)})
    units = im.image_units(low, labels, ["s"], "s", 2, 1)
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "distinct" not in plan.lower()
    assert units.count() == 40
