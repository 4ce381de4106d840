import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pixels as px
from plumbline.operators import regions as rg
from plumbline.operators import spatial as sp


def to_rows(spark, images, column="label", kind="long"):
    rows = [(s, y, x, image[y, x].item()) for s, image in images.items() for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, f"sample_id string, y int, x int, {column} {kind}")


def to_image(rows, name, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[name]
    assert not np.isnan(out).any()
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(12)
    return {"a": rng.integers(0, 3, (5, 7)), "b": rng.integers(0, 3, (6, 4)), "dot": np.array([[2]])}


def of(df, sample):
    return df.filter(F.col("sample_id") == sample).collect()


@pytest.mark.parametrize("radius", [1, 2])
def test_boundary_and_disagreement(spark, images, radius):
    df = to_rows(spark, images).withColumn("pred", F.col("label"))
    marked = sp.boundary_mask(df, ["sample_id"], radius)
    shares = sp.local_disagreement(df, ["sample_id"], radius=radius)
    for name, image in images.items():
        h, w = image.shape
        want = np.zeros((h, w), bool)
        share = np.zeros((h, w))
        padded = np.pad(image, radius, mode="edge")
        for y in range(h):
            for x in range(w):
                box = image[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                want[y, x] = box.max() != box.min()
                share[y, x] = 1 - (padded[y : y + 2 * radius + 1, x : x + 2 * radius + 1] == image[y, x]).mean()
        assert (to_image(of(marked, name), "boundary", (h, w)) == want).all()
        assert to_image(of(shares, name), "local_disagreement", (h, w)) == pytest.approx(share)


@pytest.mark.parametrize("size", [(3, 3), (11, 2), (10, 14)])
def test_nearest_resize(spark, images, size):
    out = sp.nearest_resize(to_rows(spark, images), ["sample_id"], *size, ["label"])
    for name, image in images.items():
        ys = np.floor((np.arange(size[0]) + 0.5) * image.shape[0] / size[0]).astype(int)
        xs = np.floor((np.arange(size[1]) + 0.5) * image.shape[1] / size[1]).astype(int)
        assert (to_image(of(out, name), "label", size) == image[np.ix_(ys, xs)]).all()


def line_weights(n, m):
    out = np.zeros((m, n))
    for t in range(m):
        s = max((t + 0.5) * n / m - 0.5, 0)
        i = int(s)
        out[t, i] += 1 - (s - i)
        out[t, min(i + 1, n - 1)] += s - i
    return out


@pytest.mark.parametrize("size", [(3, 3), (11, 2), (10, 14)])
def test_bilinear(spark, images, size):
    out = sp.bilinear_upsample(to_rows(spark, images), ["sample_id"], *size, {"v": F.col("label").cast("double")})
    for name, image in images.items():
        want = line_weights(image.shape[0], size[0]) @ image @ line_weights(image.shape[1], size[1]).T
        assert to_image(of(out, name), "v", size) == pytest.approx(want)


@pytest.mark.parametrize("kernel,sigma", [(3, 0.8), (7, 1.6)])
def test_blur_mirrors_the_border(spark, kernel, sigma):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (6, 9))
    out = sp.gaussian_blur(to_rows(spark, {"a": image}, "v"), ["sample_id"], kernel, sigma, ["v"])
    r = kernel // 2
    weights = np.array(sp.gaussian_weights(kernel, sigma))
    padded = np.pad(image.astype(float), r, mode="reflect")
    rows = np.array([[padded[y, x : x + kernel] @ weights for x in range(9)] for y in range(6 + 2 * r)])
    want = np.rint(np.array([[rows[y : y + kernel, x] @ weights for x in range(9)] for y in range(6)]))
    assert (to_image(out.collect(), "v", (6, 9)) == want).all()
    for bad in [(4, 1.0), (1, 1.0), (3, 0.0)]:
        with pytest.raises(ValueError):
            sp.gaussian_blur(to_rows(spark, {"a": image}, "v"), ["sample_id"], *bad, ["v"])


def test_hashes(spark):
    rng = np.random.default_rng(5)
    image = rng.random((32, 32))
    row = sp.dct_hash(to_rows(spark, {"a": image}, "v", "double"), ["sample_id"], "v", 32).first()
    n = np.arange(32)
    basis = np.array([math.sqrt((1 if u == 0 else 2) / 32) * np.cos((2 * n + 1) * u * math.pi / 64) for u in range(8)])
    flat = (basis @ image @ basis.T).ravel()
    bits = "".join("1" if c > np.median(flat[1:]) else "0" for c in flat)
    assert (row.hi, row.lo) == (int(bits[:32], 2), int(bits[32:], 2))
    grey = rng.integers(0, 256, (8, 9))
    got = sp.gradient_hash(to_rows(spark, {"a": grey}, "v"), ["sample_id"], "v", 9, 8).first().dhash
    want = int("".join("1" if b else "0" for b in (grey[:, 1:] > grey[:, :-1]).ravel()), 2)
    assert got % (1 << 64) == want


def test_masks(spark, images):
    other = dict(images, c=images["a"].copy())
    other["c"][0, 0] += 1
    pairs = spark.createDataFrame([("a", "a2"), ("a", "c"), ("a", "b")], "l string, r string")
    other["a2"] = images["a"]
    got = {r.r: (r.masks_identical, r.changed_mask_pixels) for r in sp.compare_masks(pairs, to_rows(spark, other), "sample_id", "l", "r").collect()}
    assert got == {"a2": (True, 0), "c": (False, 1), "b": (False, None)}
    shapes = sp.validate_shapes(to_rows(spark, images), to_rows(spark, {"a": images["a"] + 6, "b": images["a"]}), "sample_id", 8)
    result = {r.sample_id: (r.same_size, r.valid_labels) for r in shapes.collect()}
    assert result == {"a": (True, bool(images["a"].max() < 2)), "b": (False, True), "dot": (False, False)}


def test_strata_rows(spark, images):
    cells = to_rows(spark, images).withColumn("label", F.when((F.col("y") == 0) & (F.col("x") == 0), 255).otherwise(F.col("label")))
    out = rg.with_regions(cells, ["sample_id"], [1, 2], 3)
    assert out.count() == 2 * (35 + 24 + 1 - 3)


def test_worst_middle_best(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(9)], "id string, v double")
    rows = {(r.part, r.position): r.id for r in rg.worst_middle_best(df, "v", "id", 2).collect()}
    assert rows == {("worst", 1): "s0", ("worst", 2): "s1", ("middle", 1): "s3", ("middle", 2): "s4", ("best", 1): "s8", ("best", 2): "s7"}


def colours(spark):
    rng = np.random.default_rng(2)
    rows = [("s", y, x, *[int(v) for v in rng.integers(0, 256, 3)]) for y in range(6) for x in range(5)]
    return rows, spark.createDataFrame(rows, "sample_id string, y int, x int, r int, g int, b int")


def test_degradations_match_32_bit_arithmetic(spark):
    rows, df = colours(spark)
    image = np.array([r[3:] for r in rows], np.uint8)
    unit = image.astype(np.float32) / 255.0
    p = dict(red_scale=0.32, green_scale=0.63, blue_scale=0.88, blue_green_veil=0.08)
    veil = np.asarray([0.0, 0.55, 0.85], np.float32) * 0.08
    want = np.clip((unit * np.float32([0.32, 0.63, 0.88]) + veil) * 255.0, 0, 255).astype(np.uint8)
    got = px.degrade_color(df, **p).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b) for r in got] == [tuple(int(v) for v in w) for w in want]
    want = np.clip(np.power(np.clip(unit * 0.56, 0, 1), 1.2) * 255.0, 0, 255).astype(np.uint8)
    got = px.degrade_lowlight(df, exposure=0.56, gamma=1.2).orderBy("y", "x").collect()
    assert np.abs(np.array([(r.r, r.g, r.b) for r in got]) - want.astype(int)).max() <= 1
    digest = hashlib.sha256(b"s").digest()
    phases = [digest[i] / 255.0 * 2 * np.pi for i in (0, 1)]
    y, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    texture = (np.sin(2 * np.pi * x / 5 + phases[0]) + np.cos(2 * np.pi * y / 6 + phases[1]) + 2) / 4
    local = np.clip(0.68 - 0.08 * texture, 0.05, 1.0)[:, None]
    want = np.clip((unit * local + np.float32([0.18, 0.52, 0.70]) * (1 - local)) * 255.0, 0, 255).astype(np.uint8)
    got = px.degrade_turbidity(df, "sample_id", F.lit(6), F.lit(5), transmission=0.68, airlight_rgb=(0.18, 0.52, 0.70), spatial_variation=0.08)
    assert [(r.r, r.g, r.b) for r in got.orderBy("y", "x").collect()] == [tuple(int(v) for v in w) for w in want]


def test_conditions_keep_the_layout(spark):
    _, df = colours(spark)
    labelled = df.withColumn("label", F.col("x"))
    out = px.apply_conditions(labelled, "sample_id", px.CONDITIONS, F.lit(6), F.lit(5))
    assert {r.condition: r["count"] for r in out.groupBy("condition").count().collect()} == {c.name: 30 for c in px.CONDITIONS}
    assert out.filter("label <> x").isEmpty()
    clean = out.filter("condition = 'clean'").select("y", "x", "r", "g", "b")
    assert clean.exceptAll(df.select("y", "x", *[F.col(c).cast("long") for c in "rgb"])).isEmpty()
    report = px.changed_layout(df, out.filter("condition = 'blur_s2'"), ["sample_id", "y", "x"]).first()
    assert tuple(report) == (0, 0, 0)
    with pytest.raises(ValueError, match="unsupported"):
        px.apply_conditions(df, "sample_id", (px.Condition("x", "fog", 1),), F.lit(6), F.lit(5))


def test_user_transform_is_passed_in(spark):
    _, df = colours(spark)
    invert = {"invert": lambda: [F.lit(255) - F.col(c) for c in px.CHANNELS]}
    out = px.apply_conditions(df, "sample_id", (px.Condition("inv", "invert", 1),), F.lit(6), F.lit(5), invert)
    assert out.join(df.select("y", "x", F.col("r").alias("before")), ["y", "x"]).filter("r + before <> 255").isEmpty()


def test_condition_registry():
    rows = [dict(name=c.name, degradation_type=c.degradation_type, severity=c.severity, parameters=c.parameters) for c in px.CONDITIONS]
    assert px.load_conditions(rows) == px.CONDITIONS and len(px.CONDITIONS) == 13
    for bad in (rows[1:], rows[:-1] + [rows[0]], [dict(rows[0], severity=1)] + rows[1:]):
        with pytest.raises(ValueError):
            px.load_conditions(bad)
    with pytest.raises(ValueError):
        px.attenuated(1.5, 0.5, 0.5, 0.1)


def test_palette_round_trip(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "label int")
    back = px.rgb_to_class(px.class_to_rgb(df))
    assert back.filter("label <> class_id").isEmpty()
    with pytest.raises(Exception, match="invalid class"):
        px.class_to_rgb(spark.createDataFrame([(8,)], "label int")).collect()
    odd = spark.createDataFrame([(0, 0, 3), (255, 0, 255), (200, 100, 128)], "r int, g int, b int")
    assert sorted(r.class_id for r in px.rgb_to_class(odd).collect()) == [5, 255, 255]
    assert [(r.class_id, r.non_exact) for r in px.rgb_to_class_threshold(odd).orderBy("r").collect()] == [(0, True), (5, True), (5, False)]
    with pytest.raises(ValueError, match="unknown"):
        px.rgb_to_class(odd, strict=True)
