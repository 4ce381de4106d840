import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import softmax as sm
from plumbline.operators import calibration as cal
from plumbline.operators import scoring as sc
from plumbline.plans import evaluation as ev
from plumbline.plans import fixtures as fx
from plumbline.sources import files as fl
from plumbline.sources import sinks
from plumbline.streaming import metrics as st


def bmp(image):
    h, w, _ = image.shape
    pad = (-3 * w) % 4
    body = b"".join(image[y, :, ::-1].tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def png(image):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    h, w = image.shape[:2]
    kind = 2 if image.ndim == 3 else 0
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 256, (3, 5, 3), np.uint8), "b": rng.integers(0, 256, (2, 2, 3), np.uint8), "m": rng.integers(0, 8, (4, 3), np.uint8)}
    (tmp_path / "a.bmp").write_bytes(bmp(images["a"]))
    (tmp_path / "b.PNG").write_bytes(png(images["b"]))
    (tmp_path / "m.png").write_bytes(png(images["m"]))
    return tmp_path, images


def test_pixels_are_red_green_blue(spark, folder):
    path, images = folder
    got = {(r.sample_id, r.y, r.x): (r.r, r.g, r.b) for r in fl.read_pixels(spark, str(path)).collect()}
    for name in "ab":
        image = images[name]
        for y in range(image.shape[0]):
            for x in range(image.shape[1]):
                assert got[(name, y, x)] == tuple(int(v) for v in image[y, x])
    assert all(got[("m", y, x)] == (int(images["m"][y, x]),) * 3 for y in range(4) for x in range(3))


def test_listing_and_hashes(spark, folder):
    path, _ = folder
    (path / "notes.txt").write_text("x")
    rows = {r.sample_id: r.sha for r in fl.file_hashes(spark, str(path), [".bmp", ".png"], upper=True).collect()}
    assert rows == {n: hashlib.sha256((path / f).read_bytes()).hexdigest().upper() for n, f in (("a", "a.bmp"), ("b", "b.PNG"), ("m", "m.png"))}
    assert [r.sample_id for r in fl.list_files(spark, str(path), [".bmp"]).collect()] == ["a"]
    (path / "a.png").write_bytes(b"x")
    with pytest.raises(Exception, match="repeated stem"):
        fl.list_files(spark, str(path), [".bmp", ".png"]).collect()


def test_log_and_parts(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append_experiment(spark, {"experiment_id": "one", "seed": 3}, log)
    sinks.append_experiment(spark, {"experiment_id": "two", "notes": None}, log)
    rows = {r.experiment_id: r for r in spark.read.parquet(log).collect()}
    assert rows["one"].seed == "3" and rows["two"].notes == "" and len(rows["one"]) == 24
    with pytest.raises(ValueError):
        sinks.append_experiment(spark, {"colour": 1}, log)
    table = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_parts(df, table, ["k"])
    sinks.write_parts(spark.createDataFrame([("b", 5)], "k string, v int"), table, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(table).collect()} == {("a", 1), ("b", 5)}


def test_resume_needs_complete_unique_results(spark):
    conditions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "condition string")
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 1)], "condition string, k int")
    assert {r.condition for r in sinks.resume_pending(conditions, stored, "condition", ["k"], 2).collect()} == {"b", "c", "d"}


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("-inf"), 2), (1.5, 3)], "v double, k int")
    assert {r.k: r.v for r in sinks.nan_to_null(df).collect()} == {1: None, 2: None, 3: 1.5}


def test_model_scoring(spark):
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    weights = ((np.arange(3)[:, None] * 7 + np.arange(4)[None, :] * 13) % 11 - 5) / 5.0
    for r in sc.score_with_model(df, sc.linear_predictor(3), "e", 3).collect():
        assert r.scores == pytest.approx(np.array(r.e) @ weights, abs=1e-5)
    for r in sc.embed(df, sc.linear_predictor(3), "e", 3).collect():
        assert np.linalg.norm(r.embedding) == pytest.approx(1.0)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_file_or_a_folder(spark, tmp_path, files):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("k"))
    df.repartition(files).write.parquet(str(tmp_path / "parts"))
    if files == 1:
        next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "t.parquet")
    else:
        (tmp_path / "parts").rename(tmp_path / "t.parquet")
    state = st.stream_table(spark, str(tmp_path), "t").groupBy("k").agg(F.sum("id").alias("s"))
    got = {r["k"]: r["s"] for r in st.run_state(state, ["k"], str(tmp_path / "run")).collect()}
    assert got == {k: sum(range(k, 60, 3)) for k in range(3)}


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rng = np.random.default_rng(14)
    rows = [("x" if i % 2 else "y", int(rng.integers(0, 3)), [float(v) for v in rng.normal(0, 2, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "condition string, label int, logits array<double>")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    by = ["condition"]
    state = st.run_state(st.calibration_state(stream, by, 3), [*by, "bin"], str(tmp_path / "run"))
    a = {r.condition: r for r in st.calibration_report(state, by).collect()}
    b = {r.condition: r for r in cal.merge_bins(cal.bin_sums(sm.unit_stats(df, 3), by), by).collect()}
    for name, row in b.items():
        assert a[name].pixels == row.pixels
        assert (a[name].nll, a[name].ece) == pytest.approx((row.nll, row.ece))


def test_prediction_parts_are_validated(spark):
    rows = [("val", "a", 1, 0, [0.1, 0.2], "h"), ("val", "a", 1, 1, [0.1, 0.2], "h"), ("val", "b", 1, None, [0.1], "h"), ("val", "b", 2, 0, [0.1, 0.2], "g")]
    df = spark.createDataFrame(rows, "split string, condition string, id int, label int, logits array<double>, sha string")
    got = {r.condition: tuple(r)[2:] for r in ev.validate_predictions(df, ["split", "condition"], "id", "sha", 2).collect()}
    assert got == {"a": (1, 1, 1, 0, 0), "b": (2, 0, 2, 1, 1)}
    with pytest.raises(ValueError):
        ev.check_complete(df, ["condition", "id"], 4)


def test_conditions_are_complete(spark, sf_dir):
    out = ev.evaluate_conditions(fx.scored(spark, sf_dir), ["condition"], ["score_a", "score_b"])
    ev.check_complete(out, ["condition", "score_name", "region"], 4 * 2 * 3)


def registry_rows():
    from plumbline.operators.pixels import CONDITIONS

    return [{"name": c.name, "degradation_type": c.degradation_type, "severity": c.severity, "parameters": {k: list(v) if isinstance(v, tuple) else v for k, v in c.parameters.items()}} for c in CONDITIONS]


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_condition_registry_files(spark, tmp_path, kind):
    import json

    from plumbline.operators.pixels import CONDITIONS
    from plumbline.sources import registry

    write = json.dumps if kind == "json" else pytest.importorskip("yaml").safe_dump

    def stored(rows, name):
        (tmp_path / name).write_text(write({"experiment": {"seed": 1}, "conditions": rows}), encoding="utf-8")
        return str(tmp_path / name)

    rows = registry_rows()
    assert registry.read_conditions(spark, stored(rows, f"all.{kind}")) == CONDITIONS
    for name, bad in {"twice": rows[:-1] + rows[:1], "more": rows + [dict(rows[1], name="extra")], "clean": [dict(rows[0], severity=1), *rows[1:]], "none": []}.items():
        with pytest.raises(ValueError, match="expected"):
            registry.read_conditions(spark, stored(bad, f"{name}.{kind}"))
