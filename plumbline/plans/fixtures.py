"""Views over the driver tables with the shape of the library's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import images

CLASSES = 10
DIMS = 64

# Fixed values: (condition, degradation_type, severity, drop_n, gain).
CONDITIONS = [
    ("clean", "clean", 0, 0, 1.0),
    ("drop_s1", "drop", 1, 1, 1.0),
    ("drop_s2", "drop", 2, 2, 1.0),
    ("drop_s3", "drop", 3, 3, 1.0),
    ("gain_s1", "gain", 1, 0, 1.25),
    ("gain_s2", "gain", 2, 0, 1.5),
    ("gain_s3", "gain", 3, 0, 2.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row per document; the text stands in for the image bytes."""
    docs = table(spark, sf_dir, "documents")
    repaired = F.col("doc_id") % 40 == 0
    quantized = F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("n_chars") * (F.col("doc_id") % 10) / F.lit(20.0)))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("sample_id"),
        F.when(F.col("source").isin("src18", "src19"), "test").otherwise("train_val").alias("part"),
        F.sha2("text", 256).alias("sha"),
        F.md5(F.concat("lang", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b"))).alias("mask_sha"),
        F.col("n_chars").alias("width"),
        F.lit(1).cast("bigint").alias("height"),
        F.col("n_chars").alias("original_mask_width"),
        F.when(repaired, 2).otherwise(1).cast("bigint").alias("original_mask_height"),
        F.when(repaired, 1).otherwise(0).cast("bigint").alias("mask_resized_nearest"),
        F.coalesce(quantized, F.lit(0)).cast("bigint").alias("non_exact"),
    )


def _centroids(embeddings: DataFrame) -> DataFrame:
    """Class-by-dimension matrix of mean vectors (C x D doubles) per vector length."""
    cells = embeddings.select(F.size("embedding").alias("dims"), "label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("dims", "label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))

    def ordered(key, value):
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value])

    per_class = means.groupBy("dims", "label").agg(ordered("pos", "m").alias("mean"))
    return per_class.groupBy("dims").agg(ordered("label", "mean").alias("centroids"))


def predictions(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> DataFrame:
    """V2: centroid-classifier logits under seven conditions.

    ``units`` replaces the scored rows, e.g. by a stream; the centroids always
    come from the stored table.
    """
    embeddings = table(spark, sf_dir, "embeddings")
    units = embeddings if units is None else units
    vector = F.transform("embedding", lambda v: v.cast("double"))
    scored = (
        units.withColumn("dims", F.size("embedding"))
        .join(F.broadcast(_centroids(embeddings)), "dims")
        .withColumn("vector", vector)
    )

    def dots(drop_n):
        def one(mean):
            products = F.zip_with("vector", mean, lambda x, m: x * m)
            kept = F.filter(products, lambda p, i: i % 8 >= drop_n) if drop_n else products
            return F.aggregate(kept, F.lit(0.0), lambda s, p: s + p)

        return F.transform("centroids", one)

    dotted = scored.select("vec_id", "label", *[dots(n).alias(f"d{n}") for n in range(4)])
    rows = [
        F.struct(
            F.lit(name).alias("condition"),
            F.lit(kind).alias("degradation_type"),
            F.lit(severity).alias("severity"),
            F.lit(200.0 * gain).alias("factor"),
            F.col(f"d{drop_n}").alias("dots"),
        )
        for name, kind, severity, drop_n, gain in CONDITIONS
    ]
    fanned = dotted.select("vec_id", "label", F.inline(F.array(*rows)))
    return fanned.select(
        "vec_id",
        F.concat(F.lit("s"), F.col("vec_id") % 25).alias("sample_id"),
        F.when(F.col("vec_id") % 2 == 0, "calibration").otherwise("val").alias("split"),
        "condition",
        "degradation_type",
        "severity",
        "label",
        F.transform("dots", lambda d: F.round(F.col("factor") * d, 6)).alias("logits"),
    )


def grid(spark: SparkSession, sf_dir: str, ignore: bool = False) -> DataFrame:
    """V3: each embedding as an 8x8 grid of 4x4 label blocks, with a prediction."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "embedding", F.posexplode("embedding").alias("pos", "v")
    )
    y, x = F.floor(F.col("pos") / 8).cast("int"), (F.col("pos") % 8).cast("int")
    corner = (F.floor(y / 4) * 32 + F.floor(x / 4) * 4).cast("int")
    block = F.get("embedding", corner).cast("double")
    label = F.least(F.lit(7), F.greatest(F.lit(0), F.floor((block + 0.25) * 16))).cast("int")
    v = F.col("v").cast("double")
    limit = F.when(x.isin(3, 4) | y.isin(3, 4), 0.05).otherwise(0.15)
    pred = ((label + F.when(v > limit, 1).otherwise(0)) % 8).cast("int")
    out = cells.select(
        "sample_id",
        y.alias("y"),
        x.alias("x"),
        v.alias("v"),
        label.alias("label"),
        pred.alias("pred"),
        (0.3 + 0.65 * F.least(F.lit(1.0), F.abs(v) * 4)).alias("conf"),
        "pos",
    )
    if ignore:
        hidden = (F.col("sample_id") * 64 + F.col("pos")) % 97 == 0
        out = out.withColumn("label", F.when(hidden, 255).otherwise(F.col("label")))
    return out.drop("pos")


def grid_logits(cells: DataFrame) -> DataFrame:
    """Log-probabilities of V3: ``conf`` on the prediction, the rest shared."""
    other = F.log((1.0 - F.col("conf")) / 7.0)
    items = [F.when(F.col("pred") == k, F.log("conf")).otherwise(other) for k in range(8)]
    return cells.withColumn("logits", F.array(*items))


def mosaic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: labels of four V3 grids as one image of 16 x 16, some of them ignored."""
    tile = F.col("sample_id") % 4
    y, x = F.floor(tile / 2) * 8 + F.col("y"), (tile % 2) * 8 + F.col("x")
    return grid(spark, sf_dir, ignore=True).select(F.floor(F.col("sample_id") / 4).alias("sample_id"), y.alias("y"), x.alias("x"), "label")


def mosaic_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: logits of every other cell of the same image, 8 x 8, under seven conditions."""
    cells = grid_logits(grid(spark, sf_dir)).filter((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    tile = F.col("sample_id") % 4
    y, x = F.floor(tile / 2) * 4 + F.col("y") / 2, (tile % 2) * 4 + F.col("x") / 2
    low = cells.select(F.floor(F.col("sample_id") / 4).alias("sample_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), "logits")
    rows = [F.struct(F.lit(name).alias("condition"), F.lit(drop_n).alias("drop_n"), F.lit(gain).alias("gain")) for name, _, _, drop_n, gain in CONDITIONS]
    fanned = low.select("*", F.inline(F.array(*rows)))
    kept = F.when(F.col("x") % 8 < F.col("drop_n"), 0.0).otherwise(F.col("gain"))
    return fanned.select("sample_id", "condition", "y", "x", F.transform("logits", lambda z: F.round(kept * z, 6)).alias("logits"))


#: Farthest distance to another label that V8 measures, and digits of its upsampled logits (sums of exact sixteenths of 1e-6).
REACH, DIGITS = 5, 10


def mosaic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: every pixel of every condition with upsampled logits, local disagreement and distance to the next label."""
    logits = images.gather_images(mosaic_logits(spark, sf_dir), ["sample_id", "condition"], {"logits": F.col("logits")})
    labels = images.gather_images(mosaic_labels(spark, sf_dir), ["sample_id"], {"label": F.col("label")})
    return images.image_units(logits, labels, ["sample_id", "condition"], "sample_id", 8, REACH, DIGITS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: scored units with heavy ties."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    wrong = (F.col("event_type") == "error") | ((cents > 6000) & (F.col("event_id") % 3 == 0))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id")).alias("sample_id"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("condition"),
        F.when(F.col("event_id") % 7 == 0, "boundary").otherwise("interior").alias("region"),
        (F.floor(cents / 50) / 1000.0).cast("float").alias("score_a"),
        ((F.col("event_id") % 10) / 9.0).cast("float").alias("score_b"),
        ((F.col("user_id") % 50) / 50.0).cast("float").alias("score_c"),
        F.when(wrong, 1).otherwise(0).cast("bigint").alias("err"),
    )


def scores_long(df: DataFrame) -> DataFrame:
    """V4 in long form: one row per (unit, score name)."""
    pairs = [F.struct(F.lit(n).alias("score_name"), F.col(n).alias("score")) for n in ("score_a", "score_b", "score_c")]
    return df.select("event_id", "sample_id", "condition", "region", "err", F.inline(F.array(*pairs)))


def _pack(bits: Column) -> Column:
    """Bits to an integer, the first one most significant."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1) + b.cast("bigint"))


def _shift(value: int, places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("bigint"), places.cast("int"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: 64-bit hashes as two halves, with planted near copies in ``test``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e")
    )
    median = F.element_at(F.array_sort(F.slice("e", 2, DIMS - 1)), DIMS // 2)
    rises = F.zip_with(F.slice("e", 1, DIMS - 1), F.slice("e", 2, DIMS - 1), lambda a, b: b > a)
    steps = F.filter(rises, lambda up, i: i % 8 < 7)
    originals = (
        vectors.withColumn("median", median)
        .withColumn("bits", F.zip_with("e", F.array_repeat("median", DIMS), lambda v, m: v > m))
        .withColumn("steps", F.concat(F.array_repeat(F.lit(False), 8), steps))
        .select(
            "vec_id",
            F.lit("train_val").alias("part"),
            "e",
            _pack(F.slice("bits", 1, 32)).alias("hi"),
            _pack(F.slice("bits", 33, 32)).alias("lo"),
            _pack(F.slice("steps", 1, 32)).alias("dhi"),
            _pack(F.slice("steps", 33, 32)).alias("dlo"),
        )
    )
    flip = _shift(1, F.floor(F.col("vec_id") / 10) % 6) - 1
    zeroed = F.transform("e", lambda v, i: F.when(i == 1, F.lit(0.0)).otherwise(v))
    copies = originals.filter(F.col("vec_id") % 10 == 0).select(
        (F.col("vec_id") + 1_000_000).alias("vec_id"),
        F.lit("test").alias("part"),
        zeroed.alias("e"),
        "hi",
        F.col("lo").bitwiseXOR(flip).alias("lo"),
        "dhi",
        F.col("dlo").bitwiseXOR(_shift(7, F.col("vec_id") % 3)).alias("dlo"),
    )
    return originals.unionByName(copies).withColumn("sample_id", F.concat(F.lit("v"), F.lpad("vec_id", 8, "0")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: a training-history table (one row per epoch)."""
    purchase = F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.dayofmonth("ts").alias("epoch"))
        .agg(F.avg("value").alias("train_loss"), F.count(F.lit(1)).alias("n"), purchase.alias("share"))
        .select(
            F.col("epoch").cast("bigint").alias("epoch"),
            "train_loss",
            "n",
            F.when(F.col("epoch") % 5 == 0, F.col("share")).alias("val_metric"),
        )
    )


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: colour pixels, mostly exact palette corners."""
    exact = F.col("pos") % 4 != 0
    code = F.col("label") % 8

    def channel(bit, a, b):
        noisy = (F.col("pos") * a + F.col("vec_id") * b) % 256
        return F.when(exact, F.shiftright(code, bit).bitwiseAND(1) * 255).otherwise(noisy).cast("bigint")

    return px(spark, sf_dir).select(
        F.col("vec_id").alias("sample_id"),
        F.floor(F.col("pos") / 8).cast("bigint").alias("y"),
        (F.col("pos") % 8).cast("bigint").alias("x"),
        channel(2, 37, 11).alias("r"),
        channel(1, 53, 7).alias("g"),
        channel(0, 91, 13).alias("b"),
        (F.col("label") % 8).cast("bigint").alias("label"),
    )
