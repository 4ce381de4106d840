"""Per-unit probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.views import GRID, GRID_IGNORE, LOGIT, MOSAIC, PX, mosaic_scores, r6, softmax, units, with_
from plumbline.functions import softmax as sm
from plumbline.functions.numerics import r6 as R
from plumbline.operators.scoring import dot_scores
from plumbline.plans import fixtures as fx

C = fx.CLASSES
T = 3.0
RULES = [("raw", None, 1.0), ("clean_global", None, 3.0), ("pooled", None, 3.5), ("per_degradation", "clean", 3.0), ("per_degradation", "drop", 2.5), ("per_degradation", "gain", 4.5)]
RULE_SCHEMA = "method string, degradation_type string, temperature double"
METHODS = ["raw", "clean_global", "pooled", "per_degradation"]
RULES_SQL = "rules(method, degradation_type, temperature) AS (VALUES " + ", ".join(
    f"('{m}', {'NULL' if d is None else repr(d)}, {t}::DOUBLE)" for m, d, t in RULES
) + ")"


def rules(spark):
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def exploded(df, column, name="p"):
    return df.select("vec_id", "condition", F.posexplode(column).alias("k", name)).withColumn(name, R(name))


def q_valid_units(spark, sf):
    return sm.valid_units(fx.grid(spark, sf, ignore=True), 8).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def q_prob_sum_check(spark, sf):
    probs = sm.softmax(fx.predictions(spark, sf), C)
    gap = sm.probability_gap()
    return probs.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), (F.max(gap) <= 1e-4).alias("sums_to_one"))


def q_softmax(spark, sf):
    return exploded(sm.softmax(fx.predictions(spark, sf), C), "probs")


def q_scale_logits(spark, sf):
    return exploded(sm.scale_logits(fx.predictions(spark, sf), 2.5, C), "scaled", "z")


def q_predict(spark, sf):
    return fx.predictions(spark, sf).select("vec_id", "condition", sm.first_argmax(sm.logit_items(C)).alias("pred"))


def q_scores(spark, sf):
    return sm.uncertainty_scores(fx.predictions(spark, sf), C, T)


def single_score(name):
    def build(spark, sf):
        return q_scores(spark, sf).select("vec_id", "condition", R(name).alias(name))

    return build


def q_scores_long(spark, sf):
    """All seven scores of every valid pixel and condition."""
    units = sm.uncertainty_scores(sm.valid_units(fx.mosaic_units(spark, sf), 8), 8, T)
    long = sm.long_scores(units.select("sample_id", "condition", "y", "x", *sm.ALL_SCORES), sm.ALL_SCORES)
    return long.select("sample_id", "condition", "y", "x", "score_name", (F.round(F.col("score").cast("double"), 4) + 0.0).alias("score"))


def q_error_map(spark, sf):
    df = fx.predictions(spark, sf)
    scored = sm.uncertainty_scores(df, C, 1.0)
    return scored.select(
        "vec_id",
        "condition",
        "pred",
        R(1.0 - F.col("raw_msp")).alias("confidence"),
        R("entropy").alias("entropy"),
        (F.col("pred") == F.col("label")).alias("correct"),
    )


def q_temperature_lookup(spark, sf):
    keyed = fx.predictions(spark, sf).select("vec_id", "condition", "degradation_type")
    return (
        sm.add_temperatures(keyed, rules(spark), METHODS)
        .groupBy("method", "condition", "temperature")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def q_argmax_invariance(spark, sf):
    df = sm.add_temperatures(fx.predictions(spark, sf), rules(spark), METHODS)
    raw = df.withColumn("raw", sm.first_argmax(sm.logit_items(C)))
    scaled = sm.scale_logits(raw, "temperature", C)
    changed = F.col("raw") != sm.first_argmax(sm.logit_items(C, "scaled"))
    return scaled.groupBy("method", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("changed"))


def q_batch_score(spark, sf):
    return dot_scores(fx.table(spark, sf, "embeddings"), fx.DIMS).select(
        "vec_id", F.posexplode("scores").alias("k", "score")
    ).withColumn("score", F.round(F.col("score").cast("double"), 4) + F.lit(0.0))


STATS = units()
SCALED = with_(LOGIT, softmax("1e0"), softmax(f"{T}e0", name="cal"), "{body}")
SECOND = """two AS (SELECT vec_id, condition, max(z) z1, max(p) p1,
  list_sort(list(z), 'DESC')[2] z2, list_sort(list(p), 'DESC')[2] p2, ln(sum(exp(z/3e0 - mx))) + max(mx) lse,
  -sum(p * ln(greatest(p, 1.1920928955078125e-07))) h FROM cal GROUP BY vec_id, condition)"""
RAW = "raw AS (SELECT vec_id, condition, max(p) p1 FROM soft GROUP BY vec_id, condition)"
EXPR = {
    "raw_msp": "1 - raw.p1",
    "calibrated_msp": "1 - two.p1",
    "entropy": "h",
    "probability_margin": "1 - (two.p1 - p2)",
    "logit_margin": "-(z1 - z2)/3e0",
    "energy": "-lse",
}


def score_sql(body):
    return with_(LOGIT, softmax("1e0"), softmax(f"{T}e0", name="cal"), SECOND, RAW, body)


ENTRIES = {
    "valid_units": (q_valid_units, with_(PX, GRID, GRID_IGNORE, "SELECT label, count(*) n FROM gridi WHERE label<>255 AND label BETWEEN 0 AND 7 GROUP BY label")),
    "prob_sum_check": (q_prob_sum_check, with_(LOGIT, softmax(), "SELECT condition, count(*) n, max(abs(s-1)) <= 1e-4 AS sums_to_one FROM (SELECT vec_id, condition, sum(p) s FROM soft GROUP BY ALL) GROUP BY condition")),
    "softmax": (q_softmax, with_(LOGIT, softmax(), f"SELECT vec_id, condition, k, {r6('p')} p FROM soft")),
    "scale_logits": (q_scale_logits, with_(LOGIT, f"SELECT vec_id, condition, k, {r6('z/2.5e0')} z FROM logit")),
    "predict": (q_predict, with_(LOGIT, softmax(), "SELECT vec_id, condition, min(k) FILTER (WHERE z=mz) AS pred FROM soft GROUP BY vec_id, condition")),
    **{
        f"score_{n}": (single_score(n), score_sql(f"SELECT vec_id, condition, {r6(e)} AS {n} FROM two JOIN raw USING (vec_id, condition)"))
        for n, e in EXPR.items()
    },
    "scores_long": (
        q_scores_long,
        with_(*MOSAIC, *mosaic_scores(T, 12), "SELECT img AS sample_id, condition, CAST(y AS INT) y, CAST(x AS INT) x, score_name, round(CAST(score AS DOUBLE), 4) + 0e0 AS score FROM ms"),
    ),
    "error_map": (
        q_error_map,
        with_(
            LOGIT,
            softmax(),
            "e AS (SELECT vec_id, condition, label, min(k) FILTER (WHERE z=mz) pred, max(p) c, -sum(p*ln(greatest(p,1.1920928955078125e-07))) h FROM soft GROUP BY vec_id, condition, label)",
            f"SELECT vec_id, condition, pred, {r6('c')} confidence, {r6('h')} entropy, pred=label AS correct FROM e",
        ),
    ),
    "temperature_lookup": (
        q_temperature_lookup,
        with_(LOGIT, RULES_SQL, "SELECT r.method, u.condition, r.temperature, count(*) n FROM (SELECT DISTINCT vec_id, condition, degradation_type FROM logit) u JOIN rules r ON r.degradation_type IS NULL OR r.degradation_type = u.degradation_type GROUP BY ALL"),
    ),
    "argmax_invariance": (
        q_argmax_invariance,
        with_(
            LOGIT,
            RULES_SQL,
            "sc AS (SELECT l.vec_id, l.condition, l.k, l.z, l.z/r.temperature s, r.method FROM logit l JOIN rules r ON r.degradation_type IS NULL OR r.degradation_type = l.degradation_type)",
            "am AS (SELECT vec_id, condition, method, arg_max(k, z) a, arg_max(k, s) b FROM sc GROUP BY ALL)",
            "SELECT method, condition, count(*) n, count(*) FILTER (WHERE a<>b) AS changed FROM am GROUP BY ALL",
        ),
    ),
    "batch_score": (
        q_batch_score,
        with_(PX, f"SELECT vec_id, CAST(k AS INT) k, round(sum(v*(((pos*7+k*13)%11)-5)/5e0), 4) + 0e0 AS score FROM px CROSS JOIN range(4) t(k) GROUP BY vec_id, k"),
    ),
}
