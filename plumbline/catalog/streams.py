"""Streaming and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.calibration import CM, base_ctes, cw_ctes, ece_ctes, rounded, unit_sql
from plumbline.catalog.manifests import DIGEST, SPLIT, with_row_split
from plumbline.catalog.ranking import SCORES
from plumbline.catalog.views import LOGIT, MANIFEST, SCORED, r6, softmax, units, with_
from plumbline.functions import softmax as sm
from plumbline.operators import ranking as rk
from plumbline.plans import fixtures as fx
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import sinks
from plumbline.streaming import metrics as st

C = fx.CLASSES
BY = ["condition"]


def stream_predictions(spark, sf):
    return fx.predictions(spark, sf, st.stream_table(spark, sf, "embeddings"))


def q_calibration_stream(spark, sf):
    state = st.run_state(st.calibration_state(stream_predictions(spark, sf), BY, C), [*BY, "slot", "bin"])
    return rounded(st.calibration_report(state, BY), "nll", "brier_score", "ece", "mean_classwise_ece")


def q_confusion_stream(spark, sf):
    df = stream_predictions(spark, sf).withColumn("pred", sm.first_argmax(sm.logit_items(C)))
    return st.run_state(st.confusion_state(df, BY, C), [*BY, "target", "prediction"])


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_write_split(spark, sf):
    rows = with_row_split(fx.manifest(spark, sf)).select("sample_id", "sha", "mask_sha", "width", "split")
    return sinks.write_split(rows, scratch(spark, "split"), ["sample_id", "sha", "mask_sha", "width"])


def q_write_atomic(spark, sf):
    """Store all conditions, then replace one of them and read the table back."""
    path = scratch(spark, "metrics")
    groups = rk.score_groups(fx.scored(spark, sf), ["condition"], "score_c").select("condition", "w", "e")
    sinks.write_parts(groups, path, ["condition"])
    sinks.write_parts(groups.filter(F.col("condition") == "c1").withColumn("w", F.col("w") + 1000), path, ["condition"])
    return spark.read.parquet(path).groupBy("condition").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w"), F.sum("e").alias("e"))


def q_append_experiment(spark, sf):
    path = scratch(spark, "log")
    for name in SCORES:
        best = rk.ranking_metrics(fx.scored(spark, sf), [], name).select("pixels").first()
        sinks.append_experiment(spark, {"experiment_id": name, "epochs": best["pixels"]}, path)
    return spark.read.parquet(path).select("experiment_id", "epochs", "notes")


ENTRIES = {
    "calibration_stream": (
        q_calibration_stream,
        unit_sql(f"SELECT condition, pixels, {r6('nll')} nll, {r6('brier_score')} brier_score, {r6('ece')} ece, {r6('mean_classwise_ece')} mean_classwise_ece FROM base JOIN ece USING (condition) JOIN cwm USING (condition)", base_ctes("condition"), ece_ctes("condition"), cw_ctes("condition"), "cwm AS (SELECT condition, avg(classwise_ece) mean_classwise_ece FROM cw GROUP BY condition)"),
    ),
    "confusion_stream": (q_confusion_stream, unit_sql("SELECT condition, t AS target, CAST(p AS INT) AS prediction, n FROM cm", CM.format(by="condition", src="units", top=9))),
    "write_split": (q_write_split, with_(MANIFEST, SPLIT, f"SELECT split, count(*) AS rows, bit_xor({DIGEST}) AS digest, CAST(sum({DIGEST} % 1000000007) AS BIGINT) AS folded_sum FROM spl GROUP BY split")),
    "write_atomic": (
        q_write_atomic,
        with_(SCORED, "g AS (SELECT condition, count(*) + CASE WHEN condition='c1' THEN 1000 ELSE 0 END w, sum(err) e FROM scored GROUP BY condition, score_c)", "SELECT condition, count(*) AS rows, CAST(sum(w) AS BIGINT) w, CAST(sum(e) AS BIGINT) e FROM g GROUP BY condition"),
    ),
    "append_experiment": (q_append_experiment, with_(SCORED, "SELECT s.k AS experiment_id, CAST((SELECT count(*) FROM scored) AS VARCHAR) AS epochs, '' AS notes FROM (VALUES ('score_a'),('score_b'),('score_c')) s(k)")),
}
