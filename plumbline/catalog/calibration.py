"""Segmentation and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.scores import METHODS, RULES_SQL, rules
from plumbline.catalog.views import GRID, GRID_IGNORE, HISTORY, LOGIT, PX, r6, softmax, units, with_
from plumbline.functions import softmax as sm
from plumbline.functions.numerics import r6 as R
from plumbline.operators import calibration as cal
from plumbline.operators import comparisons as cmp
from plumbline.operators import segmentation as seg
from plumbline.plans import evaluation as ev
from plumbline.plans import fixtures as fx

C = fx.CLASSES
U = with_(LOGIT, softmax(), units(), "{}")


def rounded(df, *names):
    return df.select(*[R(c).alias(c) if c in names else F.col(c) for c in df.columns])


def unit_rows(spark, sf, keep=False):
    return sm.unit_stats(fx.predictions(spark, sf), C, keep=keep)


def q_confusion_matrix(spark, sf):
    df = fx.predictions(spark, sf).withColumn("pred", sm.first_argmax(sm.logit_items(C)))
    return seg.confusion_matrix(df, ["condition"], C)


def predicted(spark, sf):
    return fx.predictions(spark, sf).withColumn("pred", sm.first_argmax(sm.logit_items(C)))


SEG = ["pixel_accuracy", "mean_accuracy", "miou", "mean_dice"]


def q_segmentation_metrics(spark, sf):
    return rounded(seg.segmentation_metrics(predicted(spark, sf), ["condition"], C), *SEG)


def q_per_class_metrics(spark, sf):
    return rounded(seg.per_class_table(predicted(spark, sf), ["condition"], C), "iou", "dice", "accuracy")


def q_per_sample_miou(spark, sf):
    cells = fx.grid(spark, sf, ignore=True)
    return rounded(seg.segmentation_metrics(cells, ["sample_id"], 8).select("sample_id", "miou"), "miou")


def q_nll(spark, sf):
    exact = cal.nll(unit_rows(spark, sf), ["condition"])
    return rounded(exact, "nll")


def q_brier(spark, sf):
    return rounded(cal.brier(unit_rows(spark, sf), ["condition"]), "brier_score")


def q_ece(edges):
    return lambda spark, sf: rounded(cal.ece(unit_rows(spark, sf), ["condition"], edges=edges), "ece")


def q_reliability_bins(spark, sf):
    return rounded(cal.reliability_bins(unit_rows(spark, sf), ["condition"]), "mean_confidence", "accuracy")


def q_classwise_ece(spark, sf):
    return rounded(cal.classwise_ece(unit_rows(spark, sf, keep=True), ["condition"], C), "classwise_ece")


def q_classwise_ece_right(spark, sf):
    return rounded(cal.classwise_ece(unit_rows(spark, sf, keep=True), ["condition"], C, edges="right"), "classwise_ece")


def q_calibration_summary(spark, sf):
    out = cal.calibration_summary(unit_rows(spark, sf, keep=True), ["condition"], C)
    return rounded(out, "nll", "brier_score", "ece", "mean_classwise_ece")


def q_confidence_summary(spark, sf):
    out = cal.confidence_summary(unit_rows(spark, sf), ["condition"])
    return rounded(out, "mean_confidence", "mean_correct_confidence", "mean_wrong_confidence")


def q_weighted_loss(spark, sf):
    weekly = fx.history(spark, sf).withColumn("week", F.floor(F.col("epoch") / 7))
    return rounded(cal.weighted_loss(weekly, ["week"], "train_loss", "n"), "loss")


def q_per_image(spark, sf):
    df = sm.add_temperatures(fx.predictions(spark, sf), rules(spark), METHODS)
    out = cal.per_sample_calibration(df, ["condition", "sample_id", "method"], C, "temperature")
    return rounded(out, "nll", "brier_score", "ece")


def q_condition_splits(spark, sf):
    out = ev.evaluate_condition_splits(fx.predictions(spark, sf), ["condition", "split"], "vec_id", C)
    return rounded(out, *[c for c in out.columns if c not in ("condition", "split", "pixels")])


def q_condition_classes(spark, sf):
    out = ev.evaluate_condition_classes(fx.predictions(spark, sf), ["condition", "split"], C)
    return rounded(out, "iou", "dice", "accuracy", "classwise_ece")


def q_evaluate_temperatures(spark, sf):
    df = sm.add_temperatures(fx.predictions(spark, sf), rules(spark), METHODS)
    out = ev.evaluate_condition_splits(df, ["method", "condition", "split"], "vec_id", C, "temperature")
    return rounded(out, *[c for c in out.columns if c not in ("method", "condition", "split", "pixels")])


def method_metrics(spark, sf):
    df = sm.add_temperatures(fx.predictions(spark, sf), rules(spark), METHODS)
    u = sm.unit_stats(df, C, "temperature")
    by = ["method", "condition"]
    return cal.merge_bins(cal.bin_sums(u, by), by)


def q_condition_deltas(spark, sf):
    out = cmp.condition_deltas(method_metrics(spark, sf), "clean_global", ["condition"], ["nll", "brier_score", "ece"])
    return rounded(out, "delta")


def q_classwise_delta(spark, sf):
    df = sm.add_temperatures(fx.predictions(spark, sf), rules(spark), METHODS)
    u = sm.unit_stats(df, C, "temperature", keep=True)
    per_class = cal.classwise_ece(u, ["method", "condition"], C)
    out = cmp.pivot_delta(per_class, ["condition", "class_id"], "method", "classwise_ece", "clean_global", "raw")
    return rounded(out, "clean_global", "raw", "delta")


def q_reconcile(spark, sf):
    metrics = method_metrics(spark, sf)
    left = metrics.filter(F.col("method") == "raw").drop("method")
    right = metrics.filter(F.col("method") == "per_degradation").drop("method")
    out = cmp.reconcile(left, right, ["condition"], {"nll": 10.0, "brier_score": 1.0, "ece": 1e-3})
    return rounded(out, "max_difference", "tolerance")


def q_severity_series(spark, sf):
    by = ["split", "degradation_type", "severity"]
    u = unit_rows(spark, sf)
    out = cmp.severity_series(cal.merge_bins(cal.bin_sums(u, by), by).select(*by, "ece", "nll"), ["drop", "gain"])
    return rounded(out, "ece", "nll")


def q_validate_predictions(spark, sf):
    df = fx.predictions(spark, sf).withColumn("provenance", F.sha2("degradation_type", 256))
    return ev.validate_predictions(df, ["split", "condition"], "vec_id", "provenance", C)


DIV = "CASE WHEN {1} > 0 THEN {0}::DOUBLE/{1} END"
CM = "cm AS (SELECT {by}, label AS t, pred AS p, count(*) n FROM {src} WHERE label BETWEEN 0 AND {top} AND pred BETWEEN 0 AND {top} GROUP BY {by}, label, pred)"
PC = """pc AS (SELECT {by}, class_id, sum(truth) truth, sum(guess) guess, sum(hit) hit FROM (
  SELECT {by}, t AS class_id, n AS truth, 0 AS guess, CASE WHEN t=p THEN n ELSE 0 END AS hit FROM cm
  UNION ALL SELECT {by}, p, 0, n, 0 FROM cm) GROUP BY {by}, class_id)"""
IOU = "hit::DOUBLE/nullif(truth+guess-hit,0)"
DICE = "2e0*hit/nullif(truth+guess,0)"
ACC = "hit::DOUBLE/nullif(truth,0)"
SEGCOLS = f"sum(hit)::DOUBLE/sum(truth) AS pixel_accuracy, avg({ACC}) AS mean_accuracy, avg({IOU}) AS miou, avg({DICE}) AS mean_dice"


def seg_ctes(by, src="units", top=9):
    return [CM.format(by=by, src=src, top=top), PC.format(by=by)]


def rsel(keys, names):
    return keys + ", " + ", ".join(f"{r6(n)} AS {n}" for n in names)


NLL12 = "-ln(greatest(py, 1e-12))"
LEFT = "least(floor(conf*15), 14)"
RIGHT = "greatest(ceil(conf*15)-1, 0)"


def ece_ctes(by, src="units", edge=LEFT, name="ece"):
    return f"{name} AS (SELECT {by}, sum(abs(h-c))/sum(n) AS ece FROM (SELECT {by}, {edge} b, sum(conf) c, sum(correct) h, count(*) n FROM {src} GROUP BY {by}, {edge}) GROUP BY {by})"


def cw_ctes(by, src="soft", edge="least(floor(p*15), 14)", name="cw"):
    return f"{name} AS (SELECT {by}, k AS class_id, sum(abs(h-c))/sum(n) AS classwise_ece FROM (SELECT {by}, k, {edge} b, sum(p) c, count(*) FILTER (WHERE k=label) h, count(*) n FROM {src} GROUP BY {by}, k, {edge}) GROUP BY {by}, k)"


def base_ctes(by, src="units"):
    return f"base AS (SELECT {by}, count(*) pixels, avg({NLL12}) nll, avg(brier) brier_score, avg(conf) mean_confidence, avg(conf) FILTER (WHERE correct=1) mean_correct_confidence, avg(conf) FILTER (WHERE correct=0) mean_wrong_confidence FROM {src} GROUP BY {by})"


def error_ctes(by, src="units", unit="vec_id"):
    """AUROC by mid-ranks and the plain risk-coverage area, from row ranks."""
    return [
        f"""rk AS (SELECT {by}, s, {unit}, 1-correct AS err, row_number() OVER (PARTITION BY {by} ORDER BY s, {unit}) i,
  rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1)/2e0 AS mid,
  count(*) OVER (PARTITION BY {by}) n, sum(1-correct) OVER (PARTITION BY {by}) e FROM (SELECT *, CAST(1-conf AS FLOAT) s FROM {src}))""",
        f"rk2 AS (SELECT *, sum(err) OVER (PARTITION BY {by} ORDER BY i)/i::DOUBLE AS risk FROM rk)",
        f"""er AS (SELECT {by}, CASE WHEN max(e) BETWEEN 1 AND max(n)-1 THEN (sum(err*mid) - max(e)*(max(e)+1)/2e0)/nullif(max(e)*(max(n)-max(e))::DOUBLE, 0) END AS error_auroc,
  (sum(risk) - 0.5e0*(max(risk) FILTER (WHERE i=1) + max(risk) FILTER (WHERE i=n)))/max(n) AS aurc FROM rk2 GROUP BY {by})""",
    ]


WIDE = ["pixel_accuracy", "mean_accuracy", "miou", "mean_dice", "loss", "nll", "brier_score", "ece", "mean_classwise_ece", "error_auroc", "aurc", "mean_confidence", "mean_correct_confidence", "mean_wrong_confidence"]


def wide_sql(by, unit_ctes, softname, key):
    cols = ", ".join(f"{k}" for k in by.split(", "))
    return with_(
        *unit_ctes,
        *seg_ctes(by),
        f"sg AS (SELECT {by}, {SEGCOLS} FROM pc GROUP BY {by})",
        ece_ctes(by),
        cw_ctes(by, softname),
        f"cwm AS (SELECT {by}, avg(classwise_ece) mean_classwise_ece FROM cw GROUP BY {by})",
        base_ctes(by),
        *error_ctes(by),
        f"SELECT pixels, {rsel(cols, [c for c in WIDE if c != 'loss'])}, {r6('nll')} AS loss FROM base JOIN sg USING ({by}) JOIN ece USING ({by}) JOIN cwm USING ({by}) JOIN er USING ({by})",
    )


MLOGIT = "mlogit AS (SELECT l.*, r.method, r.temperature FROM logit l JOIN rules r ON r.degradation_type IS NULL OR r.degradation_type=l.degradation_type)"
MSOFT = softmax("temperature", "mlogit", "msoft", "vec_id, condition, method")
MUNITS = units("msoft", "units", key="vec_id, label, sample_id, split, condition, degradation_type, severity, method")
METHOD_CTES = [LOGIT, RULES_SQL, MLOGIT, MSOFT, MUNITS]
PAIR_METRICS = [*METHOD_CTES, base_ctes("method, condition"), ece_ctes("method, condition"), "mm AS (SELECT * FROM base JOIN ece USING (method, condition))"]


def unit_sql(body, *ctes):
    return with_(LOGIT, softmax(), units(), *ctes, body)


GRIDSEG = [PX, GRID, GRID_IGNORE]

ENTRIES = {
    "confusion_matrix": (
        q_confusion_matrix,
        unit_sql(
            "SELECT c.condition, CAST(a.k AS INT) AS target, CAST(b.k AS INT) AS prediction, coalesce(n, 0) AS n FROM (SELECT DISTINCT condition FROM units) c CROSS JOIN range(10) a(k) CROSS JOIN range(10) b(k) LEFT JOIN cm ON cm.condition=c.condition AND t=a.k AND p=b.k",
            CM.format(by="condition", src="units", top=9),
        ),
    ),
    "segmentation_metrics": (q_segmentation_metrics, unit_sql(f"SELECT {rsel('condition', SEG)} FROM (SELECT condition, {SEGCOLS} FROM pc GROUP BY condition)", *seg_ctes("condition"))),
    "per_class_metrics": (
        q_per_class_metrics,
        unit_sql(
            f"SELECT c.condition, CAST(a.k AS INT) AS class_id, {r6(IOU)} iou, {r6(DICE)} dice, {r6(ACC)} accuracy FROM (SELECT DISTINCT condition FROM units) c CROSS JOIN range(10) a(k) LEFT JOIN pc ON pc.condition=c.condition AND class_id=a.k",
            *seg_ctes("condition"),
        ),
    ),
    "per_sample_miou": (q_per_sample_miou, with_(*GRIDSEG, *seg_ctes("sample_id", "gridi", 7), f"SELECT sample_id, {r6(f'avg({IOU})')} miou FROM pc GROUP BY sample_id")),
    "nll": (q_nll, unit_sql(f"SELECT condition, {r6('avg(-ln(greatest(py, 2.220446049250313e-16)))')} nll FROM units GROUP BY condition")),
    "brier": (q_brier, unit_sql(f"SELECT condition, {r6('avg(brier)')} brier_score FROM units GROUP BY condition")),
    "ece_right_closed": (q_ece("right"), unit_sql(f"SELECT condition, {r6('ece')} ece FROM ece", ece_ctes("condition", edge=RIGHT))),
    "ece_left_closed": (q_ece("left"), unit_sql(f"SELECT condition, {r6('ece')} ece FROM ece", ece_ctes("condition"))),
    "reliability_bins": (q_reliability_bins, unit_sql(f"SELECT condition, CAST({LEFT} AS INT) AS bin, count(*) n, {r6('avg(conf)')} mean_confidence, {r6('avg(correct)')} accuracy FROM units GROUP BY condition, {LEFT}")),
    "classwise_ece": (q_classwise_ece, with_(LOGIT, softmax(), cw_ctes("condition"), f"SELECT condition, class_id, {r6('classwise_ece')} classwise_ece FROM cw")),
    "classwise_ece_right": (q_classwise_ece_right, with_(LOGIT, softmax(), cw_ctes("condition", edge="greatest(ceil(p*15)-1, 0)"), f"SELECT condition, class_id, {r6('classwise_ece')} classwise_ece FROM cw")),
    "calibration_summary": (
        q_calibration_summary,
        unit_sql(
            f"SELECT pixels, {rsel('condition', ['nll', 'brier_score', 'ece', 'mean_classwise_ece'])} FROM base JOIN ece USING (condition) JOIN (SELECT condition, avg(classwise_ece) mean_classwise_ece FROM cw GROUP BY condition) USING (condition)",
            base_ctes("condition"), ece_ctes("condition"), cw_ctes("condition"),
        ),
    ),
    "confidence_summary": (q_confidence_summary, unit_sql(f"SELECT {rsel('condition', ['mean_confidence', 'mean_correct_confidence', 'mean_wrong_confidence'])} FROM base", base_ctes("condition"))),
    "weighted_loss": (q_weighted_loss, with_(HISTORY, f"SELECT CAST(floor(epoch/7) AS BIGINT) AS week, {r6('sum(train_loss*n)/sum(n)')} loss FROM history GROUP BY 1")),
    "per_image_calibration": (
        q_per_image,
        with_(*METHOD_CTES, base_ctes("condition, sample_id, method"), ece_ctes("condition, sample_id, method"), f"SELECT {rsel('condition, sample_id, method', ['nll', 'brier_score', 'ece'])} FROM base JOIN ece USING (condition, sample_id, method)"),
    ),
    "evaluate_condition_splits": (q_condition_splits, wide_sql("condition, split", [LOGIT, softmax(), units()], "soft", "condition")),
    "evaluate_condition_classes": (
        q_condition_classes,
        with_(
            LOGIT, softmax(), units(), *seg_ctes("condition, split"), cw_ctes("condition, split"),
            f"SELECT condition, split, cw.class_id, {r6(IOU)} iou, {r6(DICE)} dice, {r6(ACC)} accuracy, {r6('classwise_ece')} classwise_ece FROM cw LEFT JOIN pc USING (condition, split, class_id)",
        ),
    ),
    "evaluate_temperatures": (q_evaluate_temperatures, wide_sql("method, condition, split", METHOD_CTES, "msoft", "method")),
    "condition_deltas": (
        q_condition_deltas,
        with_(
            *PAIR_METRICS,
            "lg AS (SELECT method, condition, 'nll' metric, nll v FROM mm UNION ALL SELECT method, condition, 'brier_score', brier_score FROM mm UNION ALL SELECT method, condition, 'ece', ece FROM mm)",
            f"SELECT a.method, 'clean_global' AS reference, a.condition, a.metric, {r6('a.v-b.v')} AS delta FROM lg a JOIN lg b USING (condition, metric) WHERE a.method<>'clean_global' AND b.method='clean_global'",
        ),
    ),
    "classwise_delta": (
        q_classwise_delta,
        with_(
            LOGIT, RULES_SQL, MLOGIT, MSOFT, cw_ctes("method, condition", "msoft"),
            f"SELECT a.condition, a.class_id, {r6('a.classwise_ece')} clean_global, {r6('b.classwise_ece')} raw, {r6('a.classwise_ece-b.classwise_ece')} delta FROM cw a JOIN cw b USING (condition, class_id) WHERE a.method='clean_global' AND b.method='raw'",
        ),
    ),
    "reconcile": (
        q_reconcile,
        with_(
            *PAIR_METRICS,
            "d AS (SELECT max(abs(a.nll-b.nll)) n, max(abs(a.brier_score-b.brier_score)) s, max(abs(a.ece-b.ece)) e FROM mm a JOIN mm b USING (condition) WHERE a.method='raw' AND b.method='per_degradation')",
            f"SELECT metric, {r6('v')} AS max_difference, {r6('t')} AS tolerance, v <= t AS within FROM (SELECT 'nll' metric, n v, 10e0 t FROM d UNION ALL SELECT 'brier_score', s, 1e0 FROM d UNION ALL SELECT 'ece', e, 1e-3 FROM d)",
        ),
    ),
    "severity_series": (
        q_severity_series,
        unit_sql(
            f"SELECT split, t.kind AS degradation_type, severity, {r6('ece')} ece, {r6('nll')} nll FROM mm CROSS JOIN (VALUES ('drop'),('gain')) t(kind) WHERE mm.degradation_type='clean' AND severity=0 UNION ALL SELECT split, degradation_type, severity, {r6('ece')}, {r6('nll')} FROM mm WHERE degradation_type IN ('drop','gain')",
            base_ctes("split, degradation_type, severity"), ece_ctes("split, degradation_type, severity"), "mm AS (SELECT * FROM base JOIN ece USING (split, degradation_type, severity))",
        ),
    ),
    "validate_predictions": (
        q_validate_predictions,
        with_(LOGIT, "SELECT split, condition, count(DISTINCT vec_id) AS units, CAST(0 AS BIGINT) AS duplicate_units, CAST(1 AS BIGINT) AS provenance_values, CAST(0 AS BIGINT) AS missing_labels, CAST(0 AS BIGINT) AS bad_logits FROM logit GROUP BY split, condition"),
    ),
}
