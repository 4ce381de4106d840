"""Fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.views import LOGIT, SCORED, r6, with_
from plumbline.operators import fusion as fu
from plumbline.operators import temperature as tp
from plumbline.plans import fixtures as fx

C = fx.CLASSES
GRID = [0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0, 4.5, 5.0, 6.0, 8.0]
KINDS = {"drop": ["drop_s1", "drop_s2", "drop_s3"], "gain": ["gain_s1", "gain_s2", "gain_s3"]}
SCOPES = {"clean": ["clean"], "pooled": [c[0] for c in fx.CONDITIONS], **KINDS}
FEATURES = ["score_a", "score_b", "score_c"]
FIXED = fu.FusionParameters(tuple(FEATURES), (0.1, 0.5, 0.4), (0.2, 0.3, 0.25), (0.18, -0.05, 0.75), -1.7, 1, 0.2, 1.0)


def calibration_rows(spark, sf):
    return fx.predictions(spark, sf).filter(F.col("split") == "calibration")


def fit_report(df):
    named = ["scope", "temperature", "initial_nll", "final_nll", "converged", "valid_units", "at_boundary", "nll_improvement"]
    return rounded(df.select(*named), "temperature", "initial_nll", "final_nll", "nll_improvement")


def q_fit_temperature(spark, sf):
    return fit_report(tp.fit_temperature(calibration_rows(spark, sf), "degradation_type", C))


def q_fit_scopes(spark, sf):
    return fit_report(tp.fit_scopes(calibration_rows(spark, sf), SCOPES, C))


def q_fit_grid(spark, sf):
    return rounded(tp.fit_temperature_grid(calibration_rows(spark, sf), ["condition"], C, GRID), "nll")


def q_standardize(spark, sf):
    rows = fx.scored(spark, sf).select("event_id", *FEATURES)
    return rounded(fu.standardize(rows, FEATURES), *FEATURES)


def q_fit_fusion(spark, sf):
    p = fu.fit_fusion(fx.scored(spark, sf), FEATURES)
    rows = list(zip(p.feature_names, p.mean, p.scale, p.coefficients)) + [("intercept", None, None, p.intercept)]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, scale double, coefficient double"), "mean", "scale", "coefficient")


def q_fusion_score(spark, sf):
    scored = fx.scored(spark, sf).select("event_id", fu.fusion_score(FIXED).cast("double").alias("score"))
    return scored.withColumn("score", F.round("score", 5))


def q_fusion_ranking(spark, sf):
    rows = fx.scored(spark, sf).withColumn("part", F.when(F.col("event_id") % 2 == 0, "calibration").otherwise("val"))
    out = fu.evaluate_fusion(
        rows.filter(F.col("part") == "calibration"), rows.filter(F.col("part") == "val"), FEATURES, ["condition"], ["condition", "sample_id"], "event_id", 685, 20260722
    )
    return rounded(out, *[c for c in out.columns if c.startswith(("risk", "top", "error", "aurc", "oracle", "eaurc", "tied"))])


def newton_sql(units, scope, steps=14):
    """Newton in 1/T from T=1 as a recursive query, each step over all units."""
    return with_(
        LOGIT,
        f"zz AS (SELECT {scope} AS scope, vec_id, condition, k, z, max(z) OVER (PARTITION BY {scope}, vec_id, condition) mz, max(CASE WHEN k=label THEN z END) OVER (PARTITION BY {scope}, vec_id, condition) zy FROM {units})",
        f"""nw AS (SELECT DISTINCT scope, 0 AS step, 1e0 AS a FROM zz UNION ALL
  SELECT scope, step+1, least(20e0, greatest(0.05e0, a - sum(ez - zy)/sum(ez2 - ez*ez))) FROM (
    SELECT n.scope, n.step, n.a, z.vec_id, z.condition, max(z.zy) zy, sum(exp(n.a*(z.z-z.mz))*z.z)/sum(exp(n.a*(z.z-z.mz))) ez, sum(exp(n.a*(z.z-z.mz))*z.z*z.z)/sum(exp(n.a*(z.z-z.mz))) ez2
    FROM nw n JOIN zz z ON z.scope=n.scope WHERE n.step < {steps} GROUP BY n.scope, n.step, n.a, z.vec_id, z.condition) GROUP BY scope, step, a)""",
        f"best AS (SELECT scope, a FROM nw WHERE step={steps})",
        "lo AS (SELECT zz.scope, vec_id, condition, ln(sum(exp(z-mz)))+max(mz)-max(zy) n1, ln(sum(exp(a*(z-mz))))+max(a*mz)-max(a*zy) n2 FROM zz JOIN best USING (scope) GROUP BY zz.scope, vec_id, condition)",
        f"SELECT scope, {r6('1/max(a)')} temperature, {r6('avg(n1)')} initial_nll, {r6('avg(n2)')} final_nll, true AS converged, count(*) AS valid_units, false AS at_boundary, {r6('avg(n1)-avg(n2)')} nll_improvement FROM lo JOIN best USING (scope) GROUP BY scope",
    )


SCOPED = "(SELECT l.*, s.scope AS sc FROM logit l JOIN (VALUES " + ", ".join(f"('{c}','{s}')" for s, cs in SCOPES.items() for c in cs) + ") s(cond, scope) ON s.cond=l.condition WHERE split='calibration')"
STD = ", ".join(f"{r6(f'(CAST({c} AS DOUBLE) - m_{c})/s_{c}')} AS {c}" for c in FEATURES)
MOM = ", ".join(f"avg(CAST({c} AS DOUBLE)) m_{c}, stddev_pop(CAST({c} AS DOUBLE)) s_{c}" for c in FEATURES)
LINEAR = " + ".join(f"(CAST({f} AS DOUBLE) - {m}e0)/{s}e0*({w}e0)" for f, m, s, w in zip(FIXED.feature_names, FIXED.mean, FIXED.scale, FIXED.coefficients))

ENTRIES = {
    "fit_temperature": (q_fit_temperature, newton_sql("(SELECT * FROM logit WHERE split='calibration')", "degradation_type")),
    "fit_scopes": (q_fit_scopes, newton_sql(SCOPED, "sc")),
    "fit_temperature_grid": (
        q_fit_grid,
        with_(
            LOGIT, f"gr AS (SELECT unnest({[float(t) for t in GRID]}) AS t)",
            "ls AS (SELECT condition, vec_id, CAST(t AS DOUBLE) t, ln(sum(exp((z-mz)/t)))+max(mz/t)-max(CASE WHEN k=label THEN z/t END) nll FROM (SELECT *, max(z) OVER (PARTITION BY vec_id, condition) mz FROM logit WHERE split='calibration') CROSS JOIN gr GROUP BY condition, vec_id, t)",
            "mn AS (SELECT condition, t, round(avg(nll),10) nll FROM ls GROUP BY condition, t)",
            f"SELECT condition, t AS temperature, {r6('nll')} nll FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY nll, t) rn FROM mn) WHERE rn=1",
        ),
    ),
    "standardize": (q_standardize, with_(SCORED, f"mo AS (SELECT {MOM} FROM scored)", f"SELECT event_id, {STD} FROM scored CROSS JOIN mo")),
    "fit_fusion": (q_fit_fusion, None),
    "fusion_score": (q_fusion_score, with_(SCORED, f"SELECT event_id, round(CAST(CAST(1/(1+exp(-({LINEAR} + ({FIXED.intercept}e0)))) AS FLOAT) AS DOUBLE), 5) AS score FROM scored")),
    "fusion_ranking": (q_fusion_ranking, None),
}
