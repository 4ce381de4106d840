"""Ranking queries (G1-G16, F20, H9, A11, A12) over the scored events (V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.views import GRID, MOSAIC, PX, SCORED, SCORED_LONG, mosaic_scores, r6, with_
from plumbline.functions.numerics import shuffle_key
from plumbline.operators import comparisons as cmp
from plumbline.operators import ranking as rk
from plumbline.operators import rows as rw
from plumbline.operators import spatial as sp
from plumbline.plans import evaluation as ev
from plumbline.plans import fixtures as fx
from plumbline.sources import sinks

BY = ["condition", "score_name"]
SCORES = ["score_a", "score_b", "score_c"]
# no multiple of V8's logit steps divided by it ends in a half at six digits
TEMPERATURE = 2.19723


def long(spark, sf):
    return fx.scores_long(fx.scored(spark, sf))


def as_double(df):
    return df.withColumn("score", F.round(F.col("score").cast("double"), 6))


def q_score_groups(spark, sf):
    return as_double(rk.score_groups(long(spark, sf), BY))


def q_prefix_groups(spark, sf):
    return as_double(rk.prefix_groups(rk.score_groups(long(spark, sf), BY), BY))


def metric(*names):
    def build(spark, sf):
        return rounded(rk.ranking_metrics(long(spark, sf), BY).select(*BY, *names), *[n for n in names if n not in COUNTS])

    return build


COUNTS = ["pixels", "unique_score_count", "tie_group_count", "largest_tie_group"]
RISKS = ["risk_at_90_coverage", "risk_at_80_coverage", "risk_at_70_coverage"]
TOPS = [f"top_{f}_uncertainty_{kind}" for f in (5, 10, 20) for kind in ("precision", "recall")]
DOUBLES = ["error_rate", "error_auroc", "error_auprc", "aurc", "oracle_aurc", "eaurc", "tied_pixel_fraction", *RISKS, *TOPS]


def q_ranking_metrics(spark, sf):
    return rounded(rk.ranking_metrics(long(spark, sf), BY), *DOUBLES)


def q_ranking_split(spark, sf):
    """The same metrics with every scope forced through the range-cut prefix."""
    return rounded(rk.ranking_metrics_ranged(long(spark, sf), BY, ranges=16), *DOUBLES)


def q_ranking_by_region(spark, sf):
    return rounded(rk.ranking_by_region(long(spark, sf), BY), *DOUBLES)


def q_ranking_per_sample(spark, sf):
    by = ["condition", "sample_id", "score_name"]
    return rounded(rk.ranking_by_region(long(spark, sf), by), *DOUBLES)


def q_ranking_all_conditions(spark, sf):
    """Seven scores x three strata x all conditions, from logits to metrics."""
    return rounded(ev.evaluate_images(fx.mosaic_units(spark, sf), ["condition"], 8, TEMPERATURE, 3, digits=6), *DOUBLES)


def q_score_groups_discrete(spark, sf):
    cells = sp.local_disagreement(fx.grid(spark, sf), ["sample_id"]).withColumn("err", (F.col("pred") != F.col("label")).cast("int"))
    return rk.score_groups_discrete(cells, [], "local_disagreement").drop("score")


def curve(spark, sf):
    return rk.risk_coverage_curve(long(spark, sf), BY, "event_id")


def q_curve(spark, sf):
    return rounded(curve(spark, sf).drop("size"), "coverage", "risk")


def q_aurc_simple(spark, sf):
    return rounded(rk.aurc_simple(curve(spark, sf), BY), "aurc_simple")


def q_condition_summary(spark, sf):
    metrics = rk.ranking_by_region(long(spark, sf), BY)
    kind = F.when(F.col("condition") != "c0", "shifted")
    keyed = metrics.withColumn("degradation_type", kind)
    out = cmp.condition_summary(keyed, ["score_name", "region", "degradation_type"], ["aurc", "eaurc", "error_auroc", "error_rate"])
    return rounded(out, "aurc", "eaurc", "error_auroc", "error_rate")


def q_sample_per_group(spark, sf):
    return rw.sample_per_group(fx.scored(spark, sf), ["condition", "sample_id"], "event_id", 3, 7).select("condition", "sample_id", "event_id")


def q_resume_pending(spark, sf):
    stored = rk.score_groups(long(spark, sf), ["condition", "score_name"]).filter(F.col("w") > 1)
    units = fx.scored(spark, sf)
    conditions = units.select("condition").distinct()
    expected = stored.filter(F.col("condition") == "c1").count()
    return sinks.resume_pending(conditions, stored, "condition", ["score_name", "score"], expected)


def q_nan_to_null(spark, sf):
    rate = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("err").cast("double"))
    return sinks.nan_to_null(fx.scored(spark, sf).select("event_id", rate.alias("rate")))


KEY = "condition, score_name"


def ranked_ctes(by, src="scored_long"):
    """Per-unit ranks, then every tie-aware metric by expansion to ranks."""
    return [
        f"""tg AS (SELECT {by}, score, count(*) w, sum(err) e FROM {src} GROUP BY {by}, score)""",
        f"""pg AS (SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) n0,
  CAST(coalesce(sum(e) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) e0,
  CAST(sum(w) OVER (PARTITION BY {by}) AS BIGINT) n, CAST(sum(e) OVER (PARTITION BY {by}) AS BIGINT) et FROM tg)""",
        "rnk AS (SELECT *, unnest(range(n0+1, n0+w+1)) AS i FROM pg)",
        # oracle order: all correct units first
        f"""rr AS (SELECT *, (e0 + e::DOUBLE/w*(i-n0))/i AS risk, greatest(0, i-(n-et))::DOUBLE/i AS ideal FROM rnk)""",
        f"""ar AS (SELECT {by}, (sum(risk) - 0.5e0*(sum(risk) FILTER (WHERE i=1) + sum(risk) FILTER (WHERE i=n)))/max(n) AS aurc,
  (sum(ideal) - 0.5e0*(sum(ideal) FILTER (WHERE i=1) + sum(ideal) FILTER (WHERE i=n)))/max(n) AS oracle_aurc,
  """
        + ", ".join(f"sum(e::DOUBLE/w) FILTER (WHERE i <= greatest(1, ceil(n*{q}e0)))/max(greatest(1, ceil(n*{q}e0))) AS risk_at_{round(q*100)}_coverage" for q in rk.COVERAGES)
        + ", "
        + ", ".join(
            f"coalesce(sum(e::DOUBLE/w) FILTER (WHERE i > n - greatest(1, ceil(n*{f}e0))),0)/max(greatest(1, ceil(n*{f}e0))) AS top_{round(f*100)}_uncertainty_precision, "
            f"coalesce(sum(e::DOUBLE/w) FILTER (WHERE i > n - greatest(1, ceil(n*{f}e0))),0)/nullif(max(et),0) AS top_{round(f*100)}_uncertainty_recall"
            for f in rk.FRACTIONS
        )
        + f" FROM rr GROUP BY {by})",
        f"""gm AS (SELECT {by}, max(n) pixels, max(et)::DOUBLE/max(n) error_rate,
  CASE WHEN max(et) BETWEEN 1 AND max(n)-1 THEN (sum(e*(n0+(w+1)/2e0)) - max(et)*(max(et)+1)/2e0)/nullif(max(et)::DOUBLE*(max(n)-max(et)),0) END error_auroc,
  sum(e*(et-e0)::DOUBLE/(n-n0))/nullif(max(et),0) error_auprc,
  count(*) unique_score_count, count(*) FILTER (WHERE w>1) tie_group_count, max(w) largest_tie_group,
  coalesce(sum(w) FILTER (WHERE w>1),0)::DOUBLE/max(n) tied_pixel_fraction FROM pg GROUP BY {by})""",
        f"rm AS (SELECT *, aurc-oracle_aurc AS eaurc FROM gm JOIN ar USING ({by}))",
    ]


def metric_sql(by, names, src="scored_long", ctes=(SCORED, SCORED_LONG), final="rm"):
    cols = [n if n in COUNTS else f"{r6(n)} AS {n}" for n in names]
    return with_(*ctes, *ranked_ctes(by, src), f"SELECT {by}, {', '.join(cols)} FROM {final}")


ALL = ["pixels", "unique_score_count", "tie_group_count", "largest_tie_group", *DOUBLES]
STRATA = "strat AS (SELECT * FROM scored_long UNION ALL SELECT event_id, sample_id, condition, 'full', err, score_name, score FROM scored_long)"
MOSAIC_STRATA = "mstrat AS (SELECT condition, score_name, score, err, unnest(['full', CASE WHEN distance<=3 THEN 'boundary' ELSE 'interior' END]) AS region FROM ms)"
CURVE = [SCORED, SCORED_LONG, f"rc AS (SELECT {KEY}, event_id, row_number() OVER (PARTITION BY {KEY} ORDER BY score, event_id) AS rank, count(*) OVER (PARTITION BY {KEY}) n, sum(err) OVER (PARTITION BY {KEY} ORDER BY score, event_id ROWS UNBOUNDED PRECEDING) ce FROM scored_long)"]

ENTRIES = {
    "score_groups": (q_score_groups, with_(SCORED, SCORED_LONG, f"SELECT {KEY}, round(CAST(score AS DOUBLE),6) score, count(*) w, CAST(sum(err) AS BIGINT) e FROM scored_long GROUP BY {KEY}, score_name, scored_long.score")),
    "prefix_groups": (
        q_prefix_groups,
        with_(SCORED, SCORED_LONG, *ranked_ctes(KEY)[:2], f"SELECT {KEY}, round(CAST(score AS DOUBLE),6) score, w, CAST(e AS BIGINT) e, n0 AS w_before, e0 AS e_before, n AS w_total, et AS e_total FROM pg"),
    ),
    "aurc": (metric("aurc"), metric_sql(KEY, ["aurc"])),
    "eaurc": (metric("oracle_aurc", "eaurc"), metric_sql(KEY, ["oracle_aurc", "eaurc"])),
    "error_auroc": (metric("error_auroc"), metric_sql(KEY, ["error_auroc"])),
    "error_auprc": (metric("error_auprc"), metric_sql(KEY, ["error_auprc"])),
    "risk_at_coverage": (metric(*RISKS), metric_sql(KEY, RISKS)),
    "top_fraction": (metric(*TOPS), metric_sql(KEY, TOPS)),
    "tie_statistics": (metric(*COUNTS, "tied_pixel_fraction"), metric_sql(KEY, [*COUNTS, "tied_pixel_fraction"])),
    "ranking_metrics": (q_ranking_metrics, metric_sql(KEY, ALL)),
    "ranking_metrics_ranged": (q_ranking_split, metric_sql(KEY, ALL)),
    "ranking_by_region": (q_ranking_by_region, metric_sql("condition, score_name, region", ALL, "strat", (SCORED, SCORED_LONG, STRATA))),
    "ranking_per_sample": (q_ranking_per_sample, metric_sql("condition, sample_id, score_name, region", ALL, "strat", (SCORED, SCORED_LONG, STRATA))),
    "ranking_all_conditions": (q_ranking_all_conditions, metric_sql("condition, score_name, region", ALL, "mstrat", (*MOSAIC, *mosaic_scores(TEMPERATURE, 6), MOSAIC_STRATA))),
    "score_groups_discrete": (
        q_score_groups_discrete,
        with_(
            PX, GRID,
            "off AS (SELECT a.k dy, b.k dx FROM range(-1,2) a(k) CROSS JOIN range(-1,2) b(k))",
            "ld AS (SELECT g.sample_id, g.y, g.x, 1 - avg(CASE WHEN h.pred=g.pred THEN 1e0 ELSE 0e0 END) s, max(CASE WHEN g.pred<>g.label THEN 1 ELSE 0 END) err FROM grid g CROSS JOIN off JOIN grid h ON h.sample_id=g.sample_id AND h.y=least(7,greatest(0,g.y+dy)) AND h.x=least(7,greatest(0,g.x+dx)) GROUP BY g.sample_id, g.y, g.x)",
            "SELECT CAST(round_even(s*9, 0) AS BIGINT) AS level, count(*) w, CAST(sum(err) AS BIGINT) e FROM ld GROUP BY 1",
        ),
    ),
    "risk_coverage_curve": (q_curve, with_(*CURVE, f"SELECT {KEY}, event_id, rank, {r6('rank::DOUBLE/n')} coverage, {r6('ce::DOUBLE/rank')} risk FROM rc")),
    "aurc_simple": (q_aurc_simple, with_(*CURVE, f"SELECT {KEY}, {r6('(sum(ce::DOUBLE/rank) - 0.5e0*(sum(ce::DOUBLE/rank) FILTER (WHERE rank=1) + sum(ce::DOUBLE/rank) FILTER (WHERE rank=n)))/max(n)')} aurc_simple FROM rc GROUP BY {KEY}")),
    "condition_summary": (
        q_condition_summary,
        with_(
            SCORED, SCORED_LONG, STRATA, *ranked_ctes("condition, score_name, region", "strat"),
            f"SELECT score_name, region, CASE WHEN condition<>'c0' THEN 'shifted' END AS degradation_type, {r6('avg(aurc)')} aurc, {r6('avg(eaurc)')} eaurc, {r6('avg(error_auroc)')} error_auroc, {r6('avg(error_rate)')} error_rate FROM rm GROUP BY 1,2,3",
        ),
    ),
    "sample_per_group": (q_sample_per_group, with_(SCORED, "SELECT condition, sample_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY condition, sample_id ORDER BY md5('7:'||event_id)) rn FROM scored) WHERE rn<=3")),
    "resume_pending": (
        q_resume_pending,
        with_(SCORED, SCORED_LONG, f"st AS (SELECT condition, score_name, score FROM scored_long GROUP BY ALL HAVING count(*)>1)", "SELECT DISTINCT condition FROM scored WHERE condition NOT IN (SELECT condition FROM st GROUP BY condition HAVING count(*) = (SELECT count(*) FROM st WHERE condition='c1'))"),
    ),
    "nan_to_null": (q_nan_to_null, with_(SCORED, "SELECT event_id, CASE WHEN event_id%5=0 OR event_id%7=0 THEN NULL ELSE CAST(err AS DOUBLE) END AS rate FROM scored")),
}
