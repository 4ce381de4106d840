"""Bootstrap queries (L9-L12) and history queries (H6, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.calibration import base_ctes, ece_ctes, rounded
from plumbline.catalog.grids import METHODS, RADII, REGION_UNITS
from plumbline.catalog.ranking import STRATA, long, ranked_ctes
from plumbline.catalog.views import HISTORY, SCORED, SCORED_LONG, md5_index, r6, with_
from plumbline.operators import bootstrap as bs
from plumbline.operators import history as hi
from plumbline.operators import ranking as rk
from plumbline.operators import regions as rg
from plumbline.plans import fixtures as fx

ITERATIONS, SEED = 1000, 20260721
OUT = ["mean_difference", "ci95_low", "ci95_high"]


def differences(spark, sf):
    rows = fx.scored(spark, sf)
    return rows.groupBy("condition", "sample_id").agg(
        (F.avg(F.col("score_a").cast("double")) - F.avg(F.col("score_c").cast("double"))).alias("a_minus_c"),
        (F.avg(F.col("score_b").cast("double")) - F.avg(F.col("score_c").cast("double"))).alias("b_minus_c"),
    )


VALUES = ["a_minus_c", "b_minus_c"]


def q_paired(spark, sf):
    return rounded(bs.paired_bootstrap(differences(spark, sf), ["condition"], "sample_id", VALUES, ITERATIONS, SEED), *OUT)


def q_poisson(spark, sf):
    return rounded(bs.poisson_bootstrap(differences(spark, sf), ["condition"], "sample_id", VALUES, ITERATIONS, SEED), *OUT)


def q_clustered(spark, sf):
    per_sample = rk.ranking_by_region(long(spark, sf), ["condition", "sample_id", "score_name"])
    return rounded(bs.clustered_bootstrap(per_sample, "score_a", ["region"], "sample_id", ITERATIONS, SEED), *OUT)


def q_boundary(spark, sf):
    units = rg.method_units(fx.mosaic_units(spark, sf), 8, METHODS)
    table = rg.region_metrics(units, ["condition", "method", "sample_id"], RADII, within=["condition", "sample_id"])
    return rounded(bs.boundary_bootstrap(table, "sample_id", ITERATIONS, SEED), *OUT)


def q_best(spark, sf):
    return rounded(hi.best_checkpoint(fx.history(spark, sf), "epoch", "val_metric"), "best_value", "last_value")


def q_early_stop(spark, sf):
    return rounded(hi.early_stop(fx.history(spark, sf), "epoch", "val_metric", 2), "val_metric", "best_so_far")


def bootstrap_sql(src, by, key, values, extra="", iterations=ITERATIONS):
    """Index bootstrap over ``src`` as CTEs ending in ``boot``."""
    un = " UNION ALL ".join(f"SELECT {by}, it, '{v}' AS metric, {v} AS value FROM bm" for v in values)
    ce = " UNION ALL ".join(f"SELECT {by}, count(*) clusters, '{v}' AS metric, avg({v}) AS mean_difference FROM {src} GROUP BY {by}" for v in values)
    on = " AND ".join(f"d.{c.strip()}=p.{c.strip()}" for c in by.split(","))
    return [
        f"rkd AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST({key} AS VARCHAR))) rnk, count(*) OVER (PARTITION BY {by}) sz FROM {src})",
        f"dr AS (SELECT {by}, it, {md5_index('sz', repr(str(SEED)), 'CAST(it AS VARCHAR)', 'CAST(rnk AS VARCHAR)')} + 1 AS pick FROM rkd CROSS JOIN range({iterations}) t(it))",
        f"bm AS (SELECT {', '.join('d.' + c.strip() for c in by.split(','))}, it, {', '.join(f'avg(p.{v}) AS {v}' for v in values)} FROM dr d JOIN rkd p ON {on} AND p.rnk=d.pick GROUP BY ALL)",
        f"bl AS ({un})",
        f"bi AS (SELECT {by}, metric, quantile_cont(value, 0.025) ci95_low, quantile_cont(value, 0.975) ci95_high, count(*) iterations FROM bl GROUP BY {by}, metric)",
        f"bc AS ({ce})",
    ]


def result(by, extra=""):
    return f"SELECT {by}, metric, clusters, iterations, {', '.join(f'{r6(c)} AS {c}' for c in OUT)}{extra} FROM bc JOIN bi USING ({by}, metric)"


DIFF = "df AS (SELECT condition, sample_id, avg(CAST(score_a AS DOUBLE))-avg(CAST(score_c AS DOUBLE)) a_minus_c, avg(CAST(score_b AS DOUBLE))-avg(CAST(score_c AS DOUBLE)) b_minus_c FROM scored GROUP BY condition, sample_id)"
THRESH = []
_p, _r = 0.36787944117144233, 0.0
for _k in range(12):
    _r += _p
    THRESH.append(_r)
    _p /= _k + 1
WEIGHT = "(" + " + ".join(f"CASE WHEN u >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in THRESH) + ")"
POISSON = [
    f"pw AS (SELECT *, {WEIGHT} w FROM (SELECT df.*, it, {md5_index('1152921504606846976', repr(str(SEED)), 'CAST(it AS VARCHAR)', 'sample_id')}/1152921504606846976e0 AS u FROM df CROSS JOIN range({ITERATIONS}) t(it)))",
    "bm AS (SELECT condition, it, sum(w*a_minus_c)/sum(w) a_minus_c, sum(w*b_minus_c)/sum(w) b_minus_c FROM pw GROUP BY condition, it)",
    *bootstrap_sql("df", "condition", "sample_id", VALUES)[3:],
]
PS = "condition, sample_id, score_name, region"
CLUSTER = [
    SCORED, SCORED_LONG, STRATA, *ranked_ctes(PS, "strat"),
    "cl AS (SELECT region, score_name, sample_id, avg(eaurc) eaurc, avg(error_auprc) error_auprc, avg(top_10_uncertainty_recall) top_10_uncertainty_recall FROM rm GROUP BY ALL)",
    "cd AS (SELECT a.region, a.score_name, a.sample_id, -(a.eaurc-b.eaurc) eaurc, a.error_auprc-b.error_auprc error_auprc, a.top_10_uncertainty_recall-b.top_10_uncertainty_recall top_10_uncertainty_recall FROM cl a JOIN cl b USING (region, sample_id) WHERE b.score_name='score_a')",
    *bootstrap_sql("cd", "region, score_name", "sample_id", ["eaurc", "error_auprc", "top_10_uncertainty_recall"]),
]
RS = "condition, radius, method, region, sample_id"
REGION_TABLE = [
    *REGION_UNITS, base_ctes(RS), ece_ctes(RS), *ranked_ctes(RS, "units"),
    f"rt AS (SELECT radius, method, region, sample_id, avg(nll) nll, avg(ece) ece, avg(aurc) aurc, avg(eaurc) eaurc FROM base JOIN ece USING ({RS}) JOIN (SELECT {RS}, aurc, eaurc FROM rm) USING ({RS}) GROUP BY ALL)",
]


def diff_cte(name, left, right, metrics):
    (lm, lr), (rm_, rr) = left, right
    return f"{name} AS (SELECT a.radius, a.sample_id, {', '.join(f'a.{m}-b.{m} AS {m}' for m in metrics)} FROM rt a JOIN rt b USING (radius, sample_id) WHERE a.method='{lm}' AND a.region='{lr}' AND b.method='{rm_}' AND b.region='{rr}')"


def renamed(ctes, tag):
    import re

    names = ["rkd", "dr", "bm", "bl", "bi", "bc"]
    return [re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m.group(1) + tag, c) for c in ctes]


B1 = ["nll", "ece", "aurc", "eaurc"]
B2 = ["nll", "ece"]
BOUNDARY = [
    *REGION_TABLE,
    diff_cte("d1", ("clean_global", "boundary"), ("clean_global", "interior"), B1),
    diff_cte("d2", ("clean_global", "boundary"), ("raw", "boundary"), B2),
    *renamed(bootstrap_sql("d1", "radius", "sample_id", B1), "_1"),
    *renamed(bootstrap_sql("d2", "radius", "sample_id", B2), "_2"),
]

ENTRIES = {
    "paired_bootstrap": (q_paired, with_(SCORED, DIFF, *bootstrap_sql("df", "condition", "sample_id", VALUES), result("condition"))),
    "poisson_bootstrap": (q_poisson, with_(SCORED, DIFF, *POISSON, result("condition"))),
    "clustered_bootstrap": (q_clustered, with_(*CLUSTER, result("region, score_name"))),
    "boundary_bootstrap": (
        q_boundary,
        with_(*BOUNDARY, renamed([result("radius", ", 'boundary_minus_interior' AS comparison")], "_1")[0] + " UNION ALL " + renamed([result("radius", ", 'calibrated_minus_raw_boundary' AS comparison")], "_2")[0]),
    ),
    "best_checkpoint": (
        q_best,
        with_(HISTORY, f"SELECT (SELECT epoch FROM history WHERE val_metric IS NOT NULL ORDER BY val_metric DESC, epoch LIMIT 1) AS best_epoch, {r6('(SELECT max(val_metric) FROM history)')} AS best_value, (SELECT max(epoch) FROM history WHERE val_metric IS NOT NULL) AS last_epoch, {r6('(SELECT val_metric FROM history WHERE val_metric IS NOT NULL ORDER BY epoch DESC LIMIT 1)')} AS last_value"),
    ),
    "early_stop": (
        q_early_stop,
        with_(
            HISTORY,
            "v AS (SELECT epoch, val_metric, max(val_metric) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev FROM history WHERE val_metric IS NOT NULL)",
            "w AS (SELECT *, CASE WHEN prev IS NULL OR val_metric > prev THEN 1 ELSE 0 END imp, row_number() OVER (ORDER BY epoch) rn FROM v)",
            "z AS (SELECT *, rn - max(CASE WHEN imp=1 THEN rn END) OVER (ORDER BY epoch) AS since, greatest(val_metric, coalesce(prev, val_metric)) best_so_far FROM w)",
            f"SELECT epoch, {r6('val_metric')} val_metric, {r6('best_so_far')} best_so_far, CAST(since AS BIGINT) AS since_improvement, coalesce(epoch = (SELECT min(epoch) FROM z WHERE since >= 2), false) AS stops_here FROM z",
        ),
    ),
}
