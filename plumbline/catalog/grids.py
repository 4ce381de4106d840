"""Grid queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.catalog.calibration import base_ctes, ece_ctes, rounded, seg_ctes, IOU
from plumbline.catalog.ranking import ranked_ctes
from plumbline.catalog.views import GRID, GRID_IGNORE, MOSAIC, PX, bilinear_axis, r6, with_
from plumbline.operators import pixels as pxl
from plumbline.operators import ranking as rk
from plumbline.operators import regions as rg
from plumbline.operators import segmentation as seg
from plumbline.operators import spatial as sp
from plumbline.plans import fixtures as fx
from plumbline.sources import manifests as mf

S = ["sample_id"]
RADII = [1, 3, 5]
METHODS = {"raw": 1.0, "clean_global": 2.0}


def grey(spark, sf):
    """V3 as a grey image of whole levels."""
    return fx.grid(spark, sf).withColumn("g", F.floor(F.abs("v") * 255.0))


def q_pixel_hash(spark, sf):
    out = mf.table_fingerprint(fx.grid(spark, sf), S, ["y", "x", "label"])
    return out.select("sample_id", F.md5(F.concat_ws(":", "rows", "digest", "folded_sum")).alias("pixel_hash"))


def q_class_to_rgb(spark, sf):
    return pxl.class_to_rgb(fx.grid(spark, sf).select("sample_id", "y", "x", "label"))


def q_nearest_resize(spark, sf):
    return sp.nearest_resize(fx.grid(spark, sf), S, 5, 12, ["label"])


def q_bilinear(spark, sf):
    cells = fx.grid_logits(fx.grid(spark, sf))
    out = sp.bilinear_upsample(cells, S, 13, 11, {**{f"z{k}": F.col("logits")[k] for k in range(8)}, "v": F.col("v")})
    return rounded(out, *[f"z{k}" for k in range(8)], "v")


def q_blur(spark, sf):
    return sp.gaussian_blur(grey(spark, sf).select("sample_id", "y", "x", "g"), S, 7, 1.6, ["g"])


def q_local_disagreement(spark, sf):
    out = sp.local_disagreement(fx.grid(spark, sf), S)
    return rounded(out.select("sample_id", "y", "x", "local_disagreement"), "local_disagreement")


def q_boundary_mask(spark, sf):
    out = sp.boundary_mask(fx.grid(spark, sf, ignore=True), S, 1)
    return out.select("sample_id", "y", "x", "boundary")


def q_strata_counts(spark, sf):
    marked = rg.with_regions(fx.grid(spark, sf, ignore=True), S, [1], 8)
    return rk.with_strata(marked).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") != F.col("label")).alias("errors"))


def q_region_calibration(spark, sf):
    by = ["condition", "method"]
    out = rg.region_metrics(rg.method_units(fx.mosaic_units(spark, sf), 8, METHODS), by, RADII)
    return rounded(out, *[c for c in out.columns if c not in (*by, "radius", "region", "pixels")])


def with_part(cells):
    return cells.withColumn("part", F.concat(F.lit("p"), F.col("sample_id") % 10))


def q_histogram(spark, sf):
    return sp.class_histogram(with_part(fx.grid(spark, sf)), ["part"], 8)


def q_classes_present(spark, sf):
    return sp.classes_present(fx.grid(spark, sf), S)


def cropped(spark, sf):
    """Masks of which every ninth lost its last row."""
    return fx.grid(spark, sf).filter((F.col("sample_id") % 9 != 0) | (F.col("y") < 7))


def q_compare_masks(spark, sf):
    ids = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"))
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    return sp.compare_masks(pairs, cropped(spark, sf), "sample_id", "a", "b")


def q_worst_middle_best(spark, sf):
    scores = seg.segmentation_metrics(fx.grid(spark, sf), S, 8).select("sample_id", F.round("miou", 6).alias("miou"))
    return rounded(rg.worst_middle_best(scores, "miou", "sample_id", 5), "miou")


def q_phash(spark, sf):
    return sp.dct_hash(fx.grid(spark, sf), S, "v", 8)


def q_dhash(spark, sf):
    return sp.gradient_hash(fx.grid(spark, sf), S, "v", 8, 8)


def q_validate_shapes(spark, sf):
    return sp.validate_shapes(fx.rgb(spark, sf), cropped(spark, sf), "sample_id", 7)


G = [PX, GRID]
GI = [PX, GRID, GRID_IGNORE]
CELL = "CAST('0x' || substr(md5(y||'|'||x||'|'||label),1,15) AS BIGINT)"
OFF = "off AS (SELECT a.k dy, b.k dx FROM range(-1,2) a(k) CROSS JOIN range(-1,2) b(k))"


def boundary_cte(radius, src="gridi", name="bnd"):
    return f"""{name} AS (SELECT g.sample_id, g.y, g.x, min(h.label)<>max(h.label) AS boundary FROM {src} g JOIN {src} h ON h.sample_id=g.sample_id AND abs(h.y-g.y)<={radius} AND abs(h.x-g.x)<={radius} GROUP BY g.sample_id, g.y, g.x)"""


def nearest_sql(n, m):
    return "(VALUES " + ", ".join(f"({t},{math.floor((t + 0.5) * n / m)})" for t in range(m)) + ")"


def blur_axis_sql(n, kernel, sigma):
    radius, weights = kernel // 2, sp.gaussian_weights(kernel, sigma)
    rows = []
    for t in range(n):
        for d, w in zip(range(-radius, radius + 1), weights):
            folded = (t + d) % (2 * (n - 1))
            rows.append((t, min(folded, 2 * (n - 1) - folded), w))
    return "(VALUES " + ", ".join(f"({t},{s},{w!r}::DOUBLE)" for t, s, w in rows) + ")"


BLUR7 = blur_axis_sql(8, 7, 1.6)
REGION_UNITS = [
    *MOSAIC,
    "me AS (SELECT * FROM (VALUES ('raw', 1e0), ('clean_global', 2e0)) t(method, temperature))",
    "gs AS (SELECT *, exp(z/temperature - mx)/sum(exp(z/temperature - mx)) OVER (PARTITION BY img, condition, y, x, method) p FROM (SELECT *, max(z/temperature) OVER (PARTITION BY img, condition, y, x, method) mx FROM up CROSS JOIN me))",
    "gu AS (SELECT gs.img AS sample_id, gs.condition, gs.method, distance, label, gs.y, gs.x, max(p) conf, sum(CASE WHEN k=label THEN p ELSE 0 END) py, sum((p-CASE WHEN k=label THEN 1 ELSE 0 END)*(p-CASE WHEN k=label THEN 1 ELSE 0 END)) brier FROM gs JOIN dist ON dist.img=gs.img AND dist.y=gs.y AND dist.x=gs.x WHERE label BETWEEN 0 AND 7 GROUP BY ALL)",
    "units AS (SELECT gu.*, r.radius, CASE WHEN distance<=r.radius THEN 'boundary' ELSE 'interior' END AS region, CAST(1-conf AS FLOAT) AS score, CAST(pred=label AS BIGINT) AS correct, 1-CAST(pred=label AS BIGINT) AS err FROM gu JOIN upp ON upp.img=gu.sample_id AND upp.condition=gu.condition AND upp.y=gu.y AND upp.x=gu.x CROSS JOIN (VALUES "
    + ", ".join(f"({r})" for r in RADII)
    + ") r(radius))",
]
RBY = "condition, radius, method, region"
DCT_SCALE = "(CASE WHEN {u}=0 THEN sqrt(1e0/8) ELSE sqrt(2e0/8) END)"

ENTRIES = {
    "pixel_hash": (q_pixel_hash, with_(*G, f"SELECT sample_id, md5(concat_ws(':', count(*), bit_xor({CELL}), CAST(sum({CELL} % 1000000007) AS BIGINT))) AS pixel_hash FROM grid GROUP BY sample_id")),
    "class_to_rgb": (q_class_to_rgb, with_(*G, "SELECT sample_id, y, x, label, CAST(255*(label//4) AS BIGINT) r, CAST(255*((label//2)%2) AS BIGINT) g, CAST(255*(label%2) AS BIGINT) b FROM grid")),
    "nearest_resize": (
        q_nearest_resize,
        with_(*G, f"SELECT g.sample_id, CAST(ty.t AS BIGINT) y, CAST(tx.t AS BIGINT) x, g.label FROM grid g JOIN {nearest_sql(8, 5)} ty(t,s) ON ty.s=g.y JOIN {nearest_sql(8, 12)} tx(t,s) ON tx.s=g.x"),
    ),
    "bilinear_upsample": (
        q_bilinear,
        with_(*G, f"SELECT g.sample_id, CAST(ty.t AS BIGINT) y, CAST(tx.t AS BIGINT) x, {', '.join(r6(f'sum(ty.w*tx.w*ln(CASE WHEN pred={k} THEN conf ELSE (1e0-conf)/7e0 END))') + f' z{k}' for k in range(8))}, {r6('sum(ty.w*tx.w*v)')} v FROM grid g JOIN {bilinear_axis(8, 13)} ty(t,s,w) ON ty.s=g.y JOIN {bilinear_axis(8, 11)} tx(t,s,w) ON tx.s=g.x GROUP BY ALL"),
    ),
    "degrade_blur": (
        q_blur,
        with_(*G, f"SELECT g.sample_id, CAST(ty.t AS BIGINT) y, CAST(tx.t AS BIGINT) x, CAST(round_even(sum(ty.w*tx.w*floor(abs(v)*255e0)), 0) AS BIGINT) g FROM grid g JOIN {BLUR7} ty(t,s,w) ON ty.s=g.y JOIN {BLUR7} tx(t,s,w) ON tx.s=g.x GROUP BY ALL"),
    ),
    "score_local_disagreement": (
        q_local_disagreement,
        with_(*G, OFF, f"SELECT g.sample_id, g.y, g.x, {r6('1 - avg(CASE WHEN h.pred=g.pred THEN 1e0 ELSE 0e0 END)')} local_disagreement FROM grid g CROSS JOIN off JOIN grid h ON h.sample_id=g.sample_id AND h.y=least(7,greatest(0,g.y+dy)) AND h.x=least(7,greatest(0,g.x+dx)) GROUP BY ALL"),
    ),
    "boundary_mask": (q_boundary_mask, with_(*GI, boundary_cte(1), "SELECT sample_id, y, x, boundary FROM bnd")),
    "strata_counts": (
        q_strata_counts,
        with_(*GI, boundary_cte(1), "v AS (SELECT g.*, CASE WHEN boundary THEN 'boundary' ELSE 'interior' END region FROM gridi g JOIN bnd USING (sample_id,y,x) WHERE label<>255)", "SELECT region, count(*) n, count(*) FILTER (WHERE pred<>label) errors FROM (SELECT region, pred, label FROM v UNION ALL SELECT 'full', pred, label FROM v) GROUP BY region"),
    ),
    "region_calibration": (
        q_region_calibration,
        with_(
            *REGION_UNITS, base_ctes(RBY), ece_ctes(RBY), *ranked_ctes(RBY, "units"),
            f"SELECT {RBY}, b.pixels, {', '.join(f'{r6(c)} AS {c}' for c in ['nll', 'brier_score', 'ece', 'mean_wrong_confidence', 'error_rate', 'error_auroc', 'aurc', 'oracle_aurc', 'eaurc'])} FROM base b JOIN ece USING ({RBY}) JOIN (SELECT {RBY}, error_rate, error_auroc, aurc, oracle_aurc, eaurc FROM rm) USING ({RBY})",
        ),
    ),
    "class_pixel_histogram": (q_histogram, with_(*G, "SELECT 'p'||(s.k) AS part, CAST(c.k AS INT) AS class_id, (SELECT count(*) FROM grid WHERE sample_id%10=s.k AND label=c.k) AS pixels FROM range(10) s(k) CROSS JOIN range(8) c(k)")),
    "classes_present": (q_classes_present, with_(*G, "SELECT sample_id, array_to_string(list_sort(list(DISTINCT label)), '|') AS classes_present FROM grid GROUP BY sample_id")),
    "compare_masks": (
        q_compare_masks,
        with_(
            *G, "m AS (SELECT * FROM grid WHERE sample_id%9<>0 OR y<7)",
            "SELECT a.vec_id a, b.vec_id b, (a.vec_id%9=0)=(b.vec_id%9=0) AND count(*) FILTER (WHERE p.label<>q.label)=0 AS masks_identical, CASE WHEN (a.vec_id%9=0)=(b.vec_id%9=0) THEN count(*) FILTER (WHERE p.label<>q.label) END AS changed_mask_pixels FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1 JOIN m p ON p.sample_id=a.vec_id JOIN m q ON q.sample_id=b.vec_id AND q.y=p.y AND q.x=p.x GROUP BY a.vec_id, b.vec_id",
        ),
    ),
    "worst_middle_best": (
        q_worst_middle_best,
        with_(
            *G, *seg_ctes("sample_id", "grid", 7), f"sc AS (SELECT sample_id, round(avg({IOU}),6) miou FROM pc GROUP BY sample_id)",
            "o AS (SELECT *, row_number() OVER (ORDER BY miou, sample_id)-1 i, count(*) OVER () n FROM sc)",
            f"SELECT sample_id, {r6('miou')} miou, part, CAST(position AS BIGINT) AS position FROM (SELECT *, 'worst' part, i+1 AS position FROM o WHERE i<5 UNION ALL SELECT *, 'middle', i-greatest(0,n//2-2)+1 FROM o WHERE i>=greatest(0,n//2-2) AND i<n//2+3 UNION ALL SELECT *, 'best', n-i FROM o WHERE i>=n-5)",
        ),
    ),
    "phash_bits": (
        q_phash,
        with_(
            *G,
            f"dct AS (SELECT sample_id, a.k vv, b.k uu, sum(v * {DCT_SCALE.format(u='b.k')}*cos((2*x+1)*b.k*pi()/16e0) * {DCT_SCALE.format(u='a.k')}*cos((2*y+1)*a.k*pi()/16e0)) c FROM grid CROSS JOIN range(8) a(k) CROSS JOIN range(8) b(k) GROUP BY sample_id, a.k, b.k)",
            "dm AS (SELECT sample_id, median(c) m FROM dct WHERE uu+vv>0 GROUP BY sample_id)",
            "SELECT sample_id, CAST(sum(CASE WHEN vv<4 AND c>m THEN 1::BIGINT << CAST(31-(vv*8+uu) AS INT) ELSE 0 END) AS BIGINT) hi, CAST(sum(CASE WHEN vv>=4 AND c>m THEN 1::BIGINT << CAST(63-(vv*8+uu) AS INT) ELSE 0 END) AS BIGINT) lo FROM dct JOIN dm USING (sample_id) GROUP BY sample_id",
        ),
    ),
    "dhash_bits": (
        q_dhash,
        with_(*G, "SELECT sample_id, CAST(sum(CASE WHEN nv > v THEN 1::BIGINT << CAST(55-(y*7+x) AS INT) ELSE 0 END) AS BIGINT) dhash FROM (SELECT *, lead(v) OVER (PARTITION BY sample_id, y ORDER BY x) nv FROM grid) WHERE x<7 GROUP BY sample_id"),
    ),
    "validate_shapes": (q_validate_shapes, with_(*G, "SELECT sample_id, sample_id%9<>0 AS same_size, max(label) < 7 AS valid_labels FROM grid WHERE sample_id%9<>0 OR y<7 GROUP BY sample_id")),
}
