"""DuckDB text of the fixture views, composed into the comparison queries."""

from __future__ import annotations

import math

from plumbline.plans.fixtures import CONDITIONS


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1e-10, 6) + 0e0)"


def with_(*parts: str) -> str:
    """``WITH`` list from CTE texts followed by the final select."""
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


PX = """px AS (SELECT vec_id, label, generate_subscripts(embedding,1)-1 AS pos,
  CAST(unnest(embedding) AS DOUBLE) v FROM embeddings)"""

MANIFEST = """manifest AS (SELECT 'd'||doc_id AS sample_id,
  CASE WHEN source IN ('src18','src19') THEN 'test' ELSE 'train_val' END AS part,
  sha256(text) AS sha, md5(lang || CASE WHEN doc_id%4=0 THEN 'a' ELSE 'b' END) AS mask_sha,
  n_chars AS width, CAST(1 AS BIGINT) AS height, n_chars AS original_mask_width,
  CAST(CASE WHEN doc_id%40=0 THEN 2 ELSE 1 END AS BIGINT) AS original_mask_height,
  CAST(CASE WHEN doc_id%40=0 THEN 1 ELSE 0 END AS BIGINT) AS mask_resized_nearest,
  CAST(CASE WHEN doc_id%3=0 THEN floor(n_chars*(doc_id%10)/20e0) ELSE 0 END AS BIGINT) AS non_exact
  FROM documents)"""

COND = (
    "cond(condition, degradation_type, severity, drop_n, gain) AS (VALUES "
    + ", ".join(f"('{n}','{t}',{s},{d},{g}::DOUBLE)" for n, t, s, d, g in CONDITIONS)
    + ")"
)

# logit: one row per (unit, class)
LOGIT = ",\n".join(
    [
        PX,
        COND,
        """logit AS (
  WITH c AS (SELECT label AS k, pos, avg(v) m FROM px GROUP BY label, pos)
  SELECT px.vec_id, px.label, 's'||(px.vec_id % 25) AS sample_id,
    CASE WHEN px.vec_id % 2 = 0 THEN 'calibration' ELSE 'val' END AS split,
    cond.condition, cond.degradation_type, cond.severity, c.k,
    round(200e0*cond.gain*sum(CASE WHEN px.pos % 8 < cond.drop_n THEN 0e0 ELSE px.v*c.m END), 6) z
  FROM px JOIN c ON px.pos = c.pos CROSS JOIN cond
  GROUP BY px.vec_id, px.label, cond.condition, cond.degradation_type, cond.severity, cond.gain, c.k)""",
    ]
)


def softmax(temperature: str = "1e0", source: str = "logit", name: str = "soft", key: str = "vec_id, condition") -> str:
    """``name``: ``source`` plus the class probability ``p`` at a temperature."""
    return f"""{name} AS (SELECT *, exp(z/({temperature}) - mx) / sum(exp(z/({temperature}) - mx)) OVER (PARTITION BY {key}) AS p
  FROM (SELECT *, max(z/({temperature})) OVER (PARTITION BY {key}) mx, max(z) OVER (PARTITION BY {key}) mz FROM {source}))"""


def units(source: str = "soft", name: str = "units", extra: str = "", key: str = "vec_id, label, sample_id, split, condition, degradation_type, severity") -> str:
    """One row per unit: prediction, confidence and per-unit losses."""
    return f"""{name} AS (SELECT {key}{extra}, max(p) AS conf, min(k) FILTER (WHERE z = mz) AS pred,
  CAST(CASE WHEN min(k) FILTER (WHERE z = mz) = label THEN 1 ELSE 0 END AS BIGINT) AS correct,
  sum(CASE WHEN k = label THEN p ELSE 0 END) AS py,
  sum((p - CASE WHEN k = label THEN 1 ELSE 0 END) * (p - CASE WHEN k = label THEN 1 ELSE 0 END)) AS brier
  FROM {source} GROUP BY {key}{extra})"""


GRID = """grid AS (SELECT a.vec_id sample_id, CAST(floor(a.pos/8) AS INT) y, CAST(a.pos%8 AS INT) x, a.pos, a.v,
  CAST(least(7,greatest(0,floor((b.v+0.25e0)*16))) AS INT) AS label,
  CAST((least(7,greatest(0,floor((b.v+0.25e0)*16))) + CASE WHEN a.v > CASE WHEN a.pos%8 IN (3,4)
    OR CAST(floor(a.pos/8) AS INT) IN (3,4) THEN 0.05e0 ELSE 0.15e0 END THEN 1 ELSE 0 END) % 8 AS INT) AS pred,
  0.3e0 + 0.65e0*least(1e0, abs(a.v)*4) AS conf
  FROM px a JOIN px b ON a.vec_id=b.vec_id
   AND b.pos = CAST(floor(floor(a.pos/8)/4)*32 + floor((a.pos%8)/4)*4 AS INT))"""

GRID_IGNORE = """gridi AS (SELECT sample_id, y, x, v, pred, conf,
  CASE WHEN (sample_id*64+pos)%97=0 THEN 255 ELSE label END AS label FROM grid)"""

def bilinear_axis(n: int, m: int) -> str:
    """Rows (t, s, w): bilinear weights from n source to m target positions."""
    rows = []
    for t in range(m):
        source = max((t + 0.5) * n / m - 0.5, 0.0)
        first = math.floor(source)
        part = source - first
        rows.append((t, first, 1.0 - part))
        if part > 0:
            rows.append((t, min(first + 1, n - 1), part))
    return "(VALUES " + ", ".join(f"({t},{s},{w!r}::DOUBLE)" for t, s, w in rows) + ")"


# V8: labels, distance to the next label, upsampled logits and predictions of the mosaic images
MOSAIC = [
    PX, COND, GRID, GRID_IGNORE,
    "mos AS (SELECT sample_id//4 AS img, CAST(((sample_id%4)//2)*8+y AS INT) y, CAST(((sample_id%4)%2)*8+x AS INT) x, label FROM gridi)",
    "dist AS (SELECT g.img, g.y, g.x, g.label, coalesce(min(greatest(abs(h.y-g.y), abs(h.x-g.x))) FILTER (WHERE h.label<>g.label), 6) AS distance FROM mos g JOIN mos h ON h.img=g.img AND abs(h.y-g.y)<=5 AND abs(h.x-g.x)<=5 GROUP BY ALL)",
    "low AS (SELECT sample_id//4 AS img, ((sample_id%4)//2)*4+y//2 y, ((sample_id%4)%2)*4+x//2 x, pred, conf FROM grid WHERE y%2=0 AND x%2=0)",
    "lz AS (SELECT img, y, x, condition, k, round((CASE WHEN x%8 < drop_n THEN 0e0 ELSE gain END)*ln(CASE WHEN k=pred THEN conf ELSE (1e0-conf)/7e0 END), 6) z FROM low CROSS JOIN range(8) t(k) CROSS JOIN cond)",
    f"up AS (SELECT img, condition, ty.t y, tx.t x, k, round(sum(ty.w*tx.w*z), 10) z FROM lz JOIN {bilinear_axis(8, 16)} ty(t,s,w) ON ty.s=lz.y JOIN {bilinear_axis(8, 16)} tx(t,s,w) ON tx.s=lz.x GROUP BY ALL)",
    "upp AS (SELECT img, condition, y, x, min(k) FILTER (WHERE z=mz) pred FROM (SELECT *, max(z) OVER (PARTITION BY img, condition, y, x) mz FROM up) GROUP BY img, condition, y, x)",
    "off3 AS (SELECT a.k dy, b.k dx FROM range(-1,2) a(k) CROSS JOIN range(-1,2) b(k))",
    "lod AS (SELECT g.img, g.condition, g.y, g.x, g.pred, avg(CASE WHEN h.pred=g.pred THEN 0e0 ELSE 1e0 END) ld FROM upp g CROSS JOIN off3 JOIN upp h ON h.img=g.img AND h.condition=g.condition AND h.y=least(15,greatest(0,g.y+dy)) AND h.x=least(15,greatest(0,g.x+dx)) GROUP BY ALL)",
]


def mosaic_scores(temperature: float, digits: int) -> list[str]:
    """``ms``: one row per valid pixel, condition and score."""
    t = f"{temperature!r}::DOUBLE"
    names = ["raw_msp", "calibrated_msp", "entropy", "probability_margin", "logit_margin", "energy", "local_disagreement"]
    return [
        f"mp AS (SELECT *, exp(z-mz)/sum(exp(z-mz)) OVER w p1, exp((z-mz)/{t})/sum(exp((z-mz)/{t})) OVER w p FROM (SELECT *, max(z) OVER (PARTITION BY img, condition, y, x) mz FROM up) WINDOW w AS (PARTITION BY img, condition, y, x))",
        f"mw AS (SELECT img, condition, y, x, 1-max(p1) raw_msp, 1-max(p) calibrated_msp, -sum(p*ln(greatest(p,1.1920928955078125e-07))) entropy, 1-(list_sort(list(p),'DESC')[1]-list_sort(list(p),'DESC')[2]) probability_margin, -(list_sort(list(z),'DESC')[1]-list_sort(list(z),'DESC')[2])/{t} logit_margin, -(max(z)/{t}+ln(sum(exp((z-mz)/{t})))) energy FROM mp GROUP BY img, condition, y, x)",
        "mu AS (SELECT mw.*, ld AS local_disagreement, pred, label, distance, CAST(pred<>label AS INT) err FROM mw JOIN lod USING (img, condition, y, x) JOIN dist USING (img, y, x) WHERE label BETWEEN 0 AND 7)",
        "ms AS (" + " UNION ALL ".join(f"SELECT img, condition, y, x, distance, err, '{n}' AS score_name, CAST(round({n}, {digits}) AS FLOAT) AS score FROM mu" for n in names) + ")",
    ]


SCORED = """scored AS (SELECT event_id, 'u'||user_id AS sample_id, 'c'||(event_id%4) AS condition,
  CASE WHEN event_id%7=0 THEN 'boundary' ELSE 'interior' END AS region,
  CAST(floor(cents/50)/1000e0 AS FLOAT) score_a, CAST((event_id%10)/9e0 AS FLOAT) score_b,
  CAST((user_id%50)/50e0 AS FLOAT) score_c,
  CAST(CASE WHEN event_type='error' OR (cents > 6000 AND event_id%3=0) THEN 1 ELSE 0 END AS BIGINT) err
  FROM (SELECT *, CAST(round(value*100) AS BIGINT) cents FROM events))"""

SCORED_LONG = """scored_long AS (
  SELECT event_id, sample_id, condition, region, err, 'score_a' score_name, score_a score FROM scored
  UNION ALL SELECT event_id, sample_id, condition, region, err, 'score_b', score_b FROM scored
  UNION ALL SELECT event_id, sample_id, condition, region, err, 'score_c', score_c FROM scored)"""

HASHED = """med AS (SELECT vec_id, median(v) m FROM px WHERE pos > 0 GROUP BY vec_id),
steps AS (SELECT vec_id, pos, v, lead(v) OVER (PARTITION BY vec_id ORDER BY pos) nv FROM px),
dsteps AS (SELECT vec_id, 8 + CAST(floor(pos/8) AS INT)*7 + pos%8 AS bit FROM steps WHERE pos%8 < 7 AND nv > v),
dh AS (SELECT vec_id, CAST(coalesce(sum(CASE WHEN bit < 32 THEN 1::BIGINT << (31-bit) ELSE 0 END),0) AS BIGINT) dhi,
  CAST(coalesce(sum(CASE WHEN bit >= 32 THEN 1::BIGINT << (63-bit) ELSE 0 END),0) AS BIGINT) dlo FROM dsteps GROUP BY vec_id),
orig AS (SELECT px.vec_id, 'train_val' AS part,
  CAST(coalesce(sum(CASE WHEN pos < 32 AND v > m THEN 1::BIGINT << CAST(31-pos AS INT) ELSE 0 END),0) AS BIGINT) hi,
  CAST(coalesce(sum(CASE WHEN pos >= 32 AND v > m THEN 1::BIGINT << CAST(63-pos AS INT) ELSE 0 END),0) AS BIGINT) lo
  FROM px JOIN med USING (vec_id) GROUP BY px.vec_id),
orig2 AS (SELECT o.vec_id, part, hi, lo, coalesce(dhi,0) dhi, coalesce(dlo,0) dlo FROM orig o LEFT JOIN dh USING (vec_id)),
hashed AS (SELECT *, 'v'||lpad(CAST(vec_id AS VARCHAR),8,'0') sample_id FROM (
  SELECT * FROM orig2 UNION ALL
  SELECT vec_id+1000000, 'test', hi, xor(lo, (1::BIGINT << CAST((vec_id//10)%6 AS INT)) - 1), dhi,
    xor(dlo, 7::BIGINT << CAST(vec_id%3 AS INT)) FROM orig2 WHERE vec_id%10=0))"""

HISTORY = """history AS (SELECT CAST(day(ts) AS BIGINT) AS epoch, avg(value) AS train_loss, count(*) AS n,
  CASE WHEN day(ts)%5=0 THEN avg(CASE WHEN event_type='purchase' THEN 1e0 ELSE 0e0 END) END AS val_metric
  FROM events GROUP BY day(ts))"""

RGB = """rgb AS (SELECT vec_id AS sample_id, CAST(floor(pos/8) AS BIGINT) y, CAST(pos%8 AS BIGINT) x,
  CAST(CASE WHEN pos%4<>0 THEN 255*((label%8)//4) ELSE (pos*37+vec_id*11)%256 END AS BIGINT) r,
  CAST(CASE WHEN pos%4<>0 THEN 255*(((label%8)//2)%2) ELSE (pos*53+vec_id*7)%256 END AS BIGINT) g,
  CAST(CASE WHEN pos%4<>0 THEN 255*((label%8)%2) ELSE (pos*91+vec_id*13)%256 END AS BIGINT) b,
  CAST(label%8 AS BIGINT) AS label FROM px)"""


def md5_index(size: str, *parts: str) -> str:
    """Uniform index from 60 md5 bits, as in ``functions.numerics.shuffle_index``."""
    return f"(CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}),1,15) AS BIGINT) % ({size}))"
