"""Colour queries (B6, B7, B12-B16, B18) over the pixel view (V7)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.catalog.calibration import rounded
from plumbline.catalog.grids import blur_axis_sql
from plumbline.catalog.views import PX, RGB, r6, with_
from plumbline.operators import pixels as pxl
from plumbline.plans import fixtures as fx

SIZE = 8
KEY = ["sample_id", "y", "x"]


def image(spark, sf):
    return fx.rgb(spark, sf)


def colours(df):
    return df.select(*KEY, "r", "g", "b")


def q_class(spark, sf):
    return pxl.rgb_to_class(image(spark, sf)).select(*KEY, "class_id")


def q_threshold(spark, sf):
    return pxl.rgb_to_class_threshold(image(spark, sf)).select(*KEY, "class_id", "non_exact")


def q_normalize(spark, sf):
    out = pxl.denormalize_channels(pxl.normalize_channels(image(spark, sf)))
    names = [f"{c}_{k}" for c in pxl.CHANNELS for k in ("norm", "unit")]
    return rounded(out.select(*KEY, *names), *names)


def q_overlay(spark, sf):
    return colours(pxl.overlay(image(spark, sf), 0.45))


def by_name(name):
    return next(c for c in pxl.CONDITIONS if c.name == name).parameters


def q_color(spark, sf):
    return colours(pxl.degrade_color(image(spark, sf), **by_name("color_s2")))


def q_lowlight(spark, sf):
    return colours(pxl.degrade_lowlight(image(spark, sf), **by_name("lowlight_s2")))


def q_turbidity(spark, sf):
    return colours(pxl.degrade_turbidity(image(spark, sf), "sample_id", F.lit(SIZE), F.lit(SIZE), **by_name("turbidity_s2")))


def q_apply(spark, sf):
    out = pxl.apply_conditions(image(spark, sf), "sample_id", pxl.CONDITIONS, F.lit(SIZE), F.lit(SIZE))
    return out.select("condition", *KEY, "label", "r", "g", "b")


BASE = [PX, RGB]


def f32(value):
    return f"CAST({float(value)!r}::DOUBLE AS FLOAT)"


def unit(c):
    return f"(CAST({c} AS FLOAT)/{f32(255)})"


def level(expr):
    return f"CAST(floor(least(greatest(CAST({expr} AS DOUBLE), 0e0), 255e0)) AS BIGINT)"


def color_sql(p):
    scales = (p["red_scale"], p["green_scale"], p["blue_scale"])
    return {c: level(f"({unit(c)}*{f32(s)} + {f32(v)}*{f32(p['blue_green_veil'])})*{f32(255)}") for c, s, v in zip("rgb", scales, pxl.VEIL)}


def lowlight_sql(p):
    return {c: level(f"CAST(pow(CAST(least(greatest({unit(c)}*{f32(p['exposure'])},0),1) AS DOUBLE), {p['gamma']}e0) AS FLOAT)*{f32(255)}") for c in "rgb"}


def turbidity_sql(p):
    two_pi = repr(2.0 * math.pi)
    phase = [f"(CAST('0x'||substr(sha256(CAST(sample_id AS VARCHAR)),{2*b+1},2) AS BIGINT)/255e0*2e0*{math.pi!r}::DOUBLE)" for b in (0, 1)]
    texture = f"((sin({two_pi}::DOUBLE*x/8 + {phase[0]}) + cos({two_pi}::DOUBLE*y/8 + {phase[1]}) + 2e0)/4e0)"
    local = f"least(greatest({p['transmission']}e0 - {p['spatial_variation']}e0*{texture}, 0.05e0), 1e0)"
    return {c: level(f"(CAST({unit(c)} AS DOUBLE)*{local} + CAST({f32(a)} AS DOUBLE)*(1e0-{local}))*255e0") for c, a in zip("rgb", p["airlight_rgb"])}


def channel_sql(condition):
    kind, p = condition.degradation_type, condition.parameters
    if kind == "clean":
        return {c: c for c in "rgb"}
    return {"color_attenuation": color_sql, "lowlight": lowlight_sql, "turbidity": turbidity_sql}[kind](p)


def select_sql(channels, prefix=""):
    return f"SELECT {prefix}sample_id, y, x, " + ", ".join(f"{e} AS {c}" for c, e in channels.items()) + " FROM rgb"


def apply_sql():
    parts = []
    for c in pxl.CONDITIONS:
        if c.degradation_type == "blur":
            axis = blur_axis_sql(SIZE, c.parameters["kernel_size"], c.parameters["sigma"])
            sums = ", ".join(f"CAST(round_even(sum(ty.w*tx.w*q.{k}), 0) AS BIGINT) AS {k}" for k in "rgb")
            parts.append(
                f"SELECT '{c.name}' AS condition, b.sample_id, b.y, b.x, b.label, s.r, s.g, s.b FROM rgb b JOIN (SELECT q.sample_id, ty.t y, tx.t x, {sums} FROM rgb q JOIN {axis} ty(t,s,w) ON ty.s=q.y JOIN {axis} tx(t,s,w) ON tx.s=q.x GROUP BY q.sample_id, ty.t, tx.t) s ON s.sample_id=b.sample_id AND s.y=b.y AND s.x=b.x"
            )
        else:
            parts.append(f"SELECT '{c.name}' AS condition, sample_id, y, x, label, " + ", ".join(f"{e} AS {k}" for k, e in channel_sql(c).items()) + " FROM rgb")
    return " UNION ALL ".join(parts)


CODE = "CAST(CASE WHEN r>={t} THEN 4 ELSE 0 END + CASE WHEN g>={t} THEN 2 ELSE 0 END + CASE WHEN b>={t} THEN 1 ELSE 0 END AS INT)"
EXACT = "(r IN (0,255) AND g IN (0,255) AND b IN (0,255))"
NORM = ", ".join(
    f"{r6(f'({c}/255e0 - {m}e0)/{s}e0')} AS {c}_norm, {r6(f'least(greatest(({c}/255e0 - {m}e0)/{s}e0*{s}e0 + {m}e0, 0e0), 1e0)')} AS {c}_unit"
    for c, m, s in zip("rgb", pxl.CHANNEL_MEAN, pxl.CHANNEL_STD)
)
TINT = {c: f"CAST(floor({c}*(1e0-0.45e0) + 255*((label//{d})%2)*0.45e0) AS BIGINT)" for c, d in zip("rgb", (4, 2, 1))}

ENTRIES = {
    "rgb_to_class": (q_class, with_(*BASE, f"SELECT sample_id, y, x, CASE WHEN {EXACT} THEN {CODE.format(t=255)} ELSE 255 END AS class_id FROM rgb")),
    "rgb_to_class_threshold": (q_threshold, with_(*BASE, f"SELECT sample_id, y, x, {CODE.format(t=128)} AS class_id, NOT {EXACT} AS non_exact FROM rgb")),
    "normalize_channels": (q_normalize, with_(*BASE, f"SELECT sample_id, y, x, {NORM} FROM rgb")),
    "overlay": (q_overlay, with_(*BASE, select_sql(TINT))),
    "degrade_color": (q_color, with_(*BASE, select_sql(color_sql(by_name("color_s2"))))),
    "degrade_lowlight": (q_lowlight, with_(*BASE, select_sql(lowlight_sql(by_name("lowlight_s2"))))),
    "degrade_turbidity": (q_turbidity, with_(*BASE, select_sql(turbidity_sql(by_name("turbidity_s2"))))),
    "apply_condition": (q_apply, with_(*BASE, apply_sql())),
}
