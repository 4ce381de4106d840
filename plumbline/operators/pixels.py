"""Colour and label transforms over pixel rows ``(sample, y, x, r, g, b)``.

The arithmetic keeps the 32-bit steps of the image library it stands in for, so
truncation to whole levels falls on the same side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.spatial import gaussian_blur

# Channel statistics of the usual pretrained encoders.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
# Blue-green veil of the colour attenuation.
VEIL = (0.0, 0.55, 0.85)
CHANNELS = ("r", "g", "b")


def _single(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def _unit(channel: str) -> Column:
    return (F.col(channel).cast("float") / _single(255.0)).cast("float")


def _level(value: Column) -> Column:
    """Clip to 0..255 and truncate."""
    return F.floor(F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(255.0)))


def is_exact_colour() -> Column:
    """Every channel is at an end of its range."""
    out = F.lit(True)
    for c in CHANNELS:
        out = out & F.col(c).isin(0, 255)
    return out


def _code(threshold: int) -> Column:
    bits = [F.when(F.col(c) >= threshold, weight).otherwise(0) for c, weight in zip(CHANNELS, (4, 2, 1))]
    return bits[0] + bits[1] + bits[2]


def rgb_to_class(df: DataFrame, strict: bool = False, out: str = "class_id") -> DataFrame:
    """Exact palette lookup; other colours are 255, or an error if strict."""
    if strict:
        unknown = df.filter(~is_exact_colour()).select(*CHANNELS).distinct().orderBy(*CHANNELS).limit(20).collect()
        if unknown:
            raise ValueError(f"unknown colours, first values: {[tuple(r) for r in unknown]}")
    return df.withColumn(out, F.when(is_exact_colour(), _code(255)).otherwise(255))


def rgb_to_class_threshold(df: DataFrame, out: str = "class_id") -> DataFrame:
    """Nearest palette corner and whether the colour was inexact."""
    return df.withColumn(out, _code(128)).withColumn("non_exact", ~is_exact_colour())


def class_to_rgb(df: DataFrame, label: str = "label") -> DataFrame:
    """Palette colour of a class; an invalid class is an error."""
    ok = (F.col(label) >= 0) & (F.col(label) <= 7)
    checked = F.when(ok, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("invalid class "), F.col(label))))
    bits = [F.shiftright(checked.cast("int"), b).bitwiseAND(1) * 255 for b in (2, 1, 0)]
    return df.select("*", *[b.cast("bigint").alias(c) for c, b in zip(CHANNELS, bits)])


def normalize_channels(df: DataFrame) -> DataFrame:
    """(v/255 - mean) / std per channel."""
    return df.select("*", *[((F.col(c) / 255.0 - m) / s).alias(f"{c}_norm") for c, m, s in zip(CHANNELS, CHANNEL_MEAN, CHANNEL_STD)])


def denormalize_channels(df: DataFrame) -> DataFrame:
    """B12 inverse, clipped to [0, 1]."""

    def back(c, m, s):
        return F.least(F.greatest(F.col(f"{c}_norm") * s + m, F.lit(0.0)), F.lit(1.0))

    return df.select("*", *[back(c, m, s).alias(f"{c}_unit") for c, m, s in zip(CHANNELS, CHANNEL_MEAN, CHANNEL_STD)])


def overlay(df: DataFrame, alpha: float, label: str = "label") -> DataFrame:
    """Blend of the image and its label colour, truncated."""
    tinted = class_to_rgb(df.select(*[c for c in df.columns if c not in CHANNELS], *[F.col(c).alias(f"_{c}") for c in CHANNELS]), label)
    mixed = [F.floor(F.col(f"_{c}") * (1.0 - alpha) + F.col(c) * alpha) for c in CHANNELS]
    return tinted.select(*[c for c in df.columns if c not in CHANNELS], *[m.alias(c) for m, c in zip(mixed, CHANNELS)])


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def attenuated(red_scale: float, green_scale: float, blue_scale: float, blue_green_veil: float) -> list[Column]:
    """Channel scales plus a veil."""
    scales = (red_scale, green_scale, blue_scale)
    _require(all(0 <= s <= 1 for s in (*scales, blue_green_veil)), "colour parameters must lie in [0, 1]")

    def one(channel, scale, veil):
        added = (_single(veil) * _single(blue_green_veil)).cast("float")
        lit = (_unit(channel) * _single(scale)).cast("float") + added
        return _level((lit * _single(255.0)).cast("float"))

    return [one(c, s, v) for c, s, v in zip(CHANNELS, scales, VEIL)]


def darkened(exposure: float, gamma: float) -> list[Column]:
    """Exposure then gamma."""
    _require(0 < exposure <= 1 and gamma >= 1, "exposure must lie in (0, 1] and gamma must be at least 1")

    def one(channel):
        dim = F.least(F.greatest((_unit(channel) * _single(exposure)).cast("float"), _single(0.0)), _single(1.0))
        curved = F.pow(dim.cast("double"), F.lit(float(gamma))).cast("float")
        return _level((curved * _single(255.0)).cast("float"))

    return [one(c) for c in CHANNELS]


def sample_phase(sample: Column, byte: int) -> Column:
    """Angle from one byte of the id's SHA-256."""
    digest = F.sha2(sample.cast("string"), 256)
    return F.conv(F.substring(digest, 2 * byte + 1, 2), 16, 10).cast("double") / 255.0 * 2.0 * math.pi


def hazed(
    transmission: float, airlight_rgb: tuple[float, float, float], spatial_variation: float, sample: str, height: Column, width: Column
) -> list[Column]:
    """Haze whose strength varies over the image, fixed per sample."""
    _require(0 < transmission <= 1 and 0 <= spatial_variation < transmission, "invalid transmission or variation")
    _require(len(airlight_rgb) == 3 and all(0 <= a <= 1 for a in airlight_rgb), "airlight must be three values in [0, 1]")
    wave_x = F.sin(2.0 * math.pi * F.col("x") / F.greatest(width, F.lit(1)) + sample_phase(F.col(sample), 0))
    wave_y = F.cos(2.0 * math.pi * F.col("y") / F.greatest(height, F.lit(1)) + sample_phase(F.col(sample), 1))
    texture = (wave_x + wave_y + 2.0) / 4.0
    local = F.least(F.greatest(F.lit(float(transmission)) - F.lit(float(spatial_variation)) * texture, F.lit(0.05)), F.lit(1.0))

    def one(channel, air):
        return _level((_unit(channel).cast("double") * local + _single(air).cast("double") * (1.0 - local)) * 255.0)

    return [one(c, a) for c, a in zip(CHANNELS, airlight_rgb)]


def _replace(df: DataFrame, channels: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in CHANNELS]
    return df.select(*rest, *[v.alias(c) for v, c in zip(channels, CHANNELS)])


def degrade_color(df: DataFrame, **parameters) -> DataFrame:
    return _replace(df, attenuated(**parameters))


def degrade_lowlight(df: DataFrame, **parameters) -> DataFrame:
    return _replace(df, darkened(**parameters))


def degrade_turbidity(df: DataFrame, sample: str, height: Column, width: Column, **parameters) -> DataFrame:
    return _replace(df, hazed(sample=sample, height=height, width=width, **parameters))


def degrade_blur(df: DataFrame, sample: list[str], kernel_size: int, sigma: float) -> DataFrame:
    return gaussian_blur(df, sample, kernel_size, sigma, list(CHANNELS))


@dataclass(frozen=True)
class Condition:
    """One registered image condition."""

    name: str
    degradation_type: str
    severity: int
    parameters: dict = field(default_factory=dict)


# The registered conditions.
CONDITIONS = (
    Condition("clean", "clean", 0),
    Condition("color_s1", "color_attenuation", 1, {"red_scale": 0.75, "green_scale": 0.88, "blue_scale": 0.97, "blue_green_veil": 0.02}),
    Condition("color_s2", "color_attenuation", 2, {"red_scale": 0.52, "green_scale": 0.76, "blue_scale": 0.93, "blue_green_veil": 0.05}),
    Condition("color_s3", "color_attenuation", 3, {"red_scale": 0.32, "green_scale": 0.63, "blue_scale": 0.88, "blue_green_veil": 0.08}),
    Condition("turbidity_s1", "turbidity", 1, {"transmission": 0.88, "airlight_rgb": (0.15, 0.48, 0.67), "spatial_variation": 0.04}),
    Condition("turbidity_s2", "turbidity", 2, {"transmission": 0.68, "airlight_rgb": (0.18, 0.52, 0.70), "spatial_variation": 0.08}),
    Condition("turbidity_s3", "turbidity", 3, {"transmission": 0.48, "airlight_rgb": (0.22, 0.56, 0.73), "spatial_variation": 0.12}),
    Condition("lowlight_s1", "lowlight", 1, {"exposure": 0.78, "gamma": 1.08}),
    Condition("lowlight_s2", "lowlight", 2, {"exposure": 0.56, "gamma": 1.20}),
    Condition("lowlight_s3", "lowlight", 3, {"exposure": 0.36, "gamma": 1.35}),
    Condition("blur_s1", "blur", 1, {"kernel_size": 3, "sigma": 0.8}),
    Condition("blur_s2", "blur", 2, {"kernel_size": 7, "sigma": 1.6}),
    Condition("blur_s3", "blur", 3, {"kernel_size": 11, "sigma": 2.5}),
)


def load_conditions(rows: list[dict], expected: int = len(CONDITIONS)) -> tuple[Condition, ...]:
    """Exactly ``expected`` unique names and one clean severity-0 row."""
    out = tuple(Condition(str(r["name"]), str(r["degradation_type"]), int(r["severity"]), dict(r.get("parameters") or {})) for r in rows)
    names = {c.name for c in out}
    _require(len(out) == expected and len(names) == expected, f"expected {expected} uniquely named conditions")
    clean = [c for c in out if c.name == "clean" and c.degradation_type == "clean" and c.severity == 0]
    _require(len(clean) == 1, "expected one clean condition of severity 0")
    return out


PointTransform = Callable[..., list[Column]]
POINT: dict[str, PointTransform] = {"color_attenuation": attenuated, "lowlight": darkened}


def apply_conditions(df: DataFrame, sample: str, conditions: tuple[Condition, ...], height: Column, width: Column, transforms: dict[str, PointTransform] | None = None) -> DataFrame:
    """Every pixel under every condition; coordinates and labels are kept.

    ``transforms`` (N1) adds point transforms by degradation type; each returns
    the three new channel columns.

    Point conditions are computed side by side in one scan and fanned out; only
    the neighbourhood conditions add a shuffle of their own.
    """
    point = POINT | (transforms or {})
    rest = [c for c in df.columns if c not in CHANNELS]
    rows, blurs = [], []
    for c in conditions:
        if c.degradation_type == "blur":
            blurs.append(c)
            continue
        if c.degradation_type == "clean":
            channels = [F.col(name).cast("bigint") for name in CHANNELS]
        elif c.degradation_type == "turbidity":
            channels = hazed(sample=sample, height=height, width=width, **c.parameters)
        elif c.degradation_type in point:
            channels = point[c.degradation_type](**c.parameters)
        else:
            raise ValueError(f"unsupported degradation type {c.degradation_type}")
        rows.append(F.struct(F.lit(c.name).alias("condition"), *[v.alias(n) for v, n in zip(channels, CHANNELS)]))
    out = df.select(*rest, F.inline(F.array(*rows))) if rows else None
    for c in blurs:
        blurred = degrade_blur(df, [sample], **c.parameters)
        kept = blurred.withColumn("condition", F.lit(c.name)).select(*rest, "condition", *CHANNELS)
        out = kept if out is None else out.unionByName(kept)
    return out


def changed_layout(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Validator of a user transform: pixels added, lost or out of range."""
    left = before.select(*keys, F.lit(1).alias("_b"))
    bad = F.lit(False)
    for c in CHANNELS:
        bad = bad | F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 255)
    right = after.select(*keys, F.lit(1).alias("_a"), bad.alias("_bad"))
    joined = left.join(right, keys, "full_outer")
    return joined.agg(
        F.count_if(F.col("_b").isNull()).alias("added"),
        F.count_if(F.col("_a").isNull()).alias("lost"),
        F.count_if("_bad").alias("out_of_range"),
    )
