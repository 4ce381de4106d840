"""Neighbourhood operators over pixel tables ``(sample, y, x, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _extent(df: DataFrame, sample: list[str]) -> DataFrame:
    return df.groupBy(*sample).agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))


def with_extent(df: DataFrame, sample: list[str]) -> DataFrame:
    """Largest coordinates per sample: one small row per sample, joined back."""
    return df.join(_extent(df, sample), sample)


def _line(sample: list[str], axis: str, radius: int):
    """Window along an image row (axis x) or column (axis y), clipped at its ends."""
    return W.partitionBy(*sample, "y" if axis == "x" else "x").orderBy(axis).rowsBetween(-radius, radius)


def local_disagreement(df: DataFrame, sample: list[str], pred: str = "pred", radius: int = 1) -> DataFrame:
    """Share of the window whose prediction differs from the centre's.

    Every pixel gathers its neighbours along the row, then the gathered lists
    along the column: two windows over single image lines, no copies of pixels
    and no join. A list cut short by the edge repeats its end.
    """
    side = 2 * radius + 1

    def padded(found: Column, axis: str) -> Column:
        before = F.greatest(F.lit(radius) - F.col(axis), F.lit(0)).cast("int")
        after = F.lit(side) - before - F.size(found)
        return F.concat(F.array_repeat(F.get(found, F.lit(0)), before), found, F.array_repeat(F.get(found, F.size(found) - 1), after))

    rows = df.withColumn("_row", F.collect_list(F.struct(F.col(pred).alias("p"))).over(_line(sample, "x", radius)))
    rows = rows.withColumn("_row", padded(F.col("_row"), "x"))
    both = rows.withColumn("_box", F.collect_list("_row").over(_line(sample, "y", radius))).drop("_row")
    differs = F.filter(F.flatten(padded(F.col("_box"), "y")), lambda v: ~v["p"].eqNullSafe(F.col(pred)))
    return both.withColumn("local_disagreement", F.size(differs) / float(side * side)).drop("_box")


def boundary_mask(df: DataFrame, sample: list[str], radius: int, label: str = "label", out: str = "boundary") -> DataFrame:
    """True where the labels within the box are not all equal.

    Separable: extremes along rows, then along columns. A window partition is
    one image row or column, never a whole image.
    """
    row = W.partitionBy(*sample, "y").orderBy("x").rowsBetween(-radius, radius)
    column = W.partitionBy(*sample, "x").orderBy("y").rowsBetween(-radius, radius)
    along = df.withColumn("_hi", F.max(label).over(row)).withColumn("_lo", F.min(label).over(row))
    both = along.withColumn("_hi", F.max("_hi").over(column)).withColumn("_lo", F.min("_lo").over(column))
    return both.withColumn(out, F.col("_hi") != F.col("_lo")).drop("_hi", "_lo")


def region_of(boundary: str = "boundary") -> Column:
    return F.when(F.col(boundary), "boundary").otherwise("interior")


def _axis_scatter(name: str, size: Column, low: Column, high: Column, weight) -> Column:
    """Targets ``at`` in [low, high] with their non-zero weight for this source."""
    spots = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    weighted = F.transform(spots, lambda t: F.struct(t.alias("at"), weight(t, F.col(name), size).alias("w")))
    return F.filter(weighted, lambda s: s["w"] > 0)


def _sized(df: DataFrame, sample: list[str]) -> DataFrame:
    out = with_extent(df, sample)
    return (
        out.withColumn("_h", F.col("_my").cast("bigint") + 1)
        .withColumn("_w", F.col("_mx").cast("bigint") + 1)
        .withColumn("y", F.col("y").cast("bigint"))
        .withColumn("x", F.col("x").cast("bigint"))
        .drop("_my", "_mx")
    )


def nearest_resize(df: DataFrame, sample: list[str], height: int, width: int, values: list[str]) -> DataFrame:
    """Nearest-neighbour resize, source index floor((i + 0.5) * scale).

    Each source cell is sent to the target cells that read it, so there is no
    target grid to build and nothing to join but the image sizes.
    """

    def axis(name, size, target):
        low = F.floor(F.col(name) * target / size) - 1
        high = F.floor((F.col(name) + 1) * target / size) + 1

        def reads(t, position, extent):
            return F.when(F.floor((t + 0.5) * extent / target) == position, 1).otherwise(0)

        return _axis_scatter(name, size, F.greatest(low, F.lit(0)), F.least(high, F.lit(target - 1)), reads)

    rows = _sized(df.select(*sample, "y", "x", *values), sample)
    rows = rows.withColumn("_ty", F.explode(axis("y", F.col("_h"), height))).withColumn("_tx", F.explode(axis("x", F.col("_w"), width)))
    return rows.select(*sample, F.col("_ty.at").alias("y"), F.col("_tx.at").alias("x"), *values)


def bilinear_upsample(df: DataFrame, sample: list[str], height: int, width: int, values: dict[str, Column]) -> DataFrame:
    """Half-pixel bilinear interpolation as a weighted scatter and one sum."""

    def axis(name, size, target):
        low = F.floor((F.col(name) - 1) * target / size) - 1
        high = F.floor((F.col(name) + 2) * target / size) + 1

        def share(t, position, extent):
            source = F.greatest((t + 0.5) * extent / target - 0.5, F.lit(0.0))
            first = F.floor(source)
            second = F.least(first + 1, extent - 1)
            part = source - first
            return F.when(first == position, 1.0 - part).otherwise(0.0) + F.when(second == position, part).otherwise(0.0)

        return _axis_scatter(name, size, F.greatest(low, F.lit(0)), F.least(high, F.lit(target - 1)), share)

    named = df.select(*sample, "y", "x", *[c.alias(n) for n, c in values.items()])
    rows = _sized(named, sample)
    rows = rows.withColumn("_ty", F.explode(axis("y", F.col("_h"), height))).withColumn("_tx", F.explode(axis("x", F.col("_w"), width)))
    weight = F.col("_ty.w") * F.col("_tx.w")
    flat = rows.select(*sample, F.col("_ty.at").alias("y"), F.col("_tx.at").alias("x"), *[(weight * F.col(n)).alias(n) for n in values])
    return flat.groupBy(*sample, "y", "x").agg(*[F.sum(n).alias(n) for n in values])


def gaussian_weights(kernel: int, sigma: float) -> list[float]:
    import math

    radius = kernel // 2
    raw = [math.exp(-(d * d) / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_blur(
    df: DataFrame, sample: list[str], kernel: int, sigma: float, channels: list[str]
) -> DataFrame:
    """Separable Gaussian with a mirrored border that skips the edge pixel.

    Every pixel gathers its image line within the radius, along rows and then
    along columns, and sums it with the weights; a mirrored source is never
    farther than the radius from its target. Two windows over single lines, no
    copies of pixels. A line's size matters only where the window is clipped, and
    there the clipped list ends with the line. Other columns ride along.
    """
    if kernel < 3 or kernel % 2 == 0 or sigma <= 0:
        raise ValueError("blur needs an odd kernel of at least 3 and a positive sigma")
    radius, weights = kernel // 2, gaussian_weights(kernel, sigma)
    extra = [c for c in df.columns if c not in (*sample, "y", "x", *channels)]
    place = [F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")]
    rows = df.select(*sample, *place, *extra, *channels)
    for axis in ("x", "y"):
        gathered = rows.withColumn("_line", F.collect_list(F.struct(*channels)).over(_line(sample, axis, radius)))
        first = F.greatest(F.col(axis) - radius, F.lit(0))
        period = F.greatest(2 * (first + F.size("_line") - 1), F.lit(1))

        def source(d: int) -> Column:
            spot = F.pmod(F.col(axis) + d, period)
            return F.get(F.col("_line"), (F.least(spot, period - spot) - first).cast("int"))

        picked = gathered.withColumn("_taps", F.array(*[source(d) for d in range(-radius, radius + 1)]))
        sums = {c: sum((F.get(F.col("_taps"), F.lit(i))[c] * w for i, w in enumerate(weights)), F.lit(0.0)) for c in channels}
        rows = picked.select(*[c for c in rows.columns if c not in channels], *[total.alias(c) for c, total in sums.items()])
    return rows.select(*sample, "y", "x", *extra, *[F.rint(c).cast("bigint").alias(c) for c in channels])


def class_histogram(df: DataFrame, by: list[str], classes: int, label: str = "label") -> DataFrame:
    """pixels per class, zero-filled over the classes."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(label) == k).alias(f"_c{k}") for k in range(classes)])
    rows = [F.struct(F.lit(k).alias("class_id"), F.col(f"_c{k}").alias("pixels")) for k in range(classes)]
    return counts.select(*by, F.inline(F.array(*rows)))


def classes_present(df: DataFrame, sample: list[str], label: str = "label") -> DataFrame:
    """F16: sorted distinct classes, packed as text."""
    packed = F.array_join(F.array_sort(F.collect_set(F.col(label).cast("int"))), "|")
    return df.groupBy(*sample).agg(packed.alias("classes_present"))


def validate_shapes(images: DataFrame, masks: DataFrame, sample: str, classes: int) -> DataFrame:
    """Per sample, whether sizes agree and whether every label is valid."""

    def extent(df, name, *extra):
        return df.groupBy(sample).agg(F.max("y").alias(f"_y{name}"), F.max("x").alias(f"_x{name}"), *extra)

    left = extent(images, "i")
    right = extent(masks, "m", F.max("label").alias("_top"), F.min("label").alias("_low"))
    same = F.col("_yi").eqNullSafe(F.col("_ym")) & F.col("_xi").eqNullSafe(F.col("_xm"))
    valid = (F.col("_top") < classes) & (F.col("_low") >= 0)
    return left.join(right, sample, "full_outer").select(
        sample, same.alias("same_size"), F.coalesce(valid, F.lit(False)).alias("valid_labels")
    )


def compare_masks(pairs: DataFrame, masks: DataFrame, sample: str, left: str, right: str, label: str = "label") -> DataFrame:
    """identical?, changed pixels; different sizes give (false, null)."""
    cells = masks.select(F.col(sample).alias("_id"), "y", "x", F.col(label).alias("_label"))

    def side(column, name):
        ids = pairs.select(left, right, F.col(column).alias("_id"))
        return ids.join(cells, "_id").select(left, right, "y", "x", F.col("_label").alias(name))

    both = side(left, "_a").join(side(right, "_b"), [left, right, "y", "x"], "full_outer")
    lone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    stats = both.groupBy(left, right).agg(lone.alias("_lone"), F.count_if(F.col("_a") != F.col("_b")).alias("_changed"))
    same_size = F.col("_lone") == 0
    return stats.select(
        left,
        right,
        (same_size & (F.col("_changed") == 0)).alias("masks_identical"),
        F.when(same_size, F.col("_changed")).alias("changed_mask_pixels"),
    )


def dct_hash(df: DataFrame, sample: list[str], value: str, size: int) -> DataFrame:
    """Signs of the low 8x8 DCT-II block against the median of its 63
    non-constant coefficients, as two 32-bit halves, first bit highest.

    Two grouped sums (rows, then columns) replace a join with the basis; the
    basis is a cosine of the coordinates.
    """
    import math

    def basis(position, u):
        scale = math.sqrt((1.0 if u == 0 else 2.0) / size)
        return scale * F.cos((2 * F.col(position) + 1) * u * math.pi / (2.0 * size))

    rows = df.groupBy(*sample, "y").agg(*[F.sum(F.col(value) * basis("x", u)).alias(f"_r{u}") for u in range(8)])
    cells = rows.select(*sample, "y", F.posexplode(F.array(*[f"_r{u}" for u in range(8)])).alias("u", "_r"))
    sums = cells.groupBy(*sample, "u").agg(*[F.sum(F.col("_r") * basis("y", v)).alias(f"_c{v}") for v in range(8)])
    ordered = F.array_sort(F.collect_list(F.struct("u", F.array(*[f"_c{v}" for v in range(8)]).alias("c"))))
    table = sums.groupBy(*sample).agg(ordered.alias("_t"))
    # row-major over (v, u): vertical frequency outside, horizontal inside
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda v: F.transform("_t", lambda s: F.get(s["c"], v))))
    coefficients = table.select(*sample, flat.alias("_f"))
    median = F.element_at(F.array_sort(F.slice("_f", 2, 63)), 32)
    bits = coefficients.withColumn("_m", median).withColumn("_b", F.zip_with("_f", F.array_repeat("_m", 64), lambda c, m: c > m))
    return bits.select(*sample, _halves("_b", 1).alias("hi"), _halves("_b", 33).alias("lo"))


def _halves(bits: str, start: int) -> Column:
    return F.aggregate(F.slice(bits, start, 32), F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1) + b.cast("bigint"))


def gradient_hash(df: DataFrame, sample: list[str], value: str, width: int, height: int) -> DataFrame:
    """Bits of ``g[x+1] > g[x]``, row-major, first bit highest."""
    following = F.lead(value).over(W.partitionBy(*sample, "y").orderBy("x"))
    steps = df.withColumn("_next", following).filter(F.col("_next").isNotNull())
    place = (F.lit(height * (width - 1) - 1) - (F.col("y") * (width - 1) + F.col("x"))).cast("int")
    bit = F.when(F.col("_next") > F.col(value), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint"))
    return steps.groupBy(*sample).agg(F.bit_or(bit).alias("dhash"))
