"""Tie-aware ranking of errors by an uncertainty score.

Everything is computed on tie groups ``(scope, score, w, e)``: ``w`` units share
a score, ``e`` of them are errors. Grouping replaces a sort, pre-aggregates on
the map side and bounds the rows that reach the prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import harmonic_gap
from plumbline.operators.prefix import HEAVY_ROWS, RANGES, add_prefix

COVERAGES = (0.9, 0.8, 0.7)
FRACTIONS = (0.05, 0.1, 0.2)


def _finite_score(score: str) -> Column:
    value = F.col(score).cast("float")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(value)


def score_groups(df: DataFrame, by: list[str], score: str = "score", err: str = "err") -> DataFrame:
    """G1: tie groups after the cast to float32; a non-finite score is an error."""
    return (
        df.select(*by, _finite_score(score).alias("score"), F.col(err).cast("bigint").alias("_e"))
        .groupBy(*by, "score")
        .agg(F.count(F.lit(1)).alias("w"), F.sum("_e").alias("e"))
    )


def score_groups_discrete(df: DataFrame, by: list[str], score: str = "score", err: str = "err", steps: int = 9) -> DataFrame:
    """Groups on the k/9 lattice; a score off the lattice is an error."""
    value = _finite_score(score).cast("double")
    level = F.rint(value * steps)
    on_lattice = (F.abs(value - level / steps) <= 2e-6) & (level >= 0) & (level <= steps)
    checked = F.when(on_lattice, level.cast("bigint")).otherwise(F.raise_error(F.lit("score is off the lattice")))
    return (
        df.select(*by, checked.alias("level"), F.col(err).cast("bigint").alias("_e"))
        .groupBy(*by, "level")
        .agg(F.count(F.lit(1)).alias("w"), F.sum("_e").alias("e"))
        .withColumn("score", (F.col("level") / steps).cast("float"))
    )


def prefix_groups(groups: DataFrame, by: list[str], ranges: int = RANGES, heavy: int = HEAVY_ROWS) -> DataFrame:
    """Counts and errors before each group, and the scope totals."""
    return add_prefix(groups, by, "score", {"w": F.col("w"), "e": F.col("e")}, ranges=ranges, heavy=heavy)


def _curve_area(part: Column, first: Column, count: Column, errors: Column) -> Column:
    return (part - 0.5 * (first + errors / count)) / count


def oracle_area(count: Column, errors: Column) -> Column:
    """Area of the ideal order (all correct units, then all errors)."""
    right = count - errors
    first = F.when(right > 0, 0.0).otherwise(1.0)
    return _curve_area(errors - right * harmonic_gap(right, errors), first, count, errors)


def _cut(q: float, size: Column) -> Column:
    return F.greatest(F.lit(1.0), F.ceil(size.cast("double") * F.lit(q)).cast("double"))


def summarize_prefix(
    prefixed: DataFrame,
    by: list[str],
    coverages: tuple[float, ...] = COVERAGES,
    fractions: tuple[float, ...] = FRACTIONS,
) -> DataFrame:
    """G4-G10 from prefix groups in one hash aggregation per scope."""
    w, e = F.col("w").cast("double"), F.col("e").cast("double")
    n0, e0 = F.col("w_before").cast("double"), F.col("e_before").cast("double")
    size, errs = F.col("w_total").cast("double"), F.col("e_total").cast("double")
    rate = e / w
    risk = w * rate + (e0 - rate * n0) * harmonic_gap(n0, w)
    above_n, above_e = size - n0 - w, errs - e0 - e
    aggs = [
        F.max("w_total").alias("_n"),
        F.max("e_total").alias("_err"),
        F.sum(risk).alias("_risk"),
        F.max(F.when(F.col("w_before") == 0, rate)).alias("_first"),
        F.sum(e * (n0 + (w + 1.0) / 2.0)).alias("_ranks"),
        F.sum(e * (errs - e0) / (size - n0)).alias("_precision"),
        F.count(F.lit(1)).alias("unique_score_count"),
        F.count_if(F.col("w") > 1).alias("tie_group_count"),
        F.max("w").alias("largest_tie_group"),
        F.sum(F.when(F.col("w") > 1, w).otherwise(0.0)).alias("_tied"),
    ]
    for q in coverages:
        k = _cut(q, size)
        inside = (n0 < k) & (k <= n0 + w)
        aggs.append(F.max(F.when(inside, (e0 + e * (k - n0) / w) / k)).alias(f"risk_at_{round(q * 100)}_coverage"))
    for f in fractions:
        k = _cut(f, size)
        inside = (above_n < k) & (k <= above_n + w)
        aggs.append(F.max(F.when(inside, above_e + e * (k - above_n) / w)).alias(f"_hit_{round(f * 100)}"))
        aggs.append(F.max(k).alias(f"_k_{round(f * 100)}"))
    keys = by or [F.lit(0).alias("_all")]
    s = prefixed.groupBy(*keys).agg(*aggs)
    n, err = F.col("_n").cast("double"), F.col("_err").cast("double")
    area, ideal = _curve_area(F.col("_risk"), F.col("_first"), n, err), oracle_area(n, err)
    mixed = (err > 0) & (err < n)
    out = [
        F.col("_n").alias("pixels"),
        (err / n).alias("error_rate"),
        F.when(mixed, F.try_divide(F.col("_ranks") - err * (err + 1.0) / 2.0, err * (n - err))).alias("error_auroc"),
        F.when(err > 0, F.try_divide(F.col("_precision"), err)).alias("error_auprc"),
        area.alias("aurc"),
        ideal.alias("oracle_aurc"),
        (area - ideal).alias("eaurc"),
        "unique_score_count",
        "tie_group_count",
        "largest_tie_group",
        (F.col("_tied") / n).alias("tied_pixel_fraction"),
        *[f"risk_at_{round(q * 100)}_coverage" for q in coverages],
    ]
    for f in fractions:
        name = round(f * 100)
        out.append((F.col(f"_hit_{name}") / F.col(f"_k_{name}")).alias(f"top_{name}_uncertainty_precision"))
        out.append(F.when(err > 0, F.try_divide(F.col(f"_hit_{name}"), err)).alias(f"top_{name}_uncertainty_recall"))
    return s.select(*by, *out)


def ranking_metrics(df: DataFrame, by: list[str], score: str = "score", err: str = "err", **options) -> DataFrame:
    """All ranking metrics, one row per scope."""
    return summarize_prefix(prefix_groups(score_groups(df, by, score, err), by), by, **options)


def with_strata(df: DataFrame, region: str = "region") -> DataFrame:
    """Every row in ``full`` and in its own ``boundary``/``interior``."""
    return df.withColumn(region, F.explode(F.array(F.lit("full"), F.col(region))))


def ranking_by_region(df: DataFrame, by: list[str], region: str = "region", score: str = "score", err: str = "err", **options) -> DataFrame:
    """G11 per stratum.

    Tie groups are formed per (scope, region, score) first; ``full`` is fanned
    out of those groups, so the strata copy groups and not input rows.
    """
    own = score_groups(df, [*by, region], score, err)
    keys = [*by, region]
    strata = with_strata(own, region).groupBy(*keys, "score").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    return summarize_prefix(prefix_groups(strata, keys), keys, **options)


def risk_coverage_curve(df: DataFrame, by: list[str], unit: str, score: str = "score", err: str = "err", **options) -> DataFrame:
    """Rank, coverage and cumulative risk per unit; ties ordered by ``unit``."""
    rows = df.select(*by, unit, _finite_score(score).alias("score"), F.col(err).cast("bigint").alias("err"))
    ordered = add_prefix(rows, by, "score", {"n": F.lit(1).cast("bigint"), "e": F.col("err")}, tie=unit, **options)
    rank = F.col("n_before") + 1
    return ordered.select(
        *by,
        unit,
        rank.alias("rank"),
        (rank / F.col("n_total")).alias("coverage"),
        ((F.col("e_before") + F.col("err")) / rank).alias("risk"),
        F.col("n_total").alias("size"),
    )


def aurc_simple(curve: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid of G14. Coverage steps are equal, so the area needs only
    the sum of the risks and its two end values."""
    keys = by or [F.lit(0).alias("_all")]
    ends = F.when(F.col("rank") == 1, F.col("risk")).otherwise(0.0) + F.when(
        F.col("rank") == F.col("size"), F.col("risk")
    ).otherwise(0.0)
    return curve.groupBy(*keys).agg(
        ((F.sum("risk") - 0.5 * F.sum(ends)) / F.max("size")).alias("aurc_simple")
    ).select(*by, "aurc_simple")


def ranking_metrics_ranged(df: DataFrame, by: list[str], ranges: int, score: str = "score", err: str = "err") -> DataFrame:
    """G11 with every scope cut into ranges, whatever its size."""
    prefixed = prefix_groups(score_groups(df, by, score, err), by, ranges=ranges, heavy=0)
    return summarize_prefix(prefixed, by)
