"""Ordered prefix sums that do not gather a scope into one task.

A running window over a whole scope sorts that scope in one task. Here a scope
with many rows is first cut into value ranges (approximate quantiles, exact
results): the totals of the few ranges are accumulated, and the running window
only works inside one range. A value so frequent that it equals a cut point gets
a range of its own, which the tie-breaker column cuts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

RANGES = 256
HEAVY_ROWS = 500_000


def _with_range(df: DataFrame, value: str, cuts: str, out: str, ranges: int) -> DataFrame:
    """``2 * (cuts below value) + (value is a cut)``, zero without cuts.

    The count is found by halving. Each step is a projection of its own, so it
    compiles to a few array reads per row instead of a scan of all cuts; reading
    past the end gives null, which never counts as below.
    """
    step = 1 << max(ranges - 1, 1).bit_length()
    df = df.withColumn("_at", F.lit(0))
    while step > 1:
        step //= 2
        probe = F.get(F.col(cuts), F.col("_at") + (step - 1))
        df = df.withColumn("_at", F.col("_at") + F.when(probe < F.col(value), step).otherwise(0))
    hot = F.coalesce(F.get(F.col(cuts), F.col("_at")) == F.col(value), F.lit(False))
    return df.withColumn(out, 2 * F.col("_at") + F.when(hot, 1).otherwise(0)).drop("_at")


def _text_position(text: Column, skip: Column) -> Column:
    """Order-preserving number from the seven bytes after a shared prefix."""
    tail = F.hex(F.encode(F.substr(text, skip + 1, F.lit(7)), "UTF-8"))
    return F.conv(F.rpad(F.substring(tail, 1, 14), 14, "0"), 16, 10).cast("double")


def _shared_prefix(low: Column, high: Column) -> Column:
    """Length of the prefix shared by the smallest and the largest text."""
    lengths = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    return F.size(F.filter(lengths, lambda i: F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i)))


def _numeric_tie(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``_tie``: a number that orders like the tie-breaker, for cutting only; ``keys`` are large scopes, which are few."""
    if df.schema[tie].dataType.simpleString() != "string":
        return df.withColumn("_tie", F.col(tie))
    ends = df.groupBy(*keys).agg(F.min(tie).alias("_lo"), F.max(tie).alias("_hi"))
    ends = ends.select(*keys, _shared_prefix(F.col("_lo"), F.col("_hi")).alias("_skip"))
    return df.join(F.broadcast(ends), keys).withColumn("_tie", _text_position(F.col(tie), F.col("_skip"))).drop("_skip")


def add_prefix(
    df: DataFrame,
    by: list[str],
    value: str,
    sums: dict[str, Column],
    tie: str | None = None,
    ranges: int = RANGES,
    heavy: int = HEAVY_ROWS,
) -> DataFrame:
    """Add ``<name>_before`` (exclusive prefix) and ``<name>_total`` per scope.

    Order inside a scope is ``value`` ascending, then ``tie``. The input is
    stored and read once more to count the scopes. Scopes of up to ``heavy`` rows
    take one window; only larger ones get cut points, at least ``ranges`` and as
    many as keep a range below half of ``heavy``.
    """
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    base = cut_lineage(base.select("*", *[expr.alias(f"_in_{name}") for name, expr in sums.items()]))
    # at most one row per ``heavy`` rows of the input
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > heavy)
    most = sizes.agg(F.max("_size")).first()[0]
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    whole = W.partitionBy(*keys)
    before = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.select(
            *df.columns,
            *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"{n}_before") for n in sums],
            *[F.sum(f"_in_{n}").over(whole).alias(f"{n}_total") for n in sums],
        )

    if most is None:
        return windowed(base)
    large = F.broadcast(cut_lineage(sizes))
    ranges = max(ranges, -(-2 * most // max(heavy, 10_000)))
    light = base.join(large, keys, "left_anti")
    return windowed(light).unionByName(_ranged_prefix(base.join(large.drop("_size"), keys), df.columns, keys, value, sums, tie, ranges))


def _ranged_prefix(base: DataFrame, columns: list[str], keys: list[str], value: str, sums: dict[str, Column], tie: str | None, ranges: int) -> DataFrame:
    """The prefix of large scopes: cut at quantiles, totals of the ranges accumulated, windows inside."""
    if tie:
        base = _numeric_tie(base, keys, tie)
    probabilities = [i / ranges for i in range(1, ranges)]

    def cuts(column: str, name: str) -> Column:
        return F.array_distinct(F.percentile_approx(column, probabilities, 8 * ranges)).alias(name)

    aggs = [F.sum(f"_in_{n}").alias(f"{n}_total") for n in sums] + [cuts(value, "_cuts")]
    if tie:
        aggs.append(cuts("_tie", "_tie_cuts"))
    # one row per large scope, with one cut for every half limit of its rows; stored, as approximate
    # quantiles hang on the order in which partial ones arrive, and ranges and totals need the same cuts
    scopes = cut_lineage(base.groupBy(*keys).agg(*aggs))
    located = base.join(F.broadcast(scopes), keys)
    located = _with_range(located, value, "_cuts", "_range", ranges)
    if tie:
        located = _with_range(located, "_tie", "_tie_cuts", "_place", ranges)
        located = located.withColumn("_sub", F.when(F.col("_range") % 2 == 1, F.col("_place")).otherwise(0)).drop("_tie_cuts", "_place")
    else:
        located = located.withColumn("_sub", F.lit(0))
    located = located.drop("_cuts")
    cell = [*keys, "_range", "_sub"]
    totals = located.groupBy(*cell).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    running = W.partitionBy(*keys).orderBy("_range", "_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *cell,
        *[F.coalesce(F.sum(f"_sum_{n}").over(running), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = located.join(offsets, cell)
    return joined.select(
        *columns,
        *[
            (F.col(f"_off_{n}") + F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0))).alias(f"{n}_before")
            for n in sums
        ],
        *[F.col(f"{n}_total") for n in sums],
    )


def add_hashed_rank(df: DataFrame, key: str, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """``rank`` (1-based) and ``size`` by a hex digest column ``key``.

    Digests are uniform, so their first digits cut the rows into 16**digits
    equal ranges; only the range counts (a fixed number per scope) are
    accumulated in one place.
    """
    by = by or []
    ranged = df.withColumn("_range", F.substring(key, 1, digits))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    scope = W.partitionBy(*(by or [F.lit(0)]))
    offsets = counts.select(
        *by,
        "_range",
        (F.sum("_n").over(scope.orderBy("_range")) - F.col("_n")).alias("_off"),
        F.sum("_n").over(scope).alias("size"),
    )
    inside = W.partitionBy(*by, "_range").orderBy(key)
    return (
        ranged.join(offsets, [*by, "_range"])
        .withColumn("rank", F.col("_off") + F.row_number().over(inside))
        .drop("_range", "_off")
    )


def hashed_cuts(df: DataFrame, key: str, by: list[str], rank: Column, digits: int = 2) -> DataFrame:
    """``cut``: the digest at a 1-based ``rank`` (of ``size``) per scope; no row for ranks outside it.

    Rows are counted by their first digits where they are; only those of the one range
    that holds the rank are ordered. Scopes are few: their ranges are broadcast.
    """
    ranged = df.select(*by, key, F.substring(key, 1, digits).alias("_range"))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    scope = W.partitionBy(*by)
    placed = counts.select(*by, "_range", "_n", (F.sum("_n").over(scope.orderBy("_range")) - F.col("_n")).alias("_off"), F.sum("_n").over(scope).alias("size"))
    spot = placed.withColumn("_rank", rank - F.col("_off")).filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
    held = ranged.join(F.broadcast(spot.select(*by, "_range", "_rank")), [*by, "_range"])
    ordered = held.withColumn("_row", F.row_number().over(scope.orderBy(key)))
    return ordered.filter(F.col("_row") == F.col("_rank")).select(*by, F.col(key).alias("cut"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], **options) -> DataFrame:
    """Linear-interpolation quantiles without holding a scope's values in one task.

    Distinct values with their counts get prefix counts; the one or two values
    that cover position ``q * (n - 1)`` are then picked by an aggregation.
    """
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    counted = base.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    placed = add_prefix(counted, keys, value, {"_w": F.col("_w")}, **options)
    aggs = []
    for name, q in qs.items():
        spot = F.lit(q) * (F.col("_w_total") - 1).cast("double")
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            covers = (F.col("_w_before") <= at) & (at < F.col("_w_before") + F.col("_w"))
            aggs.append(F.max(F.when(covers, F.col(value))).alias(f"_{side}_{name}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_part_{name}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in qs
        ],
    )
