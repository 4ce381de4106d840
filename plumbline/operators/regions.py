"""Metrics by boundary and interior region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.functions.numerics import harmonic_gaps
from plumbline.functions.softmax import unit_stats, valid_units
from plumbline.operators import calibration as cal
from plumbline.operators import ranking as rk
from plumbline.operators.prefix import add_prefix
from plumbline.operators.spatial import boundary_mask


def with_regions(df: DataFrame, sample: list[str], radii: list[int], classes: int) -> DataFrame:
    """One row per (valid pixel, radius) with its region.

    The windows of all radii share one partitioning, so they share its shuffles.
    """
    marked = df
    for r in radii:
        marked = boundary_mask(marked, sample, r, out=f"_boundary_{r}")
    rows = [
        F.struct(F.lit(r).alias("radius"), F.when(F.col(f"_boundary_{r}"), "boundary").otherwise("interior").alias("region"))
        for r in radii
    ]
    return valid_units(marked, classes).select(*df.columns, F.inline(F.array(*rows)))


def method_units(units: DataFrame, classes: int, methods: dict[str, float]) -> DataFrame:
    """Unit statistics per method (name to temperature)."""
    rows = [F.struct(F.lit(m).alias("method"), F.lit(float(t)).alias("temperature")) for m, t in methods.items()]
    return unit_stats(units.select("*", F.inline(F.array(*rows))), classes, "temperature")


def _by_radius(groups: DataFrame, radii: list[int], rest: list[str]) -> DataFrame:
    """Groups by distance, once for every radius with the region they fall into."""
    region = {r: F.when(F.col("distance") <= r, "boundary").otherwise("interior") for r in radii}
    rows = [F.struct(F.lit(r).alias("radius"), region[r].alias("region")) for r in radii]
    return groups.select(*rest, F.inline(F.array(*rows)))


METRICS = ("nll", "brier_score", "ece", "mean_wrong_confidence", "error_rate", "error_auroc", "aurc", "oracle_aurc", "eaurc")
#: Rows that a task measures at once, at least.
ROWS = 1 << 18


def region_metrics(units: DataFrame, by: list[str], radii: list[int], within: list[str] | None = None) -> DataFrame:
    """F13 for all radii: calibration and ranking metrics per (by, radius, region).

    Bins and tie groups are formed per distance to the next label first. Radii
    regroup those, so they copy groups and not pixels. ``within`` names keys of ``by``
    whose rows stand one after the other in one partition, as the pixels of an image
    do: such scopes are measured where they are, and no pixel is moved.
    """
    if within:
        return _local_metrics(units, by, radii, within)
    own, keys = [*by, "distance"], [*by, "radius", "region"]
    sums = cal.bin_sums(units, own)
    totals = [c for c in sums.columns if c not in (*own, "bin")]
    bins = _by_radius(sums, radii, [*by, "bin", *totals]).groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in totals])
    merged = cal.merge_bins(bins, keys).select(*keys, "pixels", *METRICS[:4])
    errors = units.select(*own, (1.0 - F.col("conf")).cast("float").alias("score"), (1 - F.col("correct")).alias("err"))
    groups = _by_radius(rk.score_groups(errors, own), radii, [*by, "score", "w", "e"]).groupBy(*keys, "score").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    ranked = rk.summarize_prefix(rk.prefix_groups(groups, keys), keys).select(*keys, *METRICS[4:])
    return merged.join(ranked, keys)


def scope_metrics(scope: np.ndarray, scopes: int, conf: np.ndarray, correct: np.ndarray, nll: np.ndarray, brier: np.ndarray) -> dict[str, np.ndarray]:
    """``calibration.merge_bins`` and ``ranking.summarize_prefix`` of many small scopes: METRICS (undefined: NaN) and ``pixels`` per scope number."""

    def sums(values: np.ndarray | None = None, at: np.ndarray = scope, size: int = scopes) -> np.ndarray:
        return np.bincount(at, values, size).astype(float)

    score = (1.0 - conf).astype(np.float32)
    if not np.isfinite(score).all():
        raise ValueError("scores must be finite")
    cell = scope * cal.BINS + np.minimum(np.floor(conf * cal.BINS), cal.BINS - 1).astype(np.int64)
    gaps = np.abs(sums(correct, cell, scopes * cal.BINS) - sums(conf, cell, scopes * cal.BINS)).reshape(scopes, cal.BINS)
    n, hits, mass, right = sums(), sums(correct), sums(conf), sums(conf * correct)
    # tie groups in order: units and errors of each, and before each in its scope
    order = np.lexsort((score, scope))
    ordered, values = scope[order], score[order]
    starts = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]) | (values[1:] != values[:-1])))
    at = ordered[starts]
    w, e = np.diff(np.append(starts, len(order))).astype(float), np.add.reduceat(1.0 - correct[order], starts)
    err = n - hits
    n0, e0 = (np.cumsum(x) - x - (np.cumsum(all_) - all_)[at] for x, all_ in ((w, n), (e, err)))
    rate = e / w

    def area(part: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (part - 0.5 * (first + err / n)) / n

    with np.errstate(divide="ignore", invalid="ignore"):
        aurc = area(sums(w * rate + (e0 - rate * n0) * harmonic_gaps(n0, w), at), sums(np.where(n0 == 0, rate, 0.0), at))
        oracle = area(err - hits * harmonic_gaps(hits, err), np.where(hits > 0, 0.0, 1.0))
        ranks = sums(e * (n0 + (w + 1.0) / 2.0), at)
        found = [sums(nll) / n, sums(brier) / n, gaps.sum(axis=1) / n, (mass - right) / err, err / n, (ranks - err * (err + 1.0) / 2.0) / (err * hits), aurc, oracle, aurc - oracle]
    return {"pixels": n.astype(np.int64), **{name: np.where(np.isfinite(x), x, np.nan) for name, x in zip(METRICS, found)}}


def _local_metrics(units: DataFrame, by: list[str], radii: list[int], within: list[str]) -> DataFrame:
    """The same where all rows of a ``within`` stand in a row in one partition; a second row of it is an error."""
    fields = [units.schema[k] for k in by]
    schema = StructType([*fields, StructField("radius", IntegerType()), StructField("region", StringType()), StructField("pixels", LongType()), *[StructField(m, DoubleType()) for m in METRICS]])

    def codes(table: pa.Table, keys: list[str]) -> np.ndarray:
        """One number per row and distinct keys, null being a key too."""
        columns = [table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        return np.unique(np.stack(columns), axis=1, return_inverse=True)[1].ravel()

    def measured(table: pa.Table) -> Iterator[pa.RecordBatch]:
        scope = codes(table, by)
        _, first = np.unique(scope, return_index=True)
        distance, conf, correct, nll, brier = (table.column(c).to_numpy().astype(float) for c in ("distance", "conf", "correct", "nll", "brier"))
        for radius in radii:
            found = scope_metrics(2 * scope + (distance > radius), 2 * len(first), conf, correct, nll, brier)
            there = np.flatnonzero(found["pixels"])
            keys = [table.column(k).combine_chunks().take(pa.array(first[there // 2])) for k in by]
            values = [pa.array(found[m][there], from_pandas=True) for m in METRICS]
            place = [pa.array(np.full(len(there), radius, dtype=np.int32)), pa.array(np.array(["boundary", "interior"])[there % 2]), pa.array(found["pixels"][there])]
            yield pa.RecordBatch.from_arrays([*keys, *place, *values], names=schema.names)

    def scopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def whole(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for key in zip(*(table.column(k).take(pa.array(starts)).to_pylist() for k in within)):
                if key in seen:
                    raise ValueError("the rows of a scope must stand in a row")
                seen.add(key)
            yield from measured(table)

        def runs(table: pa.Table) -> np.ndarray:
            run = codes(table, within)
            return np.append(0, 1 + np.flatnonzero(run[1:] != run[:-1]))

        held, rows, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held)
                starts = runs(table)
                if len(starts) > 1:
                    yield from whole(table.slice(0, starts[-1]), starts[:-1])
                # the last run may go on
                held = table.slice(starts[-1]).to_batches()
                rows = sum(b.num_rows for b in held)
                enough = max(ROWS, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from whole(table, runs(table))

    return units.select(*by, "distance", "conf", "correct", "nll", "brier").mapInArrow(scopes, schema)


def region_calibration(units: DataFrame, by: list[str]) -> DataFrame:
    """calibration and ranking metrics per scope of region units."""
    bins = cal.merge_bins(cal.bin_sums(units, by), by)
    errors = units.select(*by, (1.0 - F.col("conf")).cast("float").alias("score"), (1 - F.col("correct")).alias("err"))
    ranked = rk.ranking_metrics(errors, by).select(*by, "error_rate", "error_auroc", "aurc", "oracle_aurc", "eaurc")
    return bins.select(*by, "pixels", "nll", "brier_score", "ece", "mean_wrong_confidence").join(ranked, by)


def worst_middle_best(scores: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """H5: k lowest, k around the middle and k highest (best first)."""
    ranked = add_prefix(scores.filter(F.col(value).isNotNull()), [], value, {"n": F.lit(1).cast("bigint")}, tie=key)
    at, size = F.col("n_before"), F.col("n_total")
    half = F.floor(size / 2)
    start = F.greatest(F.lit(0), half - k // 2)
    groups = F.array_compact(
        F.array(
            F.when(at < k, F.struct(F.lit("worst").alias("part"), (at + 1).alias("position"))),
            F.when((at >= start) & (at < half + (k + 1) // 2), F.struct(F.lit("middle").alias("part"), (at - start + 1).alias("position"))),
            F.when(at >= size - k, F.struct(F.lit("best").alias("part"), (size - at).alias("position"))),
        )
    )
    return ranked.select(key, value, F.inline(groups))
