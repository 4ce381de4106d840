"""Calibration metrics as mergeable sums per (scope, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numerics import EPS64, as_col
from plumbline.functions.softmax import unit_stats

BINS = 15


def bin_left(value: Column | str, bins: int = BINS) -> Column:
    """bins ``[l, u)``, the last one closed."""
    return F.least(F.floor(as_col(value) * bins), F.lit(bins - 1)).cast("int")


def bin_right(value: Column | str, bins: int = BINS) -> Column:
    """bins ``(l, u]``, the first one closed at zero."""
    return F.greatest(F.ceil(as_col(value) * bins) - 1, F.lit(0)).cast("int")


EDGES = {"left": bin_left, "right": bin_right}


def _keys(by: list[str]) -> list:
    return list(by) or [F.lit(0).alias("_all")]


def reliability_bins(units: DataFrame, by: list[str], bins: int = BINS, edges: str = "left") -> DataFrame:
    """F8: count, mean confidence and accuracy per populated bin."""
    return (
        units.groupBy(*by, EDGES[edges]("conf", bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence"), F.avg("correct").alias("accuracy"))
    )


def ece(units: DataFrame, by: list[str], bins: int = BINS, edges: str = "left") -> DataFrame:
    """sum of n_b/n |accuracy - confidence|."""
    binned = units.groupBy(*_keys(by), EDGES[edges]("conf", bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("conf").alias("_conf"), F.sum("correct").alias("_hit")
    )
    gap = F.sum(F.abs(F.col("_hit") - F.col("_conf"))) / F.sum("_n")
    return binned.groupBy(*(by or ["_all"])).agg(gap.alias("ece")).select(*by, "ece")


def class_bins(units: DataFrame, by: list[str], classes: int, bins: int = BINS, edges: str = "left", label: str = "label") -> DataFrame:
    """Sums per (scope, class, bin) of the one-vs-rest probabilities.

    The fan-out names its elements: exploding the array column would make the
    optimizer test the array for emptiness, with all of softmax written into a
    filter below.
    """
    rows = [F.struct(F.lit(k).alias("class_id"), F.col("probs")[k].alias("_p")) for k in range(classes)]
    spread = units.select(*by, F.col(label).alias("_label"), F.inline(F.array(*rows)))
    return spread.groupBy(*by, "class_id", EDGES[edges]("_p", bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_p").alias("_prob"),
        F.count_if(F.col("_label") == F.col("class_id")).alias("_event"),
    )


def classwise_ece(units: DataFrame, by: list[str], classes: int, bins: int = BINS, edges: str = "left", label: str = "label") -> DataFrame:
    """one-vs-rest ECE per class, weighted over all rows of the scope."""
    sums = class_bins(units, by, classes, bins, edges, label)
    gap = F.sum(F.abs(F.col("_event") - F.col("_prob"))) / F.sum("_n")
    return sums.groupBy(*by, "class_id").agg(gap.alias("classwise_ece"))


def bin_sums(units: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """The mergeable state of F10: sums per (scope, bin)."""
    return units.groupBy(*_keys(by), bin_left("conf", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("conf").alias("conf_sum"),
        F.sum("correct").alias("hit_sum"),
        F.sum("nll").alias("nll_sum"),
        F.sum("brier").alias("brier_sum"),
        F.sum(F.when(F.col("correct") == 1, F.col("conf"))).alias("right_conf_sum"),
    )


def merge_bins(sums: DataFrame, by: list[str]) -> DataFrame:
    """Roll the bins of F10 up to one row per scope."""
    n, hits = F.sum("n"), F.sum("hit_sum")
    right = F.sum("right_conf_sum")
    return (
        sums.groupBy(*(by or ["_all"]))
        .agg(
            n.alias("pixels"),
            (F.sum("nll_sum") / n).alias("nll"),
            (F.sum("brier_sum") / n).alias("brier_score"),
            (F.sum(F.abs(F.col("hit_sum") - F.col("conf_sum"))) / n).alias("ece"),
            (F.sum("conf_sum") / n).alias("mean_confidence"),
            F.try_divide(right, hits).alias("mean_correct_confidence"),
            F.try_divide(F.sum("conf_sum") - F.coalesce(right, F.lit(0.0)), n - hits).alias("mean_wrong_confidence"),
        )
    )


def slot_sums(units: DataFrame, by: list[str], classes: int, bins: int = BINS, label: str = "label") -> DataFrame:
    """State of every mergeable metric in one pass: sums per (scope, slot, bin).

    Slot -1 is the overall confidence; slots 0..C-1 are the one-vs-rest
    probabilities with the row, column and diagonal counts of their class, which
    is all that the segmentation metrics need. One fan-out keeps the input to a
    single scan and the map-side combine shrinks it to (C+1) x bins rows per
    scope before the shuffle.
    """
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    right = F.when(F.col("correct") == 1, F.col("conf")).otherwise(0.0)

    def slot(number, p, hit, guess, both, loss, brier, right_conf):
        named = dict(slot=F.lit(number), p=p, hit=hit, guess=guess, both=both, nll=loss, brier=brier, right_conf=right_conf)
        return F.struct(*[column.alias(name) for name, column in named.items()])

    slots = [slot(-1, F.col("conf"), F.col("correct"), none, none, F.col("nll"), F.col("brier"), right)]
    for k in range(classes):
        event, guess = (F.col(label) == k).cast("bigint"), (F.col("pred") == k).cast("bigint")
        slots.append(slot(k, F.col("probs")[k], event, guess, event * guess, zero, zero, zero))
    spread = units.select(*by, F.inline(F.array(*slots)))
    return spread.groupBy(*by, "slot", bin_left("p", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("p_sum"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("hit", "guess", "both", "nll", "brier", "right_conf")],
    )


def merge_slots(sums: DataFrame, by: list[str]) -> DataFrame:
    """One row per (scope, slot); class slots carry IoU, Dice and accuracy."""
    n, hit, guess, both = F.sum("n"), F.sum("hit_sum"), F.sum("guess_sum"), F.sum("both_sum")
    right = F.sum("right_conf_sum")
    return sums.groupBy(*by, "slot").agg(
        n.alias("n"),
        (F.sum(F.abs(F.col("hit_sum") - F.col("p_sum"))) / n).alias("ece"),
        (F.sum("nll_sum") / n).alias("nll"),
        (F.sum("brier_sum") / n).alias("brier_score"),
        (F.sum("p_sum") / n).alias("mean_confidence"),
        F.try_divide(right, hit).alias("mean_correct_confidence"),
        F.try_divide(F.sum("p_sum") - right, n - hit).alias("mean_wrong_confidence"),
        F.try_divide(both, hit + guess - both).alias("iou"),
        F.try_divide(2 * both, hit + guess).alias("dice"),
        F.try_divide(both, hit).alias("accuracy"),
        hit.alias("truth"),
        both.alias("both"),
    )


OVERALL = ("nll", "brier_score", "ece", "mean_confidence", "mean_correct_confidence", "mean_wrong_confidence")


def merge_scopes(slots: DataFrame, by: list[str]) -> DataFrame:
    """One row per scope with calibration, confidence and segmentation metrics."""
    overall, single = F.col("slot") == -1, F.col("slot") >= 0

    def mean(name):
        return F.avg(F.when(single, F.col(name)))

    return (
        slots.groupBy(*_keys(by))
        .agg(
            F.max(F.when(overall, F.col("n"))).alias("pixels"),
            *[F.max(F.when(overall, F.col(name))).alias(name) for name in OVERALL],
            mean("ece").alias("mean_classwise_ece"),
            F.try_divide(F.sum("both"), F.sum(F.when(single, F.col("truth")))).alias("pixel_accuracy"),
            mean("accuracy").alias("mean_accuracy"),
            mean("iou").alias("miou"),
            mean("dice").alias("mean_dice"),
        )
        .drop("_all")
    )


def calibration_summary(units: DataFrame, by: list[str], classes: int, bins: int = BINS, label: str = "label") -> DataFrame:
    """NLL, Brier, ECE and the mean class-wise ECE per scope."""
    merged = merge_scopes(merge_slots(slot_sums(units, by, classes, bins, label), by), by)
    return merged.select(*by, "pixels", "nll", "brier_score", "ece", "mean_classwise_ece")


def confidence_summary(units: DataFrame, by: list[str]) -> DataFrame:
    """mean confidence overall, when right and when wrong (null if none)."""
    return units.groupBy(*by).agg(
        F.avg("conf").alias("mean_confidence"),
        F.avg(F.when(F.col("correct") == 1, F.col("conf"))).alias("mean_correct_confidence"),
        F.avg(F.when(F.col("correct") == 0, F.col("conf"))).alias("mean_wrong_confidence"),
    )


def nll(units: DataFrame, by: list[str], clamp: float = EPS64) -> DataFrame:
    """mean -ln p of the true class, at either clamp."""
    return units.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.col("py"), F.lit(clamp)))).alias("nll"))


def brier(units: DataFrame, by: list[str]) -> DataFrame:
    """mean squared distance to the one-hot truth."""
    return units.groupBy(*by).agg(F.avg("brier").alias("brier_score"))


def weighted_loss(df: DataFrame, by: list[str], loss: str, count: str) -> DataFrame:
    """batch losses weighted by their unit counts; null when empty."""
    value = F.try_divide(F.sum(F.col(loss) * F.col(count)), F.sum(count).cast("double"))
    return df.groupBy(*by).agg(value.alias("loss"))


def per_sample_calibration(df: DataFrame, by: list[str], classes: int, temperature: str) -> DataFrame:
    """NLL, Brier and ECE per sample for a per-row temperature column."""
    units = unit_stats(df, classes, temperature)
    return merge_bins(bin_sums(units, by), by).select(*by, "nll", "brier_score", "ece")
