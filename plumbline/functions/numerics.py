"""Numeric expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Machine epsilons and the accumulator clamp.
EPS32 = 1.1920928955078125e-07
EPS64 = 2.220446049250313e-16
ACCUMULATOR_CLAMP = 1e-12


def as_col(value: Column | str | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def r6(value: Column | str) -> Column:
    """Six-decimal double for reports, without a negative zero.

    The nudge of 1e-10 decides exact halves (common with counts over powers of
    two) the same way whatever the last bit of the sum before it.
    """
    return F.round(as_col(value).cast("double") + 1e-10, 6) + F.lit(0.0)


def total(items: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, items)


def shuffle_key(seed: int | str, *cols: Column | str) -> Column:
    """Reproducible pseudo-random sort key; any engine with md5 gives the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def shuffle_index(seed: int | str, size: Column, *cols: Column | str) -> Column:
    """Uniform index in ``[0, size)`` from 60 bits of the md5 key."""
    bits = F.conv(F.substring(shuffle_key(seed, *cols), 1, 15), 16, 10).cast("bigint")
    return bits % size


def harmonic_gap(before: Column, width: Column) -> Column:
    """``1/(n+1) + ... + 1/(n+w)`` in closed form.

    Equals psi(n+w+1) - psi(n+1). Eight recurrence terms move both arguments
    to at least nine, then the asymptotic series is differenced term by term;
    no term subtracts two large values, so it stays accurate for w << n.
    """
    return _gap(before.cast("double"), width, F.log1p)


def harmonic_gaps(before: np.ndarray, width: np.ndarray) -> np.ndarray:
    """``harmonic_gap`` of arrays."""
    return _gap(before.astype(float), width.astype(float), np.log1p)


def _gap(before, width, log1p):
    low, high = before + 1.0, before + width + 1.0
    steps = total([width / ((low + i) * (high + i)) for i in range(8)])
    a, b = low + 8.0, high + 8.0
    ia, ib = 1.0 / (a * a), 1.0 / (b * b)
    series = (
        (ia - ib) / 12.0
        - (ia * ia - ib * ib) / 120.0
        + (ia * ia * ia - ib * ib * ib) / 252.0
        - (ia * ia * ia * ia - ib * ib * ib * ib) / 240.0
    )
    return steps + log1p(width / a) + width / (2.0 * a * b) + series


def linear_quantile(column: Column | str, q: float) -> Column:
    return F.percentile(as_col(column), F.lit(q))


def finite_or_null(column: Column) -> Column:
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(~bad, column)
