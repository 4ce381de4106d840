"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a missing id where ids are ordered: after every other.
LAST_ID = (1 << 63) - 1
#: Rows of narrow (up to 64 bytes) decision tables that may be broadcast: 64 MB at most.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null and empty alike)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(1), whole).alias("_h2")]


def broadcast_if_small(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """Broadcast a counted narrow table below BROADCAST_ROWS rows of 64 bytes (``width``: bytes of a row); larger ones join by shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_ROWS * 64 else df


def packed(docs: DataFrame, *keys: Column) -> DataFrame:
    """Whole rows in one column ``_row`` beside keys, so that no name of theirs clashes; ``unpacked`` undoes it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *keys)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def constant(values: list[int], kind: str = "bigint") -> Column:
    """A constant array of whole numbers. One text literal folds into it, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def place(column: Column, starts: list[int], kind: str = "bigint") -> Column:
    """Index of the last of the ascending ``starts`` at or below the column (0 below all), by halving."""
    listed, top = constant(starts, kind), (len(starts) - 1).bit_length()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(top))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(listed, at + step) <= column, step).otherwise(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    The optimizer may copy a projected column into the lambda that reads it and so
    compute it for every element; a lambda's own variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
