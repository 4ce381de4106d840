"""Sharding by minimax contiguous partition.

Equal texts form one atomic group. Groups are ordered by their smallest doc_id,
those of missing ids only by their text's hash after all others, and cut into contiguous shards so that the largest shard is as small as any
contiguous cut allows. The capacity is found by binary search with a greedy
check. The search reads a summary of the ordered groups (totals of id ranges),
which is refined by further aggregations only where a cut may fall, the largest
ranges first, until every cut candidate is a single group. A round returns at
most ``BLOCKS`` rows to the driver.

Defined cases: a null text counts as empty; rows that share a doc_id stay
together; null ids come last, each text of theirs a group of its own; an empty table gives no rows; shards may stay
empty when groups are few or one group exceeds its share.
"""

from __future__ import annotations

from bisect import bisect_right
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, constant, place, text_key

#: Ranges in one summary: the most rows that a round returns to the driver.
BLOCKS = 32_768
OVERHEAD = 16
#: Holds an id, or LAST_ID and a hash above it.
PLACE = "decimal(20,0)"


class Ordered:
    """Prefix sums of consecutive id ranges (rows with last, bytes, groups, most)."""

    def __init__(self, blocks: list):
        self.last = [b["last"] for b in blocks]
        self.single = [b["groups"] == 1 for b in blocks]
        self.ends = [0, *accumulate(b["bytes"] for b in blocks)]
        self.total = self.ends[-1]
        self.most = max(b["most"] for b in blocks)

    def below(self, x: int) -> int:
        """Largest known boundary at or below x."""
        return self.ends[bisect_right(self.ends, min(x, self.total)) - 1]

    def reach(self, x: int) -> int:
        """Largest boundary at or below x that refinement could still find."""
        i = bisect_right(self.ends, min(x, self.total)) - 1
        return self.ends[i] if i == len(self.single) or self.single[i] else min(x, self.total)

    def fits(self, capacity: int, shards: int, step, start: int = 0) -> bool:
        at = start
        for _ in range(shards):
            if at >= self.total:
                return True
            at = step(at + capacity)
        return at >= self.total

    def least_capacity(self, shards: int, step) -> int:
        low, high = max(self.most, -(-self.total // shards)), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, step) else (middle + 1, high)
        return low

    def open_blocks(self, shards: int) -> list[int]:
        """Blocks of several groups in which a cut of the least capacity may fall."""
        low, high = self.least_capacity(shards, self.reach), self.least_capacity(shards, self.below)
        at_least = at_most = 0
        found: set[int] = set()
        for _ in range(shards):
            first = bisect_right(self.ends, min(at_least + low, self.total)) - 1
            last = bisect_right(self.ends, min(at_most + high, self.total)) - 1
            found.update(i for i in range(first, min(last + 1, len(self.single))) if not self.single[i])
            at_least, at_most = self.below(at_least + low), self.reach(at_most + high)
        return sorted(found)

    def cuts(self, shards: int) -> list[int]:
        """Last id of every shard but the final one.

        Within the least capacity, each cut is moved towards an even share of
        what is left wherever the rest still fits.
        """
        capacity = self.least_capacity(shards, self.below)
        at, ids = 0, []
        for left in range(shards - 1, 0, -1):
            share = at + (self.total - at) // (left + 1)
            i = bisect_right(self.ends, share) - 1
            nearest = min(self.ends[i : i + 2], key=lambda end: abs(end - share))
            even = min(max(nearest, at), self.below(at + capacity))
            at = even if even > at and self.fits(capacity, left, self.below, even) else self.below(at + capacity)
            i = bisect_right(self.ends, at) - 1
            ids.append(self.last[i - 1] if i else -LAST_ID)
        return ids


def _place(rep: Column, h1: Column) -> Column:
    """A group's place in the order: its smallest id, or above all ids the first hash of a text without one.

    Texts that share a first hash share a place and stay together.
    """
    return F.when(rep == LAST_ID, h1.cast(PLACE) + F.lit(Decimal(1 << 64))).otherwise(rep).cast(PLACE)


def _totals(groups: DataFrame) -> list:
    """Totals by _block, in order."""
    made = groups.groupBy("_block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("most"), F.min("rep").alias("first"), F.max("rep").alias("last"))
    found = (r.asDict() for r in made.collect() if r["_block"] is not None)
    return sorted(({**r, "first": int(r["first"]), "last": int(r["last"])} for r in found), key=lambda r: r["first"])


def _split(groups: DataFrame, shards: int, blocks: int) -> list[int]:
    """Places after which the ordered groups are cut."""
    nameless = F.col("rep") > F.lit(LAST_ID)
    first, last = groups.agg(F.min("rep"), F.max(F.when(~nameless, F.col("rep")))).first()
    width = ((last if last is not None else first) - first) // blocks + 1
    # missing ids are a block of their own at first, which no id range reaches
    block = F.when(nameless, F.lit(blocks + 1)).otherwise(F.floor((F.col("rep") - F.lit(first)) / F.lit(width))).cast("long")
    found = _totals(groups.withColumn("_block", block))
    while open_blocks := Ordered(found).open_blocks(shards):
        chosen = sorted(sorted(open_blocks, key=lambda i: -found[i]["bytes"])[: max(1, blocks // 4)])
        each = blocks // len(chosen)
        starts, ends = [found[i]["first"] for i in chosen], [found[i]["last"] for i in chosen]
        widths = [(b - a) // each + 1 for a, b in zip(starts, ends)]
        at, rep = F.col("_at"), F.col("rep")
        piece = at * (each + 1) + F.floor((rep - F.get(constant(starts, PLACE), at)) / F.get(constant(widths, PLACE), at)).cast("long")
        inside = rep.between(F.get(constant(starts, PLACE), at), F.get(constant(ends, PLACE), at))
        placed = groups.withColumn("_at", place(rep, starts, PLACE)).withColumn("_block", F.when(inside, piece))
        gone = set(chosen)
        found = sorted([*(r for i, r in enumerate(found) if i not in gone), *_totals(placed)], key=lambda r: r["first"])
    return Ordered(found).cuts(shards)


def shard_documents(docs: DataFrame, shards: int = 40, blocks: int = BLOCKS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes are near equal and the largest shard is least.
    ``slot`` counts from 0 without gaps inside a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key(F.col("text"))))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    texts = rows.groupBy("_h1", "_h2").agg(F.min("_id").alias("rep"), F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    texts = stored(texts.withColumn("rep", _place(F.col("rep"), F.col("_h1"))))
    count = texts.agg(F.sum("copies")).first()[0]
    if not count:
        return _numbered(rows.withColumn("shard", F.lit(0)), 1, shards)
    cuts = _split(stored(texts.groupBy("rep").agg(F.sum("bytes").alias("bytes"))), shards, blocks)
    shard = sum(((F.col("rep") > F.lit(Decimal(cut))).cast("int") for cut in cuts), F.lit(0))
    placed = rows.join(texts.select("_h1", "_h2", "rep"), ["_h1", "_h2"]).withColumn("shard", shard)
    return _numbered(stored(placed), count, shards)


def _numbered(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Slots by bucket: the offset of a bucket in its shard plus the rank in the bucket.

    A bucket has some thousands of rows, or a hundred-thousandth of all of
    them; the offsets are at most ``shards`` x 10,000 + ``shards`` rows.
    """
    buckets = -(-count // (10 * max(1_000, count // 100_000)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_h1"), F.lit(buckets)) if buckets > 1 else F.lit(0).cast("long"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "_h1", "_h2"))
    ranked = rows.withColumn("_rank", rank).join(F.broadcast(offsets), ["shard", "_bucket"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
