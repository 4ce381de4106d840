"""Near duplicates: exact threshold and top-k searches without all-pairs work.

Both searches rest on the pigeonhole principle. Two 64-bit hashes within
distance d agree on at least one of d+1 bands; two unit vectors within Euclidean
distance r are within r/sqrt(m) in at least one of m coordinate blocks, which
metric trees search (``operators.metric``). Equal bands and common leaves are
equi-joins, and every hit is verified, so the result is exact.

Equal hashes and equal vectors are collapsed to one representative first. A hash
carried by a third of all rows is then one row here; its members are listed as a
star around the representative.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import metric
from plumbline.operators.rows import head_per_group
from plumbline.session import cut_lineage

#: Hashes of a bucket above which it is banded again, so that a hash meets about as many others at any size.
HOT_BUCKET = 256
# Beyond this distance bands are too narrow for a second level to help.
REFINED_DISTANCE = 7


def join_halves(hi: str, lo: str) -> Column:
    """64-bit pattern from two 32-bit halves (a signed bigint, never compared by size)."""
    return F.shiftleft(F.col(hi), 32).bitwiseOR(F.col(lo))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _layout(bits: int, bands: int) -> list[tuple[int, int]]:
    """(start, width) of nearly equal bands over ``bits`` bits."""
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(bands)]


def _mask(width: int) -> int:
    return (1 << width) - 1 if width < 64 else -1


def _band(h: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(h, start).bitwiseAND(F.lit(_mask(width)).cast("bigint"))


def _rest(h: Column, start: int, width: int) -> Column:
    """The bits outside a band, closed up."""
    low = h.bitwiseAND(F.lit(_mask(start)).cast("bigint")) if start else F.lit(0).cast("bigint")
    if start + width >= 64:
        return low
    return F.shiftleft(F.shiftrightunsigned(h, start + width), start).bitwiseOR(low)


def _keyed(df: DataFrame, max_d: int, hot: DataFrame | None) -> DataFrame:
    """One row per (hash, band); rows of hot buckets once more per sub-band.

    Within a bucket the agreeing band is settled, so the remaining bits still
    differ in at most ``max_d`` places and can be banded again.
    """
    h = F.col("h")
    bands = _layout(64, max_d + 1)
    entries = [
        F.struct(F.lit(i).alias("band"), _band(h, s, w).alias("value"), _rest(h, s, w).alias("rest"))
        for i, (s, w) in enumerate(bands)
    ]
    rows = df.select("*", F.inline(F.array(*entries)))
    if hot is None:
        return rows.withColumn("sub", F.lit(-1)).withColumn("sub_value", F.lit(0).cast("bigint"))
    flagged = rows.join(hot.withColumn("_hot", F.lit(True)), ["band", "value"], "left")
    by_width = {}
    for i, (_, width) in enumerate(bands):
        by_width.setdefault(64 - width, []).append(i)
    choices = None
    for bits, members in by_width.items():
        subs = F.array(
            *[F.struct(F.lit(j).alias("sub"), _band(F.col("rest"), s, w).alias("sub_value")) for j, (s, w) in enumerate(_layout(bits, max_d + 1))]
        )
        test = F.col("band").isin(*members) & F.col("_hot")
        choices = F.when(test, subs) if choices is None else choices.when(test, subs)
    single = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("sub_value")))
    return flagged.select("*", F.inline(choices.otherwise(single))).drop("_hot")


def _first_zero(x: Column, layout: list[tuple[int, int]]) -> Column:
    return F.coalesce(*[F.when(_band(x, s, w) == 0, F.lit(i)) for i, (s, w) in enumerate(layout)])


def _first_hit(max_d: int) -> Column:
    """Keep a pair only at the first band (and sub-band) it agrees on.

    This replaces a distinct over all hits.
    """
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    bands = _layout(64, max_d + 1)
    same = F.col("band") == _first_zero(x, bands)
    if max_d > REFINED_DISTANCE:
        return same
    sub = None
    for i, (start, width) in enumerate(bands):
        first = _first_zero(_rest(x, start, width), _layout(64 - width, max_d + 1))
        test = F.col("band") == i
        sub = F.when(test, first) if sub is None else sub.when(test, first)
    return same & ((F.col("sub") == -1) | (F.col("sub") == sub))


def _hot_buckets(df: DataFrame, max_d: int, limit: int) -> DataFrame:
    return _keyed(df, max_d, None).groupBy("band", "value").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")


def _distinct_pairs(a: DataFrame, b: DataFrame | None, max_d: int, hot_bucket: int) -> DataFrame:
    """Pairs of distinct hash rows within ``max_d``; ``b`` None is a self-join."""
    hot = None
    if max_d <= REFINED_DISTANCE:
        both = a.select("h") if b is None else a.select("h").unionByName(b.select("h"))
        hot = _hot_buckets(both, max_d, hot_bucket)
    keys = ["band", "value", "sub", "sub_value"]

    def side(df, suffix):
        keyed = _keyed(df, max_d, hot).drop("rest")
        return keyed.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns])

    joined = side(a, "a").join(side(a if b is None else b, "b"), keys)
    if b is None:
        joined = joined.filter(F.col("h_a") < F.col("h_b"))
    close = hamming(F.col("h_a"), F.col("h_b"))
    return joined.filter((close <= max_d) & _first_hit(max_d)).withColumn("distance", close.cast("bigint")).drop(*keys)


def hash_pairs(hashes: DataFrame, max_d: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs of distinct hashes ``h`` within ``max_d`` bits; other columns get the suffixes _a and _b."""
    return _distinct_pairs(hashes, None, max_d, hot_bucket)


def hamming_pairs(df: DataFrame, unit: str, h: Column, max_d: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Unordered pairs within ``max_d`` bits.

    Rows are ``(id_a, id_b, distance, pairs)``: representatives of two hash
    groups with the number of unit pairs they stand for, and for equal hashes
    the star of the group (each row one pair of the group's own count).
    ``expand_pairs`` lists the members where groups are known to be small.
    """
    rows = df.select(F.col(unit).alias("unit"), h.alias("h"))
    groups = rows.groupBy("h").agg(F.min("unit").alias("rep"), F.count(F.lit(1)).alias("n"))
    found = _distinct_pairs(groups, None, max_d, hot_bucket)
    cross = found.select(
        F.least("rep_a", "rep_b").alias("id_a"),
        F.greatest("rep_a", "rep_b").alias("id_b"),
        "distance",
        (F.col("n_a") * F.col("n_b")).alias("pairs"),
    )
    shared = groups.filter(F.col("n") > 1)
    star = rows.join(shared, "h").filter(F.col("unit") != F.col("rep"))
    same = star.select(
        F.col("rep").alias("id_a"), F.col("unit").alias("id_b"), F.lit(0).cast("bigint").alias("distance"), F.lit(1).cast("bigint").alias("pairs")
    )
    return cross.unionByName(same)


def expand_pairs(pairs: DataFrame, df: DataFrame, unit: str, h: Column) -> DataFrame:
    """Members behind the representative pairs of ``hamming_pairs``."""
    rows = df.select(F.col(unit).alias("unit"), h.alias("h"))
    named = rows.join(rows.groupBy("h").agg(F.min("unit").alias("rep")), "h").select("rep", "unit")
    cross = pairs.filter(F.col("distance") > 0)
    left = cross.join(named.select(F.col("rep").alias("id_a"), F.col("unit").alias("unit_a")), "id_a")
    both = left.join(named.select(F.col("rep").alias("id_b"), F.col("unit").alias("unit_b")), "id_b")
    return both.select("unit_a", "unit_b", "distance")


#: Distinct hashes of one side that a task searches at once (512 KB).
SEARCHED = 65_536


def _sub_codes(count: int) -> list[tuple[int, int]]:
    """Bands about as long as the count's logarithm, so that a bucket holds few hashes."""
    return _layout(64, max(2, min(6, 64 // max(10, (count - 1).bit_length()))))


def _closest(a: np.ndarray, b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray, k: int, most: int) -> list[tuple[int, int, int]]:
    """The k closest pairs within ``most`` bits as (distance, index a, index b), ties by name.

    Bands of one side are looked up in sorted bands of the other, first equal ones, then
    those that differ in one bit, two bits and so on. Once the bands up to some place were
    tried with s flips and the rest with s - 1, a pair not seen yet differs in s + 1 and s bits there,
    which ends the search when the k-th pair found is closer.
    """
    bands = _sub_codes(max(len(a), len(b)))
    tables = []
    for start, width in bands:
        part = (b >> np.uint64(start)) & np.uint64(_mask(width))
        order = np.argsort(part, kind="stable")
        tables.append((order, part[order]))
    best = [np.zeros(0, dtype=np.int64)] * 3  # distance, a, b

    def add(found_a: np.ndarray, found_b: np.ndarray) -> None:
        nonlocal best, most
        distance = np.bitwise_count(a[found_a] ^ b[found_b]).astype(np.int64)
        close = distance <= most
        rows = np.concatenate([np.stack(best), np.stack([distance[close], found_a[close], found_b[close]])], axis=1)
        rows = np.unique(rows, axis=1)
        order = np.lexsort((names_b[rows[2]], names_a[rows[1]], rows[0]))[:k]
        best = list(rows[:, order])
        if len(order) == k:
            most = min(most, int(best[0][-1]))

    for flips in range(max(w for _, w in bands) + 1):
        for place, ((start, width), (order, keys)) in enumerate(zip(bands, tables)):
            if len(bands) * flips + place > most:
                return list(zip(*(x.tolist() for x in best)))
            own = (a >> np.uint64(start)) & np.uint64(_mask(width))
            for bits in itertools.combinations(range(width), flips):
                wanted = own ^ np.uint64(sum(1 << bit for bit in bits))
                low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
                hits = high - low
                at = np.repeat(np.arange(len(a)), hits)
                offset = np.arange(len(at)) - np.repeat(np.cumsum(hits) - hits, hits)
                if len(at):
                    add(at, order[low[at] + offset])
    return list(zip(*(x.tolist() for x in best)))


def _packed_hashes(side: DataFrame, count: int, name: str) -> DataFrame:
    """Blocks of distinct hashes in one row each: block, hashes (bytes) and first ids."""
    blocks = max(1, -(-count // SEARCHED))
    members = F.array_sort(F.collect_list(F.struct("h", F.col("ids")[0].alias("id"))))
    grouped = side.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias(f"block_{name}")).agg(members.alias("m"))
    return grouped.select(f"block_{name}", F.col("m.h").alias(f"h_{name}"), F.col("m.id").alias(f"id_{name}"))


def _searched_pairs(left: DataFrame, right: DataFrame, counts: tuple[int, int], k: int, most: int) -> DataFrame:
    """Closest k pairs of every two blocks within ``most`` bits: h_a, h_b, distance."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a, b = (np.asarray(h, dtype=np.int64).view(np.uint64) for h in (row.h_a, row.h_b))
                ranks = [np.unique(np.asarray(ids, dtype=object), return_inverse=True)[1] for ids in (row.id_a, row.id_b)]
                found = _closest(a, b, *ranks, k, most)
                yield pd.DataFrame([(row.h_a[i], row.h_b[j], d) for d, i, j in found], columns=["h_a", "h_b", "distance"])

    partners = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, -(-counts[1] // SEARCHED)) - 1).cast("bigint")))
    asked = cut_lineage(_packed_hashes(left, counts[0], "a")).withColumn("block_b", partners)
    joined = asked.join(cut_lineage(_packed_hashes(right, counts[1], "b")), "block_b")
    return joined.drop("block_a", "block_b").mapInPandas(search, "h_a long, h_b long, distance long")


def _equal_band_pairs(left: DataFrame, right: DataFrame, count: int, k: int) -> DataFrame:
    """Closest k pairs of hashes that agree on a band: h_a, h_b, distance, first ids. Complete below as many bits as there are bands."""

    def side(df: DataFrame, name: str) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(i).alias("band"), _band(F.col("h"), s, w).alias("value")) for i, (s, w) in enumerate(_sub_codes(count))])
        return df.select(F.col("h").alias(f"h_{name}"), F.col("ids")[0].alias(f"first_{name}"), F.inline(bands))

    joined = side(left, "a").join(side(right, "b"), ["band", "value"])
    first = _first_zero(F.col("h_a").bitwiseXOR(F.col("h_b")), _sub_codes(count))
    close = hamming(F.col("h_a"), F.col("h_b")).cast("bigint").alias("distance")
    return joined.filter(F.col("band") == first).select("h_a", "h_b", close, "first_a", "first_b").orderBy("distance", "first_a", "first_b").limit(k)


def hamming_topk(a: DataFrame, b: DataFrame, unit: str, h: Column, k: int) -> DataFrame:
    """The k closest pairs of two sides, by (distance, id_a, id_b).

    Bands about as long as the logarithm of the hashes are joined first, which is
    complete below as many bits as there are bands. Only where k pairs aren't that close
    are blocks of hashes searched best first (``_closest``), none farther than the
    k-th pair known; a pair of blocks returns k rows. Of equal hashes only the k
    first ids can take part, so the expansion is bounded by k alone.
    """

    def side(df):
        rows = df.select(F.col(unit).alias("unit"), h.alias("h"))
        sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        first = head_per_group(rows, ["h"], ["unit"], k).groupBy("h").agg(F.array_sort(F.collect_list("unit")).alias("ids"))
        return sizes.join(first, "h")

    left, right = cut_lineage(side(a)), cut_lineage(side(b))
    counts = left.count(), right.count()
    count = max(1, *counts)
    found = _equal_band_pairs(left, right, count, k).drop("first_a", "first_b")
    found = cut_lineage(found)
    held = found.agg(F.count(F.lit(1)), F.max("distance")).first()
    known = held[1] if held[0] == k else 64
    if known >= len(_sub_codes(count)) and all(counts):
        found = _searched_pairs(left, right, counts, k, known)
    named = found.join(left.select(F.col("h").alias("h_a"), F.col("ids").alias("ids_a")), "h_a").join(right.select(F.col("h").alias("h_b"), F.col("ids").alias("ids_b")), "h_b")
    best = named.withColumn("_a", F.col("ids_a")[0]).withColumn("_b", F.col("ids_b")[0]).orderBy("distance", "_a", "_b").limit(k)
    units = best.withColumn("id_a", F.explode("ids_a")).withColumn("id_b", F.explode("ids_b"))
    return units.select("id_a", "id_b", "distance").orderBy("distance", "id_a", "id_b").limit(k)


#: The pairs of splits that are compared.
COMPARISONS = [("train", "val"), ("train", "calibration"), ("train", "test"), ("val", "test")]


def compare_splits(df: DataFrame, split: str, unit: str, h: Column, k: int, comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """The k closest pairs of each two splits: comparison, id_a, id_b, distance."""
    df = cut_lineage(df)
    parts = []
    for one, other in comparisons or COMPARISONS:
        pairs = hamming_topk(df.filter(F.col(split) == one), df.filter(F.col(split) == other), unit, h, k)
        parts.append(pairs.select(F.lit(f"{one}_vs_{other}").alias("comparison"), "id_a", "id_b", "distance"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def distance_summary(pairs: DataFrame, by: str = "comparison") -> DataFrame:
    """spread of the distances per comparison (of a top-k table of unit pairs)."""
    return pairs.groupBy(by).agg(
        F.min("distance").alias("min_distance"),
        F.median("distance").alias("median_distance"),
        F.max("distance").alias("max_distance"),
        F.count(F.lit(1)).alias("n"),
    )


def knn_cosine(df: DataFrame, unit: str, vector: str, dims: int, k: int, min_cos: float, leaf: int = metric.LEAF, sample: int = metric.SAMPLE, hot: int = metric.HOT) -> DataFrame:
    """E5: up to k nearest neighbours with cosine of at least ``min_cos``.

    The search is exact (``operators.metric``). A vector is searched no farther than
    its k-th neighbour of the same leaf, so a dense group is not compared pairwise at the
    full radius. Equal vectors share one entry; of each only the k+1 first ids can
    be anyone's neighbour.
    """
    radius = math.sqrt(2.0 - 2.0 * min_cos) * (1 + 1e-9)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    unit_rows = df.select(F.col(unit).alias("unit"), F.zip_with(vector, F.array_repeat(F.greatest(norm, F.lit(1e-12)), F.size(vector)), lambda v, n: v / n).alias("e"))
    named = cut_lineage(unit_rows.select("unit", "e", *[F.xxhash64(F.lit(seed), F.to_json("e")).alias(f"_v{seed}") for seed in (1, 2)]))
    vid = ["_v1", "_v2"]
    sizes = named.groupBy(*vid).agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("n"))
    base = cut_lineage(sizes.withColumn("node", F.monotonically_increasing_id()))
    units = cut_lineage(named.join(base.select(*vid, "node"), vid).select("node", "unit"))
    forest = metric.fit_forest(base.select("node", "e"), dims, leaf, sample, hot)
    pairs = metric.close_pairs(metric.local_radius(base, forest, dims, k, radius), forest, dims)
    full = pairs.join(base.select(F.col("node").alias("va"), F.col("e").alias("ea")), "va").join(base.select(F.col("node").alias("vb"), F.col("e").alias("eb")), "vb")
    dot = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    hits = full.select("va", "vb", dot.alias("cosine")).filter(F.col("cosine") >= min_cos)
    own = base.filter(F.col("n") > 1).select(F.col("node").alias("va"), F.col("node").alias("vb"), F.lit(1.0).alias("cosine"))
    firsts = head_per_group(units, ["node"], ["unit"], k + 1)
    listed = hits.unionByName(own).join(firsts.select(F.col("node").alias("vb"), F.col("unit").alias("neighbour")), "vb")
    shortlist = head_per_group(listed, ["va"], [F.desc("cosine"), "neighbour"], k + 1).select("va", "neighbour", "cosine")
    members = units.select(F.col("node").alias("va"), "unit").join(shortlist, "va").filter(F.col("unit") != F.col("neighbour"))
    ranked = head_per_group(members.select("unit", "neighbour", "cosine"), ["unit"], [F.desc("cosine"), "neighbour"], k)
    return ranked.filter(F.col("cosine") >= min_cos)
