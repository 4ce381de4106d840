"""Near copies for the pipeline: texts whose five-word shingles are at least 0.8 alike.

Each distinct set of shingles is a node with a 64-bit SimHash of the set. Fingerprints
that differ in up to ``DISTANCE`` bits are found along a ring of ``SEGMENTS`` segments, as
in ``op3`` (``simhash.near_links``), but of each key only the first ``MET`` nodes are
looked at by all others, so a large family gives pairs in proportion to its texts. The
sets of such nodes are compared exactly: the Jaccard index decides. In each of
``RING_TURNS`` a node is compared with one of those, of another component than its own.

These are proposals only: two sets that are 0.8 alike may differ in more bits or not be
proposed, so an exact search follows for all pairs whose nodes aren't in one component yet: in
one order of all shingles, the first fifth of either set and one shingle more must meet.
The order goes from rare to frequent, so that what a text has for itself comes first.
Texts of one family that are less alike fill that part with shingles of their own and meet
nowhere. Rarity is read from one table of ``CELLS`` counts over all texts, of a fixed size;
any order is right, a better one meets less often. A meeting place bounds the similarity
too: whatever either text has before it is not shared.

In each turn of that search the members of a meeting place (a shingle) look at its centre,
the node with the fewest shingles before it, as the text that others were made from. Each
node takes the one centre it meets most often, and their sets are compared exactly. What a
turn links is one component for the next. Once a turn links nothing more, or after
``TURNS``, the pairs still in different components that the bound allows are compared, so
the components are those of all pairs at 0.8 or more.

Defined cases: null and empty texts have the empty set and are copies of each other;
texts below five words have one shingle, the whole text. Of a component the first row
by id, text and whole row stays; a missing id comes last and is nobody else's id. Rows
equal in all columns count as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import smallest_reachable
from plumbline.llm.simhash import majority, near_links, shingle_values
from plumbline.llm.store import batches_of, discard, stored
from plumbline.llm.text import LAST_ID, broadcast_if_small, packed, text_key, unpacked

WIDTH = 5
#: Bits in which linked fingerprints may differ, and segments of their ring.
DISTANCE, SEGMENTS = 5, 8
#: Nodes of a ring key that all others look at.
MET = 8
#: Turns of the search by fingerprint, and of the exact search before all pairs left are compared.
RING_TURNS, TURNS = 2, 4
#: Texts that a Python worker holds at once.
TEXTS = 500
#: Counts of the rarity table (4 MB), and how many travel in a row.
CELLS, PIECE = 1 << 20, 1 << 16
#: Tables of tasks are added up by groups first.
MERGE = 256
ORDER = ["_id", "_h1", "_h2", "_h3"]


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending distinct XXH64 values of a text's shingles."""
    return np.unique(shingle_values(text, WIDTH))


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(40)).astype(np.int64) % CELLS


def prefix(values: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, as many as must meet those of a set that is 0.8 alike."""
    order = np.lexsort((values, rarity[_cells(values)]))
    return values[order[: len(values) - -(-4 * len(values) // 5) + 1]] if len(values) else values


def _order(docs: DataFrame) -> list[Column]:
    """A total order of rows, but for rows equal in all columns."""
    whole = F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])
    return [F.coalesce(docs["doc_id"], F.lit(LAST_ID)).alias("_id"), *text_key(docs["text"]), whole.alias("_h3")]


NODES = "_id long, _h1 long, _h2 long, _h3 long, node long, print long, piece int, part long, counts binary"


def _nodes(docs: DataFrame) -> DataFrame:
    """Per row its key, node and fingerprint; and per task the pieces of its rarity table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, part = np.zeros(CELLS, dtype="<u4"), 0
        for batch in batches:
            nodes, prints = [], []
            for text in batch["text"]:
                values = shingle_set(text)
                np.add.at(counts, _cells(values), 1)
                nodes.append(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).astype("i8"))
                prints.append(majority(values))
            part = part or int(nodes[0]) if nodes else part
            yield batch[ORDER].assign(node=nodes, print=prints, piece=None, part=None, counts=None)
        if counts.any():
            pieces = [zlib.compress(counts[at : at + PIECE].tobytes(), 1) for at in range(0, CELLS, PIECE)]
            yield pd.DataFrame({c: None for c in [*ORDER, "node", "print"]} | {"piece": range(len(pieces)), "part": part % MERGE, "counts": pieces}, columns=[*ORDER, "node", "print", "piece", "part", "counts"])

    return docs.select(*_order(docs), "text").mapInPandas(rows, NODES)


def _rarity(found: DataFrame) -> np.ndarray:
    """The summed rarity table: 16 rows of one size come to the driver."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, dtype="<u8")
        for counts in frame["counts"]:
            raw = np.frombuffer(zlib.decompress(counts), dtype="<u4")
            total += raw
        summed = np.minimum(total, (1 << 32) - 1).astype("<u4")
        return pd.DataFrame({"piece": [int(frame["piece"].iloc[0])], "counts": [zlib.compress(summed.tobytes(), 1)]})

    pieces = found.filter(F.col("piece").isNotNull())
    once = pieces.groupBy("piece", "part").applyInPandas(add, "piece int, counts binary")
    total = np.zeros(CELLS, dtype=np.int64)
    for row in once.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():
        total[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["counts"]), dtype="<u4")
    return total


def _meeting_rows(texts: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Per node of ``texts`` and shingle of its prefix: key, node, pos, size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(node, values) for node, values in ((n, shingle_set(t)) for n, t in zip(batch["node"], batch["text"])) if len(values)]
            keys = [prefix(values, rarity) for _, values in found]
            if keys:
                lengths = [len(k) for k in keys]
                yield pd.DataFrame(
                    {
                        "key": np.concatenate(keys).view("i8"),
                        "node": np.repeat([n for n, _ in found], lengths),
                        "pos": np.concatenate([np.arange(n, dtype="i4") for n in lengths]),
                        "size": np.repeat(np.array([len(v) for _, v in found], dtype="i4"), lengths),
                    }
                )

    return texts.select("node", "text").mapInPandas(rows, "key long, node long, pos int, size int")


def _sets(texts: DataFrame) -> DataFrame:
    """Per row of ``texts`` its node and shingles."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t).view("<i8") for t in batch["text"]]})

    return texts.select("node", "text").mapInPandas(rows, "node long, shingles array<long>")


def _possible(pos: str, size: str) -> Column:
    """Whether what follows a meeting place can make two sets 0.8 alike; the other's columns have a leading _."""
    follow = F.least(F.col(size) - F.col(pos), F.col(f"_{size}") - F.col(f"_{pos}"))
    sized = 5 * F.least(size, f"_{size}") >= 4 * F.greatest(size, f"_{size}")
    return sized & (9 * follow >= 4 * (F.col(size) + F.col(f"_{size}")))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs u, v whose sets have a Jaccard index of at least 0.8; a set travels once for all pairs as v."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    found = left.join(broadcast_if_small(pairs, pairs.count()), "u").join(right, "v")
    both = F.size(F.array_intersect("a", "b"))
    return found.filter(5 * both >= 4 * (F.size("a") + F.size("b") - both)).select("u", "v")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the meeting places that hold several components, with their label."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    found = labels.withColumnRenamed("label", "_l")
    named = stored(members.join(found, "node", "left").select(*members.columns, F.coalesce("_l", "node").alias("label")))
    several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    left = stored(named.join(several, "key"))
    discard(named)
    return left


OTHER = ["node", "pos", "size", "label"]


def _central_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Per node its most frequent centre of another component, where the bound allows it."""
    first = F.min(F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "label")).alias("c")
    centres = stored(mixed.groupBy("key").agg(first).select("key", *[F.col(f"c.{c}").alias(f"_{c}") for c in OTHER]))
    met = mixed.join(centres, "key").filter((F.col("label") != F.col("_label")) & _possible("pos", "size"))
    counted = met.groupBy("node", "_node").agg(F.count("*").alias("n"))
    best = counted.groupBy("node").agg(F.max(F.struct("n", "_node")).alias("m"))
    pairs = stored(best.select(F.col("node").alias("u"), F.col("m._node").alias("v")))
    discard(centres)
    return pairs


def _all_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of different components that meet where the bound allows it."""
    other = mixed.select("key", *[F.col(c).alias(f"_{c}") for c in OTHER])
    met = mixed.join(other, "key").filter((F.col("label") < F.col("_label")) & _possible("pos", "size"))
    return stored(met.select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct())


def _ring_pairs(prints: DataFrame) -> DataFrame:
    """Pairs u, v of nodes whose fingerprints are near: the first nodes of two fingerprints, and of one with its others.

    All pairs where no key has more than ``MET`` fingerprints; else u is one of a key's first.
    """
    prints = stored(prints)
    firsts = stored(prints.groupBy("print").agg(F.min("node").alias("first")))
    others = prints.join(firsts, "print").filter(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    linked = near_links(firsts.select(F.col("first").alias("node"), "print"), DISTANCE, SEGMENTS, MET)
    pairs = stored(linked.distinct().unionByName(others))
    discard(firsts, prints)
    return pairs


def _first_pairs(near: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Per node one that it is near to, of another component; nodes of a family agree on the same ones."""
    if labels is not None:
        left = labels.select(F.col("node").alias("u"), F.col("label").alias("_a"))
        right = labels.select(F.col("node").alias("v"), F.col("label").alias("_b"))
        near = near.join(left, "u", "left").join(right, "v", "left").filter(F.coalesce("_a", "u") != F.coalesce("_b", "v"))
    first = F.min(F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), "u")).alias("c")
    return stored(near.groupBy("v").agg(first).select(F.col("c.u").alias("u"), "v"))


def _linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame | None, bool]:
    """Labels with the alike ones of ``pairs`` linked too, and whether there are any; a component so far is a star."""
    found = stored(_similar(pairs, sets))
    discard(pairs)
    new = found.limit(1).count() > 0
    if new:
        star = None if labels is None else labels.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        labels = smallest_reachable(found if star is None else found.unionByName(star))
    discard(found)
    return labels, new


def _components(members: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame | None:
    """Per linked node: node, label. First the pairs ``near`` by fingerprint, then what only meeting places show."""
    labels, grown = None, True
    for turn in range(RING_TURNS):
        labels, _ = _linked(_first_pairs(near, labels, turn), sets, labels)
    discard(near)
    for turn in range(TURNS + 1):
        last = turn == TURNS or not grown
        mixed = _mixed(members, labels)
        pairs = _all_pairs(mixed) if last else _central_pairs(mixed, turn)
        discard(mixed if labels is not None else None)
        labels, grown = _linked(pairs, sets, labels)
        if last:
            break
    return labels


def _members(texts: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Meeting rows of the keys that several nodes have; all rows are dealt by key once."""
    place = Window.partitionBy("key")
    met = _meeting_rows(texts, rarity).withColumn("_a", F.min("node").over(place)).withColumn("_b", F.max("node").over(place))
    return met.filter("_a <> _b").drop("_a", "_b").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row of the order: _id, _h1, _h2, _h3, node, component."""
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        found = stored(_nodes(docs))
    rarity = _rarity(found)
    rows = found.filter(F.col("piece").isNull()).select(*ORDER, "node")
    near = _ring_pairs(found.filter(F.col("piece").isNull()).select("node", "print").distinct())
    least = stored(rows.groupBy("node").agg(F.min(F.struct(*ORDER)).alias("r")).select("node", "r.*"))
    keyed = docs.select(*_order(docs), "text")
    with batches_of(spark, TEXTS):
        members = stored(_members(keyed.join(broadcast_if_small(least, least.count()), ORDER), rarity))
    candidates = stored(least.join(members.select("node").distinct(), "node", "left_semi"))
    count = candidates.count()
    with batches_of(spark, TEXTS):
        sets = stored(_sets(keyed.join(broadcast_if_small(candidates, count), ORDER)))
    if sets.count() > count:  # rows equal in all columns
        sets = stored(sets.dropDuplicates(["node"]))
    labels = _components(members, sets, near)
    discard(sets, members, candidates)
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels.withColumnRenamed("label", "_l"), "node", "left").select(*ORDER, "node", F.coalesce("_l", "node").alias("component"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of each component; columns unchanged."""
    found = stored(near_copies(docs))
    first = F.min(F.struct(*ORDER)).alias("r")
    nodes = found.groupBy("component", "node").agg(first)
    keep = stored(nodes.groupBy("component").agg(F.min("r").alias("r")).select("r.*"))
    keyed = packed(docs, *_order(docs))
    return unpacked(keyed.join(keep, ORDER, "left_semi").dropDuplicates(ORDER))
