"""Hard negatives by an R-tree that bounds inner products.

Every vector is indexed. Rows are tiled by nested quantiles of the two coordinates
that vary most (cuts from a bounded sample, which decide balance only), a tile that is
still large is dealt by a hash of its rows, and each piece becomes one packed tree:
sort-tile-recursive leaves of one label each, then boxes over 16 consecutive nodes. A
box gives an interval of inner products, as every coordinate adds between the
products with its two ends. The queue takes the box with the greatest upper end first
and drops boxes outside all score windows or strictly below the k-th score found, so
ties are still seen and results are exact. Labels are one more coordinate of a box.

Anchors are the stated query set. They go over all trees in blocks, one after the other,
each broadcast and bounded by ``BLOCK_VALUES``. A tree returns at most k rows for each
question; the merge keeps the first k of those.

Defined cases: rows with a missing vec_id, label or vector, or a missing or non-finite
component, take no part; a shorter vector counts as filled up with zeros; rows that
share a vec_id are all candidates for others but never for each other, and each of
them is an anchor of its own; components beyond 64 bits after scaling saturate, and so do scores;
an anchor without positives, or without a row in a window, returns nothing for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import broadcast_if_small

#: Components in one tree: 4,096 vectors of 64, 2 MB.
TREE_VALUES = 1 << 18
#: Components of the anchors that travel at once: 8 MB.
BLOCK_VALUES = 1 << 20
#: Trees in one task at most.
TASK_TREES = 8
ALL = (float("-inf"), float("inf"))
LEAF, FANOUT = 128, 16
SAMPLE = 50_000
TILES = 4_096
EXACT = 1 << 53
LONG = (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label, vec (whole numbers)."""
    rows = rows.select(rows["vec_id"], rows["label"].cast("long").alias("label"), rows["embedding"])
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    return part.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))


def _matrix(vectors: list, dims: int) -> np.ndarray:
    filled = np.zeros((len(vectors), dims), dtype="<i8")
    for row, vector in zip(filled, vectors):
        row[: len(vector)] = vector
    return filled


def _tile_cuts(rows: DataFrame, dims: int, tiles: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Two coordinates, cuts of the first and, per slab, cuts of the second."""
    drawn = rows.select("vec", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    sample = _matrix(list(drawn["vec"]), dims).astype(float)
    first, second = [int(c) for c in (*np.argsort(-sample.var(axis=0), kind="stable")[:2], 0)[:2]]
    slabs = max(1, round(tiles**0.5))
    each = -(-tiles // slabs)
    cuts = np.quantile(sample[:, first], np.arange(1, slabs) / slabs)
    slab = np.searchsorted(cuts, sample[:, first], side="right")
    inner = [np.quantile(s, np.arange(1, each) / each) if len(s) else np.zeros(each - 1) for s in (sample[slab == k, second] for k in range(slabs))]
    return first, second, cuts, np.array(inner).reshape(slabs, each - 1)


def _tiled(rows: DataFrame, dims: int, count: int, most: int) -> DataFrame:
    """Rows with ``piece``, about ``most`` rows each or fewer."""
    tiles = min(TILES, -(-count // most))
    if tiles > 1:
        first, second, cuts, inner = _tile_cuts(rows, dims, tiles)

        @F.pandas_udf("long")
        def tile(vectors: pd.Series) -> pd.Series:
            pair = np.array([[v[c] if c < len(v) else 0 for c in (first, second)] for v in vectors], dtype=float).reshape(-1, 2)
            slab = np.searchsorted(cuts, pair[:, 0], side="right")
            return pd.Series(slab * (inner.shape[1] + 1) + [int(np.searchsorted(inner[s], y, side="right")) for s, y in zip(slab, pair[:, 1])])

        rows = stored(rows.withColumn("_tile", tile("vec")))
    else:
        rows = rows.withColumn("_tile", F.lit(0).cast("long"))
    sizes = stored(rows.groupBy("_tile").agg(F.ceil(F.count("*") / most).alias("_salts")))
    dealt = rows.join(F.broadcast(sizes), "_tile")
    return dealt.withColumn("piece", F.struct("_tile", F.pmod(F.xxhash64("vec_id", "vec"), "_salts").alias("salt"))).drop("_tile", "_salts")


def _str_order(vectors: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in sort-tile-recursive order inside each label, and where leaves start."""
    order, starts = [], []

    def tile(rows: np.ndarray, axes: list[int]) -> None:
        pages = -(-len(rows) // LEAF)
        if not axes or pages <= 1:
            base = sum(map(len, order))
            order.append(rows)
            starts.extend(range(base, base + len(rows), LEAF))
            return
        slabs = int(np.ceil(pages ** (1 / len(axes))))
        width = -(-pages // slabs) * LEAF
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        for at in range(0, len(rows), width):
            tile(rows[at : at + width], axes[1:])

    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        spread = vectors[rows].astype(float).var(axis=0)
        tile(rows, [int(c) for c in np.argsort(-spread, kind="stable")[:3]])
    return np.concatenate(order), np.array(starts)


class Tree:
    """A packed R-tree over rows in leaf order; the last level is one box or a few."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, starts: np.ndarray):
        self.ids, self.labels, self.ends = ids, labels, np.append(starts[1:], len(ids))
        self.starts = starts
        self.top = max(1, int(np.abs(vectors).max(initial=0)), -int(vectors.min(initial=0)))
        self.vectors = vectors
        lo, hi = np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts)
        least, most = labels[starts], labels[starts]
        self.levels = [(lo, hi, least, most)]
        while len(lo) > FANOUT:
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((lo, hi, least, most))
        self._kinds: dict[type, tuple] = {}

    def numbers(self, query: np.ndarray) -> tuple:
        """The tree in a number type in which inner products with the query are exact."""
        top = max(1, max((abs(int(x)) for x in query), default=0))
        kind = np.float64 if self.top * top * max(1, len(query)) < EXACT else object
        if kind not in self._kinds:
            self._kinds[kind] = (self.vectors.astype(kind), [(lo.astype(kind), hi.astype(kind)) for lo, hi, _, _ in self.levels])
        return (*self._kinds[kind], query.astype(kind))


def search(tree: Tree, query: np.ndarray, windows: list[tuple[int, int]], k: int, label: int, same: bool, own: int) -> list[list[tuple[int, int]]]:
    """Per window (least, most score) its first k rows as (score, id), of the label or of the others.

    Rows with the id ``own`` are left out.
    """
    vectors, boxes, q = tree.numbers(query)
    up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    least = [w[0] for w in windows]
    queue: list[tuple[int, int, int, int]] = []

    def offer(level: int, start: int, end: int) -> None:
        lo, hi = boxes[level]
        upper = hi[start:end] @ up + lo[start:end] @ down
        lower = lo[start:end] @ up + hi[start:end] @ down
        _, _, first, last = tree.levels[level]
        for at in range(start, end):
            apart = not first[at] <= label <= last[at] if same else first[at] == last[at] == label
            top, bottom = upper[at - start], lower[at - start]
            if not apart and any(top >= a and bottom <= w[1] for a, w in zip(least, windows)):
                heapq.heappush(queue, (-top, level, at, bottom))

    offer(len(boxes) - 1, 0, len(boxes[-1][0]))
    while queue:
        top, level, at, bottom = heapq.heappop(queue)
        if not any(-top >= a and bottom <= w[1] for a, w in zip(least, windows)):
            continue
        if level:
            offer(level - 1, at * FANOUT, min(len(boxes[level - 1][0]), (at + 1) * FANOUT))
            continue
        start, end = tree.starts[at], tree.ends[at]
        scores = vectors[start:end] @ q
        for i in np.flatnonzero(scores >= min(least)):
            score, item = int(scores[i]), int(tree.ids[start + i])
            if item == own:
                continue
            for j, (a, (_, most)) in enumerate(zip(least, windows)):
                if a <= score <= most:
                    kept = found[j]
                    kept.append((-score, item))
                    if len(kept) > k:
                        kept.sort()
                        kept.pop()
                    if len(kept) == k:
                        least[j] = -max(kept)[0]
    return [[(-s, i) for s, i in sorted(x)] for x in found]


TREE = "ids binary, labels binary, vectors binary, starts binary"


def build_trees(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """One row per tree over all ``rows`` (vec_id, label, vec): ids, labels, vectors and leaf starts as bytes."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, labels, ids = _matrix(list(frame["vec"]), dims), frame["label"].to_numpy("<i8"), frame["vec_id"].to_numpy("<i8")
        order, starts = _str_order(vectors, labels)
        return pd.DataFrame([[x.astype("<i8").tobytes() for x in (ids[order], labels[order], vectors[order], starts)]], columns=["ids", "labels", "vectors", "starts"])

    return _tiled(rows, dims, rows.count(), most).groupBy("piece").applyInPandas(build, TREE)


def _clamped(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def _window(positive: int) -> tuple[int, int]:
    """Scores from four fifths of a positive's to its own."""
    return -((-4 * positive) // 5), positive


PACKED = "block long, q binary, own binary, kind binary, asked binary, counts binary, positives binary"


def _packed_block(dims: int):
    """Questions of one block as one row of bytes."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.array([len(p) for p in frame["positives"]], dtype="<i8")
        positives = np.concatenate([np.array(p, dtype="<i8") for p in frame["positives"]])
        parts = [frame["q"].to_numpy("<i8"), frame["anchor_id"].to_numpy("<i8"), frame["label"].to_numpy("<i8"), _matrix(list(frame["vec"]), dims), counts, positives]
        return pd.DataFrame([[int(frame["block"].iloc[0]), *[x.astype("<i8").tobytes() for x in parts]]], columns=["block", "q", "own", "kind", "asked", "counts", "positives"])

    return pack


def _asked(trees: DataFrame, questions: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """First k answers of every tree: q, j (window), score, item.

    ``questions``: q, anchor_id, label, vec, positives (scores; none where the label's own rows are asked for).
    """

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, labels, starts, q, own, kind, counts, positives = (np.frombuffer(x, "<i8") for x in (row.ids, row.labels, row.starts, row.q, row.own, row.kind, row.counts, row.positives))
                vectors, asked = (np.frombuffer(x, "<i8").reshape(-1, dims) for x in (row.vectors, row.asked))
                tree, ends, rows = Tree(ids, labels, vectors, starts), np.cumsum(counts), []
                for at in range(len(q)):
                    windows = [ALL] if same else [_window(int(p)) for p in positives[ends[at] - counts[at] : ends[at]]]
                    for j, items in enumerate(search(tree, asked[at], windows, k, int(kind[at]), same, int(own[at]))):
                        rows += [(int(q[at]), j, _clamped(score), item) for score, item in items]
                yield pd.DataFrame(rows, columns=["q", "j", "score", "item"])

    count = questions.count()
    blocks = max(1, -(-count * dims // BLOCK_VALUES))
    packed = stored(questions.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).groupBy("block").applyInPandas(_packed_block(dims), PACKED))
    number = trees.count()
    spread = trees.repartition(max(min(number, trees.sparkSession.sparkContext.defaultParallelism), -(-number // TASK_TREES)))
    parts = [stored(spread.withColumn("block", F.lit(b).cast("long")).join(F.broadcast(packed.filter(F.col("block") == b)), "block").mapInPandas(answers, "q long, j int, score long, item long")) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _first(answers: DataFrame, k: int) -> DataFrame:
    """Of each question and window the first k answers with their rank from 1."""
    order = Window.partitionBy("q", "j").orderBy(F.desc("score"), "item")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, k: int = 5, positives: int = 5, tree_values: int = TREE_VALUES) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id and both scores.

    ``rows``: vec_id, label, vec (see ``usable``); ``anchors`` chooses the queries by vec_id.
    """
    rows = stored(rows)
    dims = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    asked = stored(rows.filter(anchors).withColumn("q", F.monotonically_increasing_id()))
    count = asked.count()
    if not count:
        return rows.select(*[F.col("vec_id").alias(c) for c in ("anchor_id", "positive_id")], F.lit(1).alias("rank"), *[F.col("vec_id").alias(c) for c in ("negative_id", "positive_score", "negative_score")]).limit(0)
    trees = stored(build_trees(rows, dims, max(LEAF, tree_values // dims)))
    questions = asked.select("q", F.col("vec_id").alias("anchor_id"), "label", "vec", F.array().cast("array<long>").alias("positives"))
    near = stored(_first(_asked(trees, questions, dims, positives, True), positives).select("q", "rank", "item", "score"))
    listed = near.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    wanted = stored(questions.drop("positives").join(listed, "q").select("q", "anchor_id", "label", "vec", "positives"))
    if not wanted.limit(1).count():
        return hard_negatives(rows.limit(0), anchors)
    against = _first(_asked(trees, wanted, dims, k, False), k)
    named = near.select("q", (F.col("rank") - 1).alias("j"), F.col("item").alias("positive_id"), F.col("score").alias("positive_score"))
    found = against.join(named, ["q", "j"]).join(broadcast_if_small(wanted.select("q", "anchor_id"), count), "q")
    return found.select("anchor_id", "positive_id", "rank", F.col("item").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame) -> DataFrame:
    """The query: labels of every seventh id moved by one, every hundredth row an anchor."""
    rows = usable(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
