"""Close pairs of unit vectors by metric partition trees.

Vectors are turned by one fixed random rotation, so that distance spreads evenly over
coordinates, and cut into blocks. Two vectors within r are within r / sqrt(blocks) in at
least one block, a radius far below the usual distance there. Each block has a tree:
leaders of a node are chosen farthest first on a bounded sample, every vector belongs to
its nearest leader, and a search enters a child only if its ball reaches over the plane
between that leader and the nearest one. Leaves above ``HOT`` vectors are split again on a
sample of their own until none is left or a round changes nothing.

The sample decides how even the leaves are, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 8
#: Children of a node, vectors of a leaf, and vectors above which a leaf is split again.
FANOUT, LEAF, HOT = 8, 64, 2_048
#: Rows that one round of splitting sees on the driver (8 MB of 64 coordinates; splits see blocks only).
SAMPLE = 16_384
ROUNDS = 6
CELL_BITS = 40
CHUNK = 1_024


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """Leaders, each the point farthest from those before it; equal points give one."""
    chosen = [int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    apart = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


class Tree:
    """Leaders by node; children are nodes (zero and above) or leaves (below: ~leaf)."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaders: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(points, leaf)

    def _new_leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        if len(points) <= leaf:
            return self._new_leaf()
        leaders = _spread(points, FANOUT)
        if len(leaders) == 1:
            return self._new_leaf()
        node = len(self.leaders)
        self.leaders.append(leaders)
        self.children.append([])
        near = _squares(points, leaders).argmin(axis=1)
        for k in range(len(leaders)):
            self.children[node].append(self._grow(points[near == k], leaf))
        return node

    def split(self, leaf: int, points: np.ndarray, size: int) -> bool:
        """Put a subtree in place of a leaf; False if its points can't be told apart."""
        grown = self._grow(points, size)
        if grown < 0:
            return False
        if self.root == ~leaf:
            self.root = grown
        for children in self.children:
            for k, child in enumerate(children):
                if child == ~leaf:
                    children[k] = grown
        return True

    def visit(self, points: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they enter: their own (no reach), or all that their ball may meet."""
        rows, leaves, stack = [], [], [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), ~node))
                continue
            leaders = self.leaders[node]
            squares = _squares(points[at], leaders)
            near = squares.argmin(axis=1)
            if reach is None:
                enters = np.arange(len(leaders)) == near[:, None]
            else:
                between = np.sqrt(_squares(leaders, leaders))[near]
                past = (squares - squares.min(axis=1)[:, None]) / np.maximum(2 * between, 1e-300)
                enters = (past <= reach[at, None]) | (np.arange(len(leaders)) == near[:, None])
            for k, child in enumerate(self.children[node]):
                stack.append((child, at[enters[:, k]]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0.0)


class Forest:
    """A rotation, its blocks and a tree for each."""

    def __init__(self, sample: np.ndarray, dims: int, leaf: int):
        self.rotation = np.linalg.qr(np.random.default_rng(17).normal(size=(dims, dims)))[0]
        edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).round().astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        turned = sample @ self.rotation
        self.trees = [Tree(turned[:, a:b], leaf) for a, b in self.blocks]

    def reach(self, radius: np.ndarray | float) -> np.ndarray | float:
        """Radius within a block, with room for rounding."""
        return radius / math.sqrt(len(self.blocks)) * (1 + 1e-9) + 1e-9

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = vectors @ self.rotation
        return [turned[:, a:b] for a, b in self.blocks]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(list(vectors)).astype(float) if len(vectors) else np.zeros((0, dims))


def _homes(base: DataFrame, forest: Forest, dims: int) -> DataFrame:
    """Per vector and block: cell and the block's coordinates."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in enumerate(forest.parts(_matrix(batch["e"], dims))):
                at, leaf = forest.trees[block].visit(part, None)
                yield pd.DataFrame({"node": batch["node"].to_numpy()[at], "block": block, "leaf": leaf, "part": list(part[at])})

    return base.select("node", "e").mapInPandas(rows, "node long, block int, leaf long, part array<double>")


def fit_forest(base: DataFrame, dims: int, leaf: int = LEAF, sample: int = SAMPLE, hot: int = HOT) -> Forest:
    """Trees for the distinct vectors of ``base`` (node, e).

    Where the sample is the whole table its leaves are known to be small. Else leaves
    are counted, and large ones split on a sample of theirs.
    """
    drawn = base.select("e", F.xxhash64("node").alias("h")).orderBy("h").limit(sample + 1).toPandas()["e"]
    count = len(drawn) if len(drawn) <= sample else base.count()
    forest = Forest(_matrix(drawn[:sample], dims), dims, max(2, leaf * sample // max(count, sample)))
    for _ in range(ROUNDS if count > sample else 0):
        homes = _homes(base, forest, dims)
        large = homes.groupBy("block", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).collect()
        if not large:
            break
        each = max(2 * FANOUT, sample * dims // (len(large) * (dims // len(forest.blocks))))
        keys = {(r["block"], r["leaf"]): r["n"] for r in large}
        listed = base.sparkSession.createDataFrame([(b, l, min(1.0, each / n)) for (b, l), n in keys.items()], "block int, leaf long, share double")
        chosen = homes.join(F.broadcast(listed), ["block", "leaf"]).filter(F.pmod(F.xxhash64("node", "block"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        found = chosen.select("block", "leaf", "part").toPandas()
        changed = [forest.trees[b].split(int(leaf_id), np.stack(list(rows["part"])), max(2, leaf * len(rows) // keys[b, leaf_id])) for (b, leaf_id), rows in found.groupby(["block", "leaf"])]
        if not any(changed):
            break
    return forest


def local_radius(base: DataFrame, forest: Forest, dims: int, k: int, radius: float) -> DataFrame:
    """``base`` (node, e, n) with ``reach``: the k-th neighbour's distance inside the own leaf, ``radius`` at most.

    No nearer than the true one, so a search up to it is complete, and a dense
    group isn't compared at the full radius.
    """

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        leaf = np.zeros(len(vectors), dtype=np.int64)
        at, found = forest.trees[0].visit(forest.parts(_matrix(vectors, dims))[0], None)
        leaf[at] = found
        return pd.Series(leaf)

    def bounded(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, n = _matrix(frame["e"], dims), frame["n"].to_numpy()
        reach = np.full(len(frame), radius)
        for start in range(0, len(frame), CHUNK):
            cosine = vectors[start : start + CHUNK] @ vectors.T
            own = np.arange(start, start + len(cosine))
            order = np.argsort(-cosine, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1)
            enough = held - 1 >= k  # the vector's own row is none of its neighbours
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
            kth = cosine[np.arange(len(own)), order[np.arange(len(own)), at]]
            reach[own] = np.where(at >= 0, np.minimum(radius, np.sqrt(np.maximum(2 - 2 * kth, 0) + 1e-12) + 1e-7), radius)
        return frame[["node", "e"]].assign(reach=reach)

    return base.withColumn("cell", cell("e")).groupBy("cell").applyInPandas(bounded, "node long, e array<double>, reach double")


def close_pairs(searched: DataFrame, forest: Forest, dims: int) -> DataFrame:
    """Pairs (va, vb) with vb within va's ``reach`` in some block: all that are within it as a whole, and few more.

    ``searched``: node, e, reach.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, reach = batch["node"].to_numpy(), forest.reach(batch["reach"].to_numpy())
            for block, part in enumerate(forest.parts(_matrix(batch["e"], dims))):
                for bound in (None, reach):
                    at, leaf = forest.trees[block].visit(part, bound)
                    coordinates = [x.tobytes() for x in np.ascontiguousarray(part[at])]
                    yield pd.DataFrame({"cell": (block << CELL_BITS) + leaf, "node": nodes[at], "reach": -1.0 if bound is None else reach[at], "part": coordinates})

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        part = np.frombuffer(b"".join(frame["part"]), dtype=float).reshape(len(frame), -1)
        node, reach = frame["node"].to_numpy(), frame["reach"].to_numpy()
        home = reach < 0
        found = []
        for start in range(0, int((~home).sum()), CHUNK):
            asks = np.flatnonzero(~home)[start : start + CHUNK]
            near = _squares(part[asks], part[home]) <= (reach[asks] ** 2 + 1e-12)[:, None]
            a, b = np.nonzero(near)
            found.append((node[asks][a], node[home][b]))
        va, vb = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        other = va != vb
        return pd.DataFrame({"va": va[other], "vb": vb[other]})

    dealt = searched.select("node", "e", "reach").mapInPandas(rows, "cell long, node long, reach double, part binary")
    return dealt.groupBy("cell").applyInPandas(matched, "va long, vb long").distinct()
