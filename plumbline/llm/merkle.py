"""Merkle manifest of a dataset: blocks of a binary hash tree in van Emde Boas order.

Leaves are row digests, ranked inside their language by a range shuffle of narrow
rows. 1,024 consecutive leaves are the aligned subtree of one block. A block's
nodes lie in one byte string, recursively split at half height, so a path of any
length touches few neighbouring pieces; ``Layout`` finds a node's place by arithmetic
from three numbers a depth. Block roots are the leaves of the next level, and so on
until a language has one root; the language roots are ranked and treated alike.
Sibling digests come down the same levels: a block hands each leaf its siblings
inside the block and those above its own root.

A run's last, single node becomes its own digest's digest as long as its level has
several nodes, which a block that is not the only one follows up to its full height.

Defined cases: nulls of any column enter a leaf as ``-``; a missing id orders last in
its language, by leaf; rows equal in all columns are leaves of their own; a missing
language is a language, first in order; an empty table has no rows and no root.
Other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, broadcast_if_small

#: Levels below a block's root, so 1,024 leaves and 64 KB of digests a block.
HEIGHT = 10
SIZE = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


class Layout:
    """Places of the nodes of a perfect tree in van Emde Boas order.

    A tree of several levels is cut below half of them. A node at depth d is the root
    of a bottom tree in exactly one cut; that cut's top tree starts at depth ``start[d]``
    and holds ``top[d]`` nodes, each of its bottom trees ``bottom[d]``.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.start, self.top, self.bottom = [0] * levels, [0] * levels, [0] * levels
        self._cut(0, levels)

    def _cut(self, depth: int, levels: int) -> None:
        if levels == 1:
            return
        above = levels // 2
        at = depth + above
        self.start[at], self.top[at], self.bottom[at] = depth, (1 << above) - 1, (1 << (levels - above)) - 1
        self._cut(depth, above)
        self._cut(at, levels - above)

    def place(self, depth: int, index: np.ndarray) -> np.ndarray:
        """Places of the nodes with these indices at a depth."""
        found = np.zeros_like(index)
        while depth:
            found += self.top[depth] + (index & self.top[depth]) * self.bottom[depth]
            index, depth = index >> (depth - self.start[depth]), self.start[depth]
        return found


@lru_cache(maxsize=64)
def layout(height: int) -> Layout:
    return Layout(height + 1)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height_of(total: int, full: int = HEIGHT) -> int:
    """Height of a block of a level with so many nodes: the whole level's, or a full block's."""
    return min(full, max(0, int(total) - 1).bit_length())


def build_block(leaves: list[bytes], height: int) -> bytes:
    """A block's nodes in order of their places; places beyond the last leaf stay zero."""
    order = layout(height)
    nodes = np.zeros(((1 << (height + 1)) - 1, SIZE), dtype=np.uint8)
    level = [leaf.hex() for leaf in leaves]
    for depth in range(height, -1, -1):
        raw = np.frombuffer(bytes.fromhex("".join(level)), dtype=np.uint8).reshape(-1, SIZE)
        nodes[order.place(depth, np.arange(len(level)))] = raw
        level = [_digest("".join(level[k : k + 2])) for k in range(0, len(level), 2)] if depth else level
    return nodes.tobytes()


def block_paths(nodes: bytes, count: int, height: int) -> list[list[str]]:
    """Per leaf its siblings inside the block from the leaf up: side (L or R) and digest, or - for none."""
    order = layout(height)
    digests = nodes.hex()
    paths: list[list[str]] = [[] for _ in range(count)]
    for depth in range(height, 0, -1):
        index = np.arange(count) >> (height - depth)
        beside = index ^ 1
        places = (order.place(depth, beside) * 2 * SIZE).tolist()
        for path, at, odd, there in zip(paths, places, (index & 1).tolist(), (beside <= index[-1]).tolist()):
            path.append(("L" if odd else "R") + digests[at : at + 2 * SIZE] if there else "-")
    return paths


def fold(leaf: str, path: list[str]) -> str:
    """Root recomputed from a leaf and its siblings."""
    for step in path:
        leaf = _digest(leaf if step == "-" else step[1:] + leaf if step[0] == "L" else leaf + step[1:])
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _scope(lang: Column) -> Column:
    """A language as an ordered key: the missing one first."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))


def row_leaves(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, scope, leaf, tampered (the leaf after tampering, null where nothing changes)."""
    rows = docs.select(*[docs[c] for c in FIELDS])
    fields = {c: _field(F.col(c)) for c in FIELDS}
    changed = fields | {"n_chars": _field(F.col("n_chars").cast("decimal(20,0)") + 1)}
    leaf, other = (F.unhex(F.sha2(F.concat(*[f[c] for c in FIELDS]).cast("binary"), 256)) for f in (fields, changed))
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return rows.select("doc_id", _scope(F.col("lang")).alias("scope"), leaf.alias("leaf"), F.when(touched, other).alias("tampered"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``idx``, their rank in ``scope`` by ``order``, and ``total``, the rows of the scope.

    Ranges are dealt by scope, order and the row's number, so neither a large scope
    nor equal rows meet in one task. Only a count per range and scope is summed up.
    """
    keys = ["scope", *order, "_row"]
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    counts = stored(placed.groupBy("scope", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    scope = Window.partitionBy("scope")
    before = F.coalesce(F.sum("_n").over(scope.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("scope", "_range", (before - F.col("_first")).alias("_offset"), F.sum("_n").over(scope).alias("total"))
    joined = placed.join(broadcast_if_small(offsets, counts.count()), ["scope", "_range"])
    return joined.withColumn("idx", F.col("_at") + F.col("_offset")).drop("_row", "_at", "_range", "_offset")


def _blocks(nodes: DataFrame, extra: list[str], height: int) -> DataFrame:
    """Blocks of a level: scope, block, total, nodes, root and one array for each extra column."""
    members = F.array_sort(F.collect_list(F.struct("idx", "leaf", *extra)))
    groups = nodes.groupBy("scope", F.shiftright("idx", height).alias("block")).agg(F.first("total").alias("total"), members.alias("m"))

    @F.pandas_udf("binary")
    def build(leaves: pd.Series, totals: pd.Series) -> pd.Series:
        return pd.Series([build_block(list(x), height_of(t, height)) for x, t in zip(leaves, totals)])

    made = groups.select("scope", "block", "total", *[F.col(f"m.{c}").alias(c) for c in ["leaf", *extra]]).withColumn("nodes", build("leaf", "total"))
    return made.withColumn("root", F.substring("nodes", 1, SIZE))


def build_levels(leaves: DataFrame, extra: list[str], height: int) -> list[DataFrame]:
    """Stored blocks by level, the leaves' first. ``leaves``: scope, idx, total, leaf and extra columns."""
    levels = [stored(_blocks(leaves, extra, height))]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > 1 << height:
        most = -(-most >> height)
        upper = levels[-1].filter(F.col("total") > 1 << height)
        nodes = upper.select("scope", F.col("block").alias("idx"), (-F.shiftright(-F.col("total"), height)).alias("total"), F.col("root").alias("leaf"))
        levels.append(stored(_blocks(nodes, [], height)))
    return levels


def scope_roots(levels: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """Per scope its root."""
    tops = [x.filter(F.col("total") <= 1 << height).select("scope", "root") for x in levels]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found


def _leaf_paths(blocks: DataFrame, height: int) -> DataFrame:
    """Per leaf of blocks with ``upper``: scope, idx, path."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                inside = block_paths(row.nodes, len(row.leaf), height_of(row.total, height))
                yield pd.DataFrame({"scope": row.scope, "idx": np.arange(len(inside)) + (row.block << height), "path": [p + list(row.upper) for p in inside]})

    return blocks.select("scope", "block", "total", "leaf", "nodes", "upper").mapInPandas(paths, "scope string, idx long, path array<string>")


def with_upper(levels: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Blocks of the lowest level with ``upper``: the siblings above their roots, from there up.

    ``above`` holds scope and upper of the scopes' roots.
    """
    paths = None
    for blocks in reversed(levels):
        full = blocks.filter(F.col("total") <= 1 << height).join(above, "scope")
        if paths is not None:
            inner = blocks.filter(F.col("total") > 1 << height).join(paths, ["scope", "block"])
            full = full.unionByName(inner)
        found = full if blocks is levels[0] else stored(full)
        paths = None if blocks is levels[0] else stored(_leaf_paths(found, height).withColumnRenamed("idx", "block").withColumnRenamed("path", "upper"))
    return found


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored blocks of the languages' trees and of the tree over their roots, each by level.

    A block: scope (language key), block, total (nodes of its level), leaf digests, nodes
    (all digests in van Emde Boas order) and root; the lowest level also has doc_id and tampered.
    """
    leaves = ranked(row_leaves(docs).withColumn("_id", F.coalesce("doc_id", F.lit(LAST_ID))), ["_id", "leaf"]).drop("_id")
    levels = build_levels(leaves, ["doc_id", "tampered"], height)
    named = scope_roots(levels, height).select(F.lit("").alias("scope"), F.col("scope").alias("name"), F.col("root").alias("leaf"))
    return levels, build_levels(ranked(named, ["name"]), ["name"], height)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches: Iterator[pd.DataFrame], height: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            root, upper = row.top.hex(), list(row.upper)
            inside = block_paths(row.nodes, len(row.leaf), height_of(row.total, height))
            above = "".join(step[1:] for step in upper)
            leaves = [leaf.hex() for leaf in row.leaf]
            frame = pd.DataFrame({"doc_id": pd.array(list(row.doc_id), dtype="Int64"), "leaf": leaves})
            frame["subroot"], frame["root"] = row.subroot.hex(), root
            frame["proof_sha256"] = [_digest("".join(step[1:] for step in path) + above) for path in inside]
            frame["folded_root"] = [fold(leaf if other is None else other.hex(), path + upper) for leaf, other, path in zip(leaves, row.tampered, inside)]
            frame["verified"] = frame["folded_root"] == root
            yield frame


def merkle_proofs(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    levels, tops = manifest(docs, height)
    nothing = tops[-1].select("scope").distinct().withColumn("upper", F.array().cast("array<string>"))
    whole = scope_roots(tops, height).select(F.col("root").alias("top"))
    named = tops[0].select("scope", "block", F.posexplode("name").alias("_at", "name"))
    named = named.select("name", (F.shiftleft("block", height) + F.col("_at")).alias("idx"))
    paths = _leaf_paths(with_upper(tops, nothing, height), height).join(named, "idx").select(F.col("name").alias("scope"), F.col("path").alias("upper"))
    above = stored(paths.join(scope_roots(levels, height).withColumnRenamed("root", "subroot"), "scope"))
    top = whole.first()
    blocks = with_upper(levels, above.select("scope", "upper"), height).join(above.select("scope", "subroot"), "scope")
    blocks = blocks.withColumn("top", F.lit(bytes(top["top"]) if top else b"").cast("binary"))
    return blocks.select("doc_id", "total", "leaf", "tampered", "nodes", "upper", "subroot", "top").mapInPandas(lambda batches: _prove(batches, height), PROOFS)


PROOFS_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), fields AS (
  SELECT doc_id, lang, n_chars, text, source,
         doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS touched
  FROM documents, crc_table
), hashed AS (
  SELECT *, sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                          coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                       coalesce(strlen((n_chars + touched::INT)::VARCHAR) || ':' || (n_chars + touched::INT), '-'), coalesce(strlen(text) || ':' || text, '-'))) AS changed
  FROM fields
), leaves AS (
  SELECT doc_id, leaf, changed, coalesce('=' || lang, '') AS scope,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS total
  FROM hashed
), tree AS (
  SELECT scope, 0 AS lvl, idx, total, leaf AS h FROM leaves
  UNION ALL
  SELECT scope, lvl + 1, idx // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE total > 1 GROUP BY scope, lvl, idx // 2, total
), subroots AS (
  SELECT scope, lvl AS height, h AS subroot, row_number() OVER (ORDER BY encode(scope)) - 1 AS idx, count(*) OVER () AS total FROM tree WHERE total = 1
), top AS (
  SELECT 0 AS lvl, idx, total, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE total > 1 GROUP BY lvl, idx // 2, total
), folded AS (
  SELECT l.doc_id, l.leaf, l.scope, false AS over, 0 AS lvl, l.idx, l.total, l.changed AS h, '' AS siblings, l.idx AS _k FROM leaves l
  UNION ALL
  SELECT f.doc_id, f.leaf, f.scope, f.over OR f.total = 1,
         CASE WHEN f.total = 1 THEN 0 ELSE f.lvl + 1 END,
         CASE WHEN f.total = 1 THEN s.idx ELSE f.idx // 2 END,
         CASE WHEN f.total = 1 THEN s.total ELSE (f.total + 1) // 2 END,
         CASE WHEN f.total = 1 THEN f.h WHEN f.idx % 2 = 1 THEN sha256(concat(coalesce(a.h, b.h), f.h)) ELSE sha256(concat(f.h, coalesce(a.h, b.h))) END,
         CASE WHEN f.total = 1 THEN f.siblings ELSE concat(f.siblings, coalesce(a.h, b.h)) END, f._k
  FROM folded f JOIN subroots s ON s.scope = f.scope
  LEFT JOIN tree a ON NOT f.over AND f.total > 1 AND a.scope = f.scope AND a.lvl = f.lvl AND a.idx = xor(f.idx, 1)
  LEFT JOIN top b ON f.over AND f.total > 1 AND b.lvl = f.lvl AND b.idx = xor(f.idx, 1)
  WHERE NOT (f.over AND f.total = 1)
)
SELECT f.doc_id, f.leaf, s.subroot, r.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folded f JOIN subroots s ON s.scope = f.scope JOIN top r ON r.total = 1 WHERE f.over AND f.total = 1
"""
