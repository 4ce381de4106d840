"""Line deduplication over the whole corpus.

Lines are normalised and hashed, hashes are counted over distinct documents,
and lines of a frequent hash go from every document but the one with the
largest id. Only hashes and positions are shuffled for the decision; texts move
once, to meet the positions that they lose.

Defined cases: a null or empty text is one empty line; rows that share a doc_id
are one document; missing ids count as one document that orders last; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, ascii_lower, broadcast_if_small, text_key

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def _keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per long line: document, text key, position and line key."""
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), *text_key(F.col("text")), F.posexplode_outer(F.split(F.col("text"), "\n", -1)).alias("_pos", "_line"))
    long = lines.filter(F.char_length("_line") >= least_chars).withColumn("_key", ascii_lower(F.btrim(F.col("_line"), F.lit(BLANKS))))
    return long.filter(F.char_length("_key") >= least_chars).select("_id", "_h1", "_h2", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2"))


def _frequent(keys: DataFrame, least_docs: int) -> DataFrame:
    """Line keys found in enough documents, with the largest document id."""
    per_document = keys.groupBy("_k1", "_k2", "_id").agg(F.lit(1).alias("_one"))
    counted = per_document.groupBy("_k1", "_k2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper"))
    return counted.filter(F.col("_docs") >= least_docs).select("_k1", "_k2", "_keeper")


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Per row: doc_id, text (what is left), n_lines, n_dropped."""
    frequent = stored(_frequent(_keys(docs, least_chars), least_docs))
    small = broadcast_if_small(frequent, frequent.count())
    hits = _keys(docs, least_chars).join(small, ["_k1", "_k2"]).filter(F.col("_id") != F.col("_keeper"))
    dropped = hits.groupBy("_id", "_h1", "_h2").agg(F.array_sort(F.collect_set("_pos")).alias("_dropped"))
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), *text_key(F.col("text")))
    joined = rows.join(dropped, ["_id", "_h1", "_h2"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
    left = F.when(F.col("_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    return joined.select("doc_id", left.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
