"""Benchmark decontamination with broadcast sets of test n-grams.

Benchmark texts become windows of 13 words (a shorter text is one window). The
windows' hashes are broadcast in slices of bounded size and probed with every
window of every document. Windows of documents are never shuffled, only hits are;
they meet their texts again and count only if the words are equal.

Defined cases: a null text has no words; an item without an id counts as item
``''``; repeated rows each get their result; rows that share a doc_id but not a
text are told apart; an empty benchmark hits nothing; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, ascii_lower, broadcast_if_small, let, packed, text_key, unpacked

#: Everything in ASCII but digits and lower-case letters.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Windows in one broadcast slice: about 200 bytes each.
SLICE_WINDOWS = 250_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def _with_runs(found: Column, most: int, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of the hashes of runs of 1, 2, 4 ... words from each place, by doubling."""

    def further(runs: list[Column]) -> Column:
        width = 1 << (len(runs) - 1)
        if 2 * width > most:
            return body(runs)
        return let(F.transform(runs[-1], lambda run, i: F.xxhash64(run, F.get(runs[-1], i + width))), lambda longer: further([*runs, longer]))

    return let(F.transform(found, lambda word: F.xxhash64(word)), lambda single: further([single]))


def _gram(runs: list[Column], i: Column, length: int) -> Column:
    """Hash of the window at a place: of its runs, longest first."""
    pieces, at = [], 0
    for k in reversed(range(len(runs))):
        if length >> k & 1:
            pieces.append(F.get(runs[k], i + at))
            at += 1 << k
    return F.xxhash64(F.lit(length), *pieces)


def _hashes(text: Column, lengths: list[int]) -> Column:
    """Hash of every window of each length, one length after the other."""

    def of(runs: list[Column], length: int) -> Column:
        size = F.size(runs[0])
        return F.when(size >= length, F.transform(F.sequence(F.lit(0), size - length), lambda i: _gram(runs, i, length))).otherwise(F.array().cast("array<bigint>"))

    return _with_runs(words(text), max(lengths), lambda runs: F.concat(*[of(runs, n) for n in lengths]) if len(lengths) > 1 else of(runs, lengths[0]))


def _window_hash(window: Column, most: int) -> Column:
    def of(runs: list[Column]) -> Column:
        found = F.lit(None).cast("long")
        for n in range(1, most + 1):
            found = F.when(F.size(window) == n, _gram(runs, F.lit(0), n)).otherwise(found)
        return found

    return _with_runs(window, most, of)


def test_windows(benchmark: DataFrame, length: int = 13) -> DataFrame:
    """Distinct windows: _gram (hash), _window (words), _length, _items."""

    def of(found: Column) -> Column:
        size = F.least(F.size(found), F.lit(length))
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.size(found) - size + 1), lambda i: F.slice(found, i, size)))

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"), F.explode(let(words(F.col("text")), of)).alias("_window"))
    windows = items.withColumn("_length", F.size("_window"))
    return windows.groupBy("_length", "_window").agg(F.collect_set("_item").alias("_items")).withColumn("_gram", _window_hash(F.col("_window"), length))


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of one slice of windows by hash, one row per document position."""
    texts = docs.select(*_key(), F.size(words(F.col("text"))).alias("_n"), _hashes(F.col("text"), lengths).alias("_grams"))
    # the outer form keeps the optimizer from computing the hashes once more to drop texts without any
    grams = texts.select("_id", "_h1", "_h2", "_n", F.posexplode_outer("_grams").alias("_at", "_gram"))
    start, offset = F.col("_at"), F.lit(0)
    for n in lengths:
        start = F.when(F.col("_at") >= offset, F.col("_at") - offset).otherwise(start)
        offset = offset + F.greatest(F.col("_n") - n + 1, F.lit(0))
    # a position's length follows from its place, and must be that of the window
    hits = grams.join(F.broadcast(windows), "_gram").withColumn("_start", start)
    return hits.select("_id", "_h1", "_h2", F.struct("_start", "_window", "_items").alias("_hit"))


def _key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), *text_key(F.col("text"))]


def find_hits(docs: DataFrame, benchmark: DataFrame, length: int = 13, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """Per document with hits: _id, _h1, _h2, _n (words), n_hit, _items (sorted)."""
    windows = stored(test_windows(benchmark, length))
    sizes = windows.groupBy("_length").count().collect()
    lengths, count = sorted(r["_length"] for r in sizes), sum(r["count"] for r in sizes)
    slices = max(1, -(-count // slice_windows))
    parts = [_scan(docs, windows.filter(F.pmod("_gram", F.lit(slices)) == k).drop("_length"), lengths or [length]) for k in range(slices)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = stored(hits.groupBy("_id", "_h1", "_h2").agg(F.collect_set("_hit").alias("_hits")))
    keys = hits.select("_id", "_h1", "_h2")
    # only texts with hits are moved to be verified
    texts = docs.select(*_key(), "text").join(broadcast_if_small(keys, keys.count()), ["_id", "_h1", "_h2"], "left_semi").dropDuplicates(["_id", "_h1", "_h2"])
    verified = let(words(F.col("text")), lambda found: F.struct(F.size(found).alias("n"), F.filter("_hits", lambda h: F.slice(found, h["_start"] + 1, F.size(h["_window"])) == h["_window"]).alias("hits")))
    # files of hits are far smaller than hits: windows and items repeat
    found = texts.join(hits.hint("merge"), ["_id", "_h1", "_h2"]).select("_id", "_h1", "_h2", verified.alias("_v")).filter(F.size("_v.hits") > 0)
    spans = F.array_sort(F.transform("_v.hits", lambda h: F.struct(h["_start"].alias("start"), (h["_start"] + F.size(h["_window"])).alias("end"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("hit")),
        lambda at, span: F.struct(F.greatest(at["reach"], span["end"]).alias("reach"), (at["hit"] + F.greatest(F.lit(0), span["end"] - F.greatest(at["reach"], span["start"]))).alias("hit")),
        lambda at: at["hit"],
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("_v.hits", lambda h: h["_items"]))))
    return found.select("_id", "_h1", "_h2", F.col("_v.n").alias("_n"), covered.cast("long").alias("n_hit"), names.alias("_items"))


def is_contaminated(hit: Column, size: Column) -> Column:
    """At least one word in twenty stands in a benchmark window."""
    return (hit > 0) & (20 * hit >= size)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark).select("_id", "_h1", "_h2", "n_hit", "_items")
    rows = docs.select("doc_id", *_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    joined = rows.join(found, ["_id", "_h1", "_h2"], "left").withColumn("n_hit", hit)
    names = F.array_join(F.coalesce("_items", F.array().cast("array<string>")), ",")
    return joined.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the contaminated ones, columns unchanged."""
    bad = stored(find_hits(docs, benchmark).filter(is_contaminated(F.col("n_hit"), F.col("_n"))).select("_id", "_h1", "_h2"))
    keyed = packed(docs, *_key())
    return unpacked(keyed.join(broadcast_if_small(bad, bad.count()), ["_id", "_h1", "_h2"], "left_anti"))


HITS_SQL = r"""
WITH doc AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents
), item AS (
  SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT doc_id, i, spans.n, item_id FROM spans JOIN windows ON spans.n = windows.n AND spans.s = windows.s
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
