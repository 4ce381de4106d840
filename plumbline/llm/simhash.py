"""Near duplicates by SimHash, with candidates filtered along a ring of segments.

A fingerprint has 64 bits, one per majority of the shingles' XXH64 values. It is
read as a ring of four 16-bit segments. For two fingerprints within three bits
some segment starts a chain whose first l segments differ in at most 3l/4 bits
for every l (0, 1, 2, 3). The join key takes the first two links of that chain:
the starting segment unchanged and the next with at most one bit changed, so 32
bits select the candidates; the third link is checked before the whole distance.

Only distinct fingerprints are compared, so copies cost nothing. Links are
between fingerprints, at most one row per pair; membership is one row per document.

Defined cases: a null or empty text has fingerprint zero and links like any
other; repeated rows share a component, rows that share an id only if their
fingerprints link; a missing id takes part and orders last, and a component of
missing ids only has component_id null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import smallest_reachable
from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, packed, unpacked

SEED = 42
DISTANCE = 3
SEGMENTS = 4


def shingle_values(text: str | None, width: int) -> np.ndarray:
    """XXH64 values of a text's shingles, in order; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def majority(values: np.ndarray) -> int:
    """Signed 64-bit number of the bits set in over half the values; none: zero."""
    if not len(values):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(values), 4096):
        part = values[start : start + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    return majority(shingle_values(text, width))


def fingerprints(texts: Column) -> Column:
    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return of(texts)


def _turned(value: Column, bits: int) -> Column:
    """The ring read from a bit on."""
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def near_links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, first: int | None = None) -> DataFrame:
    """Links u < v between nodes of ``prints`` (node, print) within the distance, whose chains have no change in one link and one at most in two.

    With ``first``, u is one of the first so many nodes of a key; links grow with the rows, and the caller finds the others.
    Both sides are many rows a node, which Spark's estimate of an explode leaves out: they are dealt by key, never broadcast.
    """
    width = 64 // segments
    reads = F.array(*[F.struct(F.lit(k).alias("seg"), _turned(F.col("print"), width * k).alias("ring")) for k in range(segments)])
    rings = prints.select("node", F.explode(reads).alias("r")).select("node", F.col("r.seg").alias("seg"), F.col("r.ring").alias("ring"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    stored = rings.select(F.col("node").alias("u"), "seg", F.shiftrightunsigned("ring", 64 - 2 * width).alias("key"), F.col("ring").alias("ring_u"))
    if first is not None:
        place = Window.partitionBy("seg", "key").orderBy("u")
        stored = stored.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= first).drop("_n")
    probes = rings.select(F.col("node").alias("v"), "seg", F.col("ring").alias("ring_v"), F.explode(flips).alias("flip"))
    probes = probes.select("v", "seg", F.shiftrightunsigned("ring_v", 64 - 2 * width).bitwiseXOR(F.col("flip")).alias("key"), "ring_v")
    differ = F.col("ring_u").bitwiseXOR(F.col("ring_v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(differ) <= distance)
    for links in range(3, segments):
        near = near & (F.bit_count(F.shiftrightunsigned(differ, 64 - links * width)) <= links * distance // segments)
    joined = stored.hint("merge").join(probes, (stored["key"] == probes["key"]) & (stored["seg"] == probes["seg"]) & near)
    return joined.select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, _id, component."""
    rows = stored(docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), fingerprints(F.col("text")).alias("print")))
    prints = stored(rows.groupBy("print").agg(F.min("_id").alias("least")))
    labels = stored(smallest_reachable(near_links(prints.select(F.col("print").alias("node"), "print"))))
    linked = labels.withColumnRenamed("node", "print")
    least = stored(linked.join(prints, "print").groupBy("label").agg(F.min("least").alias("component")))
    found = linked.join(least, "label").select("print", "component")
    named = stored(prints.join(found, "print", "left").select("print", F.coalesce("component", "least").alias("component")))
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"), "_id", "component")


def component_rows(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; columns unchanged.

    Of rows that share an id one stays.
    """
    keep = near_duplicates(docs).filter(F.col("_id") == F.col("component")).select("_id").distinct()
    keyed = packed(docs, F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"))
    return unpacked(keyed.join(stored(keep), "_id", "left_semi").dropDuplicates(["_id"]))
