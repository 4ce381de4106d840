"""Document fingerprints by one-permutation MinHash.

The five-word shingles of a text are hashed once. The top bits of a hash name its
bin and the least hash of a bin is the bin's value. An empty bin borrows the value
of another by optimal densification: it probes bins in an order that depends on
the empty bin only (universal hash functions first, then a hashed order of all
bins) and takes the first that is filled. Of each value the four low-order bits
are stored, sixteen to a long. Two fingerprints' share of equal entries is
corrected for entries that agree by chance (one in sixteen).

Everything is array expressions on one row, so fingerprints need no shuffle.

Defined cases: a null text is empty; a text without words has the empty
fingerprint, which is like itself (1.0) and nothing else (0.0); fewer than five
words are one shingle; rows that share a doc_id are ordered by their text's hash; a
missing id orders last; a single row is its own next document; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import LAST_ID, ascii_lower, constant, let, place, text_key

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
CODE_BITS = 4
LANES = 64 // CODE_BITS
CHANCE = 1 / (1 << CODE_BITS)
#: Low bit of every lane.
LANE_LOW = 0x1111111111111111
#: Multipliers and offsets of the universal probes, modulo a prime above the bins.
PROBES = [((2 * k + 3) * 7919 % 65521, (k + 1) * 104729 % 65521) for k in range(8)]
PRIME = 65521
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Rows of one id range of the search for the next document, and the most ranges.
RANGE_ROWS = 200
MOST_RANGES = 65_536


def _shingles(text: Column) -> Column:
    def of(words: Column) -> Column:
        n = F.size(words)
        hashes = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
        whole = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= SHINGLE, hashes).otherwise(whole)

    return let(F.array_remove(F.split(ascii_lower(text), BLANKS, -1), ""), of)


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - BIN_BITS) + (BINS // 2)


def _bins(shingles: Column) -> Column:
    """Least hash of every bin, null for an empty one."""
    most = (1 << (64 - BIN_BITS)) - 1
    # the largest value of each bin, last in order, marks a bin without hashes
    ends = F.split(F.lit(",".join(str((b << (64 - BIN_BITS)) | most) for b in range(-(BINS // 2), BINS // 2))), ",").cast("array<bigint>")

    def of(ordered: Column) -> Column:
        first = F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, i - 1))))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(most)) != most, x))

    return let(F.sort_array(F.concat(shingles, ends)), of)


def _dense(bins: Column) -> Column:
    """Codes of all bins, the empty ones borrowed; null if all are empty."""

    def of(found: Column, used: Column) -> Column:
        def borrowed(b: Column) -> Column:
            probes = [F.get(found, ((b * a + c) % PRIME % BINS).cast("int")) for a, c in PROBES]
            ordered = F.array_min(F.transform(used, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("rank"), x.alias("value"))))
            return F.coalesce(*probes, ordered["value"])

        codes = F.transform(found, lambda x, b: F.coalesce(x, borrowed(b)).bitwiseAND(F.lit((1 << CODE_BITS) - 1)))
        return F.when(F.size(used) > 0, codes)

    return let(bins, lambda found: let(F.filter(found, lambda x: x.isNotNull()), lambda used: of(found, used)))


def sketch(text: Column) -> Column:
    """The packed fingerprint as an array of longs, empty without words."""

    def pack(codes: Column) -> Column:
        lane = lambda k: F.aggregate(F.slice(codes, k * LANES + 1, LANES), F.lit(0).cast("long"), lambda at, x: F.shiftleft(at, CODE_BITS).bitwiseOR(x))
        return F.when(codes.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lane)).otherwise(F.array().cast("array<bigint>"))

    return let(_dense(_bins(_shingles(text))), pack)


def as_hex(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(LANE_LOW)))

    wrong = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda at, x: at + x)
    corrected = F.greatest(F.lit(0.0), (1 - wrong / BINS - CHANCE) / (1 - CHANCE))
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(both, corrected).otherwise(F.when(F.size(left) == F.size(right), 1.0).otherwise(0.0))


def _ranged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds _range and _extra: id ranges with about equal rows.

    The first rows of a range also go, as extras, to the end of the range
    before; those of the first range go to the last, so that the last document
    meets the first.
    """
    count, least = ids.agg(F.count("*"), F.min("_id")).first()
    ranges = max(1, min(MOST_RANGES, count // RANGE_ROWS))
    starts = [least]
    if ranges > 1:
        cuts = ids.agg(F.percentile_approx("_id", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
        starts = sorted({least, *cuts})
    rows = rows.withColumn("_at", place(F.col("_id"), starts))
    own = F.struct(F.col("_at").alias("_range"), F.lit(0).alias("_extra"))
    before = F.struct(F.pmod(F.col("_at") - 1, F.lit(len(starts))).alias("_range"), F.lit(1).alias("_extra"))
    both = F.when(F.get(constant(starts), F.col("_at")) == F.col("_id"), F.array(own, before)).otherwise(F.array(own))
    return rows.withColumn("_r", F.explode_outer(both)).select("*", "_r.*").drop("_r", "_at")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points replaced by the
    first as many of the next document by ascending doc_id.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"))
    if ids.isEmpty():
        ids = docs.sparkSession.range(1).select(F.lit(LAST_ID).alias("_id"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), *text_key(F.col("text")))
    rows = _ranged(rows.withColumn("_sketch", sketch(F.col("_text"))), ids)
    order = Window.partitionBy("_range").orderBy("_extra", "_id", "_h1", "_h2")
    paired = rows.select("doc_id", "_text", "_sketch", "_extra", F.lead("_text").over(order).alias("_next"), F.lead("_sketch").over(order).alias("_next_sketch")).filter(F.col("_extra") == 0)
    paired = paired.withColumn("n_chars", F.char_length("_text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substr(F.col("_next"), F.lit(1), quarter))
    paired = paired.select("doc_id", "n_chars", "_sketch", "_next_sketch", edited.alias("_edited"))
    done = paired.withColumn("_edited_sketch", sketch(F.col("_edited")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("_sketch")).alias("fingerprint"),
        as_hex(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
