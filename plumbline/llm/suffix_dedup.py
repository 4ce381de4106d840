"""Repeated passages of a corpus, from maximal repeats of suffix arrays.

A byte is repeated where a string of ``LEAST`` bytes that covers it also starts earlier
(in a smaller document, or before in the same one). Strings are dealt out by content:
the least hash of a string's 32-byte pieces is its anchor, so equal strings share an
anchor, and neighbouring strings with one anchor travel as one run of text. A run seen
before, whole, is repeated as it is and only counted. Different runs of one anchor
meet in a task, which sorts their suffixes (ranks of doubled prefixes), takes common
prefixes from the same ranks, scans the interval tree with a stack and reports
each interval whose occurrences differ in the byte before them: a maximal repeat with all
its occurrences. Every occurrence but the earliest is covered by it.

Each suffix is settled once, at the longest interval in which it isn't the earliest.
An anchor with very many different runs is dealt in chunks; what is earliest in
its chunk is compared across chunks by 128 bits of each string. Frequent anchors are
recognised on a sample of documents, which decides where their rows go and nothing else.

Equal texts are one text with its earliest row; later rows of it are repeated as a whole.

Defined cases: null and empty texts have no bytes; texts below ``LEAST`` bytes lose
nothing; a missing id orders last; rows that share an id are ordered by a hash of their texts,
and of rows equal in both one counts as the earlier; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.merkle import ranked
from plumbline.llm.store import stored
from plumbline.llm.text import LAST_ID, broadcast_if_small, text_key

LEAST = 100
#: Bytes of the pieces whose least hash is the anchor.
PIECE = 32
#: Strings in one run at most; a longer one (very repetitive text) is cut there.
RUN_STRINGS = 16_384
#: Bytes of an anchor's different runs in one task; an anchor with more is dealt in chunks.
CHUNK_BYTES = 1_000_000
#: Bytes of runs after which a batch of anchors is sorted.
SORT_BYTES = 1_000_000
#: Sampled documents, and how many of them make an anchor frequent; at most so many anchors are.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4_000, 8, 50_000
#: Positions per document at most (a text is one value).
SPAN = np.int64(1 << 31)
SYMBOLS = 7

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _windows(values: np.ndarray, width: int, joined) -> np.ndarray:
    """Values of all windows of a width, by joining windows of half the width."""
    length = 1
    while 2 * length <= width:
        values = joined(values[:-length], values[length:])
        length *= 2
    return joined(values[: length - width], values[width - length :]) if length < width else values


@lru_cache(maxsize=8)
def _factors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte and an odd factor for each doubling."""
    drawn = _mixed(np.arange(1, 257 + 33, dtype=np.uint64) + np.uint64(seed) * _A)
    return drawn[:256], drawn[256:] | np.uint64(1)


def piece_hashes(data: bytes, width: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all pieces of a width."""
    bytewise, factors = _factors(seed)
    rest = iter(factors)
    return _mixed(_windows(bytewise[np.frombuffer(data, dtype=np.uint8)], width, lambda a, b: a * next(rest) + b))


def runs(data: bytes) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: anchor, start, length in bytes, whether the anchor occurs twice in it."""
    if len(data) < LEAST:
        return (np.zeros(0, "u8"), *[np.zeros(0, "i8")] * 2, np.zeros(0, bool))
    hashes = piece_hashes(data, PIECE)
    least = _windows(hashes, LEAST - PIECE + 1, np.minimum)
    starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    longest = int(np.diff(np.append(starts, len(least))).max())
    if longest > RUN_STRINGS:
        starts = np.concatenate([np.arange(a, b, RUN_STRINGS) for a, b in zip(starts, np.append(starts[1:], len(least)))])
    ends = np.append(starts[1:], len(least))
    anchors = least[starts]
    shut = np.zeros(LEAST - PIECE, "u8")
    places = np.flatnonzero(hashes == _windows(np.concatenate([shut, least, shut]), LEAST - PIECE + 1, np.maximum))
    values, counts = np.unique(hashes[places], return_counts=True)
    return anchors, starts, ends - starts + LEAST - 1, np.isin(anchors, values[counts > 1])


def prefix_ranks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Where texts start in their concatenation, each position's text end, and ranks of prefixes by length.

    Ranks of prefixes of 1, 7, 14, 28 ... bytes, until they tell all positions apart or
    are as long as the longest text. A prefix cut by its text's end orders first.
    """
    lengths = np.array([len(t) + SYMBOLS - 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    symbols = np.zeros(lengths.sum() + SYMBOLS - 1, dtype=np.int64)
    for at, text in zip(starts, texts):
        symbols[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        symbols[at : at + len(text)] += 1
    count = len(symbols) - SYMBOLS + 1
    ends = np.repeat(starts + lengths - SYMBOLS + 1, lengths)
    word = np.zeros(count, dtype=np.int64)
    for k in range(SYMBOLS):
        word = (word << 9) | symbols[k : k + count]
    places, longest, length = np.arange(count), max(map(len, texts), default=0), SYMBOLS
    levels = [(1, symbols[:count].astype(np.int32))]
    while True:
        order = np.argsort(word)
        new = np.diff(word[order], prepend=-1) > 0
        kinds = int(new.sum())
        rank = np.empty(count, dtype=np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        levels.append((length, rank))
        if length >= longest or kinds == count:
            return starts, ends, levels
        later = places + length
        rest = np.where(later < ends, rank[np.minimum(later, count - 1)] + 1, 0)
        word = rank * np.int64(kinds + 1) + rest
        length *= 2


def common_prefixes(left: np.ndarray, right: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Lengths of the common prefixes of pairs of positions."""
    found = np.zeros(len(left), dtype=np.int64)
    room = np.minimum(ends[left] - left, ends[right] - right)
    for length, rank in [*reversed(levels[1:]), *levels[:1] * (SYMBOLS - 1)]:
        a, b = np.minimum(left + found, len(rank) - 1), np.minimum(right + found, len(rank) - 1)
        found = np.minimum(np.where((found < room) & (rank[a] == rank[b]), found + length, found), room)
    return found


def repeat_groups(order: np.ndarray, prefixes: np.ndarray, keys: np.ndarray, before: np.ndarray, least: int = LEAST) -> tuple[list, list, np.ndarray]:
    """Scan the interval tree of an enhanced suffix array.

    ``prefixes[k]`` is the common prefix of ``order[k - 1]`` and ``order[k]``, ``keys`` order
    positions from early to late and ``before`` is the byte before one (-1 for none). Returns the maximal
    repeats as (length, first, last index in ``order``), the covered (position, length), and which positions
    in ``order`` have an earlier equal string of ``least`` bytes.
    """
    groups, covered = [], []
    settled = np.zeros(len(order), dtype=bool)
    deep = prefixes >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep[1:], [False]]).astype(np.int8)))
    firsts, lasts = edges[::2], edges[1::2]
    # most intervals are pairs, which need no stack
    pair = firsts[lasts - firsts == 1]
    swap = keys[order[pair]] > keys[order[pair + 1]]
    later = np.where(swap, pair, pair + 1)
    settled[later] = True
    apart = (before[order[pair]] != before[order[pair + 1]]) | (before[order[pair]] == -1)
    groups += zip(prefixes[pair + 1][apart].tolist(), pair[apart].tolist(), (pair[apart] + 1).tolist())
    covered += zip(order[later[apart]].tolist(), prefixes[pair + 1][apart].tolist())
    more = lasts - firsts > 1
    for first, last in zip(firsts[more].tolist(), lasts[more].tolist()):
        early, bytes_before, steps = keys[order[first : last + 1]].tolist(), before[order[first : last + 1]].tolist(), prefixes[first + 1 : last + 1].tolist()
        stack: list[list] = []

        def close(node: list, first: int = first, early: list = early) -> None:
            length, start, end, left, open_items = node
            earliest = min(open_items, key=early.__getitem__)
            if left == -1:
                groups.append((length, first + start, first + end))
            for item in open_items:
                if item != earliest:
                    settled[first + item] = True
                    if left == -1:
                        covered.append((int(order[first + item]), length))
            node[4] = [earliest]

        for k, step in enumerate([*steps, least - 1]):
            node = [0, k, k, bytes_before[k], [k]]
            while stack and stack[-1][0] > step:
                top = stack.pop()
                _join(top, node)
                close(top)
                node = top
            if stack and stack[-1][0] == step:
                _join(stack[-1], node)
            elif step >= least:
                stack.append([step, *node[1:4], list(node[4])])
    return groups, covered, settled


def _join(node: list, child: list) -> None:
    """Add a later child's span, open items and byte before; differing or missing bytes before become -1."""
    node[2] = child[2]
    if child[3] != node[3]:
        node[3] = -1
    node[4] += child[4]


def settle(texts: list[bytes], docs: list[int], starts: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """Repeats among runs of text: covered (doc, start, length), and per run the starts of its strings that nothing earlier equals.

    The latter are (index of the run, doc, starts).
    """
    bases, ends, levels = prefix_ranks(texts)
    docs_at, starts_at = np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64)
    rank_of = np.unique(docs_at, return_inverse=True)[1]
    counts = np.array([len(t) - LEAST + 1 for t in texts])
    run = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places = bases[run] + offset
    keys, before, owner = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), -1, dtype=np.int16), np.zeros(len(ends), dtype=np.int64)
    keys[places] = rank_of[run] * SPAN + starts_at[run] + offset
    joined = np.frombuffer(b"".join(t + bytes(SYMBOLS - 1) for t in texts), dtype=np.uint8).astype(np.int16)
    before[places] = np.where(offset > 0, joined[np.maximum(places - 1, 0)], -1)
    owner[places] = run
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    prefixes = np.append(0, common_prefixes(order[:-1], order[1:], ends, levels))
    _, covered, settled = repeat_groups(order, prefixes, keys, before)
    spans = [(docs[owner[p]], int(keys[p] % SPAN), length) for p, length in covered]
    fresh = np.zeros(len(ends), dtype=bool)
    fresh[order[~settled]] = True
    left = [(k, docs[k], starts[k] + np.flatnonzero(fresh[bases[k] : bases[k] + counts[k]])) for k in range(len(texts))]
    return spans, left


RUNS = "anchor long, run long, doc long, start int, length int, several boolean"


#: Rows after which a task hands over what it has gathered.
GATHERED = 100_000


def _once(batch: pd.DataFrame, seen: set) -> Iterator[tuple]:
    """Rows of a task, of a text only the first, with the text's bytes in front.

    Rows equal in id and text are copies of a first row too.
    """
    for row in batch.itertuples(index=False):
        if row.doc not in seen:
            seen.add(row.doc)
            yield (row.text or "").encode("utf-8", "surrogatepass"), row


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest, seen = xxhash.xxh64_intdigest, set()
    for batch in batches:
        found, rows = [], 0
        for data, row in _once(batch, seen):
            anchors, starts, lengths, several = runs(data)
            if len(anchors):
                content = np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), (starts + lengths).tolist())], dtype="u8")
                found.append((anchors.view("i8"), content.view("i8"), np.full(len(anchors), row.doc), starts.astype("i4"), lengths.astype("i4"), several))
                rows += len(anchors)
            if rows >= GATHERED:
                yield _table(found, ["anchor", "run", "doc", "start", "length", "several"])
                found, rows = [], 0
        if found:
            yield _table(found, ["anchor", "run", "doc", "start", "length", "several"])


def _table(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(column) for name, column in zip(names, zip(*parts))})


def _first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as narrow rows with the number of their text, and the first row of each text with its number.

    Numbers follow the order of the texts' first rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = stored(docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), *text_key(docs["text"]), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_place")))
    firsts = rows.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_place")).alias("f"))
    firsts = firsts.select(F.lit("").alias("scope"), F.col("f._id").alias("_id"), "_h1", "_h2", F.col("f._place").alias("_place"))
    return rows, stored(ranked(firsts, ["_id", "_h1", "_h2"]).select("_id", "_h1", "_h2", "_place", F.col("idx").alias("doc")))


def _texts(docs: DataFrame, chosen: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """Texts of chosen first rows; ``chosen`` has _id, _h1, _h2 and what is to stand beside the text, ``rows`` x ``width`` bytes."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), *text_key(docs["text"]), "text")
    return keyed.join(broadcast_if_small(chosen, rows, width), ["_id", "_h1", "_h2"])


def _shared_runs(docs: DataFrame, firsts: DataFrame, count: int) -> DataFrame:
    """Runs whose anchor occurs elsewhere, or twice inside."""
    share = max(1, -(-count // SAMPLE_DOCS))
    chosen = firsts.select("_id", "_h1", "_h2", "doc")
    drawn = chosen.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0)
    sampled = _texts(docs, drawn, count // share).select("doc", "text").mapInPandas(_run_rows, RUNS)
    counted = sampled.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    frequent = stored(counted.orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT).select("anchor", F.lit(True).alias("hot")))
    found = _texts(docs, chosen, count).select("doc", "text").mapInPandas(_run_rows, RUNS).join(F.broadcast(frequent), "anchor", "left")
    # frequent anchors are dealt by document, any number of rows of them is enough to be shared
    spread = F.when(F.col("hot"), F.col("doc")).otherwise(F.lit(-1).cast("long"))
    together = Window.partitionBy("anchor", "_spread")
    met = found.withColumn("_spread", spread).withColumn("_n", F.count("*").over(together))
    return stored(met.filter((F.col("_n") > 1) | F.col("several") | F.col("hot")).select("anchor", "run", "doc", "start", "length", "several"))


SETTLED = "doc long, start int, length int, w1 long, w2 long, open boolean"


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates(["doc", "start"], ignore_index=True)
    texts, starts, chunks = list(frame["data"]), frame["start"].tolist(), frame["chunks"].tolist()
    spans, left = settle(texts, frame["doc"].tolist(), starts)
    parts = [np.array([(*s, 0, 0, 0) for s in spans], dtype="i8").reshape(-1, 6)]
    for k, doc, places in left:
        if chunks[k] > 1 and len(places):
            one, two = (piece_hashes(texts[k], LEAST, seed)[places - starts[k]].view("i8") for seed in (3, 4))
            parts.append(np.column_stack([np.full(len(places), doc), places, np.full(len(places), LEAST), one, two, np.ones(len(places), "i8")]))
    made = np.concatenate(parts)
    return pd.DataFrame(made, columns=["doc", "start", "length", "w1", "w2", "open"]).astype({"start": "i4", "length": "i4", "open": bool})


def _settle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered spans, and (open) strings of chunked anchors that are the earliest of their chunk.

    Rows come in order of anchor and chunk; some groups are sorted together.
    """
    waiting, size, last = [], 0, None
    for batch in batches:
        keys = list(zip(batch["anchor"].tolist(), batch["chunk"].tolist()))
        start = 0
        for at, (key, length) in enumerate(zip(keys, batch["data"].str.len().tolist())):
            if key != last and size >= SORT_BYTES:
                yield _settled(pd.concat([*waiting, batch.iloc[start:at]], ignore_index=True))
                waiting, size, start = [], 0, at
            last, size = key, size + length
        waiting.append(batch.iloc[start:])
    if size:
        yield _settled(pd.concat(waiting, ignore_index=True))


PIECES = ["anchor", "chunk", "chunks", "start", "length"]


def _run_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = set()
    for batch in batches:
        found, pieces, size = [], [], 0
        for data, row in _once(batch, seen):
            cut = [data[a : a + n] for a, n in zip(row.start.tolist(), row.length.tolist())]
            found.append((row.anchor, row.chunk, row.chunks, np.full(len(cut), row.doc), row.start))
            pieces += cut
            size += sum(map(len, cut))
            if size >= 16 * SORT_BYTES:
                yield _table(found, ["anchor", "chunk", "chunks", "doc", "start"]).assign(data=pieces)
                found, pieces, size = [], [], 0
        if found:
            yield _table(found, ["anchor", "chunk", "chunks", "doc", "start"]).assign(data=pieces)


def repeated_spans(docs: DataFrame, firsts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Repeated spans of first texts: doc, start, length; spans may overlap."""
    count = firsts.count()
    shared = _shared_runs(docs, firsts, count)
    place = F.struct("doc", "start")
    kinds = stored(shared.groupBy("anchor", "run", "length").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("several").alias("several")))
    again = kinds.filter("n > 1").select("anchor", "run", "length", "first")
    copies = shared.join(again, ["anchor", "run", "length"]).filter(place != F.col("first")).select("doc", "start", "length")
    different = kinds.groupBy("anchor").agg(F.count("*").alias("_runs"), F.sum("length").alias("_bytes"), F.max("several").alias("_several")).filter("_runs > 1 or _several")
    chunks = F.ceil(F.col("_bytes") / chunk_bytes).cast("int")
    open_kinds = kinds.join(different.select("anchor", chunks.alias("chunks")), "anchor")
    wanted = F.struct("anchor", F.pmod(F.xxhash64("run"), "chunks").cast("int").alias("chunk"), "chunks", F.col("first.start").alias("start"), "length")
    by_doc = stored(open_kinds.select(F.col("first.doc").alias("doc"), wanted.alias("w")).groupBy("doc").agg(F.collect_list("w").alias("wanted")).join(firsts, "doc").select("_id", "_h1", "_h2", "doc", "wanted"))
    # a document: its keys and number and two array heads; a run: 24 bytes
    size = by_doc.agg(F.sum(64 + 24 * F.size("wanted"))).first()[0] or 0
    pieces = _texts(docs, by_doc, size, 1).select("doc", "text", *[F.col(f"wanted.{c}").alias(c) for c in PIECES]).mapInPandas(_run_texts, "anchor long, chunk int, chunks int, doc long, start int, data binary")
    dealt = pieces.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    found = stored(dealt.mapInPandas(_settle_rows, SETTLED))
    across = Window.partitionBy("w1", "w2").orderBy("doc", "start")
    later = found.filter("open").withColumn("_at", F.row_number().over(across)).filter(F.col("_at") > 1)
    inside = found.filter(~F.col("open"))
    return copies.unionByName(inside.select("doc", "start", "length")).unionByName(later.select("doc", "start", "length"))


def _merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of a union, from start to end; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return list(zip(starts[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)].tolist()))


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of what was removed)."""
    rows, firsts = _first_texts(docs)
    spans = repeated_spans(docs, firsts, chunk_bytes)
    packed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("found"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def union(found: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in _merged(np.array([x["start"] for x in f], dtype="i8"), np.array([x["length"] for x in f], dtype="i8"))] for f in found])

    merged = stored(packed.select("doc", union("found").alias("spans")).join(firsts, "doc").select("_id", "_h1", "_h2", "doc", "spans"))
    size = merged.agg(F.sum(64 + 16 * F.size("spans"))).first()[0] or 0

    changed = stored(_texts(docs, merged, size, 1).select("doc", "text", "spans").mapInPandas(_kept_rows, KEPT).dropDuplicates(["doc"]))
    first = F.col("_place") == F.col("_first")
    named = rows.join(firsts.select("_h1", "_h2", "doc", F.col("_place").alias("_first")), ["_h1", "_h2"]).join(changed, "doc", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = F.when(first, F.coalesce("spans", F.array_except(whole, whole))).when(F.col("n_bytes") >= LEAST, whole).otherwise(F.array_except(whole, whole))
    digest = F.when(first, F.coalesce("digest", "_sha")).when(F.col("n_bytes") >= LEAST, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("_sha"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return named.select("doc_id", "n_bytes", gone.alias("spans"), digest.alias("kept_sha256")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


KEPT = "doc long, spans array<struct<start:long,end:long>>, digest string"


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its spans (ascending, apart)."""
    edges = [0, *(edge for span in spans for edge in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = set()
    for batch in batches:
        rows = [(row.doc, row.spans, hashlib.sha256(kept_bytes(data, [(x["start"], x["end"]) for x in row.spans])).hexdigest()) for data, row in _once(batch, seen)]
        yield pd.DataFrame(rows, columns=["doc", "spans", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
