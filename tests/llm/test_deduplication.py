"""SimHash components, fingerprints and line dedup against plain versions."""

import hashlib

import xxhash

from plumbline.llm import fingerprints, line_dedup, simhash

MASK = (1 << 64) - 1


def plain_print(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(table)).split(" ") if w]
    pieces = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Union by comparing every pair of fingerprints."""
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(plain_print(text), []).append(simhash.LAST_ID if doc_id is None else doc_id)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    listed = list(prints)
    for a in listed:
        for b in listed:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for p, ids in prints.items():
        least[root(p)] = min([*ids, least.get(root(p), simhash.LAST_ID)])
    return {p: least[root(p)] for p in prints}


def test_components(hard, hard_rows):
    want = plain_components([(r[0], r[1]) for r in hard_rows])
    got = simhash.component_rows(hard).collect()
    assert len(got) == len(hard_rows)
    expected = sorted((str(r[0]), f"{plain_print(r[1]):016x}", str(None if want[plain_print(r[1])] == simhash.LAST_ID else want[plain_print(r[1])])) for r in hard_rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected


def test_links_at_every_distance(spark):
    """All changes of up to three bits are found, and none of four that a chain can't reach."""
    base = 0x0123456789ABCDEF
    changes = [0, 1, 1 << 63, 3, 7, 1 << 16 | 1 << 32 | 1 << 48, 1 | 1 << 17 | 1 << 40, 0xF, 1 << 8 | 1 << 24 | 1 << 44 | 1 << 60]
    values = [(base ^ c) & MASK for c in changes]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "node long, print long")
    got = {(r["u"], r["v"]) for r in simhash.near_links(prints).collect()}
    assert got == {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 3}


def test_exploded_rings_are_never_broadcast(spark):
    """A stored table counts as its files, not as the rows a node becomes; links are the same from files."""
    from plumbline.llm.store import stored

    base, turned = 0x0123456789ABCDEF, 0x0F1E2D3C4B5A6978
    rows = [(0, base), (1, base ^ 5), (2, turned), (3, turned ^ (1 << 40)), (4, base ^ turned)]
    prints = stored(spark.createDataFrame(rows, "node long, print long"))
    for shape in ((), (5, 8, 8)):
        links = simhash.near_links(prints, *shape)
        assert {(r["u"], r["v"]) for r in links.collect()} == {(0, 1), (2, 3)}
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain_is_one_component(spark):
    """Components follow links over many steps."""
    from plumbline.llm.components import smallest_reachable

    size = 200
    order = [(k * 77) % size for k in range(size)]
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "u long, v long")
    labels = smallest_reachable(links).collect()
    assert len(labels) == size and {r["label"] for r in labels} == {0}


def test_keeps_one_of_each(hard, hard_rows):
    kept = simhash.keep_one_of_each(hard)
    assert kept.columns == hard.columns
    ids = [simhash.LAST_ID if r["doc_id"] is None else r["doc_id"] for r in kept.collect()]
    want = set(plain_components([(r[0], r[1]) for r in hard_rows]).values())
    assert len(ids) == len(set(ids)) and set(ids) == want


def plain_jaccard(a, b):
    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(hard, hard_rows):
    got = fingerprints.fingerprint_documents(hard).collect()
    assert len(got) == len(hard_rows)
    last = simhash.LAST_ID
    once = [r for r in hard_rows if sum(q[0] == r[0] for q in hard_rows) == 1]
    ids = sorted({last if r[0] is None else r[0] for r in hard_rows})
    texts = {r[0]: r[1] or "" for r in once}
    by_id = {r["doc_id"]: r for r in got}
    errors, checked = [], 0
    for doc_id, text in texts.items():
        after = ids[(ids.index(doc_id) + 1) % len(ids)]
        if after not in texts:
            continue
        n = len(text)
        edited = text[: n - n // 4] + texts[after][: n // 4]
        row = by_id[doc_id]
        assert row["n_chars"] == n and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(row["near_edited"] - plain_jaccard(text, edited))
        if text == texts[after]:
            assert row["near_next"] == 1.0 and row["fingerprint"] == by_id[after]["fingerprint"]
        assert 0 <= row["near_next"] <= 1
        checked += 1
    assert checked > 50
    assert sum(abs(e) for e in errors) / len(errors) < 0.08 and abs(sum(errors) / len(errors)) < 0.03
    prints = {}
    for r in got:
        if r["doc_id"] in texts:
            prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert prints[""] == {""}


def test_a_single_document_is_its_own_next(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    row = fingerprints.fingerprint_documents(one).collect()[0]
    assert row["near_next"] == 1.0 and row["n_chars"] == 15


def test_lines_equal_sql(hard, duck, same):
    from pyspark.sql import functions as F

    unique = hard.filter(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(3, 4)).select("doc_id", "text")
    got = line_dedup.line_digests(unique).collect()
    assert sum(r["n_dropped"] for r in got) > 0
    same(got, duck(line_dedup.LINES_SQL, documents=unique))
    assert line_dedup.line_digests(hard).count() == hard.count()


def test_empty_tables(empty):
    assert simhash.component_rows(empty).count() == 0
    assert simhash.keep_one_of_each(empty).columns == empty.columns
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert line_dedup.line_digests(empty).count() == 0
