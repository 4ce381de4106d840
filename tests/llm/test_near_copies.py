"""The pipeline's near copies against brute force over all pairs of texts."""

import random

import pytest

from plumbline.llm import near_copies


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(sets):
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    listed = list(parent)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if alike(a, b):
                parent[root(a)] = root(b)
    return {s: root(s) for s in listed}


def edited(rng, words, edits):
    """One-word edits spread over the text."""
    words = list(words)
    for k in range(edits):
        words[(2 * k + 1) * len(words) // (2 * edits)] = f"w{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """Texts of 200 words with up to five one-word edits, and a chain of 60 whose ends differ."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
        rows += [(100 * k + edits, edited(rng, words, edits) if edits else " ".join(words)) for edits in range(6)]
    words = [f"c{rng.randint(0, 5000)}" for _ in range(200)]
    for k in range(60):
        words[3 * k] = f"x{k}"
        rows.append((90_000 + k, " ".join(words)))
    return rows


def test_equals_brute_force(spark, near_rows):
    groups = plain_groups([plain_set(t) for _, t in near_rows])
    least = {}
    for i, t in near_rows:
        g = groups[plain_set(t)]
        least[g] = min(i, least.get(g, i))
    kept = near_copies.keep_one_of_each(spark.createDataFrame(near_rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())
    assert len(kept) < 0.5 * len(near_rows)


def test_all_turns_and_none_agree(spark, near_rows, monkeypatch):
    """Comparing all members of each bucket at once finds the same components."""
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    by_turns = sorted(map(tuple, near_copies.near_copies(docs).collect()))
    monkeypatch.setattr(near_copies, "TURNS", 0)
    assert sorted(map(tuple, near_copies.near_copies(docs).collect())) == by_turns


def test_only_linked_rows_go(spark, hard, hard_rows):
    """Missing and repeated ids link nothing: of each group of alike texts one row stays, the same in every run."""
    groups = plain_groups([plain_set(r[1]) for r in hard_rows])
    kept = near_copies.keep_one_of_each(hard)
    assert kept.columns == hard.columns
    found = kept.collect()
    assert sorted(map(hash, (groups[plain_set(r["text"])] for r in found))) == sorted(map(hash, set(groups.values())))
    assert sum(r["doc_id"] == 4 for r in found) == 2
    nameless = spark.createDataFrame([(None, f"text number {k} of nobody at all {k * 7}") for k in range(50)], "doc_id long, text string")
    assert near_copies.keep_one_of_each(nameless).count() == 50
    again = near_copies.keep_one_of_each(hard.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty_table(empty):
    assert near_copies.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_of_alike_sets_meet(seed):
    """In any order of rarity, and the bound at the first meeting place holds."""
    rng = random.Random(seed)
    rarity = near_copies.np.array([rng.randrange(9) for _ in range(near_copies.CELLS)])
    for _ in range(300):
        whole = [rng.getrandbits(64) for _ in range(rng.randint(1, 60))]
        a = near_copies.np.unique(near_copies.np.array([*whole, *(rng.getrandbits(64) for _ in range(rng.randint(0, 9)))], dtype="u8"))
        b = near_copies.np.unique(near_copies.np.array([*whole, *(rng.getrandbits(64) for _ in range(rng.randint(0, 9)))], dtype="u8"))
        x, y = (near_copies.prefix(s, rarity).tolist() for s in (a, b))
        if alike(frozenset(a.tolist()), frozenset(b.tolist())):
            first = next(v for v in x if v in y)
            follow = min(len(a) - x.index(first), len(b) - y.index(first))
            assert 9 * follow >= 4 * (len(a) + len(b))


def test_families_below_the_threshold_meet_nowhere(spark):
    """Pairs to compare grow with the texts, not with their square: nine edits each from one base, no links."""
    rng = random.Random(9)
    words = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
    for count in (300, 900):
        rows = []
        for k in range(count):
            text = list(words)
            for at in rng.sample(range(200), 9):
                text[at] = f"e{k}x{at}"
            rows.append((k, " ".join(text)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = near_copies.stored(near_copies._nodes(docs))
        rarity = near_copies._rarity(found)
        nodes = docs.withColumn("node", near_copies.F.col("doc_id"))
        met = near_copies._meeting_rows(nodes, rarity).withColumn("label", near_copies.F.col("node"))
        assert near_copies._all_pairs(met).count() <= 3 * count


def test_spent_tables_go(spark, near_rows, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(near_copies, "discard", lambda *tables: kept.extend(t for t in tables if t is not None))
    near_copies.near_copies(spark.createDataFrame(near_rows[:60], "doc_id long, text string"))
    assert len(kept) >= 8
    from plumbline.llm.store import discard

    discard(*kept)
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        kept[0].count()


def test_ring_finds_what_differs_in_few_bits(spark):
    """The stage's own distance and segments, by brute force over fingerprints; equal ones are a star."""
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        prints += [base, *(base ^ sum(1 << b for b in rng.sample(range(64), bits)) for bits in range(8))]
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "node long, print long")
    got = {tuple(sorted(r)) for r in near_copies._ring_pairs(rows).collect()}
    near = {(i, j) for j, b in enumerate(prints) for i, a in enumerate(prints[:j]) if (a ^ b).bit_count() <= near_copies.DISTANCE}
    first = {v: i for i, v in reversed(list(enumerate(prints)))}
    equal = {(first[v], i) for i, v in enumerate(prints) if first[v] != i}
    assert got == {(i, j) for i, j in near if first[prints[i]] == i and first[prints[j]] == j} | equal


def test_fingerprints_propose_pairs_first(spark, near_rows, monkeypatch):
    """The stage's first comparison is that of near fingerprints, and it links most of the near texts by itself."""
    asked = []
    plain = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: asked.append(found := plain(pairs, sets)) or found)
    sizes = []
    monkeypatch.setattr(near_copies, "_ring_pairs", lambda prints, ring=near_copies._ring_pairs: sizes.append(prints.count()) or ring(prints))
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "discard", lambda *tables: None)
    near_copies.near_copies(docs)
    assert sizes == [len({plain_set(t) for _, t in near_rows})]
    assert asked[0].count() >= 40


def test_rows_equal_in_all_columns(spark, near_rows):
    docs = spark.createDataFrame([r for r in near_rows[:30] for _ in range(3)], "doc_id long, text string")
    once = spark.createDataFrame(near_rows[:30], "doc_id long, text string")
    assert sorted(map(tuple, near_copies.keep_one_of_each(docs).collect())) == sorted(map(tuple, near_copies.keep_one_of_each(once).collect()))


def test_ring_pairs_grow_with_the_family(spark):
    """Any two of a family are at most four bits apart; its pairs grow with its fingerprints, not with their square."""
    rng = random.Random(11)
    base = rng.getrandbits(62)
    flips = rng.sample([1 << a | 1 << b for a in range(16) for b in range(a)], 120)
    counts = []
    for size in (30, 120):
        rows = spark.createDataFrame([(rng.getrandbits(62), base ^ f) for f in flips[:size]], "node long, print long")
        counts.append(near_copies._ring_pairs(rows).count())
    assert counts[1] <= 6 * counts[0]


def test_links_of_a_family_grow_with_its_texts(spark, monkeypatch):
    """One component of texts that are all alike takes links in proportion to them, in every turn."""
    rng = random.Random(12)
    words = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    rows = []
    for k in range(300):
        text = list(words)
        text[rng.randrange(400)] = f"e{k}"
        rows.append((k, " ".join(text)))
    asked = []
    monkeypatch.setattr(near_copies, "smallest_reachable", lambda links, plain=near_copies.smallest_reachable: asked.append(links.count()) or plain(links))
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert asked and max(asked) <= 2 * len(rows)


@pytest.mark.parametrize("met", [1, 1000])
def test_ring_keys_change_no_component(spark, near_rows, monkeypatch, met):
    """What lies beyond the first nodes of a key is found by the exact search."""
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    usual = sorted(map(tuple, near_copies.near_copies(docs).collect()))
    monkeypatch.setattr(near_copies, "MET", met)
    assert sorted(map(tuple, near_copies.near_copies(docs).collect())) == usual
