"""The Merkle manifest against a plain tree over lists."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        path.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at >>= 1
    return path


def plain_proofs(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    scopes = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        touched = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        other = plain_leaf(doc_id, source, lang, n_chars + 1, text) if touched else leaf
        scopes.setdefault((lang is not None, (lang or "").encode()), []).append((doc_id is None, doc_id or 0, leaf, doc_id, other))
    trees = {s: plain_tree([m[2] for m in sorted(members, key=lambda m: m[:3])]) for s, members in scopes.items()}
    order = sorted(trees)
    top = plain_tree([trees[s][-1][0] for s in order])
    found = []
    for s in order:
        for at, (_, _, leaf, doc_id, other) in enumerate(sorted(scopes[s], key=lambda m: m[:3])):
            path = plain_path(trees[s], at) + plain_path(top, order.index(s))
            folded = other
            for odd, sibling in path:
                folded = digest(sibling + folded if odd else folded + sibling)
            found.append((doc_id, leaf, trees[s][-1][0], top[-1][0], digest("".join(x for _, x in path)), folded, folded == top[-1][0]))
    return sorted(map(str, found))


def as_rows(df):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 8, 11])
def test_places_are_a_van_emde_boas_order(levels):
    """Every place once, and every subtree below a cut lies together."""

    def places(depth, index, height):
        if height == 1:
            return [(depth, index)]
        above = height // 2
        found = places(depth, index, above)
        for k in range(1 << above):
            found += places(depth + above, (index << above) + k, height - above)
        return found

    order = merkle.Layout(levels)
    want = {node: at for at, node in enumerate(places(0, 0, levels))}
    got = {(d, i): int(order.place(d, np.array([i]))[0]) for d in range(levels) for i in range(1 << d)}
    assert got == want


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13, 16])
def test_block_paths(count):
    leaves = [digest(str(k)) for k in range(count)]
    levels = plain_tree(leaves)
    height = merkle.height_of(count)
    nodes = merkle.build_block([bytes.fromhex(x) for x in leaves], height)
    assert nodes[:32].hex() == levels[-1][0]
    for at, path in enumerate(merkle.block_paths(nodes, count, height)):
        assert [("", "") if p == "-" else (int(p[0] == "L"), p[1:]) for p in path] == [(o, x) if x else ("", "") for o, x in plain_path(levels, at)]
        assert merkle.fold(leaves[at], path) == levels[-1][0]


def test_hard_rows(hard, hard_rows):
    assert as_rows(merkle.merkle_proofs(hard)) == plain_proofs([r[:5] for r in hard_rows])


def test_several_levels(spark):
    """Many languages and several levels of blocks, with small blocks."""
    rng = random.Random(4)
    rows = [(rng.randrange(400), f"text {k % 90}", rng.choice([None, "de", "", *map(str, range(9))]) if k % 3 else "en", "s", k % 50) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    levels, tops = merkle.manifest(docs, height=2)
    assert len(levels) == 4 and len(tops) == 2
    assert as_rows(merkle.merkle_proofs(docs, height=2)) == plain_proofs(rows)


def test_proofs_equal_sql(hard, duck, same):
    named = hard.select("doc_id", "text", "lang", "source", "n_chars")
    same([r.asDict() for r in merkle.merkle_proofs(named).collect()], duck(merkle.PROOFS_SQL, documents=named))


def test_empty(empty):
    assert merkle.merkle_proofs(empty).collect() == []
