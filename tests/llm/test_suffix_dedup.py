"""Repeated passages against all strings of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_dedup as sd
from plumbline.llm.text import LAST_ID, text_key


def prose(rng, words):
    return " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(words))


def plain(texts):
    """Texts in order: bytes, removed, spans, digest of what is left."""
    seen, found = set(), []
    for text in texts:
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, dtype=bool)
        for at in range(len(data) - sd.LEAST + 1):
            piece = data[at : at + sd.LEAST]
            if piece in seen:
                covered[at : at + sd.LEAST] = True
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        found.append((len(data), int(covered.sum()), int((covered[1:] > covered[:-1]).sum() + covered[0]), hashlib.sha256(kept).hexdigest()))
    return found


def as_rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def expected(docs):
    rows = docs.select("doc_id", "text", *text_key(docs["text"])).collect()
    rows.sort(key=lambda r: (LAST_ID if r.doc_id is None else r.doc_id, r._h1, r._h2))
    return sorted((str(r.doc_id), *x) for r, x in zip(rows, plain([r.text for r in rows])))


def made(seed, count):
    """Passages in strange surroundings, near copies, repeats inside a text and periodic texts."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 70)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(count)]
    texts += [prose(rng, rng.randint(0, 12)) + passage[rng.randint(0, 90) : rng.randint(200, 330)] + prose(rng, 9) for _ in range(count)]
    for _ in range(count // 2):
        words = base.split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [base + passage + base, "ab" * 400, "a" * 900, "x" + "ab" * 230, "é" * 120 + passage, passage.upper(), "a" * 99, "a" * 100]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_deal_every_string_once(seed):
    for text in made(seed, 12):
        data = text.encode()
        anchors, starts, lengths, _ = sd.runs(data)
        strings = [(p, data[p : p + sd.LEAST], int(a)) for a, s, n in zip(anchors, starts, lengths) for p in range(s, s + n - sd.LEAST + 1)]
        assert [p for p, _, _ in strings] == list(range(max(0, len(data) - sd.LEAST + 1)))
        assert all(int(sd.piece_hashes(x, sd.PIECE).min()) == a for _, x, a in strings)


def test_suffix_order_and_prefixes():
    texts = [b"banana", b"ananas", b"", b"anan", b"\x00\xff\x00", bytes(range(200)), b"ab" * 60]
    starts, ends, levels = sd.prefix_ranks(texts)
    places = np.concatenate([np.arange(s, s + len(t)) for s, t in zip(starts, texts)])
    suffix = {int(s + k): t[k:] for s, t in zip(starts, texts) for k in range(len(t))}
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    assert [suffix[int(p)] for p in order] == sorted(suffix.values())
    for a, b, n in zip(order[:-1], order[1:], sd.common_prefixes(order[:-1], order[1:], ends, levels)):
        x, y = suffix[int(a)], suffix[int(b)]
        assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1] or n == min(len(x), len(y))


def test_maximal_repeats():
    """Groups of the interval tree are the repeats that can't be extended, with all their places."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)), b"abab" * 8]
    starts, ends, levels = sd.prefix_ranks(texts)
    places = np.concatenate([np.arange(s, s + len(t)) for s, t in zip(starts, texts)])
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    before = np.full(len(ends), -1, dtype=np.int16)
    for s, t in zip(starts, texts):
        before[s + 1 : s + len(t)] = list(t[:-1])
    prefixes = np.append(0, sd.common_prefixes(order[:-1], order[1:], ends, levels))
    groups, _, _ = sd.repeat_groups(order, prefixes, np.arange(len(ends)), before, least=5)
    got = {(n, frozenset(order[a : b + 1].tolist())) for n, a, b in groups}
    want, whole = set(), {int(s): t for s, t in zip(starts, texts)}
    where = {}
    for s, t in whole.items():
        for k in range(len(t)):
            for n in range(5, len(t) - k + 1):
                where.setdefault(t[k : k + n], []).append((s + k, t[k - 1 : k] if k else None, t[k + n : k + n + 1] or None))
    for piece, found in where.items():
        left, right = {x for _, x, _ in found}, {x for _, _, x in found}
        if len(found) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
            want.add((len(piece), frozenset(p for p, _, _ in found)))
    assert got == want


@pytest.mark.parametrize("chunk_bytes", [sd.CHUNK_BYTES, 900])
def test_passages(spark, chunk_bytes):
    """The second size deals frequent anchors in chunks."""
    docs = spark.createDataFrame(list(enumerate(made(4, 40))), "doc_id long, text string").repartition(6)
    assert as_rows(sd.remove_repeats(docs, chunk_bytes)) == expected(docs)


def test_cut_runs(spark, monkeypatch):
    monkeypatch.setattr(sd, "RUN_STRINGS", 50)
    assert max(sd.runs(b"a" * 2_000)[2]) == 50 + sd.LEAST - 1


def test_hard_rows(hard):
    assert as_rows(sd.digests(hard)) == expected(hard)


def test_spans_are_what_is_removed(hard):
    for r in sd.remove_repeats(hard).join(hard.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").filter("doc_id > 100").collect():
        kept = sd.kept_bytes((r.text or "").encode(), [(s.start, s.end) for s in r.spans])
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256


def test_empty(empty):
    assert sd.digests(empty).collect() == []
