"""Hard negatives against all inner products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, score long, q long, piece string"


def plain(rows, every, k=5, positives=5):
    """rows: vec_id, label, whole components."""
    dims = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, [*v, *[0] * (dims - len(v))]) for i, label, v in rows]
    found = []
    for anchor, label, v in rows:
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, kind == label) for i, kind, w in rows if i != anchor)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            found += [(anchor, i, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(fit)]
    return sorted(found)


def as_rows(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(seed, count, dims, labels=4):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(labels), [rng.randint(-9, 30) for _ in range(dims)]) for k in range(count)]
    third = rows[7][2]
    return [(i, label, third if i % 3 == 0 else v) for i, label, v in rows]


@pytest.mark.parametrize("same", [True, False])
def test_search_is_exact(same):
    """Windows, ties and pruning of one tree against a scan of it."""
    rows = made(5, 900, 6)
    vectors, labels, ids = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    order, starts = h._str_order(vectors, labels)
    assert sorted(order.tolist()) == list(range(900))
    tree = h.Tree(ids[order], labels[order], vectors[order], starts)
    for own, label, v in rows[::90]:
        scores = sorted((-int(np.dot(v, w)), i) for i, kind, w in rows if i != own and (kind == label) == same)
        top = -scores[0][0]
        windows = [(0, top), (top // 2, top - 5), (-(10**6), 0), (top + 1, top), h._window(top)]
        want = [[(-s, i) for s, i in scores if a <= -s <= b][:5] for a, b in windows]
        assert h.search(tree, np.array(v), windows, 5, label, same, own) == want


def test_large_components_are_exact():
    """Scores beyond the floating-point range are counted as whole numbers."""
    rows = [(k, k % 2, [(1 << 40) + k, -(1 << 41) + 3 * k]) for k in range(300)]
    vectors, labels, ids = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    order, starts = h._str_order(vectors, labels)
    tree = h.Tree(ids[order], labels[order], vectors[order], starts)
    want = sorted((-sum(a * b for a, b in zip(rows[4][2], w)), i) for i, kind, w in rows if i != 4 and kind == 0)[:5]
    assert h.search(tree, np.array(rows[4][2]), [h.ALL], 5, 0, True, 4) == [[(-s, i) for s, i in want]]


def test_many_trees_and_a_hot_vector(spark):
    rows = made(6, 1_500, 5)
    table = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>").repartition(3)
    assert h.build_trees(table, 5, 200).count() > 7
    assert as_rows(h.hard_negatives(table, F.col("vec_id") % 50 == 0, tree_values=1_000)) == plain(rows, 50)


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_VALUES", 40)
    rows = made(7, 300, 4)
    table = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    assert as_rows(h.hard_negatives(table, F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_hard_rows(spark, duck):
    """Missing and non-finite values, short and empty vectors, ties, negative scores, repeated rows and clashing names."""
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-0.1, 0.4) for _ in range(3)], k % 3) for k in range(260)]
    rows += [(k, rows[20][1], 1) for k in range(300, 320)] + [(400, [], 0), (500, [0.5], 1), (600, [-1.0, -1.0, -1.0], 2), (20, rows[20][1], 2), (20, [0.1, 0.2, 0.3], 2), (100, rows[100][1], rows[100][2])]
    bad = [(None, [0.1, 0.1, 0.1], 1), (700, None, 1), (701, [0.1, None, 0.1], 1), (702, [0.1, float("nan"), 0.1], 1), (703, [float("inf"), 0.1, 0.1], 1), (704, [0.1, 0.1, 0.1], None)]
    table = spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows + bad], SCHEMA)
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows]
    got = as_rows(h.mine(table))
    assert got and got == plain(whole, 100)


def test_empty(spark):
    assert h.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    lonely = spark.createDataFrame([(0, [0.1], 1, 1, 1, "x"), (1, [0.2], 2, 1, 1, "x")], SCHEMA)
    assert h.mine(lonely).collect() == []
