import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as gr
from plumbline.operators import metric, near


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.fixture(scope="module")
def hashes(spark):
    """Clusters of close hashes, a hot hash and values that use bit 63."""
    rng = np.random.default_rng(6)
    values = []
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(6):
            v = centre
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values += [values[0]] * 40
    rows = [(f"v{i:03d}", signed(v)) for i, v in enumerate(values)]
    return values, spark.createDataFrame(rows, "id string, h long")


def brute(values, limit):
    out = {}
    for i, j in itertools.combinations(range(len(values)), 2):
        d = (values[i] ^ values[j]).bit_count()
        if d <= limit:
            out[(f"v{i:03d}", f"v{j:03d}")] = d
    return out


@pytest.mark.parametrize("hot", [0, 3, 10**6])
@pytest.mark.parametrize("limit", [0, 1, 4])
def test_pairs_equal_brute_force(hashes, hot, limit):
    values, df = hashes
    want = brute(values, limit)
    found = near.hamming_pairs(df, "id", F.col("h"), limit, hot_bucket=hot)
    rows = found.collect()
    assert len(rows) == len({(r.id_a, r.id_b) for r in rows})
    assert all(want[(r.id_a, r.id_b)] == r.distance for r in rows)
    cross = near.expand_pairs(found, df, "id", F.col("h")).collect()
    listed = {tuple(sorted((r.unit_a, r.unit_b))): r.distance for r in cross}
    assert listed == {p: d for p, d in want.items() if d > 0}
    members = {}
    for i, v in enumerate(values):
        members.setdefault(v, []).append(i)
    assert sum(r.distance == 0 for r in rows) == sum(len(m) - 1 for m in members.values())
    assert sum(r.pairs for r in rows if r.distance > 0) == len(listed)


@pytest.mark.parametrize("k", [1, 7, 60])
def test_topk_equals_brute_force(hashes, k):
    values, df = hashes
    left, right = df.filter("id < 'v030'"), df.filter("id >= 'v030'")
    want = sorted(
        ((values[i] ^ values[j]).bit_count(), f"v{i:03d}", f"v{j:03d}") for i in range(30) for j in range(30, len(values))
    )[:k]
    got = near.hamming_topk(left, right, "id", F.col("h"), k).collect()
    assert sorted((r.distance, r.id_a, r.id_b) for r in got) == want


def test_topk_of_fewer_pairs_returns_them_all(spark):
    df = spark.createDataFrame([("a", 0), ("b", -1), ("c", 5), ("d", 5)], "id string, h long")
    got = near.hamming_topk(df.filter("id < 'c'"), df.filter("id >= 'c'"), "id", F.col("h"), 10).collect()
    assert sorted((r.id_a, r.id_b, r.distance) for r in got) == [("a", "c", 2), ("a", "d", 2), ("b", "c", 62), ("b", "d", 62)]


@pytest.mark.parametrize(("leaf", "sample", "hot"), [(64, 16_384, 2_048), (2, 16_384, 2_048), (4, 20, 6)])
def test_knn_equals_brute_force(spark, leaf, sample, hot):
    """Exact copies (a third of all rows), a dense cluster and scattered vectors; also with small leaves that are split again."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    vectors = [rng.normal(size=16) for _ in range(30)]
    vectors += [centre + rng.normal(scale=0.02, size=16) for _ in range(25)]
    vectors += [centre] * 30
    x = np.array(vectors)
    x = np.round(x, 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"n{i:03d}" for i in range(len(x))]
    sims = np.round(u @ u.T, 12)
    same = (x[:, None, :] == x[None, :, :]).all(axis=2)
    sims[same] = 1.0
    want = {}
    for i in range(len(x)):
        order = sorted((-sims[i, j], ids[j]) for j in range(len(x)) if j != i and sims[i, j] >= 0.97)[:4]
        want[ids[i]] = [(n, round(-s, 9)) for s, n in order]
    df = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in zip(ids, x)], "id string, e array<double>")
    got = {}
    for r in near.knn_cosine(df, "id", "e", 16, 4, 0.97, leaf, sample, hot).collect():
        got.setdefault(r.unit, []).append((-r.cosine, r.neighbour))
    for name, pairs in want.items():
        mine = [(n, round(-s, 9)) for s, n in sorted(got.get(name, []))]
        assert [round(s, 6) for _, s in mine] == [round(s, 6) for _, s in pairs]
        assert mine and {n for n, _ in mine} == {n for n, _ in pairs} or mine == [] == pairs


def test_components_chain_star_and_loner(spark):
    chain = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(40)]
    star = [("hub", f"s{i:03d}") for i in range(200)]
    names = {n for e in chain + star for n in e} | {"alone"}
    vertices = spark.createDataFrame([(n,) for n in sorted(names)], "id string")
    edges = spark.createDataFrame(chain + star + [("a00", "a00")], "u string, v string")
    got = {r.id: r.component for r in gr.connected_components(vertices, edges, "id", "u", "v").collect()}
    assert got["alone"] == "alone"
    assert {got[f"a{i:02d}"] for i in range(41)} == {"a00"}
    assert {got[n] for n in names if n[0] in "hs"} == {"hub"}


def test_scene_source_labels(spark):
    manifest = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "sample_id string, sha string")
    reviews = spark.createDataFrame([("b", "c", "same_scene"), ("c", "d", "different_scene")], "sample_id_a string, sample_id_b string, review_decision string")
    got = {r.sample_id: (r.scene_group_id, r.scene_group_source) for r in gr.scene_groups(manifest, reviews).collect()}
    assert got["a"] == ("scene:a", "exact_sha")
    assert got["c"] == ("scene:a", "exact_sha_plus_reviewed_near_duplicate")
    assert got["d"] == ("scene:d", "exact_sha")


def test_candidates_across_partitions_are_complete(spark):
    """A test copy behind another unit's hash is not lost."""
    from plumbline.operators.review import hash_candidates

    rows = [("a1", "train_val", "s1", 0b11), ("b1", "train_val", "s2", 0), ("b2", "test", "s3", 0), ("b3", "test", "s2", 0), ("c1", "test", "s1", 1 << 40 | 0xFF << 8)]
    df = spark.createDataFrame(rows, "id string, part string, sha string, h long")
    got = {tuple(r) for r in hash_candidates(df, "id", F.col("h"), 4).collect()}
    assert got == {("a1", "b1"), ("a1", "b2"), ("b1", "b2"), ("b2", "b3")}


def test_candidates_skip_equal_content_only(spark):
    """Where the first units of two sets are copies, the first different pair stands for them."""
    from plumbline.operators.review import hash_candidates

    rows = [("a", "train_val", "s1", 0), ("b", "test", "s1", 1), ("c", "test", "s1", 1), ("d", "test", "s2", 1)]
    df = spark.createDataFrame(rows, "id string, part string, sha string, h long")
    assert {tuple(r) for r in hash_candidates(df, "id", F.col("h"), 4).collect()} == {("a", "d"), ("b", "d")}


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0] * 8), (2, [1.0] + [0.0] * 7), (3, [1.0] + [0.0] * 7)], "id long, v array<double>")
    got = {tuple(r)[:2] for r in near.knn_cosine(df, "id", "v", 8, 2, 0.99).collect()}
    assert got == {(2, 3), (3, 2)}


def scattered(rng, count, dims):
    """Random directions, a tenth of them with a copy nearby."""
    x = rng.normal(size=(count, dims))
    x[: count // 10] = x[count // 10 : 2 * (count // 10)] + rng.normal(scale=0.02, size=(count // 10, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_tree_search_misses_nothing():
    """Every leaf that holds a point within reach is entered, at any depth and after splits."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(700, 4)), np.zeros((40, 4)), rng.normal(scale=0.01, size=(60, 4))])
    tree = metric.Tree(points[::3], 20)
    homes = tree.visit(points, None)[1][np.argsort(tree.visit(points, None)[0])]
    for leaf in [int(x) for x in np.unique(homes)][:5]:
        tree.split(leaf, points[homes == leaf], 5)
    rows, leaves = tree.visit(points, None)
    home = dict(zip(rows.tolist(), leaves.tolist()))
    assert len(rows) == len(points)
    reach = rng.uniform(0, 0.6, len(points))
    entered = set(zip(*(x.tolist() for x in tree.visit(points, reach))))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i, j in zip(*np.nonzero(apart <= reach[:, None])):
        assert (i, home[j]) in entered


def test_compared_pairs_stay_flat(spark):
    """Pairs of whole vectors compared per vector do not grow from 2,000 to 32,000 vectors, and none is lost."""
    shares = []
    for count in (2_000, 32_000):
        x = scattered(np.random.default_rng(count), count, 64)
        base = spark.createDataFrame(pd.DataFrame({"node": range(count), "e": x.tolist(), "n": 1}), "node long, e array<double>, n long").repartition(8).cache()
        forest = metric.fit_forest(base.select("node", "e"), 64)
        pairs = metric.close_pairs(metric.local_radius(base, forest, 64, 6, 0.1), forest, 64).toPandas()
        shares.append(len(pairs) / count)
        found = set(zip(pairs["va"], pairs["vb"]))
        for i in range(0, count // 10, 7):
            j = i + count // 10
            if ((x[i] - x[j]) ** 2).sum() <= 0.01:
                assert (i, j) in found and (j, i) in found
        base.unpersist()
    assert max(shares) < 1 and shares[1] < 2 * shares[0] + 0.05


@pytest.mark.parametrize(("k", "count"), [(1, 300), (25, 300), (40, 2_000)])
def test_closest_of_scattered_hashes(k, count):
    """Hashes without near pairs: the best-first search agrees with all distances, ties by name."""
    rng = np.random.default_rng(k)
    a, b = (rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, count, dtype=np.uint64) for _ in range(2))
    names = rng.permutation(count), rng.permutation(count)
    distance = np.bitwise_count(a[:, None] ^ b[None]).astype(int)
    want = sorted((int(distance[i, j]), int(names[0][i]), int(names[1][j])) for i, j in zip(*np.nonzero(distance <= np.partition(distance.ravel(), k)[k])))[:k]
    assert [(d, int(names[0][i]), int(names[1][j])) for d, i, j in near._closest(a, b, *names, k, 64)] == want


def test_topk_over_several_blocks(spark, monkeypatch):
    """Blocks of 50 hashes against each other; few rows come back from each two."""
    monkeypatch.setattr(near, "SEARCHED", 50)
    rng = np.random.default_rng(4)
    values = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 400)]
    df = spark.createDataFrame([(f"v{i:03d}", v) for i, v in enumerate(values)], "id string, h long")
    want = sorted(((values[i] ^ values[j]) % (1 << 64)).bit_count() * 10**8 + i * 10**4 + j for i in range(200) for j in range(200, 400))[:30]
    got = near.hamming_topk(df.filter("id < 'v200'"), df.filter("id >= 'v200'"), "id", F.col("h"), 30).collect()
    assert [r.distance * 10**8 + int(r.id_a[1:]) * 10**4 + int(r.id_b[1:]) for r in got] == want


def test_topk_of_an_empty_side(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, h long")
    assert near.hamming_topk(df, df.limit(0), "id", F.col("h"), 5).collect() == []


def test_compare_splits(spark, hashes):
    values, df = hashes
    dealt = df.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "val", "calibration", "test"))), F.substring("id", 2, 3).cast("int") % 4 + 1))
    got = near.compare_splits(dealt, "split", "id", F.col("h"), 6).collect()
    for one, other in near.COMPARISONS:
        left, right = (("train", "val", "calibration", "test").index(x) for x in (one, other))
        want = sorted(((values[i] ^ values[j]).bit_count(), f"v{i:03d}", f"v{j:03d}") for i in range(left, len(values), 4) for j in range(right, len(values), 4))[:6]
        assert sorted((r.distance, r.id_a, r.id_b) for r in got if r.comparison == f"{one}_vs_{other}") == want


def test_compared_hashes_stay_flat(spark):
    """Hashes whose upper eight bits are all zero, as in V5: hashes met per hash do not grow with their number."""
    met = []
    for count in (16_000, 64_000):
        rng = np.random.default_rng(count)
        values = np.unique(rng.integers(0, 1 << 56, count))
        df = spark.createDataFrame(pd.DataFrame({"h": values}))
        keyed = near._keyed(df, 4, near._hot_buckets(df, 4, near.HOT_BUCKET))
        sizes = keyed.groupBy("band", "value", "sub", "sub_value").count()
        met.append(sizes.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / len(values))
    assert met[1] < 2 * met[0] + 50
