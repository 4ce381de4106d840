"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, on a bounded sample of labelled documents, how often a token occurs in
toxic and in clean ones (a document counts a token at most ``BURST`` times). A token's
probability of being toxic has a Dirichlet prior whose mean is that of its prefix (three
to eight characters, each with the shorter one as its prior and the base rate at the
root), so inflections that were never seen fall back on their stem. The score of a
token is the change in log-odds against the base rate, less a constant drift, so that
ordinary text loses and weak evidence still counts for what it is.

Every document is scanned once, in linear time, for all maximal-scoring segments.
Segment scores are brought to a common scale by extreme-value statistics: lambda
solves E[exp(lambda s)] = 1 over the tokens of clean documents and K is fitted to
their largest segments. The best sum statistic over the segments gives the
document's p-value: several passages of a word that clean texts use once weigh more than
their parts. Where no segment stands out, the reduced score of the best one, or of the best token,
orders the document below those. A logistic link, fitted on documents that the counts never
saw, turns this evidence into a probability.

Copies would count a passage many times: of sampled documents of one class that
share their least shingle hash only one is used.

Defined cases: null and empty texts have no segments; unlabelled rows are only
scored; rows without doc_id are scored and never learnt from; without both classes
the score is the base rate (0 without labels); repeated rows each get their score;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import stored

#: Documented bounds of the fit: labelled rows of each class, in expectation, and token and prefix counts kept.
PER_CLASS = 8_000
MOST_NODES = 200_000
#: Occurrences that a token or prefix must have.
LEAST_SEEN = 2
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Occurrences of a token or prefix that one document counts at most.
BURST = 5
#: Weight of the prior, in occurrences.
PRIOR = 8.0
DRIFT = 0.5
MOST_SCORE = 8.0
MOST_EVIDENCE, LEAST_EVIDENCE = 200.0, -50.0
CUTOFF = 0.3
TOKEN = re.compile(r"\w+")


def nodes_of(token: str) -> list[str]:
    """The token and its prefixes; prefixes end in a star."""
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) >= n)]


class Prefixes(dict):
    """Score of a prefix that no known token completes, computed when first asked for."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, prefix: str) -> float:
        if len(self) > 500_000:
            self.clear()
        found = self[prefix] = self.model.score_from(self.model.prefix_mean(prefix))
        return found


@dataclass
class ToxicityModel:
    counts: dict[str, tuple[int, int]]  # node -> toxic, clean occurrences
    totals: tuple[int, int]  # of all tokens
    rate: float = 0.0  # toxic share of all labels
    scale: float = 1.0  # lambda
    search: float = 1.0  # K
    link: tuple[float, float] = (0.0, -20.0)
    known: dict[str, float] = field(default_factory=dict)  # scores of the counted tokens

    def __post_init__(self):
        for node, (toxic, clean) in self.counts.items():
            if not node.endswith("*"):
                mean = self.prefix_mean(node[: PREFIXES[-1]])
                self.known[node] = self.score_from((toxic + PRIOR * mean) / (toxic + clean + PRIOR))
        self.prefixes = Prefixes(self)

    def prefix_mean(self, prefix: str) -> float:
        """Probability of a prefix, each length with the shorter one as its prior."""
        mean = self.totals[0] / sum(self.totals)
        for n in PREFIXES:
            toxic, clean = self.counts.get(prefix[:n] + "*", (0, 0)) if len(prefix) >= n else (0, 0)
            mean = (toxic + PRIOR * mean) / (toxic + clean + PRIOR)
        return mean

    def score_from(self, mean: float) -> float:
        base, mean = (min(max(p, 1e-12), 1 - 1e-12) for p in (self.totals[0] / sum(self.totals), mean))
        change = math.log(mean / (1 - mean)) - math.log(base / (1 - base))
        return max(-MOST_SCORE, min(MOST_SCORE, change)) - DRIFT

    def scores(self, text: str | None) -> np.ndarray:
        get, rest, size, times = self.known.get, self.prefixes, PREFIXES[-1], Counter()
        found = []
        for token in map(str.lower, TOKEN.findall(text or "")):
            score = get(token)
            if score is None:
                score = rest[token[:size]]
            if score > 0:
                times[token] += 1
                score = score if times[token] <= BURST else -DRIFT
            found.append(score)
        return np.array(found, dtype=float)

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Negative log p-value of the whole text (below zero: how far its best segment or token falls short), and the segments by token that stand out of its length."""
        scores = self.scores(text)
        if not len(scores):
            return LEAST_EVIDENCE, []
        found = maximal_segments(scores)
        shift = math.log(max(1.0, self.search * len(scores)))
        ordered = sorted((s for *_, s in found), reverse=True) or [float(scores.max())]
        best, total = self.scale * ordered[0] - shift, 0.0
        for r, value in enumerate(ordered, 1):
            total += self.scale * value - shift
            if total <= 0:
                break
            # Karlin and Altschul's tail of the r best segments' sum, with a factor for choosing r; it holds
            # for sums that are large beside r, where it is below the sum itself
            tail = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
            best = max(best, min(tail, total - r * math.log(2)))
        return max(LEAST_EVIDENCE, min(best, MOST_EVIDENCE)), [(a, b, s) for a, b, s in found if self.scale * s > shift]

    def probability(self, evidence: float) -> float:
        slope, shift = self.link
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * reduced(evidence) + shift))))


def reduced(evidence: float) -> float:
    """Evidence on the link's scale: logarithmic on both sides of zero."""
    return math.copysign(math.log1p(abs(evidence)), evidence)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Runs of positive scores are taken left to right. A candidate keeps the
    nearest earlier one with a lower left sum, so each is passed over once.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)]) if len(scores) else np.zeros(1)
    kept: list[tuple[float, float, int, int, int]] = []  # left, right, start, end, earlier
    for at in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(sums[at]), float(sums[at + 1]), at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, start, at + 1, j))
                break
            left, start = kept[j][0], kept[j][2]
            del kept[j:]
    return [(start, end, right - left) for left, right, start, end, _ in kept]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sketch(text: str) -> int:
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[k : k + 5]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 4))), default=0)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "sketch": [_sketch(t) for t in batch["text"]]})


def _node_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of each token and prefix, bounded by document, summed over the task's batches."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"]):
            nodes = Counter()
            for token, times in Counter(map(str.lower, TOKEN.findall(text))).items():
                for node in nodes_of(token):
                    nodes[node] += times
            counts[toxic].update({node: min(times, BURST) for node, times in nodes.items()})
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield _counted(counts)
            counts = {0: Counter(), 1: Counter()}
    yield _counted(counts)


def _counted(counts: dict[int, Counter]) -> pd.DataFrame:
    names = list(counts[0].keys() | counts[1].keys())
    return pd.DataFrame({"node": names, "toxic": [counts[1][n] for n in names], "clean": [counts[0][n] for n in names]}).astype({"node": str, "toxic": "int64", "clean": "int64"})


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float]:
    """Sampled labelled documents (doc_id, toxic, text), one per copy group; toxic share of the learnable labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(stored(chosen)), "doc_id").select("doc_id", "toxic", "text")
    picked = sample.mapInPandas(_sketches, "doc_id long, toxic int, sketch long").groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id"))
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return texts.join(F.broadcast(stored(picked.select("doc_id", "toxic").distinct())), "doc_id").select("doc_id", "toxic", "text"), rate


def _judging() -> Column:
    """One sampled document in three judges the counts of the others."""
    return F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least weighted loss, with a light ridge on the slope."""
    design, at = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge @ at
        step = np.linalg.solve((design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge, gradient)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(at[0])), float(at[1])


def _root(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda with mean exp(lambda s) = 1; one unseen top score is added to the counts."""
    values, counts = np.append(values, MOST_SCORE), np.append(counts, 1.0)
    low, high = 1e-3, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if counts @ np.exp(middle * values) <= counts.sum() else (low, middle)
    return low


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    sample, rate = _sample(docs, labels, per_class)
    counted = sample.filter(~_judging()).select("toxic", "text").mapInPandas(_node_counts, "node string, toxic long, clean long")
    nodes = stored(counted.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    row = nodes.filter(~F.col("node").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    totals = row[0] or 0, row[1] or 0
    if not all(totals):
        flat = -20.0 if rate == 0 else math.log(min(rate, 1 - 1e-9) / max(1 - rate, 1e-9))
        return ToxicityModel({}, (1, 1), rate, link=(0.0, flat))
    base = totals[0] / sum(totals)
    seen = F.col("toxic") + F.col("clean")
    apart = F.abs(F.col("toxic") - base * seen) / F.sqrt(seen)
    top = nodes.filter(seen >= LEAST_SEEN).orderBy(apart.desc(), "node").limit(MOST_NODES).collect()
    model = ToxicityModel({r["node"]: (r["toxic"], r["clean"]) for r in top}, totals, rate)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean_statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"]):
                scores = shared.value.scores(text)
                values, counts = np.unique(np.round(scores, 1), return_counts=True)
                found = [s for *_, s in maximal_segments(scores)]
                rows.append((toxic, len(scores), max(found, default=0.0), values.tolist(), counts.tolist()))
            yield pd.DataFrame(rows, columns=["toxic", "tokens", "most", "values", "counts"])

    judged = sample.filter(_judging()).select("toxic", "text")
    clean = judged.filter("toxic = 0").mapInPandas(clean_statistics, "toxic int, tokens long, most double, values array<double>, counts array<long>")
    clean = stored(clean)
    spread = clean.select(F.explode(F.arrays_zip("values", "counts")).alias("v")).groupBy("v.values").agg(F.sum("v.counts").alias("n")).collect()
    model.scale = _root(np.array([r[0] for r in spread]), np.array([float(r[1]) for r in spread]))
    row = clean.agg(F.count("*"), F.sum(F.col("tokens") * F.exp(-model.scale * F.col("most")))).first()
    model.search = row[0] / row[1] if row[1] else 1.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([reduced(shared.value.evidence(t)[0]) for t in texts], dtype=float)

    got = judged.select("toxic", evidence("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got])
    if 0 < y.sum() < len(y):
        # classes are sampled apart: weights restore the share that the labels have
        weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        model.link = _logistic(x, y, weight)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_segments, spans (characters, with scores)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            evidence, segments = shared.value.evidence(text)
            places = [m.span() for m in TOKEN.finditer(text)] if segments else []
            rows.append((shared.value.probability(evidence), [(places[a][0], places[b - 1][1], s) for a, b, s in segments]))
        return pd.DataFrame({"score": [r[0] for r in rows], "spans": [[{"start": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows]})

    scanned = docs.select("doc_id", held_out().alias("held_out"), scan("text").alias("_s"))
    score = F.col("_s.score")
    return scanned.select("doc_id", "held_out", score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"), F.size("_s.spans").cast("long").alias("n_segments"), F.col("_s.spans").alias("spans"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the learnable labels and score every document."""
    return score_documents(docs, fit_toxicity(docs, labels))
