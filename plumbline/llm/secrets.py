"""Secret scans: fixed patterns plus a character convolutional network.

The patterns give the base spans, which always stay. Every other candidate, a run
of token characters with a digit in it, is judged by a small convolutional
network over its characters and what surrounds it: embedding, convolution,
rectifier, maximum over places, linear output. The network is trained in numpy on
labelled findings from a bounded sample of documents: the base spans are its
positives, other candidates its negatives. As the context may name the secret,
half of the training windows have theirs blanked, so the shape of a value counts
by itself. Scores are calibrated by a logistic link on held-back findings, and the
threshold is the largest that keeps the required recall of held-back positives
and lets no more than the allowed share of held-back negatives through.

Defined cases: a null text is empty; without findings of both classes the base
spans stand alone; repeated rows each get their result; rows without doc_id are
scanned and never learnt from; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "model")
#: One of these stands in every assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Documented bounds of the fit: sampled documents, and findings of each class.
SAMPLE_DOCS = 40_000
SAMPLE_FINDINGS = 4_000
LEAST_RECALL = 0.98
MOST_FALSE = 0.001
BEFORE, INSIDE, AFTER = 24, 48, 16
LENGTH = BEFORE + INSIDE + AFTER
SYMBOLS, EMBEDDING, WIDTH, FILTERS = 98, 8, 5, 24
EPOCHS, BATCH, RATE = 8, 64, 0.01

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    lower, spans = text.lower(), []
    if any(name in lower for name in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m.group())]


def window(text: str, start: int, end: int) -> bytes:
    """Codes of the characters around and in a candidate; 0 pads, 1 stands for all that isn't ASCII."""

    def codes(piece: str, size: int, right: bool) -> bytes:
        found = bytes((ord(c) - 30 if 32 <= ord(c) < 127 else 97 if c in "\n\t" else 1) for c in piece)
        return found.rjust(size, b"\0") if right else found.ljust(size, b"\0")

    return codes(text[max(0, start - BEFORE) : start], BEFORE, True) + codes(text[start : min(end, start + INSIDE)], INSIDE, False) + codes(text[end : end + AFTER], AFTER, False)


def windows_of(text: str, start: int, end: int) -> list[bytes]:
    """Windows along a whole candidate, each half over the one before; the last one ends with it."""
    last = max(start, end - INSIDE)
    return [window(text, at, end) for at in [*range(start, last, INSIDE // 2), last]]


@dataclass
class SecretModel:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray  # one weight for each filter, then the shift
    link: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1

    @classmethod
    def fresh(cls, seed: int = 11) -> SecretModel:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (SYMBOLS, EMBEDDING)), rng.normal(0, 0.2, (WIDTH * EMBEDDING, FILTERS)), np.zeros(FILTERS), np.append(rng.normal(0, 0.2, FILTERS), 0.0))

    def forward(self, windows: np.ndarray):
        """Logits and what the backward pass needs; windows: rows x LENGTH codes."""
        placed = self.embedding[windows]
        places = LENGTH - WIDTH + 1
        columns = np.concatenate([placed[:, k : k + places] for k in range(WIDTH)], axis=2)
        active = columns @ self.filters + self.bias
        best = active.argmax(axis=1)
        top = np.maximum(np.take_along_axis(active, best[:, None], axis=1)[:, 0], 0)
        return top @ self.output[:-1] + self.output[-1], columns, best, top

    def probability(self, windows: np.ndarray) -> np.ndarray:
        slope, shift = self.link
        return 1 / (1 + np.exp(-np.clip(slope * self.forward(windows)[0] + shift, -30, 30)))

    def likelihood(self, windows: list[bytes]) -> float:
        """Of a candidate: that of its likeliest window."""
        parts = (windows[at : at + 256] for at in range(0, len(windows), 256))
        return max(float(self.probability(np.array([np.frombuffer(w, np.uint8) for w in part])).max()) for part in parts)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        logits, columns, best, top = self.forward(windows)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(labels)
        output = np.append(top.T @ error, error.sum())
        back = error[:, None] * self.output[:-1] * (top > 0)
        chosen = columns[np.arange(len(labels))[:, None], best]
        filters = np.einsum("bfc,bf->cf", chosen, back)
        pulled = back[:, :, None] * self.filters.T[None]
        embedding = np.zeros_like(self.embedding)
        for k in range(WIDTH):
            codes = windows[np.arange(len(labels))[:, None], best + k]
            np.add.at(embedding, codes, pulled[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        return [embedding, filters, back.sum(axis=0), output]

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 5) -> None:
        """Adam on minibatches; half of the windows lose their context in each epoch."""
        rng = np.random.default_rng(seed)
        parts = [self.embedding, self.filters, self.bias, self.output]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                batch = windows[chosen].copy()
                bare = rng.random(len(chosen)) < 0.5
                batch[bare, :BEFORE] = 0
                batch[bare, BEFORE + INSIDE :] = 0
                step += 1
                for p, g, a, b in zip(parts, self.gradients(batch, labels[chosen]), first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, windows: np.ndarray, labels: np.ndarray, least_recall: float = LEAST_RECALL, most_false: float = MOST_FALSE) -> None:
        """Logistic link by Newton steps, then the recall-constrained threshold."""
        logits = self.forward(windows)[0]
        design, at = np.stack([logits, np.ones_like(logits)], axis=1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
            gradient = design.T @ (p - labels) + 1e-2 * at
            at = at - np.clip(np.linalg.solve((design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2), gradient), -1, 1)
        self.link = (max(1e-3, float(at[0])), float(at[1]))
        p = self.probability(windows)
        recalled = float(np.quantile(p[labels == 1], 1 - least_recall, method="lower"))
        silent = float(np.quantile(p[labels == 0], 1 - most_false, method="higher"))
        # recall first: never above what keeps it; higher than the loudest negatives where that still holds
        self.threshold = min(recalled, max(0.5, np.nextafter(silent, 2))) if silent < recalled else recalled


def _is_base(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for a, _, b in spans)


def _findings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            spans = base_spans(text)
            for start, end in candidates(text):
                base = _is_base(spans, start, end)
                # a finding is known by where it starts; no part of any other candidate is one
                for k, seen in enumerate([window(text, start, end)] if base else windows_of(text, start, end)):
                    rows.append((int(base), hashlib.md5(f"{doc_id}:{start}:{k}".encode()).hexdigest(), seen))
        yield pd.DataFrame(rows, columns=["label", "order", "window"]).astype({"label": "int32"})


def fit_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_findings: int = SAMPLE_FINDINGS) -> SecretModel | None:
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    count = docs.count()
    share = min(1.0, sample_docs / max(1, count))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    found = sample.mapInPandas(_findings, "label int, order string, window binary")
    # equal windows (copies) count once
    found = found.groupBy("label", "window").agg(F.min("order").alias("order"))
    chosen = [found.filter(F.col("label") == k).orderBy("order").limit(sample_findings) for k in (0, 1)]
    got = sorted((r["order"], r["label"], bytes(r["window"])) for r in chosen[0].unionByName(chosen[1]).collect())
    windows = np.array([np.frombuffer(r[2], np.uint8) for r in got]) if got else np.zeros((0, LENGTH), np.uint8)
    labels = np.array([r[1] for r in got], dtype=float)
    held = np.arange(len(got)) % 4 == 0
    if any(len(np.unique(part)) < 2 for part in (labels[held], labels[~held])):
        return None
    model = SecretModel.fresh()
    model.train(windows[~held], labels[~held])
    model.calibrate(windows[held], labels[held])
    return model


def all_spans(text: str, model: SecretModel | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the network's added."""
    base = base_spans(text)
    if model is None:
        return base, base
    rest = [(a, b) for a, b in candidates(text) if not _is_base(base, a, b)]
    if not rest:
        return base, base
    sure = [model.likelihood(windows_of(text, a, b)) >= model.threshold for a, b in rest]
    return base, sorted([*base, *((a, 3, b) for (a, b), found in zip(rest, sure) if found)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "", shared.value)
            rows.append((*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    return docs.select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Fit on a sample of the documents and scan them all."""
    return scan_secrets(docs, fit_secrets(docs))
