"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed character n-grams (one to
three code points, everything but letters read as one blank), followed by a
linear softmax. Both layers are trained by minibatch gradient descent in numpy
on a bounded sample: about ``PER_LANGUAGE`` rows of each language, chosen by a hash of
doc_id. Features of the sample are made in Spark tasks from whole texts and from
short passages of them, so that short texts are learnt too. As both layers are
linear they fold into one table (bucket -> score of each language), which is what
the tasks get; its size depends on the number of languages only.

Confidence is calibrated by a temperature on a held-back part of the sample. A
text is rejected below the confidence that all but one in a thousand right
predictions of that part exceed, at most ``MOST_REJECTED_AT``.

Defined cases: texts that are null or have no letter are ``und`` with score 0 and
rejected; rows without doc_id are never learnt from and not held out; without a
labelled row every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of the fit: rows of each language, in expectation.
PER_LANGUAGE = 500
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
BATCH = 32
RATE = 0.3
#: No text at or above this calibrated confidence is rejected.
MOST_REJECTED_AT = 0.5
PASSAGES = (40, 160)
BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """Lower-case code points, with one blank in place of each run of other characters; whether any is a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = np.ones(len(codes), dtype=bool)
    low = codes < 1 << 16
    letter[low] = _letters()[codes[low]]
    if not low.all():
        distinct, at = np.unique(codes[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in distinct.tolist()])[at]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, BLANK)[keep].astype(np.uint32), bool(letter.any())


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of one to three code points."""
    mixed = codes * np.uint32(0x9E3779B1)
    grams = [mixed]
    for width in (2, 3):
        if len(codes) >= width:
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[width - 1 :] * np.uint32(0xC2B2AE35)
            grams.append(mixed)
    return np.concatenate(grams) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _bag(text: str) -> tuple[bytes, bytes]:
    codes, _ = _codes(text)
    ids, counts = np.unique(_buckets(codes), return_counts=True)
    return ids.astype("<u4").tobytes(), (counts / max(1, counts.sum())).astype("<f4").tobytes()


def _examples(batches):
    """Bags of each sampled text and of passages of it at places that the text fixes."""
    for batch in batches:
        rows = []
        for doc_id, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"]):
            seed = zlib.crc32(str(doc_id).encode())
            pieces = [text, *(text[(at := seed * 31 % max(1, len(text) - size)) : at + size] for size in PASSAGES)]
            rows += [(int(doc_id), lang, seed // 3 % 5 == 0, *_bag(piece)) for piece in pieces if _codes(piece)[1]]
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "held", "ids", "shares"])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language, calibrated
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages:
            return "und", 0.0, True
        codes, readable = _codes(text)
        if not readable:
            return "und", 0.0, True
        counts = np.bincount(_buckets(codes), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        logits = counts[used] @ self.table[used] / counts.sum()
        shares = np.exp(logits - logits.max())
        best = int(shares.argmax())
        score = float(shares[best] / shares.sum())
        return self.languages[best], score, score < self.threshold


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Folded table of averaged embeddings and softmax weights."""
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, classes)).astype(np.float32)
    moved, turned = np.full(BUCKETS, 1e-6, dtype=np.float32), np.full_like(weights, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for start in range(0, len(bags), BATCH):
            chosen = order[start : start + BATCH]
            ids, shares = np.concatenate([bags[i][0] for i in chosen]), np.concatenate([bags[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            starts = np.searchsorted(row, np.arange(len(chosen)))
            mean = np.add.reduceat(embedding[ids] * shares[:, None], starts, axis=0)
            error = _softmax(mean @ weights)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            back = shares[:, None] * (error @ weights.T)[row]
            # steps shrink with the squared gradients so far (of a bucket, of a weight)
            gradient = mean.T @ error
            turned += gradient**2
            np.add.at(moved, ids, (back**2).mean(axis=1))
            weights -= RATE * gradient / np.sqrt(turned)
            np.subtract.at(embedding, ids, RATE * back / np.sqrt(moved[ids])[:, None])
    return embedding @ weights


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Inverse temperature of least negative log-likelihood, on a fixed geometric grid."""
    rows = np.arange(len(labels))
    grid = 2.0 ** np.arange(-4, 6.25, 0.25)
    loss = [-np.log(np.maximum(_softmax(logits * t)[rows, labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def learnable() -> Column:
    """Rows of the learning folds: remainder 0 or 2 of crc32 of the id's text."""
    return F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    rows = docs.select("doc_id", "lang", "text").filter(learnable())
    counts = {r["lang"]: r["n"] for r in docs.filter(learnable()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32), 0.0)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / counts[name]))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = sample.mapInPandas(_examples, "doc_id long, lang string, held boolean, ids binary, shares binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["ids"]))
    bags = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["shares"], "<f4")) for r in got]
    labels = np.array([languages.index(r["lang"]) for r in got], dtype=np.int64)
    held = np.array([r["held"] for r in got], dtype=bool)
    if not bags:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32), 0.0)
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(bags))
    table = _train([bags[i] for i in fit], labels[fit], len(languages))
    judged = np.flatnonzero(held) if held.any() else fit
    logits = np.stack([shares @ table[ids] for ids, shares in (bags[i] for i in judged)])
    scale = _temperature(logits, labels[judged])
    sure = _softmax(logits * scale)
    right = sure.argmax(axis=1) == labels[judged]
    kept = np.quantile(sure.max(axis=1)[right], 0.001) if right.any() else 0.0
    return LanguageModel(languages, (table * scale).astype(np.float32), float(min(kept, MOST_REJECTED_AT)))


def predictions(docs: DataFrame, model: LanguageModel) -> Column:
    """Column of (lang_pred, score, rejected) for the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(F.col("text"))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    model = model or fit_language_model(docs)
    return docs.select("doc_id", held_out().alias("held_out"), predictions(docs, model).alias("_p")).select("doc_id", "held_out", "_p.*")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is recognised, columns unchanged."""
    model = model or fit_language_model(docs)
    return docs.filter(~predictions(docs, model)["rejected"])
