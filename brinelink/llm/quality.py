"""A quality classifier learned from positives and unlabelled text.

Only documents marked good are trusted; everything else is unlabelled. With a class prior p
the risk of a scorer is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): what the
unlabelled set holds of positives is subtracted, and the difference, the risk on negatives,
is not allowed to fall below zero, where it would only fit noise. The scorer is a logistic
model of a text's shape: how character classes follow one another, and how much repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.llm import textarrays as ta
from brinelink.llm.common import stored

#: Rows that the fit reads of the positives, and as many of the unlabelled.
FIT_ROWS = 20_000
THRESHOLD = 0.3
_CLASSES = 14


def _classes() -> np.ndarray:
    out = np.full(256, 12, np.uint8)
    out[128:] = 0
    for k, chars in enumerate(["", "", "0123456789", " \t\r", "\n", ".", ",", "!", "?", "|", "'\"()-:;", "*#$%&@~^+=<>/\\_"]):
        out[[ord(c) for c in chars]] = k
    out[97:123] = 0
    out[65:91] = 1
    out[0] = 13
    return out


_CLASS = _classes()
N_FEATURES = _CLASSES * _CLASSES + 14


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of numbers per text; an empty text has zeros."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    kind = _CLASS[data].astype(np.int64)
    inside = doc[1:] == doc[:-1]
    pair = (doc[:-1] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:]
    shape = np.bincount(pair[inside], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
    shape = np.sqrt(shape / np.maximum(size, 1)[:, None])

    starts, ends, first = ta.words(data, at)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashed = ta.hashes(data, starts, ends)

    def distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different values of each text, and how often its most frequent one occurs."""
        order = np.lexsort((values, owner))
        o, v = owner[order], values[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        heads = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, o[heads], np.diff(np.append(heads, len(v))))
        return np.bincount(o[heads], minlength=n).astype(float), top

    kinds, top = distinct(owner, hashed)
    again = np.bincount(owner[1:][(hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    three, three_first = ta.shingles(hashed, first, 3)
    runs = np.diff(three_first)
    run_kinds, run_top = distinct(np.repeat(np.arange(n), runs), three)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([at[:-1], breaks + 1]))
    edges = edges[edges < len(data)]
    stops = np.append(edges[1:], len(data))
    line_owner = doc[edges] if len(edges) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_kinds, _ = distinct(line_owner, ta.hashes(data, edges, stops))
    length = np.bincount(owner, ends - starts, minlength=n)
    long_words = np.bincount(owner[ends - starts > 20], minlength=n)
    letters = np.bincount(doc[kind <= 1], minlength=n).astype(float)
    capitals = np.bincount(doc[kind == 1], minlength=n).astype(float)
    stats = [
        np.log1p(size), np.log1p(words), length / some, long_words / some, kinds / some,
        np.log1p(kinds) / np.maximum(np.log1p(words), 1), top / some, again / some,
        run_kinds / np.maximum(runs, 1), run_top / np.maximum(runs, 1), line_kinds / np.maximum(lines, 1),
        np.log1p(lines), letters / np.maximum(size, 1), capitals / np.maximum(letters, 1),
    ]
    return np.concatenate([shape, np.stack(stats, 1)], axis=1).astype(np.float32) * (size > 0)[:, None]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 400, rate: float = 0.03, decay: float = 1e-4
) -> QualityModel:
    """Minimises the non-negative risk by full-batch Adam from zero weights; where the risk on negatives falls below zero, it is raised again."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale[scale < 1e-6] = 1
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope.astype(np.float32) / len(x), slope.mean()).astype(np.float64)

    best, best_risk = w.copy(), np.inf
    for step in range(1, epochs + 1):
        zp, zu = p @ w[:-1].astype(np.float32) + w[-1], u @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, as_negative)
        if risk < best_risk:
            best, best_risk = w.copy(), risk
        negative = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + negative if as_negative >= 0 else -negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, best[:-1].astype(np.float32), float(best[-1]), prior)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in ta.blocks(batch):
                x = features(*ta.utf8(b.column("text")))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["x"])

    return docs.select("text").mapInArrow(run, "x array<float>")


def train(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> QualityModel:
    """Learns from documents (doc_id, text) and labels (doc_id, quality), of which only the ones are used as positives.

    A document with several labels is positive if all are 1. The class prior is the share of
    positives among labelled documents. Of positives and of unlabelled documents about
    ``rows`` are read, chosen by a hash. Without positives or documents every score is the prior.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = stored(marked, "labels")
    counts = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good")).first()
    prior = min(0.99, max(0.01, counts.good / counts.n)) if counts.n else 0.5
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_docs = texts.count()

    def some(df: DataFrame, of: int) -> np.ndarray:
        part = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(of, 1)))
        got = _featured(df.where(part)).toArrow().column("x").combine_chunks()
        flat = got.values.to_numpy() if len(got) else np.zeros(0, np.float32)
        return flat.reshape(-1, N_FEATURES)

    good = marked.where("quality = 1").select("doc_id")
    chosen = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(counts.good, 1)))
    positive = some(texts.join(good.where(chosen), "doc_id", "left_semi"), counts.good)
    unlabelled = some(texts, n_docs)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES, np.float32), float(np.log(prior / (1 - prior))), prior)
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for every row; null and empty texts are scored like any other, from zeros.

    Ties and repeated rows have equal scores. Other columns are not read. No rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in ta.blocks(batch):
                s = shared.value.score(features(*ta.utf8(b.column("text"))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
