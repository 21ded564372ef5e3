"""Supervised subword embeddings: learned vectors of hashed word and character n-grams, averaged per document,
softmax output, trained by numpy stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import find_words, map_rows, unit_hash
from fillwatch.llm.ngrams import sums_by_word, word_ngrams

LOW, HIGH = 2, 4


@dataclass(frozen=True)
class QualityModel:
    bits: int
    vectors: np.ndarray  # bucket x dimension
    output: np.ndarray  # dimension x 2
    bias: np.ndarray

    def gains(self) -> np.ndarray:
        """Log-odds that each bucket adds to a document's average."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)


def _pairs(code: np.ndarray, size: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring word pairs of each text, and their number per text."""
    if len(code) < 2:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        h = (hashes[code[:-1]] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[code[1:]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h[same] >> np.uint64(64 - bits)).astype(np.int64), np.maximum(size - 1, 0)


def _word_table(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Word numbers of all texts, the distinct words, words per text, and a 64-bit hash of each distinct word."""
    words = [find_words(t or "") for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    code, distinct = pd.factorize(np.array([w for own in words for w in own], object))
    hashes = pd.util.hash_array(np.asarray(distinct, object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)
    return code, list(distinct), size, hashes


def features(texts: list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and how often they occur."""
    code, distinct, size, hashes = _word_table(texts)
    keys, begin = word_ngrams(distinct, LOW, HIGH, bits, whole=True)
    pairs, n_pairs = _pairs(code, size, hashes, bits)
    ends, pair_ends, out = np.cumsum(size), np.cumsum(n_pairs), []
    for k in range(len(texts)):
        own, n = np.unique(code[ends[k] - size[k]:ends[k]], return_counts=True)
        parts = [keys[begin[w]:begin[w + 1]] for w in own]
        ids = np.concatenate([*parts, pairs[pair_ends[k] - n_pairs[k]:pair_ends[k]]]) if len(own) else np.zeros(0, np.int64)
        weight = np.concatenate([np.repeat(n, [len(p) for p in parts]), np.ones(n_pairs[k])]) if len(own) else np.zeros(0)
        bucket, where = np.unique(ids, return_inverse=True)
        out.append((bucket, np.bincount(where, weight, len(bucket))))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, bits: int, dim: int = 16, epochs: int = 8, rate: float = 0.5,
          seed: int = 7) -> QualityModel:
    """Stochastic gradient descent on log-loss, one document a step, in a new order each epoch, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = [(ids, (n / n.sum()).astype(np.float32), y) for ids, n, y in rows if len(ids)]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, w, y = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            mean = w @ vectors[ids]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the log-loss
            back = output @ p
            output -= step * np.outer(mean, p)
            bias -= step * p
            vectors[ids] -= (step * len(ids) ** 0.5) * w[:, None] * back
    return QualityModel(bits, vectors, output, bias)


def fit(labelled: DataFrame, *, max_rows: int = 4000, bits: int = 17, **options) -> QualityModel:
    """Model of ``labelled(doc_id, text, label)``; rows without a label are ignored, null texts count as empty.

    The sample is bounded by ``max_rows`` whole texts in expectation, picked by a hash of the row so that reruns agree;
    their distinct buckets are counted on the executors, and the descent runs on the driver over these counts.
    """
    rows = labelled.where(F.col("label").isNotNull())
    n = max(1, rows.count())
    sample = rows.where(unit_hash("doc_id", F.lit("quality")) * n < max_rows)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = features(batch.column(1).to_pylist(), bits)
        return pa.record_batch([batch.column(0), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())),
                                pa.array([x[1].astype(np.float32) for x in got], pa.list_(pa.float32())), batch.column(2)],
                               ["doc_id", "ids", "n", "label"])

    counted = map_rows(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")),
                       count, "doc_id long, ids array<int>, n array<float>, label int").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    train_rows = [(np.asarray(i.values), np.asarray(w.values), int(y)) for i, w, y in
                  zip(counted["ids"], counted["n"], counted["label"].to_pylist())]
    return train(train_rows, bits=bits, **options)


def score_batch(gains: np.ndarray, bias: float, bits: int, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each text. The average is linear, so a word's n-grams add up to one number per word."""
    code, distinct, size, hashes = _word_table(texts)
    keys, begin = word_ngrams(distinct, LOW, HIGH, bits, whole=True)
    gain, n = sums_by_word(gains, keys, begin), np.diff(begin)
    pairs, n_pairs = _pairs(code, size, hashes, bits)
    doc, pair_doc = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), n_pairs)
    total = np.bincount(doc, gain[code], len(size)) + np.bincount(pair_doc, gains[pairs], len(size))
    count = np.bincount(doc, n[code], len(size)) + n_pairs
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def score(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted`` (1 if it is 0.5 or more).

    Reads ``text`` only, whole. Null and empty texts get the score of the output bias. Repeated rows stay, extra columns
    are carried, an empty table gives an empty result. Map-only: the model is a table of ``2**bits`` numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.gains(), float(model.bias[1] - model.bias[0]), model.bits))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = score_batch(*shared.value, batch.column(text).to_pylist())
        return pa.record_batch([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                               [*batch.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"
    return map_rows(kept, run, schema)
