"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a text has (not how often) makes its features; each is scaled by
the log of the ratio of its smoothed document frequencies in the two classes, and
logistic regression learns weights for the scaled features. Document frequencies
are counted on executors; weights are learned on the driver from a bounded sample
of labelled rows, reduced to the n-grams that tell the classes apart best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced, written

_BITS = 20
_SIZES = (4, 5)
_RUN = 1 << 20
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text: lower-case letters, one blank for all else between."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    s = np.where(letter, points, np.uint32(32))[keep]
    for n in _SIZES:
        for k in range(0, max(0, len(s) - n + 1), _RUN):
            own = s[k : k + _RUN + n - 1]
            h = np.full(len(own) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ own[j : j + len(h)]) * _MIX[j]
                h ^= h >> np.uint32(15)
            yield ((h * _MIX[0]) >> np.uint32(32 - _BITS)).astype(np.int64)


def _present(text: str) -> np.ndarray:
    parts = list(_buckets(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (bucket, bad, good): in how many texts of each class it is."""
    count = np.zeros((2, 1 << _BITS), np.int32)
    for batch in sliced(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count[label, _present(text)] += 1
    at = np.flatnonzero(count.sum(axis=0))
    for k in range(0, len(at), 100_000):
        own = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[1, own].astype(np.int64)), pa.array(count[0, own].astype(np.int64))], names=["bucket", "bad", "good"])


def _chosen(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            has = [np.flatnonzero(np.isin(buckets, _present(t), assume_unique=True)).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(has, pa.list_(pa.int32()))], names=["doc_id", "label", "has"])

    return run


class Classifier:
    def __init__(self, buckets: np.ndarray, coefficients: np.ndarray, bias: float):
        self.bias = bias
        self.coefficients = np.append(coefficients, 0.0)
        self.slot = np.full(1 << _BITS, len(buckets), np.int16 if len(buckets) < 1 << 15 else np.int32)
        self.slot[buckets] = np.arange(len(buckets))

    def score(self, text: str | None) -> float:
        mark = np.zeros(len(self.coefficients), bool)
        for part in _buckets(text or ""):
            mark[self.slot[part]] = True
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.coefficients[mark].sum(), -700, 700))))


def _fit(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on whole batches; deterministic."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scaled = ratio[index]
    w, b = np.zeros(len(ratio)), float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights=scaled * w[index], minlength=len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
        grad = np.append(np.bincount(index, weights=scaled * error[row], minlength=len(ratio)) / len(rows) + l2 * w, error.mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= float(step[-1])
    return w * ratio, b


def train(labelled: DataFrame, features: int = 4096, smoothing: float = 1.0, l2: float = 1e-4, rounds: int = 150) -> Classifier:
    """A classifier from rows (doc_id, text, label 0 or 1).

    All its rows are learned from, and their n-grams come to the driver, so the
    caller bounds them; the ``features`` n-gram buckets with the largest chi-squared are kept. With no
    row of label 1 every score is 0 but for rounding; with none of label 0, 1.
    """
    spark = labelled.sparkSession
    sample = written(labelled.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), 40.0 if bad else -40.0)
    counts = sample.select("label", "text").mapInArrow(_frequencies, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total, has = F.lit(float(bad + good)), F.col("bad") + F.col("good")
    gap = F.col("bad") * F.lit(float(good)) - F.col("good") * F.lit(float(bad))
    chi2 = gap * gap * total / (F.lit(float(bad) * good) * has * F.greatest(total - has, F.lit(1.0)))
    best = counts.where(has >= 3).withColumn("chi2", chi2).orderBy(F.desc("chi2"), "bucket").limit(features).collect()
    best.sort(key=lambda r: r["bucket"])
    buckets = np.array([r["bucket"] for r in best], np.int64)
    p, q = (np.array([r[k] for r in best], float) + smoothing for k in ("bad", "good"))
    ratio = np.log((p / (bad + 2 * smoothing)) / (q / (good + 2 * smoothing)))
    rows = sample.mapInArrow(_chosen(buckets), "doc_id long, label int, has array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], len(r["has"])))
    coefficients, bias = _fit([np.array(r["has"], np.int64) for r in rows], np.array([r["label"] for r in rows], float), ratio, l2, rounds)
    return Classifier(buckets, coefficients, bias)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.value
        for batch in sliced(batches):
            score = np.array([classifier.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _trained(docs: DataFrame, labels: DataFrame, folds: int, most_docs: int, options: dict) -> Classifier:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marked = written(marked, "toxicity-labels")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = written(marked.where("label = 0").orderBy(*order).limit(most_docs).unionByName(marked.where("label = 1").orderBy(*order).limit(most_docs)), "toxicity-picked")
    # At most twice most_docs rows of two numbers: a bounded table. Of rows that repeat an
    # id the largest text counts, so as many texts at most.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    model = train(texts, **options)
    every = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(every) == 2:  # the odds of all labels, not of a sample that takes as many rows of each class
        bad, good = every[1], every[0]
        model.bias += float(np.log(bad / min(bad, most_docs)) - np.log(good / min(good, most_docs)))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, most_docs: int = 4000, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row of ``docs``.

    Labels are learned only for ids whose crc32(doc_id as text) mod ``folds`` is not
    0; the others, and rows with a null id, are held out. Of each class the
    ``most_docs`` ids with the smallest hashes are learned from. Of conflicting labels of
    an id the toxic one counts; labels other than 0 and 1 are ignored. Null texts
    are empty, and an empty text gets the score of having no n-gram. Rows that
    repeat get the same score. Other columns are ignored. An empty table gives an
    empty one; without labels of both classes every score is near 0, or 1 if all are toxic.
    """
    model = docs.sparkSession.sparkContext.broadcast(_trained(docs, labels, folds, most_docs, options))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, most_docs: int = 4000, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that score below ``threshold``.

    Scores are a column of the scan, so nothing is shuffled. A null text is scored as an
    empty one; rows with a null id or no label are scored too, repeated rows each; an
    empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(_trained(docs, labels, folds, most_docs, options))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            clean = [model.value.score(t) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
