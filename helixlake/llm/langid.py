"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams in order. A document is
given the language whose profile its own most frequent n-grams are least out of
place with. Profiles are counted on executors from a bounded sample of labelled
rows, and only the finished profiles (a few hundred n-grams for each language)
reach the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import sliced

#: Code points of a text that are counted at once.
_RUN = 1 << 20
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _spelled(text: str) -> np.ndarray:
    """Lower-case letters as code points, one blank around and between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    points = np.concatenate([[_BLANK], points, [_BLANK]])
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, points, _BLANK)[keep].astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text (21 bits per code point) and how often each occurs.

    A blank stands at the ends of an n-gram only, and alone it is none.
    """
    s = _spelled(text)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, max(1, len(s) - 1), _RUN):
        one = s[k : k + _RUN]
        two = s[k : k + _RUN + 1]
        three = s[k : k + _RUN + 2]
        pair = two[:-1] | two[1:] << 21
        triple = (three[:-2] | three[1:-1] << 21 | three[2:] << 42)[three[1:-1] != _BLANK]
        found.append(np.unique(np.concatenate([one[one != _BLANK], pair[: len(one)], triple]), return_counts=True))
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, count), summed over the batch."""
    for batch in sliced(batches):
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(gram_counts(text))
        for lang, found in by_lang.items():
            grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(count)], names=["lang", "gram", "count"])


class Profiles:
    """Rank-order profiles of languages, in order of their names."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(ranked)
        self.grams = np.unique(np.array([g for own in ranked.values() for g in own], np.int64))
        # the last column stands for n-grams that no profile has
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, ranked[lang])] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and one minus its share of the largest distance there is."""
        if not text or not self.langs:
            return "und", 0.0
        grams, count = gram_counts(text)
        if not len(grams) or grams[-1] == _BLANK:
            return "und", 0.0
        top = grams[np.lexsort((grams, -count))[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        rank = self.rank[:, at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(top)))


def train_profiles(labelled: DataFrame, size: int = 300, most_docs: int = 1000) -> Profiles:
    """Profiles from rows (doc_id, lang, text); rows with a null text or lang are left out.

    Of each language about ``most_docs`` rows are read: those whose hashed id falls
    below a share of the range, so that the sample is the same at every run and
    partitioning. Ties in a profile go to the smaller n-gram.
    """
    rows = labelled.where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, most_docs / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Profiles({}, size)
    share_of = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.where(draw <= share_of).select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, count long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("count").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = model.value
        for batch in sliced(batches):
            found = [profiles.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, size: int = 300, most_docs: int = 1000, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs``.

    Profiles are learned from rows whose crc32(doc_id as text) mod ``folds`` is not
    ``held_out_fold``; a null doc_id is held out. Only the text decides a row's
    prediction. Null texts and texts without a letter are ``und`` with score 0, as
    is every text if there is nothing to learn from. Equal distances go to the
    language that sorts first. Other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", "lang")
    model = spark.sparkContext.broadcast(train_profiles(rows.where(~F.col("held_out")), size, most_docs))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
