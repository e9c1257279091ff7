"""Anchor tables of pairs: overlaps on both axes, unions, and how they follow a merged alignment.

Anchors are (pair_id, s1, e1, s2, e2, score), half-open on both sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import align, places

_SIDES = ["s1", "e1", "s2", "e2"]
_ANCHOR = ["pair_id", *_SIDES, "score"]


def overlaps(one: DataFrame, two: DataFrame, width: int = 256) -> DataFrame:
    """Anchors of ``one`` and of ``two`` (r_) that share letters on both axes.

    shared is the lesser overlap of both axes, spanned the greater extent of the two
    together. An equi-join on squares of ``width`` letters a side, so that anchors meet
    only where they are near on both axes; a pair counts in the square where its overlap
    begins.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width))
    dealt = lambda df: df.select(*_ANCHOR, F.explode(bins("s1", "e1")).alias("_x"), bins("s2", "e2").alias("_ys")).withColumn("_y", F.explode("_ys")).drop("_ys")
    right = dealt(two).withColumnsRenamed({c: f"r_{c}" for c in _ANCHOR[1:]})
    met = dealt(one).join(right, ["pair_id", "_x", "_y"]).where("s1 < r_e1 and r_s1 < e1 and s2 < r_e2 and r_s2 < e2")
    met = met.where((F.floor(F.greatest("s1", "r_s1") / width) == F.col("_x")) & (F.floor(F.greatest("s2", "r_s2") / width) == F.col("_y"))).drop("_x", "_y")
    axis = lambda n: (F.least(f"e{n}", f"r_e{n}") - F.greatest(f"s{n}", f"r_s{n}"), F.greatest(f"e{n}", f"r_e{n}") - F.least(f"s{n}", f"r_s{n}"))
    (in1, over1), (in2, over2) = axis(1), axis(2)
    return met.select("*", F.least(in1, in2).alias("shared"), F.greatest(over1, over2).alias("spanned"))


def united(one: DataFrame, two: DataFrame, width: int = 256) -> DataFrame:
    """The anchors of both tables, and one more for each two that overlap and gain by it.

    It holds both; its score is the sum of theirs times shared / spanned, rounded down, and it
    is there if that is no less than either.
    """
    score = F.floor((F.col("score") + F.col("r_score")) * F.col("shared") / F.col("spanned")).cast("double")
    box = [F.least("s1", "r_s1").alias("s1"), F.greatest("e1", "r_e1").alias("e1"), F.least("s2", "r_s2").alias("s2"), F.greatest("e2", "r_e2").alias("e2")]
    joined = overlaps(one, two, width).withColumn("_joined", score).where("_joined >= score and _joined >= r_score")
    return one.select(*_ANCHOR).unionAll(two.select(*_ANCHOR)).unionAll(joined.select("pair_id", *box, F.col("_joined").alias("score")))


def letter_columns(rows: DataFrame, key: str = "pair_id", body: str = "body") -> DataFrame:
    """The sparse map from a row's letters to its columns in an alignment: a segment a run without gaps."""
    runs = rows.select(F.col(key).alias("chr"), F.posexplode(F.regexp_extract_all(body, F.lit("-+|[^-]+"), F.lit(0))).alias("_n", "_run"))
    sized = runs.select("chr", "_n", F.length("_run").alias("size"), (~F.col("_run").startswith("-")).alias("_letters"))
    before = Window.partitionBy("chr").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    laid = sized.select("chr", "size", "_letters", total("size").alias("first"), total(F.when(F.col("_letters"), F.col("size")).otherwise(0)).alias("start")).where("_letters")
    one, none = F.lit(1), F.lit(0)
    return laid.select("chr", "start", "size", "first", one.alias("way"), one.alias("num"), one.alias("den"), (F.col("size") - 1).alias("most"), none.alias("skip"))


def carried(anchors: DataFrame, columns: DataFrame, side: int = 1, least: int = 10) -> DataFrame:
    """Anchors whose sequence on ``side`` (1 or 2) became a row of an alignment: places there as columns.

    ``columns`` is the map that ``letter_columns`` gives, by pair_id. Anchors under ``least``
    columns, or that reach out of the row, are dropped.
    """
    s, e = f"s{side}", f"e{side}"
    points = anchors.select(F.col("pair_id").alias("chr"), *_ANCHOR[1:], (F.col(e) - 1).alias("_last")).where(F.col(s) < F.col(e))
    found = places.looked_up(points, columns, **{s: "_from", "_last": "_to"}).withColumns({s: F.col("_from"), e: F.col("_to") + 1})
    return found.where(F.col(e) - F.col(s) >= least).select(F.col("chr").alias("pair_id"), *_ANCHOR[1:])


def reanchored(one: DataFrame, two: DataFrame, first: DataFrame, second: DataFrame, least: int = 10) -> DataFrame:
    """The chain of anchors between a merged alignment and another sequence or alignment.

    ``one`` are the anchors of the alignment's first part and ``two`` those of its second, both
    with the other side second; ``first`` and ``second`` are the columns of their letters.
    Both tables move onto the merged columns, are united, and are chained anew.
    """
    return align.chained(united(carried(one, first, 1, least), carried(two, second, 1, least)))


__all__ = ["carried", "letter_columns", "overlaps", "reanchored", "united"]
