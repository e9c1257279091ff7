"""Mixing sources to target weights, on DataFrame functions alone.

Sizes are summed per source before the shuffle, so a hot source costs one row
per task. The few source rows are ranked, given weights and filled up to their
targets in one pass of window sums; each document then reads its source's rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import word_count, written

#: Up to this many sources, their rates (three numbers each) are broadcast; with
#: more, the join is a shuffle that adaptive execution may split.
BROADCAST_SOURCES = 50_000


def target_rates(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) to targets and rates, one row per source.

    Sources by code point, null last, take the weights in turn and share the sum
    of all sizes. A target stops at ``most`` times its source's size and the
    excess goes to the others by weight until none is above: the level L for
    which the sum of min(most * size, L * weight) is the whole. In order of
    most * size / weight the stopped sources come first, so L follows from
    running sums.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1).cast("long")
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_all_weights", F.sum("_weight").over(everything))
        .withColumn("_stopped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.col("_all_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_total") - F.col("_stopped")) / F.col("_left"))
        # the first source, in order of ratio, that the level leaves below its cap
        .withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
        .withColumn("_final", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap")))
    return level.select(
        "source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def copies(rate, id_column, seed: str = "mix"):
    """floor(rate), and one more with a probability of the fraction.

    The draw is the first 52 bits of an MD5 of seed and id, so reruns and other
    engines agree.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_rates(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with doc_id, size, source_size,
    target and copies (how often the mix takes it).

    A null text has size 0, null is a source of its own, a null id draws like any
    other id, and rows that repeat draw alike. Extra columns only live on in
    ``row``, whatever they are called. An empty table gives an empty one.
    """
    sized = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").alias("_own"), word_count(F.col("text")).alias("size"))
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = written(target_rates(sizes, **options), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col("_own").eqNullSafe(F.col("source")), "inner")
    return joined.select("row", "doc_id", "size", "source_size", "target", copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns, as often as it is taken."""
    taken = mix_rates(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
