"""Interval operators: islands, coverage, complements, neighbours and range joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of touching or overlapping intervals: keys, island_start, island_end, n."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*keys, start, end).withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("island_end") - F.col("island_start")).alias("covered"))


def complement(df: DataFrame, extents: DataFrame, keys: list[str], longer_than: int = 0) -> DataFrame:
    """Maximal uncovered runs longer than ``longer_than``: keys, gap_start, gap_end.

    ``extents`` has the keys and ``size``; keys without intervals are one run.
    """
    found = islands(df, keys)
    order = Window.partitionBy(*keys).orderBy("island_start")
    before = found.select(*keys, F.coalesce(F.lag("island_end").over(order), F.lit(0)).alias("gap_start"), F.col("island_start").alias("gap_end"))
    last = extents.join(found.groupBy(*keys).agg(F.max("island_end").alias("_last")), keys, "left")
    after = last.select(*keys, F.coalesce("_last", F.lit(0)).cast("long").alias("gap_start"), F.col("size").cast("long").alias("gap_end"))
    both = before.select(*keys, F.col("gap_start").cast("long"), F.col("gap_end").cast("long")).unionByName(after)
    return both.where(F.col("gap_end") - F.col("gap_start") > longer_than)


def neighbours(df: DataFrame, keys: list[str]) -> DataFrame:
    """For intervals that do not overlap: the end before and the start after each."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    return df.withColumn("previous_end", F.lag("end").over(order)).withColumn("next_start", F.lead("start").over(order))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows with equal keys whose [start, end) overlap.

    Both sides go to the bins of ``width`` that they touch, so the join is an
    equi-join; a pair counts in the bin where its overlap starts. Columns of the
    right side other than the keys get the prefix ``r_``.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)))
    lhs = left.withColumn("_bin", bins())
    rhs = right.withColumn("_bin", bins())
    rhs = rhs.select(*keys, "_bin", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    joined = lhs.join(rhs, [*keys, "_bin"]).where("start < r_end and r_start < end")
    return joined.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bin")).drop("_bin")


def _least_in_tiles(keys: int):
    """(keys, tile, start, end, asked, value), sorted by keys and tile, whole tiles in a task, to (keys, start, end, value)."""

    def of_tiles(rows: pa.Table) -> pa.Table | None:
        start, end = (rows.column(keys + i).to_numpy().astype(np.int64) for i in (1, 2))
        asked = rows.column(keys + 3).to_numpy()
        turn = np.zeros(len(start), bool)
        turn[0] = True
        for c in rows.columns[: keys + 1]:
            c = c.combine_chunks()
            turn[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        # tiles side by side on one line
        first, group = np.flatnonzero(turn), np.cumsum(turn) - 1
        low, high = np.minimum.reduceat(start, first), np.maximum.reduceat(end, first)
        shift = np.concatenate([[0], np.cumsum(high - low)])
        a, b = start - low[group] + shift[group], end - low[group] + shift[group]
        of, by = np.flatnonzero(asked), np.flatnonzero(~asked)
        if not len(of) or not len(by):
            return None
        of = of[np.unique(a[of] * (shift[-1] + 1) + b[of], return_index=True)[1]]
        value = rows.column(keys + 4).combine_chunks().take(pa.array(by))
        fields = value.flatten() if pa.types.is_struct(value.type) else [value]
        order = np.lexsort([f.to_numpy(zero_copy_only=False) for f in fields[::-1]])
        rank = np.empty(len(by), np.int64)
        rank[order] = np.arange(len(by))
        none = len(by)
        level = lambda n: np.frexp(n.astype(float))[1] - 1
        # the least that holds each place: two stretches of 2^n places a span, handed down to places
        size, s, e = level(b[by] - a[by]), a[by], b[by]
        held = np.full(shift[-1], none)
        for n in range(int(size.max()), -1, -1):
            own = size == n
            np.minimum.at(held, s[own], rank[own])
            np.minimum.at(held, e[own] - (1 << n), rank[own])
            if n:
                half, later = 1 << n - 1, held.copy()
                later[half:] = np.minimum(held[half:], held[:-half])
                held = later
        best = held[a[of]]
        # and the least that begins in each stretch of 2^n places
        begun, size = np.full(shift[-1], none), level(b[of] - a[of])
        np.minimum.at(begun, s, rank)
        for n in range(int(size.max()) + 1):
            own = np.flatnonzero(size == n)
            best[own] = np.minimum(best[own], np.minimum(begun[a[of[own]]], begun[b[of[own]] - (1 << n)]))
            further = begun.copy()
            further[: -(1 << n)] = np.minimum(begun[: -(1 << n)], begun[1 << n :])
            begun = further
        met = best < none
        found = rows.take(pa.array(of[met]))
        return pa.table([*found.columns[:keys], *found.columns[keys + 1 : keys + 3], value.take(pa.array(order[best[met]]))], names=[*rows.column_names[:keys], "start", "end", rows.column_names[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = lambda batch, i: [batch.column(c)[i].as_py() for c in range(keys + 1)]

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                found = of_tiles(pa.Table.from_batches(parts))
                yield from found.to_batches(1 << 16) if found is not None else ()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and place(held[-1], -1) != place(batch, 0):
                yield from done(held)
                held = []
            if place(batch, 0) == place(batch, -1):
                held.append(batch)
                continue
            same = np.logical_and.reduce([pc.equal(c, c[-1]).to_numpy(zero_copy_only=False) for c in batch.columns[: keys + 1]])
            cut = int(same.argmax())  # the last tile may go on
            yield from done([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        yield from done(held)

    return run


def least_overlapping(targets: DataFrame, spans: DataFrame, keys: list[str], value: str, longest: int) -> DataFrame:
    """Distinct (keys, start, end) of ``targets`` with the least ``value`` of the spans that overlap each.

    No pairs are made, and a row crosses the shuffle once: to the tile of places that its target starts
    in, or whose targets its span may overlap. A span overlaps a target if it starts inside it or holds
    its start; both are looked up in stretches of 1, 2, 4, ... places of the tile. Intervals are not empty and
    none may be longer than ``longest``; targets that nothing overlaps are left out. ``value`` is a number or a struct of numbers.
    """
    longest = max(1, int(longest))
    tile = max(1 << 13, 16 * longest)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    at = lambda place: F.floor(place / tile).cast("long")
    none = F.lit(None).cast(spans.schema[value].dataType).alias(value)
    asked = targets.where(known).select(*keys, at(F.col("start")).alias("_tile"), "start", "end", F.lit(True).alias("_asked"), none)
    tiles = F.explode(F.sequence(at(F.col("start") - longest + 1), at(F.col("end") - 1)))
    given = spans.where(known & F.col(value).isNotNull()).select(*keys, tiles.alias("_tile"), "start", "end", F.lit(False).alias("_asked"), value)
    rows = asked.unionByName(given)
    schema = rows.select(*keys, "start", "end", value).schema
    return rows.repartition(*keys, "_tile").sortWithinPartitions(*keys, "_tile").mapInArrow(_least_in_tiles(len(keys)), schema)


def coverage_by_degree(blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """degree (null: all), chr (null: all sequences), n_blocks, percent of bases covered.

    The degree of a block is how many instances it has; percentages are of the
    union of intervals, for one degree and sequence and for the totals of each.
    """
    degree = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("degree"))
    rows = blocks.join(degree, "block_id").select("degree", "chr", "start", "end", "block_id")
    both = rows.unionByName(rows.withColumn("degree", F.lit(None).cast("long")))
    length = islands(both.withColumn("_d", F.coalesce("degree", F.lit(0))), ["_d", "chr"]).groupBy("_d", "chr").agg(F.sum(F.col("island_end") - F.col("island_start")).alias("covered"))
    total = extents.agg(F.sum("size").alias("total"))
    by_chr = length.join(extents, "chr").select("_d", "chr", (F.col("covered") * 100.0 / F.col("size")).alias("percent"))
    by_all = length.groupBy("_d").agg(F.sum("covered").alias("covered")).crossJoin(F.broadcast(total)).select("_d", F.lit(None).cast("int").alias("chr"), (F.col("covered") * 100.0 / F.col("total")).alias("percent"))
    counts = both.withColumn("_d", F.coalesce("degree", F.lit(0))).groupBy("_d").agg(F.countDistinct("block_id").alias("n_blocks"))
    return by_chr.unionByName(by_all).join(counts, "_d").select(F.nullif("_d", F.lit(0)).alias("degree"), "chr", "n_blocks", F.round("percent", 6).alias("percent"))
