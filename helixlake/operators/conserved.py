"""Conserved regions of alignments: the best path of two states, as a scan over tiles.

A column adds its score while the path is in the conserved state and nothing in the other,
and each change of state costs the same. All that matters of what came before is by how
much the best path that ends conserved is ahead of the other. A column holds this lead
between the two costs and adds its score: x -> min(max(x, -c), c) + m. Such steps compose to
min(max(x + a, lo), hi), so tiles are composed apart and only three numbers of each are
scanned. Where the lead passes a bound, both states come from the same one, whatever
follows; between such places the path stays where it is.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a tile.
TILE = 1 << 12
_FAR = 1 << 60


def scores(percent: int) -> tuple[int, int, int]:
    """Match, mismatch and the cost of a change, in hundredths, for regions of that identity."""
    match, mismatch = log(percent / 100 / 0.25), log((1 - percent / 100) / 0.75)
    return int(match * 100), int(mismatch * 100), int(40 * match * 100)


def row_pairs(rows: DataFrame) -> DataFrame:
    """(aln, row, body) to aln, row, r_row, a, b: each two rows of an alignment, the lesser first."""
    one = rows.select("aln", "row", F.col("body").alias("a"))
    return one.join(rows.select("aln", F.col("row").alias("r_row"), F.col("body").alias("b")), "aln").where("row < r_row")


def _tiled(pairs: DataFrame, keys: list[str], size: int, match: int, mismatch: int, gap: int) -> DataFrame:
    """keys, at, m: the column scores of each tile; null where both rows have a gap."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("a") - 1) / size).cast("int"))).alias("_t")
    piece = lambda c: F.substring(F.col(c), F.col("_t") * size + 1, F.lit(size))
    rows = pairs.where("length(a) > 0 and length(b) > 0").select(*keys, "a", "b", at).select(*keys, (F.col("_t") * size).alias("at"), piece("a").alias("a"), piece("b").alias("b"))
    known = lambda c: c.isin("A", "C", "G", "T")

    def score(x, y):
        pair = F.when(known(x) & known(y), F.when(x == y, match).otherwise(mismatch)).otherwise(0)
        return F.when((x == "-") & (y == "-"), None).when((x == "-") | (y == "-"), gap).otherwise(pair).cast("long")

    return rows.select(*keys, "at", F.zip_with(F.split("a", ""), F.split("b", ""), score).alias("m"))


def _held(x: Column, cost: int) -> Column:
    return F.least(F.greatest(x, F.lit(-cost).cast("long")), F.lit(cost).cast("long"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def conserved_regions(pairs: DataFrame, keys: list[str], percent: int = 70, gap: int = -50, tile: int = TILE) -> DataFrame:
    """keys, start, end, n: columns that the best path has in the conserved state.

    ``pairs`` has the keys, one row each, and two rows a and b of an alignment, equally long.
    Columns with a gap in both are not counted in n, and no region ends on one. Letters other than
    A, C, G, T score 0. Of two paths that are equally good the one that was not conserved counts.
    """
    match, mismatch, cost = scores(percent)
    tiles = _tiled(pairs, keys, tile, match, mismatch, gap)
    step = F.struct(_long(0).alias("a"), _long(-_FAR).alias("lo"), _long(_FAR).alias("hi"), _long(0).alias("n"))
    plus = lambda s, m: F.struct((s["a"] + m).alias("a"), (_held(s["lo"], cost) + m).alias("lo"), (_held(s["hi"], cost) + m).alias("hi"), (s["n"] + 1).alias("n"))
    tiles = tiles.withColumn("whole", F.aggregate("m", step, lambda s, m: F.when(m.isNull(), s).otherwise(plus(s, m))))

    # The lead with which each tile is entered, and the counted columns before it.
    through = lambda x, w: F.least(F.greatest(x + w["a"], w["lo"]), w["hi"])
    enter = F.struct(_long(0).alias("lead"), _long(0).alias("n"), F.array().cast("array<struct<at: int, lead: bigint, n: bigint>>").alias("at"))
    walk = lambda s, t: F.struct(through(s["lead"], t["whole"]).alias("lead"), (s["n"] + t["whole"]["n"]).alias("n"), F.concat(s["at"], F.array(F.struct(t["at"].alias("at"), s["lead"].alias("lead"), s["n"].alias("n")))).alias("at"))
    summed = tiles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "whole"))).alias("all"))
    summed = summed.select(*keys, F.aggregate("all", enter, walk).alias("s"))
    entered = tiles.select(*keys, "at", "m").join(summed.select(*keys, F.inline("s.at")), [*keys, "at"])

    # In a tile: for each run of places that settle the same state, the last of them.
    settled = "array<struct<conserved: boolean, col: int, n: bigint>>"
    begin = F.struct(F.col("lead").alias("lead"), F.col("n").alias("n"), F.col("at").alias("col"), F.array().cast(settled).alias("seen"))

    def pass_(s, m):
        which = F.when(s["lead"] > cost, True).when(s["lead"] <= -cost, False)
        here = F.array(F.struct(which.alias("conserved"), s["col"].alias("col"), s["n"].alias("n")))
        again = (F.size(s["seen"]) > 0) & (F.get(s["seen"], F.size(s["seen"]) - 1)["conserved"] == which)
        seen = F.when(which.isNull(), s["seen"]).when(again, F.concat(F.slice(s["seen"], 1, F.size(s["seen"]) - 1), here)).otherwise(F.concat(s["seen"], here))
        on = F.struct((_held(s["lead"], cost) + m).alias("lead"), (s["n"] + 1).alias("n"), (s["col"] + 1).alias("col"), seen.alias("seen"))
        return F.when(m.isNull(), F.struct(s["lead"].alias("lead"), s["n"].alias("n"), (s["col"] + 1).alias("col"), s["seen"].alias("seen"))).otherwise(on)

    places = entered.select(*keys, F.inline(F.aggregate("m", begin, pass_)["seen"]))
    size = pairs.select(*keys, F.length("a").alias("col"))
    ends = summed.join(size, keys).select(*keys, (F.col("s.lead") > 0).alias("conserved"), "col", F.col("s.n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("col")
    runs = places.unionAll(ends).withColumn("_next", F.lead("conserved").over(order)).where("_next is null or _next <> conserved")
    runs = runs.withColumn("start", F.coalesce(F.lag("col").over(order), F.lit(0))).withColumn("_n", F.coalesce(F.lag("n").over(order), _long(0)))
    found = runs.where("conserved").select(*keys, "start", F.col("col").alias("end"), (F.col("n") - F.col("_n")).alias("n")).where("n > 0")
    # Columns with a gap in both rows, at either end, are no part of a region.
    both = pairs.select(*keys, "a", "b").join(found, keys)
    cut = lambda c: F.substring(F.col(c), F.col("start") + 1, F.col("end") - F.col("start"))
    open_ = lambda f: F.least(*[F.length(F.regexp_extract(cut(c), f, 0)) for c in "ab"])
    return both.select(*keys, (F.col("start") + open_("^-*")).alias("start"), (F.col("end") - open_("-*$")).alias("end"), "n")


def alignment_score(rows: DataFrame, percent: int = 70, gap: int = -50, bounds: str = "union", tile: int = TILE) -> DataFrame:
    """aln, score, start, end: conserved columns over all pairs of rows, and their bounds.

    ``bounds`` "union" is from the first conserved column of any pair to the last, "intersection" from the
    last first one to the first last one (which may be no columns at all). Pairs without conserved
    columns have no bounds; an alignment without any is scored 0, from 0 to its end.
    """
    if bounds not in ("union", "intersection"):
        raise ValueError("bounds are a union or an intersection")
    pairs = row_pairs(rows)
    found = conserved_regions(pairs, ["aln", "row", "r_row"], percent, gap, tile)
    each = found.groupBy("aln", "row", "r_row").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    low, high = (F.min, F.max) if bounds == "union" else (F.max, F.min)
    total = each.groupBy("aln").agg(F.sum("n").alias("score"), low("start").alias("start"), high("end").alias("end"))
    size = rows.groupBy("aln").agg(F.max(F.length("body")).alias("size"))
    return size.join(total, "aln", "left").select("aln", F.coalesce("score", _long(0)).alias("score"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", "size").alias("end"))


def cropped_rows(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """The rows (aln, row, body) between the bounds of ``alignment_score``; empty where there are none."""
    width = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    return rows.join(scored, "aln").select("aln", "row", F.substring("body", F.col("start") + 1, width).alias("body"))


__all__ = ["alignment_score", "conserved_regions", "cropped_rows", "row_pairs", "scores"]
