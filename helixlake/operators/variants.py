"""Variants from aligned rows and from what blocks do not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import conventional_end, conventional_start, reverse_complement, without_gaps
from ..session import stored, unsent
from .intervals import complement
from .kmers import _tiles
from .postprocess import unique_blocks

#: Fixed value: matches shorter than this between differences belong to one variant.
CONTEXT = 30


def columns(pairs: DataFrame) -> DataFrame:
    """(pair_id, a, b) to one row per column: pair_id, col, x, y, same, ref_offset.

    ``ref_offset`` counts the letters of a before the column.
    """
    both = F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    rows = pairs.where("length(a) > 0").select("pair_id", F.posexplode(both).alias("col", "c")).select("pair_id", "col", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    before = Window.partitionBy("pair_id").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("same", F.col("x") == F.col("y")).withColumn("ref_offset", F.coalesce(F.sum((F.col("x") != "-").cast("long")).over(before), F.lit(0)))


def runs(cols: DataFrame) -> DataFrame:
    """Maximal runs of equal or of different columns: pair_id, start, end, same."""
    order = Window.partitionBy("pair_id").orderBy("col")
    turn = F.coalesce(F.col("same") != F.lag("same").over(order), F.lit(True)).cast("int")
    numbered = cols.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("pair_id", "_run").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("end"), F.first("same").alias("same")).drop("_run")


def segments(cols: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Runs with short matches inside absorbed: pair_id, start, end, same.

    A match shorter than ``context`` joins the differences around it, unless it is
    the first run or the last.
    """
    found = runs(cols)
    order = Window.partitionBy("pair_id").orderBy("start")
    inner = F.col("same") & (F.col("end") - F.col("start") < context) & (F.col("start") > 0) & F.lead("start").over(order).isNotNull()
    joined = found.withColumn("same", F.when(inner, F.lit(False)).otherwise(F.col("same")))
    turn = F.coalesce(F.col("same") != F.lag("same").over(order), F.lit(True)).cast("int")
    marked = joined.withColumn("_turn", turn).withColumn("_seg", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("pair_id", "_seg").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("same").alias("same")).drop("_seg")


def from_alignments(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Variants of b against a: pair_id, offset, ref, alt, before, after.

    ``offset`` is where the reference allele starts, in letters of a. A single
    substitution stands alone; other variants take the letter before them along,
    if there is one. Contexts are up to ``context`` columns of a on either side.
    """
    seg = segments(columns(pairs), context)
    order = Window.partitionBy("pair_id").orderBy("start")
    around = seg.withColumn("p_start", F.lag("start").over(order)).withColumn("p_end", F.lag("end").over(order)).withColumn("n_start", F.lead("start").over(order)).withColumn("n_end", F.lead("end").over(order))
    rows = around.where("not same").join(pairs, "pair_id")
    cut = lambda s, a, b: F.substring(s, a + 1, b - a)
    lone = (F.col("end") - F.col("start") == 1) & (cut("a", F.col("start"), F.col("end")) != "-") & (cut("b", F.col("start"), F.col("end")) != "-")
    shift = F.when((F.col("start") == 0) | lone, 0).otherwise(1)
    rows = rows.withColumn("shift", shift).withColumn("from", F.col("start") - F.col("shift"))
    left = F.coalesce(cut("a", F.greatest("p_start", F.col("p_end") - context), F.col("p_end")), F.lit(""))
    right = F.coalesce(cut("a", F.col("n_start"), F.least("n_end", F.col("n_start") + context)), F.lit(""))
    offset = F.length(without_gaps(F.substring("a", F.lit(1), F.col("start")))) - F.col("shift")
    return rows.select(
        "pair_id",
        offset.cast("int").alias("offset"),
        without_gaps(cut("a", F.col("from"), F.col("end"))).alias("ref"),
        without_gaps(cut("b", F.col("from"), F.col("end"))).alias("alt"),
        left.alias("before"),
        right.alias("after"),
    )


def block_alignments(blocks: DataFrame, seqs: DataFrame, min_size: int, aligner) -> DataFrame:
    """Unique blocks with both instances aligned, the reference read on the positive strand.

    ``aligner`` takes (pair_id, a, b) and returns them with gaps.
    """
    unique = unique_blocks(blocks, seqs, min_size)
    text = lambda p: F.substring(f"{p}_seq", F.col(f"{p}_start") + 1, F.col(f"{p}_end") - F.col(f"{p}_start"))
    rows = unique.join(seqs.select(F.col("chr").alias("r_chr"), F.col("seq").alias("r_seq")), "r_chr").join(seqs.select(F.col("chr").alias("a_chr"), F.col("seq").alias("a_seq")), "a_chr")
    pairs = rows.select(F.col("block_id").cast("long").alias("pair_id"), text("r").alias("a"), F.when(F.col("a_sign") > 0, text("a")).otherwise(reverse_complement(text("a"))).alias("b"))
    return aligner(pairs).select("pair_id", "a", "b").join(unique.select(F.col("block_id").cast("long").alias("pair_id"), "r_chr", "r_start", "a_chr"), "pair_id")


def copy_alignments(blocks: DataFrame, seqs: DataFrame, min_size: int) -> DataFrame:
    """Blocks that are not unique, all their instances aligned at once, each read on its own strand.

    block_id, row, chr, start, end, sign, body; ``row`` numbers a block's instances by place.
    One task aligns one block; more than 63 instances are an error, as the aligner takes no more.
    """
    from .multiple import align_groups

    unique = unique_blocks(blocks, seqs, min_size).select("block_id")
    order = Window.partitionBy("block_id").orderBy("chr", "start", "end", "sign")
    rest = blocks.join(unique, "block_id", "left_anti").select("block_id", "chr", "start", "end", "sign").withColumn("row", F.row_number().over(order))
    own = F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start"))
    rows = rest.join(seqs.select("chr", "seq"), "chr").select(F.col("block_id").cast("long").alias("group_id"), "row", F.when(F.col("sign") > 0, own).otherwise(reverse_complement(own)).alias("seq"))
    body = align_groups(rows).withColumnRenamed("group_id", "block_id")
    return rest.withColumn("block_id", F.col("block_id").cast("long")).join(body, ["block_id", "row"])


def in_blocks(aligned: DataFrame) -> DataFrame:
    """Variants in reference coordinates (1-based) from ``block_alignments``."""
    found = from_alignments(aligned.select("pair_id", "a", "b"))
    return found.join(aligned.select("pair_id", "r_chr", "r_start", "a_chr"), "pair_id").select(
        F.col("r_chr").alias("chr"), (F.col("r_start") + F.col("offset") + 1).cast("int").alias("pos"), F.col("a_chr").alias("contig"), F.lit(None).cast("int").alias("assembly_pos"), "ref", "alt", F.col("pair_id").cast("int").alias("block_id")
    )


def two_sided(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """Instances of blocks that occur on the reference and on the assembly side."""
    sided = blocks.join(seqs.select("chr", "file_idx"), "chr")
    both = sided.groupBy("block_id").agg(F.countDistinct(F.col("file_idx") == 0).alias("n")).where("n = 2").select("block_id")
    return sided.join(unsent(both), "block_id")


def last_cover(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """For blocks with a column ``stage``: chr, start, end, block_id of each covered piece.

    Where pieces overlap the latest stage counts, then the largest block id.
    Boundaries cut a sequence into elementary pieces; each takes its last writer.
    """
    rows = two_sided(blocks, seqs).select("chr", "start", "end", "stage", "block_id")
    cuts = rows.select("chr", F.col("start").alias("at")).union(rows.select("chr", F.col("end").alias("at"))).distinct()
    order = Window.partitionBy("chr").orderBy("at")
    pieces = cuts.select("chr", F.col("at").alias("start"), F.lead("at").over(order).alias("end")).where("end is not null")
    from .intervals import range_join

    hit = range_join(pieces, rows, ["chr"], 4096)
    return hit.groupBy("chr", "start", "end").agg(F.max_by("r_block_id", F.struct("r_stage", "r_block_id")).alias("block_id"))


def uncovered(blocks: DataFrame, seqs: DataFrame, min_size: int) -> DataFrame:
    """chr, file_idx, gap_start, gap_end: runs longer than ``min_size`` outside all two-sided blocks."""
    extents = seqs.select("chr", F.length("seq").alias("size"))
    gaps = complement(two_sided(blocks, seqs).select("chr", "start", "end"), extents, ["chr"], min_size)
    return gaps.join(seqs.select("chr", "file_idx"), "chr")


def with_letters(rows: DataFrame, seqs: DataFrame, start: str, end: str, name: str, tile: int = 1 << 24) -> DataFrame:
    """``rows`` (chr, ...; all different) with the letters of their sequence from ``start`` to ``end`` as ``name``.

    Rows that start in one stretch of ``tile`` letters are one row when they meet their sequence, so
    that it is held once for them and not for each; no other column should be wide. Sequences are shuffled, to as
    many partitions as there are: Spark judges them by what they were made from, or by how well they compress.
    """
    keep = rows.columns
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = seqs.select("chr", F.col("seq").alias("_seq")).repartition(parts, "chr")
    many = rows.groupBy("chr", F.floor(F.col(start) / tile).alias("_tile")).agg(F.collect_list(F.struct(*keep)).alias("_rows"))
    met = many.repartition(parts, "chr").join(unsent(whole), "chr", "left")
    # A character of a string is counted for from its start, a byte is not.
    met = met.select("_rows", "_seq", F.col("_seq").cast("binary").alias("_raw"), (F.octet_length("_seq") == F.length("_seq")).alias("_ascii"))

    def cut(row):
        begin = F.greatest(row[start], F.lit(0))
        at, n = (begin + 1).cast("int"), F.greatest(row[end] - begin, F.lit(0)).cast("int")
        own = F.when(F.col("_ascii"), F.substring("_raw", at, n).cast("string")).otherwise(F.substring("_seq", at, n))
        return row.withField(name, F.coalesce(own, F.lit("")))

    return met.select(F.explode(F.transform("_rows", cut)).alias("_row")).select("_row.*").select(*keep, name)


def large_indels(blocks: DataFrame, seqs: DataFrame, min_size: int, last_stage: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, unplaced): deletions and insertions from uncovered segments.

    A reference segment is a deletion, anchored at the letter before it. An
    assembly segment is an insertion where the unique block that ends just before
    it ends on the reference (starts, if the strands differ); without one, or with
    no letter to anchor to, it stays unplaced.
    """
    main = blocks if last_stage is None else last_stage
    gaps = uncovered(blocks, seqs, min_size).withColumn("_from", F.greatest(F.col("gap_start") - 1, F.lit(0)))
    gaps = stored(with_letters(gaps, seqs, "_from", "gap_end", "letters"), "gaps")
    gap = F.when(F.col("gap_start") > 0, F.substring("letters", 2, (1 << 31) - 1)).otherwise(F.col("letters"))
    before = F.when(F.col("gap_start") > 0, F.substring("letters", 1, 1))
    none = F.lit(None).cast("int")
    deletion = gaps.where("file_idx = 0").select("chr", F.col("gap_start").cast("int").alias("pos"), none.alias("contig"), none.alias("assembly_pos"), F.col("letters").alias("ref"), before.alias("alt"), none.alias("block_id"))
    unique = unique_blocks(main, seqs, min_size)
    anchor = unique.select(F.col("a_chr").alias("chr"), F.col("a_end").cast("long").alias("gap_start"), "r_chr", F.when(F.col("a_sign") > 0, F.col("r_end")).otherwise(F.col("r_start")).alias("r_pos"))
    here = gaps.where("file_idx <> 0").select("chr", "gap_start", gap.alias("inserted")).join(unsent(anchor), ["chr", "gap_start"], "left")
    spot = here.where("r_pos > 0").select(F.col("r_chr").alias("chr"), "r_pos", F.col("chr").alias("contig"), "gap_start", "inserted")
    asked = anchor.where("r_pos > 0").select(F.col("r_chr").alias("chr"), "r_pos", (F.col("r_pos") - 1).alias("_before")).distinct()
    letter = F.col("_letter")
    insertion = spot.join(unsent(with_letters(asked, seqs, "_before", "r_pos", "_letter")), ["chr", "r_pos"]).select("chr", F.col("r_pos").cast("int").alias("pos"), "contig", F.col("gap_start").cast("int").alias("assembly_pos"), letter.alias("ref"), F.concat(letter, "inserted").alias("alt"), none.alias("block_id"))
    unplaced = here.where("r_pos is null or r_pos <= 0").select(F.col("chr").alias("contig"), F.col("gap_start").cast("int").alias("assembly_pos"), F.col("inserted").alias("alt"))
    return deletion.unionByName(insertion), unplaced


def breakends(unplaced: DataFrame, seqs: DataFrame, reference_name: str, first_base: str, reference_size: int) -> DataFrame:
    """Two imprecise records per unplaced insertion, at position 1 of the reference.

    Contigs go by their descriptions, and records by contig, place and letters.
    """
    from .kmers import numbered

    key = F.struct("contig", "assembly_pos", "alt")
    named = unplaced.join(seqs.select(F.col("chr").alias("contig"), "description"), "contig", "left")
    rows = numbered(named.withColumn("_k", key), "_k", "i").drop("_k")
    start, end = F.col("assembly_pos") + 1, F.col("assembly_pos") + 1 + F.length("alt")
    place = lambda p: F.concat(F.coalesce("description", F.col("contig").cast("string")), F.lit(":"), p.cast("string"))
    two = F.array(
        F.struct((F.col("i") * 2).alias("n"), F.concat(F.lit(first_base + "["), place(start), F.lit("[")).alias("alt")),
        F.struct((F.col("i") * 2 + 1).alias("n"), F.concat(F.lit("]"), place(end), F.lit("]" + first_base)).alias("alt")),
    )
    return rows.select(F.explode(two).alias("r")).select(
        F.lit(reference_name).alias("chrom"), F.lit(1).alias("pos"), F.concat(F.lit("bnd_"), F.col("r.n").cast("string")).alias("id"), F.lit(first_base).alias("ref"), F.col("r.alt").alias("alt"), F.lit(f"IMPRECISE;SVTYPE=BND;CIPOS=0,{reference_size}").alias("info")
    )


def assert_unique_ids(seqs: DataFrame) -> DataFrame:
    """The sequences, or an error naming a description that occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy("description"))
    ok = F.assert_true(F.col("_n") == 1, F.concat(F.lit("this id occurs twice: "), "description"))
    return seqs.withColumn("_n", n).where(ok.isNull()).drop("_n")


def signed_coordinates(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("c_start", conventional_start("sign", "start", "end")).withColumn("c_end", conventional_end("sign", "start", "end"))


__all__ = ["assert_unique_ids", "block_alignments", "breakends", "columns", "copy_alignments", "from_alignments", "in_blocks", "large_indels", "last_cover", "runs", "segments", "signed_coordinates", "two_sided", "uncovered"]
