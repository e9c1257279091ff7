"""Sequence tables derived from general tables, for queries that have no FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement


def sequences_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, file_idx, description, seq: the letters A, C, G, T of each text.

    Every fifth text is reverse-complemented, so that both strands matter, and
    odd ids are the assembly side.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    bases = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]+", "")
    return docs.select(
        F.col("doc_id").cast("int").alias("chr"),
        (F.col("doc_id") % 2).cast("int").alias("file_idx"),
        F.concat(F.lit("gi|"), F.col("doc_id").cast("string"), F.lit("|"), F.col("source"), F.lit("|d"), F.col("doc_id").cast("string"), F.lit(".1|")).alias("description"),
        F.when(F.col("doc_id") % 5 == 0, reverse_complement(bases)).otherwise(bases).alias("seq"),
    )


def intervals_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, block_id, start, end, sign at a larger scale than documents give."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.col("l_orderkey") % 5000
    return line.select(
        F.col("l_suppkey").alias("seq_id"),
        F.col("l_partkey").alias("block_id"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"),
    )


def aligned_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, a, b: each sequence against itself with substitutions and gaps at fixed places."""
    seqs = sequences_from_documents(spark, sf_dir).where("length(seq) > 0")
    letters = F.split("seq", "")
    a = F.transform(letters, lambda c, i: F.when((i + 1) % 307 == 0, F.lit("-")).otherwise(c))
    b = F.transform(letters, lambda c, i: F.when((i + 1) % 97 == 0, F.translate(c, "ACGT", "CGTA")).when((i + 1) % 211 == 0, F.lit("-")).otherwise(c))
    return seqs.select(F.col("chr").cast("long").alias("pair_id"), F.array_join(a, "").alias("a"), F.array_join(b, "").alias("b"))


def pairs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, a, b: the aligned sequences without their gaps; of every third pair b is on the other strand."""
    free = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    other = F.when(F.col("pair_id") % 3 == 0, reverse_complement(free("b"))).otherwise(free("b"))
    return aligned_from_documents(spark, sf_dir).select("pair_id", free("a").alias("a"), other.alias("b"))


#: The length of the sequences that blocks_from_lineitem lies on.
BLOCK_SPACE = 100_100


def blocks_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block instances that do not overlap, on one sequence per supplier.

    Short intervals are spread over each sequence; of intervals that touch, the
    island they make is one instance with the id of its first.
    """
    from ..operators.intervals import islands

    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 811 + F.col("l_partkey") * 7) % 100_000
    base = line.select(
        F.col("l_suppkey").alias("seq_id"),
        (F.col("l_partkey") % 4000 + 1).alias("block_id"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") % 30 + 20).alias("end"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"),
    )
    lone = islands(base, ["seq_id"], "start", "end").select("seq_id", "island_start", "island_end")
    first = base.groupBy("seq_id", "start").agg(F.min(F.struct("block_id", "sign")).alias("m"))
    return lone.join(first, (lone.seq_id == first.seq_id) & (lone.island_start == first.start)).select(
        F.col("m.block_id").cast("int").alias("block_id"),
        F.col("m.sign").alias("sign"),
        lone.seq_id.cast("int").alias("chr"),
        F.col("island_start").cast("int").alias("start"),
        F.col("island_end").cast("int").alias("end"),
    )


def blocks_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block instances with every kind of neighbourhood, on a reference (even) and an assembly (odd) sequence for each 256 orders.

    An order is a block with one instance on either side, in the same order but for a
    stretch that the assembly has inverted: unique blocks, which can be glued. Every
    eleventh order is one of three repeats instead, the one after it is on neither side,
    and the next is on the assembly twice. Block 4 is once on every sequence.
    """
    k, i = F.col("o_orderkey"), F.col("o_orderkey") % 256
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.floor(k / 256).alias("g"), i.alias("i"), (k % 11).alias("kind"), (40 + k % 30).alias("size"))
    inverted = F.col("i").between(64, 127)
    rows = rows.withColumn("id", F.when(F.col("kind") == 0, 1 + F.col("k") % 3).otherwise(10 + F.col("k")))
    at = lambda sign, side, start: F.struct(F.col("id").alias("id"), sign.alias("sign"), (2 * F.col("g") + side).alias("chr"), start.alias("start"), (start + F.col("size")).alias("end"))
    one = F.lit(1)
    moved = F.when(inverted, 191 - F.col("i")).otherwise(F.col("i"))
    there = [at(one, 0, 100 * F.col("i") + 50), at(F.when(inverted, -1).otherwise(1), 1, 100 * moved + 55), F.when(F.col("kind") == 2, at(one, 1, 25700 + 100 * F.col("i")))]
    placed = rows.where("kind <> 1").select(F.inline(F.filter(F.array(*there), lambda x: x.isNotNull())))
    every = rows.select("g").distinct().select(F.lit(4).alias("id"), F.lit(1).alias("sign"), F.explode(F.array(2 * F.col("g"), 2 * F.col("g") + 1)).alias("chr"), F.lit(0).alias("start"), F.lit(40).alias("end"))
    return placed.unionByName(every).select(F.col("id").cast("int").alias("block_id"), "sign", *[F.col(c).cast("int") for c in ("chr", "start", "end")])
