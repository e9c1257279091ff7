"""Text sinks: each builds a table of lines, in order, that ``save`` writes as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import accession, conventional_end, conventional_start, wrapped
from ..operators import reports
from ..operators.postprocess import permutations

RULE = "-" * 80


def save(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Writes the column ``value``; with ``order`` the lines are sorted over all files."""
    rows = lines.orderBy(*order) if order else lines
    rows.select("value").write.mode("overwrite").text(path)


def fasta_lines(seqs: DataFrame, width: int = 80) -> DataFrame:
    return seqs.select("chr", F.concat(F.lit(">"), "description", F.lit("\n"), wrapped("seq", width)).alias("value"))


def coordinate_lines(blocks: DataFrame) -> DataFrame:
    """One text per block: its heading, its instances by sequence, a rule."""
    row = F.concat_ws("\t", (F.col("chr") + 1).cast("string"), F.when(F.col("sign") > 0, "+").otherwise("-"), conventional_start("sign", "start", "end").cast("string"), conventional_end("sign", "start", "end").cast("string"), (F.col("end") - F.col("start")).cast("string"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chr", "start", row.alias("row")))), lambda x: x["row"]), "\n")
    heading = F.concat(F.lit("Block #"), F.col("block_id").cast("string"), F.lit("\nSeq_id\tStrand\tStart\tEnd\tLength\n"))
    return blocks.groupBy("block_id").agg(body.alias("body")).select("block_id", F.concat(heading, "body", F.lit("\n" + RULE)).alias("value"))


def gff_lines(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    g = reports.gff(blocks, seqs)
    return g.select(F.col("seqname"), F.col("start"), F.concat_ws("\t", *[F.col(c).cast("string") for c in g.columns]).alias("value"))


def permutation_lines(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    p = permutations(blocks).join(seqs.select("chr", "description"), "chr")
    ids = F.array_join(F.transform("permutation", lambda x: F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), x.cast("string"))), " ")
    return p.select("chr", F.concat(F.lit(">"), "description", F.lit("\n"), ids, F.lit(" $")).alias("value"))


def block_fasta_lines(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    return reports.block_sequences(blocks, seqs).select("block_id", "chr", "start", F.concat(F.lit(">"), "header", F.lit("\n"), "body").alias("value"))


def sam_lines(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    s = reports.sam(blocks, seqs)
    return s.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in s.columns]).alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """The whole graph in DOT: ``part`` orders head, edges and foot."""
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph G\n{\nrankdir=LR"), (2, "}")], "part int, value string")
    return ends.unionByName(reports.dot_edges(edges).select(F.lit(1).alias("part"), "value"))


def circos_link_lines(blocks: DataFrame) -> DataFrame:
    part = lambda i: F.concat_ws(" ", F.concat(F.lit("seq"), (F.col(f"chr{i}") + 1).cast("string")), F.col(f"start{i}").cast("string"), F.col(f"end{i}").cast("string"))
    return reports.links(blocks).select("link_id", F.concat_ws("\n", F.concat_ws(" ", "link_id", part(1)), F.concat_ws(" ", "link_id", part(2))).alias("value"))


def circos_config(n_stages: int, width: int = 75) -> str:
    """Rings for the stages, each a band further out, as text of a Circos configuration."""
    rings = "\n".join(f"<highlight>\nfile = stage{i}.txt\nr0 = 1r + {width * i}p\nr1 = 1r + {width * (i + 1)}p\n</highlight>" for i in range(n_stages))
    return f"karyotype = karyotype.txt\n<ideogram>\nradius = 0.7r\nthickness = 20p\n</ideogram>\n<links>\n<link>\nfile = links.txt\nradius = 0.99r\n</link>\n</links>\n<highlights>\n{rings}\n</highlights>\n"


def vcf_header(reference: str) -> str:
    return "\n".join(
        [
            "##fileformat=VCFv4.1",
            "##source=helixlake",
            f"##reference={reference}",
            '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
            '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="Imprecise structural variation">',
            '##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="Confidence interval around POS for imprecise variants">',
            "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
        ]
    )


def vcf_lines(variants: DataFrame, seqs: DataFrame, reference: str, breakends: DataFrame | None = None) -> DataFrame:
    """Header, breakend records and variants; missing values are dots. To be sorted by part, id, pos.

    A record names its sequence by the accession in its description; ``id`` is the whole
    description, by which records are ordered.
    """
    spark = variants.sparkSession
    dot = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))
    rows = variants.join(seqs.select("chr", F.col("description").alias("id")), "chr", "left")
    record = F.concat_ws("\t", dot(accession("id")), dot(F.col("pos")), F.lit("."), dot(F.col("ref")), dot(F.col("alt")), F.lit("."), F.lit("."), F.lit("."))
    head = spark.createDataFrame([(0, None, None, vcf_header(reference))], "part int, id string, pos int, value string")
    lines = head.unionByName(rows.select(F.lit(2).alias("part"), "id", F.col("pos").cast("int").alias("pos"), record.alias("value")))
    if breakends is not None:
        mate = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("id"), "ref", "alt", F.lit("."), F.lit("."), "info")
        lines = lines.unionByName(breakends.select(F.lit(1).alias("part"), "id", "pos", mate.alias("value")))
    return lines


def unplaced_fasta_lines(unplaced: DataFrame, seqs: DataFrame, width: int = 60) -> DataFrame:
    """Insertions without a place on the reference, one FASTA record each; the heading's quotes are the format's."""
    rows = unplaced.join(seqs.select(F.col("chr").alias("contig"), F.col("description").alias("id")), "contig", "left")
    start, end = (F.col("assembly_pos") + 1).cast("string"), (F.col("assembly_pos") + F.length("alt")).cast("string")
    heading = F.concat(F.lit('>Seq="'), F.coalesce("id", F.lit(".")), F.lit('",Start='), start, F.lit('",End='), end)
    return rows.select("id", "assembly_pos", F.concat(heading, F.lit("\n"), wrapped("alt", width)).alias("value"))


def unplaced_table_lines(unplaced: DataFrame, seqs: DataFrame) -> DataFrame:
    """The same insertions as a table with a heading. To be sorted by part, id, assembly_pos."""
    rows = unplaced.join(seqs.select(F.col("chr").alias("contig"), F.col("description").alias("id")), "contig", "left")
    record = F.concat_ws("\t", F.coalesce("id", F.lit(".")), (F.col("assembly_pos") + 1).cast("string"), "alt")
    head = unplaced.sparkSession.createDataFrame([(0, None, None, "SEQ_ID\tPOS\tFRAGMENT")], "part int, id string, assembly_pos int, value string")
    return head.unionByName(rows.select(F.lit(1).alias("part"), "id", F.col("assembly_pos").cast("int").alias("assembly_pos"), record.alias("value")))


def maf_lines(rows: DataFrame) -> DataFrame:
    """Alignment rows (block_id, name, start, strand, size, body) as MAF blocks.

    On the negative strand a start counts from the other end.
    """
    length = F.length(F.replace("body", F.lit("-"), F.lit("")))
    start = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("size") - F.col("start") - length)
    line = F.concat_ws(" ", F.lit("s"), "name", start.cast("string"), length.cast("string"), "strand", F.col("size").cast("string"), "body")
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return rows.groupBy("block_id").agg(body.alias("b")).select("block_id", F.concat(F.lit("a\n"), "b", F.lit("\n")).alias("value"))


def xmfa_lines(rows: DataFrame, width: int = 80) -> DataFrame:
    """The same rows as XMFA: ``>name:start-end strand``, the body, and ``=`` after a block."""
    end = F.col("start") + F.length(F.replace("body", F.lit("-"), F.lit("")))
    one = F.concat(F.lit(">"), "name", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), "strand", F.lit("\n"), wrapped("body", width))
    return rows.groupBy("block_id").agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("b")).select("block_id", F.concat("b", F.lit("\n=")).alias("value"))


def hit_lines(hits: DataFrame) -> DataFrame:
    return hits.select(F.format_string("%s %d %d; %s %d %d; score = %.6f (%s)", "name1", "s1", "e1", "name2", "s2", "e2", "score", "strand").alias("value"))


def anchor_lines(hits: DataFrame) -> DataFrame:
    return hits.select("pair_id", "s1", F.format_string("(%d %d)=(%d %d) %.6f", "s1", "e1", "s2", "e2", "score").alias("value"))


def dotplot_lines(hits: DataFrame) -> DataFrame:
    """gnuplot arrows, one per hit."""
    return hits.select(F.format_string("set arrow from %d,%d to %d,%d nohead", "s1", "s2", "e1", "e2").alias("value"))


def split_by_sequence(seqs: DataFrame, path: str) -> None:
    """One folder per sequence."""
    fasta_lines(seqs).write.mode("overwrite").partitionBy("chr").text(path)


__all__ = [n for n in dir() if n.endswith("_lines") or n in ("save", "circos_config", "vcf_header", "split_by_sequence")]
