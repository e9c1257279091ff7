"""FASTA and other text formats as DataFrames; parsing runs on the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABET
from ..session import stored


def read_fasta(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """chr, file_idx, description, seq of all records of all files, in order.

    Records are split at lines that start with ``>`` by the reader itself, so a
    file is read in parallel. A description ends at the first blank (the first
    white space if not ``strict``). Strict reading upper-cases letters and stops at
    letters beyond the alphabet, at an empty description or an empty sequence, and
    at letters before the first header.
    """
    if not paths:
        raise ValueError("no file is named")
    rows = None
    for i, path in enumerate(paths):
        text = spark.read.option("lineSep", "\n>").text(path)
        own = text.select(F.lit(i).alias("file_idx"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    rows = stored(rows, "fasta")
    first = F.row_number().over(Window.partitionBy("file_idx").orderBy("at")) == 1
    rows = rows.withColumn("first", F.col("at") == F.min("at").over(Window.partitionBy("file_idx"))) if strict else rows.withColumn("first", first)
    body = F.when(F.col("first"), F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))
    parts = rows.withColumn("bad_start", F.col("first") & ~F.col("value").rlike(r"^\s*>")).withColumn("record", body).where(F.trim("record") != "")
    header = F.substring_index("record", "\n", 1)
    lines = F.when(F.instr("record", "\n") > 0, F.substring(F.col("record"), F.instr("record", "\n") + 1, F.length("record"))).otherwise(F.lit(""))
    seq = F.regexp_replace(lines, r"\s", "")
    records = parts.select(
        "file_idx", "at", "bad_start", (F.substring_index(header, " ", 1) if strict else F.regexp_extract(header, r"^\s*(\S*)", 1)).alias("description"), (F.upper(seq) if strict else seq).alias("seq")
    )
    if strict:
        stop = (
            F.when(F.col("bad_start"), F.lit("letters before the first header"))
            .when(F.col("description") == "", F.lit("a header is empty"))
            .when(F.col("seq") == "", F.concat(F.lit("an empty sequence: "), "description"))
            .when(F.col("seq").rlike(f"[^{ALPHABET}]"), F.concat(F.lit("illegal letter "), F.regexp_extract("seq", f"([^{ALPHABET}])", 1), F.lit(" in "), F.col("description")))
        )
        records = records.withColumn("seq", F.when(stop.isNotNull(), F.raise_error(stop).cast("string")).otherwise(F.col("seq")))
    return _numbered(records)


def _numbered(records: DataFrame) -> DataFrame:
    from ..operators.kmers import numbered

    kept = stored(records.select("file_idx", "at", "description", "seq"), "records")
    ids = numbered(kept.select(F.struct("file_idx", "at").alias("k")), "k", "n")
    return kept.join(ids.select(F.col("k.file_idx").alias("file_idx"), F.col("k.at").alias("at"), F.col("n").cast("int").alias("chr")), ["file_idx", "at"]).select("chr", "file_idx", "description", "seq")


def read_hits(lines: DataFrame) -> DataFrame:
    """Lines ``name s e; name s e; score = x (strand)`` to hits with both names."""
    p = r"^\s*(\S+)\s+(\d+)\s+(\d+);\s*(\S+)\s+(\d+)\s+(\d+);\s*score\s*=\s*([-0-9.eE+]+)\s*\(([+-])\)"
    get = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(get(1).alias("name1"), get(2).cast("int").alias("s1"), get(3).cast("int").alias("e1"), get(4).alias("name2"), get(5).cast("int").alias("s2"), get(6).cast("int").alias("e2"), get(7).cast("double").alias("score"), get(8).alias("strand"))


def read_anchors(lines: DataFrame) -> DataFrame:
    """Lines ``(s1 e1)=(s2 e2) score``."""
    p = r"^\((\d+) (\d+)\)=\((\d+) (\d+)\)\s*([-0-9.eE+]*)"
    get = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(*[get(i + 1).cast("int").alias(c) for i, c in enumerate(("s1", "e1", "s2", "e2"))], F.nullif(get(5), F.lit("")).cast("double").alias("score"))


def read_permutations(lines: DataFrame) -> DataFrame:
    """Records ``>name`` and ``+1 -2 $`` (one text each, split at ``>``) to name, permutation."""
    name = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", ""))
    body = F.regexp_extract_all("value", F.lit(r"([+-]\d+)"), F.lit(1))
    return lines.where(F.trim("value") != "").select(name.alias("name"), F.transform(body, lambda x: x.cast("int")).alias("permutation"))


def read_karyotype(lines: DataFrame) -> DataFrame:
    """Lines ``chr - name header 0 size colour`` to header, name."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(f) > 3).select(F.element_at(f, 4).alias("header"), F.element_at(f, 3).alias("name"))


def read_block_coordinates(lines: DataFrame) -> DataFrame:
    """Sections ``Block #n`` with rows of a coordinates file (one text each) to blocks."""
    block = F.regexp_extract("value", r"Block #(\d+)", 1)
    row = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+\t[+-]\t\d+\t\d+\t\d+)$"), F.lit(1)))
    rows = lines.where(block != "").select(block.cast("int").alias("block_id"), row.alias("r")).withColumn("f", F.split("r", "\t"))
    a, b = F.get("f", 2).cast("int"), F.get("f", 3).cast("int")
    return rows.select("block_id", F.when(F.get("f", 1) == "+", 1).otherwise(-1).alias("sign"), (F.get("f", 0).cast("int") - 1).alias("chr"), (F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("end"))


def read_key_values(column):
    """A header ``a=1,b='x'`` to a map; quotes are dropped."""
    return F.str_to_map(F.regexp_replace(column, "[\"']", ""), F.lit(","), F.lit("="))


def reference_accession(header_lines: DataFrame) -> DataFrame:
    """The accession that a VCF header's ##reference line names."""
    return header_lines.where(F.col("value").startswith("##reference")).select(F.regexp_extract("value", r"([A-Z]{1,2}_?[0-9]+)", 1).alias("accession"))


def read_matrix(text: str) -> tuple[dict[tuple[str, str], int], int, int]:
    """A substitution matrix with its letters on top, then gap open and extend."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    letters = lines[0]
    scores = {(r[0], c): int(v) for r in lines[1 : 1 + len(letters)] for c, v in zip(letters, r[1:], strict=True)}
    rest = [int(x) for line in lines[1 + len(letters) :] for x in line]
    return scores, rest[0] if rest else -1500, rest[1] if len(rest) > 1 else -50
