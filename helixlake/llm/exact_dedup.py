"""Exact dedup by progressive refinement, on DataFrame functions alone.

Rows are first told apart by their length in bytes, then by a hash of a short
prefix, and only rows that still share both are told apart by the digest of their
whole text. Each round counts its groups with a partial sum before the shuffle, so a group that
holds a third of all rows arrives as one row per task, and the joins that carry
the counts back are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a null text is an empty one.
    The row with the largest id of a group stays. A null id is smaller than any
    other. Rows that repeat with the same id and text form one group, of which
    one row is kept. Other columns of the input are neither read nor returned.
    An empty table gives an empty one. Without ``digest_all`` the digest is null
    for rows that a length or prefix already tells from all others, as their
    texts are never read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.col("_text"), 256).alias("text_sha256")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"),
    )
    both = ["_len", "_prefix"]
    copies = F.count(F.lit(1)).alias("_copies")
    if digest_all:
        # Every digest is asked for, so it is taken where the text is read and no text
        # is moved. Equal rows become one with a count, so that one can stay.
        keys = written(rows.select("_id", *both, digest).groupBy("_id", *both, "text_sha256").agg(copies), "exact-keys")
    else:
        keys = rows.select("_id", *both, F.lit(1).cast("long").alias("_copies"))

    # Round 1: lengths that several rows have.
    # (Each round's groups are written: the joins then shuffle both sides themselves, and
    # adaptive execution can split a hot key or broadcast a table that turns out small.)
    lengths = written(keys.groupBy("_len").agg(F.sum("_copies").alias("_n")).where("_n > 1").select("_len"), "exact-lengths")
    # Round 2: among those, prefixes that several rows have.
    shared = keys.select(*both, "_copies").join(lengths, "_len", "left_semi").groupBy(*both).agg(F.sum("_copies").alias("_n"))
    prefixes = written(shared.where("_n > 1").select(*both), "exact-prefixes")
    forget(lengths)
    # Round 3: whole texts of the rows that are left.
    if digest_all:
        alike = keys.join(prefixes, both, "left_semi")
        alone = keys.join(prefixes, both, "left_anti")
    else:
        left = rows.join(prefixes, both, "left_semi").select("_id", *both, digest).groupBy("_id", *both, "text_sha256").agg(copies)
        alike = written(left, "exact-keys")
        alone = keys.join(prefixes, both, "left_anti").withColumn("text_sha256", F.lit(None).cast("string"))
    groups = alike.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("_id").alias("_keep"), F.sum("_copies").alias("_size")).where("_size > 1")
    groups = written(groups, "exact-groups")
    # Rows that are alone go past the join, which has the digests of the others alone.
    met = alike.join(groups, F.col("text_sha256") == F.col("_sha"), "left").select(
        "_id", F.when(F.col("_sha").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", "_copies").alias("group_size"), "text_sha256", "_copies"
    )
    lone = alone.select("_id", F.col("_id").alias("keep_id"), F.col("_copies").alias("group_size"), "text_sha256", "_copies")
    return (
        met.unionAll(lone)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            ((F.col("_copy") == 1) & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns and each once.

    A row stays if it is the kept row of its group. Rows that repeat with the
    same id and text are the same document: one of them stays, that whose columns
    as JSON come first. Null texts are empty ones and a null id is an id like any
    other; an empty table gives an empty one. Texts of any length are digested whole.
    """
    decided = exact_dedup(docs, id_col, text_col, digest_all=True)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    lost = written(
        decided.where(F.col("group_size") > 1)
        .groupBy(key(id_col).alias("key"), F.col("text_sha256").alias("sha"))
        .agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("all"))
        .where("kept < all")
        .select("key", "sha", (F.col("kept") > 0).alias("some")),
        "exact-lost",
    )
    # The row goes through as a struct, so no column of it can clash with these.
    rows = docs.select(F.struct("*").alias("row"), key(id_col).alias("key"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    # The keys of the rows that go follow the input. A merge join keeps one plan at every size:
    # each text is moved once, where a broadcast would give way to this at some size anyway.
    single = rows.join(lost.select("key", "sha").hint("merge"), ["key", "sha"], "left_anti").select("row.*")
    repeated = lost.where("some")
    if repeated.isEmpty():
        return single
    first = rows.join(repeated.select("key", "sha"), ["key", "sha"], "left_semi").groupBy("key", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionAll(first.select("row.*"))
