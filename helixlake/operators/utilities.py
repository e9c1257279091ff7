"""Utilities on alignments, hits and contigs."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .intervals import islands
from .kmers import kmers


def projected(pairs: DataFrame) -> DataFrame:
    """The two rows without the columns in which both have a gap."""
    both = F.filter(F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y")), lambda c: ~((c["x"] == "-") & (c["y"] == "-")))
    rows = pairs.select("pair_id", both.alias("c"))
    return rows.select("pair_id", F.array_join(F.col("c.x"), "").alias("a"), F.array_join(F.col("c.y"), "").alias("b")).where("a <> '' or b <> ''")


def project_rows(aligned: DataFrame, wanted: list[str]) -> DataFrame:
    """aln, row, body: the rows of each alignment in ``wanted``, without columns in which they all have gaps.

    ``aligned`` has these columns, bodies of one alignment being equally long. The wanted rows
    of one alignment meet; letters beyond the end of a shorter body count as gaps.
    """
    own = aligned.where(F.col("row").isin(wanted)).groupBy("aln").agg(F.sort_array(F.collect_list(F.struct("row", F.filter(F.split("body", ""), lambda c: c != "").alias("letters")))).alias("rows"))
    letter = lambda r, i: F.coalesce(F.get(r["letters"], i), F.lit("-"))
    widest = F.array_max(F.transform("rows", lambda r: F.size(r["letters"])))
    columns = F.when(widest > 0, F.filter(F.sequence(F.lit(0), widest - 1), lambda i: F.exists("rows", lambda r: letter(r, i) != "-"))).otherwise(F.array().cast("array<int>"))
    cut = lambda at: F.transform("rows", lambda r: F.struct(r["row"].alias("row"), F.array_join(F.transform(at, lambda i: letter(r, i)), "").alias("body")))
    return own.select("aln", F.inline(F.get(F.transform(F.array(columns), cut), 0)))


def conserved_windows(cols: DataFrame, width: int, identity: float) -> DataFrame:
    """Runs of overlapping windows of ``width`` columns with at least that share of equal letters."""
    ahead = Window.partitionBy("pair_id").orderBy("col").rowsBetween(0, width - 1)
    hit = (F.col("same") & (F.col("x") != "-")).cast("int")
    counted = cols.withColumn("_h", F.sum(hit).over(ahead)).withColumn("_n", F.count(F.lit(1)).over(ahead))
    good = counted.where((F.col("_n") == width) & (F.col("_h") >= F.ceil(F.lit(width * identity - 1e-9)))).select("pair_id", F.col("col").alias("start"), (F.col("col") + width).alias("end"))
    return islands(good, ["pair_id"]).select("pair_id", F.col("island_start").alias("start"), F.col("island_end").alias("end"))


def letter_map(cols: DataFrame) -> DataFrame:
    """For every letter of a: its number, and how many letters b has up to that column (from 1)."""
    upto = Window.partitionBy("pair_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum((F.col(c) != "-").cast("long")).over(upto)
    return cols.withColumn("letter_a", count("x")).withColumn("letter_b", count("y")).where("x <> '-'").select("pair_id", "letter_a", "letter_b")


def extracted(cols: DataFrame, begin: int, end: int) -> DataFrame:
    """The letters of b in the columns in which a has its letters begin to end (from 1, inclusive)."""
    upto = Window.partitionBy("pair_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    rows = cols.withColumn("_a", F.sum((F.col("x") != "-").cast("long")).over(upto)).where(F.col("_a").between(begin, end) & (F.col("y") != "-"))
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("col", "y"))).alias("r")).select("pair_id", F.array_join(F.col("r.y"), "").alias("letters"))


def best_local_run(cols: DataFrame, match: int = 1, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """pair_id, best: the largest sum over a run of columns, 0 at least.

    A running sum minus its smallest value so far is the score that is reset at 0.
    """
    value = F.when((F.col("x") == "-") | (F.col("y") == "-"), gap).when(F.col("same"), match).otherwise(mismatch)
    upto = Window.partitionBy("pair_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    total = cols.withColumn("_v", value).withColumn("_c", F.sum("_v").over(upto))
    low = F.least(F.lit(0), F.min("_c").over(upto))
    return total.withColumn("_s", F.col("_c") - low).groupBy("pair_id").agg(F.max("_s").cast("long").alias("best"))


def bounds(hits: DataFrame) -> DataFrame:
    """The box around all hits of a pair."""
    return hits.groupBy("pair_id").agg(F.min("s1").alias("from1"), F.max("e1").alias("to1"), F.min("s2").alias("from2"), F.max("e2").alias("to2"))


def overlap_box(hits: DataFrame) -> DataFrame:
    """The box around all hits, or -1 four times if there are none."""
    box = hits.agg(F.min("s1").alias("from1"), F.max("e1").alias("to1"), F.min("s2").alias("from2"), F.max("e2").alias("to2"))
    return box.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in box.columns])


def not_contained(hits: DataFrame) -> DataFrame:
    """Hits that end, on the second sequence, after all that start before them there."""
    order = Window.partitionBy("pair_id").orderBy("s2", F.desc("e2"), "s1", F.desc("score"))
    reach = F.max("e2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("_r", reach).where("_r is null or e2 > _r").drop("_r")


def above_cutoff(hits: DataFrame, cutoff: float) -> DataFrame:
    return hits.where(F.col("score") >= cutoff)


def swapped(hits: DataFrame) -> DataFrame:
    """Hits with the roles of the two sequences exchanged."""
    names = {"s1": "s2", "e1": "e2", "s2": "s1", "e2": "e1"}
    return hits.select(*[F.col(names.get(c, c)).alias(c) for c in hits.columns])


def reflected(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Hits and their mirror images on the second sequence (pair_id, size2)."""
    rows = hits.withColumn("mirrored", F.lit(False))
    back = hits.join(sizes, "pair_id").select(*[(F.col("size2") - F.col("e2") if c == "s2" else F.col("size2") - F.col("s2") if c == "e2" else F.col(c)).alias(c) for c in hits.columns], F.lit(True).alias("mirrored"))
    return rows.unionByName(back)


def in_regions(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """Hits inside a region of their pair (pair_id, a1, b1, a2, b2)."""
    return hits.join(regions, "pair_id").where("s1 >= a1 and e1 <= b1 and s2 >= a2 and e2 <= b2").select(*hits.columns).distinct()


def open_boxes(chain: DataFrame, least_area: int = 10, least_side: int = 5) -> DataFrame:
    """The boxes before each anchor of a chain that are worth another search."""
    order = Window.partitionBy("pair_id").orderBy("s1")
    rows = chain.select("pair_id", F.coalesce(F.lag("e1").over(order), F.lit(0)).alias("f1"), F.col("s1").alias("t1"), F.coalesce(F.lag("e2").over(order), F.lit(0)).alias("f2"), F.col("s2").alias("t2"))
    w, h = F.col("t1") - F.col("f1"), F.col("t2") - F.col("f2")
    return rows.where((w > least_side) & (h > least_side) & (w * h >= least_area))


def strand_summary(hits: DataFrame) -> DataFrame:
    """Counts of hits, minus-strand hits, strand switches and jumps back along the first sequence."""
    order = Window.partitionBy("pair_id").orderBy("s1", "s2", "e1", "e2", "score", "strand")
    rows = hits.withColumn("_b", F.lag("strand").over(order)).withColumn("_p", F.lag("s2").over(order))
    return rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strand") == "-").alias("n_minus"), F.count_if(F.col("_b") != F.col("strand")).alias("n_switches"), F.count_if(F.col("s2") < F.col("_p")).alias("n_jumps_back"))


def word_matches(seqs: DataFrame, k: int) -> DataFrame:
    """Words that occur on both sides: how often on each, and how many pairs that makes.

    Counts are summed before the shuffle; the pairs themselves are never listed.
    """
    words = kmers(seqs, k).where("strand = 0").select("chr", "kmer").join(seqs.select("chr", "file_idx"), "chr")
    found = words.groupBy(F.col("kmer").alias("word")).agg(F.count_if(F.col("file_idx") == 0).alias("n0"), F.count_if(F.col("file_idx") != 0).alias("n1"))
    return found.where("n0 > 0 and n1 > 0").withColumn("n_pairs", F.col("n0") * F.col("n1"))


def seed_values(seqs: DataFrame, k: int) -> DataFrame:
    """word, n, value: what a letter of each word is worth, the more the rarer it is."""
    words = kmers(seqs, k).where("strand = 0").groupBy(F.col("kmer").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    places = seqs.agg(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0))).cast("long").alias("places"))
    return words.crossJoin(F.broadcast(places)).select("word", "n", F.round(F.log(F.col("places") / F.col("n")) / k, 6).alias("value"))


def cut_ranges(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(chr, from_, to_, flip) to chr, from_, n, cut: parts of sequences, reversed on demand."""
    rows = ranges.join(seqs.select("chr", "seq"), "chr").where(F.length("seq") > F.col("from_"))
    part = F.substring("seq", F.col("from_") + 1, F.col("to_") - F.col("from_"))
    return rows.select("chr", "from_", F.length(part).alias("n"), F.when(F.col("flip"), reverse_complement(part)).otherwise(part).alias("cut"))


def masked_ranges(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sequences with the letters of their ranges (chr, from_, to_) as N."""
    own = ranges.groupBy("chr").agg(F.collect_list(F.struct("from_", "to_")).alias("r"))
    letters = F.transform(F.split("seq", ""), lambda c, i: F.when(F.exists("r", lambda x: (x["from_"] <= i) & (i < x["to_"])), F.lit("N")).otherwise(c))
    return seqs.join(own, "chr", "left").withColumn("seq", F.when(F.col("r").isNull() | (F.col("seq") == ""), F.col("seq")).otherwise(F.array_join(letters, ""))).drop("r")


def merged_sequences(seqs: DataFrame) -> DataFrame:
    """One record: the first header and all letters in order of chr. For small sets."""
    rows = F.sort_array(F.collect_list(F.struct("chr", "description", "seq")))
    return seqs.agg(rows.alias("r")).select(F.element_at("r.description", 1).alias("description"), F.array_join(F.col("r.seq"), "").alias("seq"))


def overlaid(cols: DataFrame, letters: DataFrame) -> DataFrame:
    """Rows of an alignment with other letters threaded through the gaps of a.

    ``letters`` has pair_id and seq with one letter for each of a's.
    """
    upto = Window.partitionBy("pair_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    rows = cols.withColumn("_n", F.sum((F.col("x") != "-").cast("int")).over(upto)).join(letters, "pair_id")
    cell = F.when(F.col("x") == "-", "-").otherwise(F.substring("seq", F.col("_n"), F.lit(1)))
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("col", cell.alias("c")))).alias("r")).select("pair_id", F.array_join(F.col("r.c"), "").alias("row"))


def _threaded(batches):
    """(pair_id, a, seq) to (pair_id, row): the letters of seq one by one in the places of a's."""
    for batch in batches:
        rows = []
        for a, seq in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            letters = iter(seq)
            rows.append("".join(c if c == "-" else next(letters, "") for c in a))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["pair_id", "row"])


def overlaid_rows(pairs: DataFrame, letters: DataFrame) -> DataFrame:
    """What ``overlaid`` gives, from whole rows (pair_id, a): a row meets its letters once, and no column is a row."""
    both = pairs.where("length(a) > 0").join(letters, "pair_id")
    return both.select("pair_id", "a", "seq").mapInArrow(_threaded, "pair_id long, row string")


def contig_groups(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of contigs that overlap, numbered along each sequence."""
    found = islands(intervals, keys)
    return found.withColumn("group_no", F.row_number().over(Window.partitionBy(*keys).orderBy("island_start")).cast("long")).select(*keys, "group_no", "island_start", "island_end", "n")


def best_order(contigs: list[tuple[str, int, int, float]], most: int = 16) -> tuple[float, list[str]]:
    """The order of contigs with hits (name, start, end, score) that loses least to overlaps.

    Exact over all orders by a table over subsets; the overlap of neighbours costs
    its share of the second's score.
    """
    n = len(contigs)
    if n > most:
        raise ValueError(f"at most {most} contigs are ordered exactly")

    def cost(i, j):
        _, a, b, _ = contigs[i]
        _, c, d, score = contigs[j]
        shared = max(0, min(b, d) - max(a, c)) + max(0, a - c)
        return score * min(1.0, shared / max(1, d - c))

    best = {(1 << i, i): (contigs[i][3], (i,)) for i in range(n)}
    for size in range(2, n + 1):
        for chosen in combinations(range(n), size):
            mask = sum(1 << i for i in chosen)
            for j in chosen:
                rest = mask ^ (1 << j)
                best[(mask, j)] = max(((best[(rest, i)][0] + contigs[j][3] - cost(i, j), best[(rest, i)][1] + (j,)) for i in chosen if i != j), key=lambda x: (x[0], tuple(-k for k in x[1])))
    full = (1 << n) - 1
    score, order = max((best[(full, j)] for j in range(n)), key=lambda x: (x[0], tuple(-k for k in x[1]))) if n else (0.0, ())
    return score, [contigs[i][0] for i in order]


def glued_alignment(pieces: list[tuple[int, str, str]], base: str, other_filler: str = "N") -> tuple[str, str]:
    """Pieces (start on the base, base row, other row) as one alignment of the whole base.

    Overlapping pieces are cut where the first one's equal columns plus the second's
    are most; base letters that no piece covers face the filler.
    """
    from .align import merge_point

    import numpy as np

    def columns(piece):
        at, out = piece[0], []
        for x, y in zip(piece[1], piece[2], strict=True):
            out.append((at, x, y))
            at += x != "-"
        return out

    rows: list[tuple[int, str, str]] = []
    for piece in sorted(pieces):
        new = columns(piece)
        start = new[0][0] if new else 0
        end = rows[-1][0] + 1 if rows else 0
        if rows and start < end:
            stop = min(end, new[-1][0] + 1)
            same = lambda cols, p: float(any(a == p and x == y and x != "-" for a, x, y in cols))
            spots = range(start, stop)
            cut = start + merge_point(np.array([same(rows, p) for p in spots]), np.array([same(new, p) for p in spots]))
            rows = [c for c in rows if c[0] < cut]
            new = [c for c in new if c[0] >= cut]
        rows += new
    out, at = [], 0
    for p, x, y in rows:
        while at < p:
            out.append((base[at], other_filler))
            at += 1
        out.append((x, y))
        at = max(at, p + (x != "-"))
    out += [(c, other_filler) for c in base[at:]]
    return "".join(x for x, _ in out), "".join(y for _, y in out)
