"""Permutations of blocks, gluing of stripes, boundary correction and repeat matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..session import discard, stored
from .align import local_ends_udf
from .intervals import neighbours

#: Fixed value: what stands beyond the ends of a permutation.
SENTINEL = 1073741823
_ORDER = ["start", "end", "block_id"]


def permutations(blocks: DataFrame) -> DataFrame:
    """chr, permutation: signed block ids in order of their start."""
    rows = F.sort_array(F.collect_list(F.struct("start", "end", (F.col("sign") * F.col("block_id")).alias("id"))))
    return blocks.groupBy("chr").agg(rows.alias("r")).select("chr", F.col("r.id").alias("permutation"))


def stripes(blocks: DataFrame) -> DataFrame:
    """first_block, second_block for every instance: what follows it, read in its own direction."""
    order = Window.partitionBy("chr").orderBy(*_ORDER)
    signed = F.col("sign") * F.col("block_id")
    after = F.coalesce(F.lead(signed).over(order), F.lit(SENTINEL))
    before = F.coalesce(-F.lag(signed).over(order), F.lit(SENTINEL))
    return blocks.select(F.col("block_id").alias("first_block"), F.when(F.col("sign") > 0, after).otherwise(before).alias("second_block"))


def glue_candidates(stripe: DataFrame) -> DataFrame:
    """first_block, second_block of all blocks that are always followed by the same other block.

    That block must have as many instances, and not be the block itself or an end.
    """
    one = stripe.groupBy("first_block").agg(F.count(F.lit(1)).alias("n"), F.min("second_block").alias("second_block"), F.max("second_block").alias("_max"))
    one = stored(one, "stripe-groups")
    agree = one.where(f"second_block = _max and second_block <> {SENTINEL} and abs(second_block) <> first_block")
    size = one.select(F.col("first_block").alias("_b"), F.col("n").alias("_n"))
    return agree.join(size, F.abs("second_block") == F.col("_b")).where("n = _n").select("first_block", "second_block", "n")


def _ends(rows: DataFrame) -> DataFrame:
    """block_id, n, end, next_block, next_end: what each end of a block always touches, null if not always the same.

    ``rows`` have ``at``, their number in order of sequences and places. End 1 is where an
    instance on the positive strand ends. A next block has as many instances, and is another.
    """
    here = rows.select("block_id", "sign", "chr", "at")
    there = here.select(F.col("chr").alias("_chr"), F.col("at").alias("_at"), F.col("block_id").alias("next_block"), F.col("sign").alias("_sign"))
    each = F.explode(F.array(F.lit(1), F.lit(-1))).alias("step")
    around = here.select("*", each).withColumn("_to", F.col("at") + F.col("step")).join(there, (F.col("_to") == F.col("_at")) & (F.col("chr") == F.col("_chr")), "left")
    # going up a sequence one leaves a positive instance by its end 1 and enters the next by its end 0
    side = lambda sign: F.when(sign * F.col("step") > 0, 1).otherwise(0)
    touch = around.select("block_id", side(F.col("sign")).alias("end"), F.struct("next_block", side(-F.col("_sign")).alias("next_end")).alias("t"))
    ends = touch.groupBy("block_id", "end").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"), F.max("t").alias("_max"))
    ends = stored(ends.withColumn("t", F.when((F.col("t") == F.col("_max")) & F.col("t.next_block").isNotNull() & (F.col("t.next_block") != F.col("block_id")), F.col("t"))).drop("_max"), "block-ends")
    size = ends.where("end = 1").select(F.col("block_id").alias("_b"), F.col("n").alias("_n"))
    fits = ends.join(size, F.col("t.next_block") == F.col("_b"), "left")
    ok = F.col("n") == F.col("_n")
    return fits.select("block_id", "n", "end", F.when(ok, F.col("t.next_block")).alias("next_block"), F.when(ok, F.col("t.next_end")).alias("next_end"))


def chains(ends: DataFrame) -> DataFrame:
    """chain, block_id, rank, way: blocks that touch end to end wherever they are, in order.

    ``way`` is 1 if a chain is walked through the block from its end 0 to its end 1, else -1.
    Every walk out of a block by one of its ends looks ahead 1, 2, 4, ... blocks until it
    knows its last one: a chain of n blocks takes log n joins, each a row or two a block.
    A block that touches none is a chain of its own.
    """
    walk = ends.select(F.struct("block_id", "end").alias("at"), F.when(F.col("next_block").isNotNull(), F.struct(F.col("next_block").alias("block_id"), (1 - F.col("next_end")).alias("end"))).alias("to"))
    walk = stored(walk.select("at", F.coalesce("to", "at").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("to").isNull().alias("done")), "walks")
    while not walk.where("not done").isEmpty():
        ahead = walk.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        before = walk
        walk = stored(walk.join(ahead, "to").select("at", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done")), "walks")
        discard(before)
    # both walks of a block end at the ends of its chain; the chain goes from the lesser
    two = walk.groupBy(F.col("at.block_id").alias("block_id")).agg(*[F.min(F.when(F.col("at.end") == e, F.struct("to", "far"))).alias(f"e{e}") for e in (0, 1)])
    back = F.col("e0.to") <= F.col("e1.to")
    return two.select(F.least("e0.to", "e1.to").alias("chain"), "block_id", F.when(back, F.col("e0.far")).otherwise(F.col("e1.far")).alias("rank"), F.when(back, 1).otherwise(-1).alias("way"))


_RUNS = "struct<left:struct<first:int,block:int,rank:bigint>,right:struct<first:int,block:int,rank:bigint>>"


def _joined(a, b):
    """What is left of two neighbouring stretches of a chain: a block that faces left, one that faces right.

    A block takes up what it faces. Of two that face each other the one with the least id
    of its side goes first and takes up the other, with all that this one had.
    """
    none = F.lit(None).cast(_RUNS)["left"]
    facing = a["right"].isNotNull() & b["left"].isNotNull()
    first = a["right"]["first"] < b["left"]["first"]
    left, right = F.when(facing & first, none).otherwise(b["left"]), F.when(facing & ~first, none).otherwise(a["right"])

    def one(x, y, kept):
        run = F.struct(F.least(x["first"], y["first"]).alias("first"), kept["block"].alias("block"), kept["rank"].alias("rank"))
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(run)

    return F.struct(one(a["left"], left, left).alias("left"), one(right, b["right"], right).alias("right"))


def _folded(rows: DataFrame, by: list) -> DataFrame:
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "runs"))).alias("l"))
    fold = F.aggregate(F.transform("l", lambda x: x["runs"]), F.lit(None).cast(_RUNS), lambda a, b: F.when(a.isNull(), b).otherwise(_joined(a, b)).cast(_RUNS))
    return lists.select("chain", F.get("l", 0)["rank"].alias("rank"), fold.alias("runs"))


def glued_names(chain: DataFrame, bits: int = 10) -> DataFrame:
    """block_id, glued, glued_rank, rank, way: the block that takes up each block of a chain.

    The smallest block goes first and takes up all that it faces along the chain. Stretches of
    1,024 blocks are folded, then stretches of these, until a chain is one.
    """
    run = F.struct(F.col("block_id").cast("int").alias("first"), F.col("block_id").cast("int").alias("block"), F.col("rank"))
    none = F.lit(None).cast(_RUNS)["left"]
    rows = chain.select("chain", "rank", F.struct(F.when(F.col("way") < 0, run).otherwise(none).alias("left"), F.when(F.col("way") > 0, run).otherwise(none).alias("right")).cast(_RUNS).alias("runs"))
    longest, shift = chain.agg(F.max("rank")).first()[0] or 0, 0
    while True:
        shift += bits
        rows = _folded(rows, ["chain", F.shiftright("rank", shift).alias("_part")])
        if longest >> shift == 0:
            break
    last = rows.select("chain", "runs.*")
    own = F.when(F.col("left").isNotNull() & (F.col("right").isNull() | (F.col("rank") <= F.col("left.rank"))), F.col("left")).otherwise(F.col("right"))
    return chain.join(last, "chain").withColumn("_own", own).select("block_id", F.col("_own.block").alias("glued"), F.col("_own.rank").alias("glued_rank"), "rank", "way")


def glue_stripes(blocks: DataFrame) -> DataFrame:
    """Glues until nothing can be glued, the smallest block first; ids become 1, 2, ... again.

    Ends of blocks that always touch each other make chains, and gluing goes along them: it
    never makes two ends touch that did not. A chain's blocks are found by doubling walks and
    settled by a fold; an instance knows from its rank how far on the instance is that takes it
    up, so no sequence, component or block is one task. Gluing one pair at a time gives the same.
    """
    from .kmers import numbered

    rows = blocks.select("block_id", "sign", "chr", "start", "end")
    rows = stored(numbered(rows.withColumn("_by", F.struct("chr", "start", "end", "block_id")), "_by", "at").drop("_by"), "to-glue")
    chain = stored(chains(_ends(rows)), "chains")
    named = rows.join(glued_names(chain), "block_id")
    home = F.col("at") + F.col("sign") * F.col("way") * (F.col("glued_rank") - F.col("rank"))
    sign = F.max(F.when(F.col("glued_rank") == F.col("rank"), F.col("sign")))
    glued = named.groupBy(F.col("glued").alias("block_id"), "chr", home.alias("_home")).agg(sign.alias("sign"), F.min("start").alias("start"), F.max("end").alias("end"))
    return dense_ids(stored(glued.select("block_id", "sign", "chr", "start", "end"), "glued"))


def dense_ids(blocks: DataFrame) -> DataFrame:
    """Renumbers block ids by rank; the set of ids, not of instances, is ranked."""
    from .kmers import numbered

    ids = numbered(blocks.select("block_id").distinct(), "block_id", "_id")
    return blocks.join(ids, "block_id").select((F.col("_id") + 1).cast("int").alias("block_id"), *[c for c in blocks.columns if c != "block_id"])


def unique_blocks(blocks: DataFrame, seqs: DataFrame, min_size: int = 0) -> DataFrame:
    """Blocks with one instance on each side, of at least ``min_size``: one row with both.

    Columns r_chr, r_start, r_end are the reference's (file 0), a_* the assembly's;
    a_sign is the assembly's strand once the reference is read on the positive one.
    """
    sided = blocks.join(seqs.select("chr", "file_idx"), "chr")
    ref = F.col("file_idx") == 0
    row = F.struct("chr", "start", "end", "sign")
    both = sided.groupBy("block_id").agg(F.count_if(ref).alias("nr"), F.count_if(~ref).alias("na"), F.min(F.when(ref, row)).alias("r"), F.min(F.when(~ref, row)).alias("a"), F.min(F.col("end") - F.col("start")).alias("least"))
    return both.where((F.col("nr") == 1) & (F.col("na") == 1) & (F.col("least") >= min_size)).select(
        "block_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ra" for c in ("chr", "start", "end")], F.col("r.sign").alias("r_sign"), (F.col("a.sign") * F.col("r.sign")).alias("a_sign")
    )


def boundary_windows(blocks: DataFrame, seqs: DataFrame, reach: int) -> DataFrame:
    """left_from, left_to, right_from, right_to: where each block's ends may really be.

    Up to ``reach`` on either side, but not into neighbouring blocks nor beyond the
    sequence or the block itself (positions are clamped, they never wrap).
    """
    rows = neighbours(blocks, ["chr"]).join(seqs.select("chr", F.length("seq").alias("_size")), "chr")
    far = F.col("start") - reach
    left = F.when(F.col("previous_end").isNotNull(), F.greatest(F.col("previous_end"), far) + 1).otherwise(F.when(far >= 0, far + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("left_from", F.least(left, F.col("start"))).withColumn("left_to", F.least(F.col("start") + reach, F.col("_size")))
    right = F.when(F.col("next_start").isNotNull(), F.least(F.col("next_start"), F.col("end") + reach)).otherwise(F.least(F.col("end") + reach, F.col("_size")))
    return rows.withColumn("right_from", F.greatest(F.col("end") - reach + 1, F.lit(0))).withColumn("right_to", right).drop("_size", "previous_end", "next_start")


def correct_boundaries(blocks: DataFrame, seqs: DataFrame, min_block_size: int) -> DataFrame:
    """Moves the ends of unique blocks to where both instances align locally."""
    reach = min(min_block_size, 1024)
    unique = unique_blocks(blocks, seqs)
    window = stored(boundary_windows(blocks, seqs, reach).join(seqs.select("chr", "seq"), "chr").join(unique.select("block_id", "r_sign"), "block_id"), "windows")
    sign = F.col("sign") * F.col("r_sign")
    part = lambda a, b: F.substring("seq", F.col(a) + 1, F.greatest(F.col(b) - F.col(a), F.lit(0)))
    left, right = part("left_from", "left_to"), part("right_from", "right_to")
    head = F.when(sign > 0, left).otherwise(reverse_complement(right))
    tail = F.when(sign > 0, right).otherwise(reverse_complement(left))
    rows = window.select("block_id", "chr", sign.alias("sign"), "left_from", "left_to", "right_from", "right_to", head.alias("head"), tail.alias("tail"))
    side = rows.join(seqs.select("chr", "file_idx"), "chr")
    ref = side.where("file_idx = 0").select("block_id", F.col("head").alias("rh"), F.col("tail").alias("rt"))
    asm = side.where("file_idx <> 0").select("block_id", F.col("head").alias("ah"), F.col("tail").alias("at"))
    # Few bytes, but much work a row: as many partitions as there are, or a small table would be one task.
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = ref.join(asm, "block_id").repartition(parts)
    ends = stored(both.select("block_id", local_ends_udf("rh", "ah").alias("h"), local_ends_udf("rt", "at").alias("t")), "ends")
    moved = side.join(ends, "block_id")
    own = lambda c, f: F.when(F.col("file_idx") == 0, F.col(f"{c}.{f}1")).otherwise(F.col(f"{c}.{f}2"))
    start = F.when(F.col("sign") > 0, F.col("left_from") + own("h", "begin")).otherwise(F.col("left_to") - own("t", "end"))
    end = F.when(F.col("sign") > 0, F.col("right_from") + own("t", "end")).otherwise(F.col("right_to") - own("h", "begin"))
    better = moved.select("block_id", "chr", "sign", start.cast("int").alias("start"), end.cast("int").alias("end"))
    rest = blocks.join(unique.select("block_id"), "block_id", "left_anti").select("block_id", "chr", "sign", "start", "end")
    return rest.unionByName(better).select("block_id", "sign", "chr", "start", "end")


def match_repeats(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs of a reference and an assembly instance, neither unique, with the same neighbours.

    Instances match if the blocks before and after them are the same, read in the
    instance's own direction. Returned as block_id, r_chr, r_start, a_chr, a_start.
    """
    order = Window.partitionBy("chr").orderBy(*_ORDER)
    signed = F.col("sign") * F.col("block_id")
    before, after = F.lag(signed).over(order), F.lead(signed).over(order)
    rows = blocks.withColumn("_b", F.when(F.col("sign") > 0, before).otherwise(-after)).withColumn("_a", F.when(F.col("sign") > 0, after).otherwise(-before))
    rows = rows.where("_a is not null and _b is not null").join(seqs.select("chr", "file_idx"), "chr")
    ref = rows.where("file_idx = 0").select("block_id", "_a", "_b", F.col("chr").alias("r_chr"), F.col("start").alias("r_start"))
    asm = rows.where("file_idx <> 0").select("block_id", "_a", "_b", F.col("chr").alias("a_chr"), F.col("start").alias("a_start"))
    return ref.join(asm, ["block_id", "_a", "_b"]).select("block_id", "r_chr", "r_start", "a_chr", "a_start")


def instance_overlap(a_start, a_end, b_start, b_end):
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
