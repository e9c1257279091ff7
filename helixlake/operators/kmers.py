"""K-mers of both strands, junction vertices and the condensed graph.

A k-mer starts somewhere on either strand. Equal k-mers are one vertex if they
are preceded or followed by different letters, or touch the end of a sequence; the
stretch between two vertices on a strand is an edge.

K-mers of up to 31 letters are packed and grouped in numpy (``packed``). Of longer ones, runs of
neighbouring k-mers with the same minimiser cross the shuffle as one string (a super-k-mer),
for both strands at once; k-mers are taken from them where they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..session import stored
from . import packed as small
from .places import looked_up, segments

END = "#"


def strands(seqs: DataFrame) -> DataFrame:
    """chr, strand (0 as read, 1 reverse-complemented), seq."""
    one = seqs.select("chr", F.lit(0).alias("strand"), "seq")
    return one.unionAll(seqs.select("chr", F.lit(1).alias("strand"), reverse_complement("seq").alias("seq")))


def _tiles(df: DataFrame, size: int, over: int) -> DataFrame:
    """Rows (at, piece, ...) cut into pieces of ``size`` letters that run on into the next by ``over``.

    A substring is counted from the start of its string, so windows of a long one are
    taken from short pieces: the work is then in proportion to the length.
    """
    pieces = F.transform(
        F.sequence(F.lit(0), F.length("piece") - over - 1, F.lit(size)),
        lambda s: F.struct((F.col("at") + s).alias("at"), F.substring("piece", s + 1, F.lit(size + over)).alias("piece")),
    )
    return df.select(*[c for c in df.columns if c not in ("at", "piece")], F.inline(pieces))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """chr, strand, pos, kmer, prev, next for every k-mer of A, C, G, T on both strands.

    One pass over the positive strand gives both: the k-mer at p is, reversed, the
    one at length - k - p on the other strand. ``#`` stands beyond an end.
    """
    whole = seqs.where(F.length("seq") >= k).select("chr", F.length("seq").alias("len"), F.lit(0).alias("at"), F.concat(F.lit(END), "seq", F.lit(END)).alias("piece"))
    # Long pieces are dealt out first, or a chromosome would be one task.
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = _tiles(_tiles(whole, 1 << 16, k + 1).repartition(parts, "chr", "at"), 1 << 8, k + 1)
    at = tiles.select("chr", "len", "at", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - k - 2)).alias("q"))
    here = at.select(
        "chr",
        "len",
        (F.col("at") + F.col("q")).alias("p"),
        F.substring("piece", F.col("q") + 2, F.lit(k)).alias("kmer"),
        F.substring("piece", F.col("q") + 1, F.lit(1)).alias("prev"),
        F.substring("piece", F.col("q") + k + 2, F.lit(1)).alias("next"),
    ).where(~F.col("kmer").rlike("[^ACGT]"))
    plus = F.struct(F.lit(0).alias("strand"), F.col("p").alias("pos"), F.col("kmer").alias("kmer"), F.col("prev").alias("prev"), F.col("next").alias("next"))
    minus = F.struct(F.lit(1).alias("strand"), (F.col("len") - k - F.col("p")).alias("pos"), reverse_complement("kmer").alias("kmer"), _flipped("next").alias("prev"), _flipped("prev").alias("next"))
    return here.select("chr", F.inline(F.array(plus, minus)))


def _bit(c: str):
    """One bit per letter; anything else but the end counts as one more letter."""
    return F.when(F.col(c) == "A", 1).when(F.col(c) == "C", 2).when(F.col(c) == "G", 4).when(F.col(c) == "T", 8).when(F.col(c) == END, 16).otherwise(32)


def _swapped(mask: str):
    """The bits of the letters on one side, as the other strand has them on its other side."""
    m = F.col(mask)
    part = lambda bit, left: F.shiftleft(m.bitwiseAND(bit), left) if left > 0 else F.shiftright(m.bitwiseAND(bit), -left)
    return part(1, 3).bitwiseOR(part(2, 1)).bitwiseOR(part(4, -1)).bitwiseOR(part(8, -3)).bitwiseOR(m.bitwiseAND(48))


def packed(kmer, k: int):
    """Two bits a letter in a long, in order of the k-mers; the k-mer itself where 62 bits do not hold it."""
    c = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("long") if k <= 31 else c


def _least_ahead(values: str, shift: int):
    """Each value, or the one so many places on if that is less."""
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + shift)))


def super_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """chr, len, at, mini, piece: every run of neighbouring k-mers of one minimiser.

    The minimiser of a k-mer is the least hash of its m-letter words, each taken as it is or
    reversed, whichever is less; so both strands, and all places, of a k-mer have the same.
    A piece has the letter before its first k-mer, which is at ``at``, and that after its
    last. Some (k - m) / 2 k-mers make a run, which takes k letters more than it has k-mers.
    """
    m = max(1, min(k // 2, 31))
    width = k - m + 1
    whole = seqs.where(F.length("seq") >= k).select("chr", F.length("seq").alias("len"), F.lit(0).alias("at"), F.concat(F.lit(END), "seq", F.lit(END)).alias("piece"))
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = _tiles(_tiles(whole, 1 << 16, k + 1).repartition(parts, "chr", "at"), max(1 << 8, 1 << width.bit_length()), k + 1)
    # One row of a generator each, so that lambdas read these and do not work them out for every letter.
    rows = tiles.select("*", F.inline(F.array(F.struct(F.length("piece").alias("_size"), reverse_complement("piece").alias("_back")))))
    word = lambda i: F.xxhash64(F.least(F.substring("piece", i + 1, F.lit(m)), F.substring("_back", F.col("_size") - i - m + 1, F.lit(m))))
    rows = rows.withColumn("_least", F.transform(F.sequence(F.lit(1), F.col("_size") - m - 1), word))
    have = 1
    while have < width:  # the least over so many words, then over up to twice as many
        shift = min(have, width - have)
        rows = rows.withColumn("_least", _least_ahead("_least", shift))
        have += shift
    n = F.col("_size") - k - 1
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_least", i) != F.get("_least", i - 1)))
    rows = rows.withColumn("_first", first)
    run = lambda s, j: F.struct(
        (F.col("at") + s).alias("at"),
        F.get("_least", s).alias("mini"),
        F.substring("piece", s + 1, F.coalesce(F.get("_first", j + 1), n) - s + k + 1).alias("piece"),
    )
    return rows.select("chr", "len", F.inline(F.transform("_first", run)))


def _each(runs: DataFrame, k: int) -> DataFrame:
    """The k-mers of runs: their columns but ``piece``, and q (from the run's start), kmer, back (reversed), prev, next.

    A run is reversed, and looked through for other letters, once for all its k-mers.
    """
    kept = [c for c in runs.columns if c != "piece"]
    once = F.struct(F.length("piece").alias("_size"), reverse_complement("piece").alias("_back"), F.col("piece").rlike("[^ACGT#]").alias("_odd"))
    rows = runs.select(*kept, "piece", F.inline(F.array(once))).select(*kept, "piece", "_size", "_back", "_odd", F.explode(F.sequence(F.lit(0), F.col("_size") - k - 2)).alias("q"))
    letters = lambda start, n: F.substring("piece", F.col("q") + start, F.lit(n))
    back = F.substring("_back", F.col("_size") - F.col("q") - k, F.lit(k))
    each = rows.select(*kept, "_odd", "q", letters(2, k).alias("kmer"), back.alias("back"), letters(1, 1).alias("prev"), letters(k + 2, 1).alias("next"))
    return each.where(~(F.col("_odd") & F.col("kmer").rlike("[^ACGT]"))).drop("_odd")


def _flipped(c: str):
    return F.translate(F.col(c), "ACGT", "TGCA")


def extension_sets(runs: DataFrame, k: int) -> DataFrame:
    """kmer, n, prev_mask, next_mask, mini: the letters around each k-mer, as bits.

    Equal runs, on either strand, are counted before and in a first shuffle, so that
    copies are one row; a second deals different runs to their minimisers. The k-mers
    of a minimiser are then together and are grouped where they are, by the lesser of
    both strands, which gives the other as well.
    """
    once = runs.groupBy("mini", F.least("piece", reverse_complement("piece")).alias("piece")).agg(F.count(F.lit(1)).alias("copies"))
    here = _each(once.repartition("mini"), k).withColumn("_prev", _flipped("next")).withColumn("_next", _flipped("prev"))
    as_read = F.col("kmer") <= F.col("back")
    pick = lambda one, other: F.when(as_read, _bit(one)).otherwise(_bit(other))
    sums = here.groupBy("mini", F.least("kmer", "back").alias("kmer")).agg(F.sum("copies").alias("n"), F.bit_or(pick("prev", "_prev")).alias("prev_mask"), F.bit_or(pick("next", "_next")).alias("next_mask"))
    both = sums.withColumn("_back", reverse_complement("kmer")).withColumn("_prev", _swapped("next_mask")).withColumn("_next", _swapped("prev_mask"))
    row = lambda kmer, n, before, after: F.struct(F.col(kmer).alias("kmer"), n.alias("n"), before.alias("prev_mask"), after.alias("next_mask"))
    one = row("kmer", F.col("n"), F.col("prev_mask"), F.col("next_mask"))
    # A k-mer that is its own reverse complement is there twice at each place.
    own = row("kmer", 2 * F.col("n"), F.col("prev_mask").bitwiseOR(F.col("_prev")), F.col("next_mask").bitwiseOR(F.col("_next")))
    other = row("_back", F.col("n"), F.col("_prev"), F.col("_next"))
    return both.select("mini", F.inline(F.when(F.col("kmer") == F.col("_back"), F.array(own)).otherwise(F.array(one, other)))).select("kmer", "n", "prev_mask", "next_mask", "mini")


def junctions(extensions: DataFrame) -> DataFrame:
    """K-mers with several letters, or an end, before or after, that recur or touch an end."""
    many = lambda c: (F.bit_count(c) > 1) | (F.col(c).bitwiseAND(16) > 0)
    ends = F.col("prev_mask").bitwiseOR(F.col("next_mask")).bitwiseAND(16) > 0
    return extensions.where((many("prev_mask") | many("next_mask")) & ((F.col("n") > 1) | ends))


def _ranged(df: DataFrame, by: str, size):
    """(rows in ranges of ``by``, written, with ``_part``; a column of what ``size`` adds up to in the parts before; in all)."""
    dealt = stored(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = {r["_part"]: r["size"] for r in dealt.groupBy("_part").agg(F.sum(size).alias("size")).collect()}
    offsets, total = {}, 0
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    if not offsets:
        return dealt, F.lit(0), 0
    return dealt, F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_part")), total


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in order of a unique column, without one task for all rows.

    Rows are range-partitioned and written; each part is numbered by itself, from
    where the parts before it end.
    """
    dealt, offset, _ = _ranged(df, by, F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return dealt.withColumn(name, (rank - 1 + offset).cast("long")).drop("_part")


def summed_before(df: DataFrame, by: str, size: str, name: str) -> tuple[DataFrame, int]:
    """Adds the sum of a long column over the rows before, in order of a unique column; and the sum over all."""
    dealt, offset, total = _ranged(df, by, F.col(size))
    before = F.sum(size).over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(name, (F.coalesce(before, F.lit(0)) + offset).cast("long")).drop("_part"), total


def vertices(runs: DataFrame, k: int) -> DataFrame:
    """kmer, n, vertex (ids in order of k-mers), and what places are found by: mini, or key and code (packed)."""
    if "info" in runs.columns:
        rows = small.both(runs.where("first"), [F.col("key").alias("code"), F.col("key"), F.col("n")], [F.col("back").alias("code"), F.col("key"), F.col("n")])
        return numbered(rows, "code", "vertex").select(small.letters(F.col("code"), k).alias("kmer"), "n", "vertex", "key", "code")
    return numbered(junctions(extension_sets(runs, k)).select("kmer", "n", "mini"), "kmer", "vertex")


def places_of(seqs: DataFrame, k: int) -> DataFrame:
    """What the graph is made of: the places of junctions, or super-k-mers for k over 31; written."""
    return stored(small.junction_places(seqs, k), "junctions") if k <= small.MOST else stored(super_kmers(seqs, k), "super-kmers")


def extensions(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n, prev_mask, next_mask: the letters around each k-mer, as bits."""
    if k > small.MOST:
        return extension_sets(super_kmers(seqs, k), k).drop("mini")
    rows = small.extension_sets(seqs, k)
    row = lambda kmer, before, after: [small.letters(F.col(kmer), k).alias("kmer"), F.col("n"), before.cast("int").alias("prev_mask"), after.cast("int").alias("next_mask")]
    return small.both(rows, row("key", F.col("prev_mask"), F.col("next_mask")), row("back", _swapped("next_mask"), _swapped("prev_mask")))


def vertex_instances(runs: DataFrame, vertex: DataFrame, k: int) -> DataFrame:
    """chr, strand, pos, vertex, next: every place of a vertex. ``runs`` is of ``places_of`` or ``super_kmers``.

    Of super-k-mers, only runs whose minimiser some vertex has are looked at; a place meets the vertices
    of both its strands in one row of an equi-join on packed k-mers.
    """
    if "info" in runs.columns:
        here = small.named_places(runs, vertex)
        at = lambda strand, pos, name, after: F.struct(F.lit(strand).alias("strand"), pos.alias("pos"), F.col(name).alias("vertex"), after.alias("next"))
        return here.select("chr", F.inline(F.array(at(0, F.col("p"), "one", small.letter_after("info")), at(1, F.col("len") - k - F.col("p"), "other", small.letter_after_turned("info")))))
    near = runs.join(vertex.select("mini").distinct(), "mini", "left_semi")
    here = _each(near, k).withColumn("p", F.col("at") + F.col("q"))
    here = here.select("chr", "len", "p", "prev", "next", packed(F.least("kmer", "back"), k).alias("key"), (F.col("kmer") <= F.col("back")).alias("as_read"))
    lesser = vertex.where(F.col("kmer") <= reverse_complement("kmer")).select("kmer", F.col("vertex").alias("one"))
    greater = vertex.where(F.col("kmer") >= reverse_complement("kmer")).select(reverse_complement("kmer").alias("kmer"), F.col("vertex").alias("other"))
    named = lesser.join(greater, "kmer").select(packed("kmer", k).alias("key"), "one", "other")
    place = lambda strand, pos, one, other, after: F.struct(F.lit(strand).alias("strand"), pos.alias("pos"), F.when(F.col("as_read"), F.col(one)).otherwise(F.col(other)).alias("vertex"), after.alias("next"))
    plus = place(0, F.col("p"), "one", "other", F.col("next"))
    minus = place(1, F.col("len") - k - F.col("p"), "other", "one", _flipped("prev"))
    return here.join(named, "key").select("chr", F.inline(F.array(plus, minus)))


def edges(instances: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """The condensed graph: one row per stretch between neighbouring vertices of a strand.

    ``seqs`` may have ``places``, a map of original positions, in which the ends of an
    edge are looked up; without it letters are where they were read.
    """
    order = Window.partitionBy("chr", "strand").orderBy("pos")
    step = instances.withColumn("end_vertex", F.lead("vertex").over(order)).withColumn("_to", F.lead("pos").over(order)).where("_to is not null")
    size = F.col("_to") - F.col("pos") + k
    rows = step.join(seqs.select("chr", F.length("seq").alias("_len")), "chr").withColumn("actual_len", size)
    rows = rows.withColumn("actual_pos", F.when(F.col("strand") == 0, F.col("pos")).otherwise(F.col("_len") - F.col("pos") - F.col("actual_len")))
    return _as_read(rows.withColumnsRenamed({"vertex": "start_vertex", "next": "first_char"}), seqs)


def _edges_of_places(places: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """``edges`` from ``packed.named_places``: neighbours on one strand are so on the other, the other way round."""
    order = Window.partitionBy("chr").orderBy("p")
    here = places.select("chr", "p", "one", "other", F.col("info").bitwiseAND(F.lit(0x1FFFF)).cast("int").alias("info"))
    step = here.withColumn("_next", F.lead(F.struct("p", "one", "other", "info")).over(order)).where("_next is not null")
    edge = lambda strand, start, end, first: F.struct(F.lit(strand).alias("strand"), F.col(start).alias("start_vertex"), F.col(end).alias("end_vertex"), first.alias("first_char"))
    two = F.array(edge(0, "one", "_next.one", small.letter_after("info")), edge(1, "_next.other", "other", small.letter_after_turned("_next.info")))
    rows = step.select("chr", F.col("p").alias("actual_pos"), (F.col("_next.p") - F.col("p") + k).alias("actual_len"), two.alias("_two"))
    return _as_read(rows, seqs)


def _as_read(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """Edges (or both of a stretch, in ``_two``) with their original places."""
    if "places" in seqs.columns:
        rows = looked_up(rows.withColumn("_last", F.col("actual_pos") + F.col("actual_len") - 1), segments(seqs), actual_pos="_a", _last="_b")
        rows = rows.withColumn("orig_pos", F.least("_a", "_b")).withColumn("orig_len", F.abs(F.col("_a") - F.col("_b")) + 1)
    else:
        rows = rows.withColumn("orig_pos", F.col("actual_pos")).withColumn("orig_len", F.col("actual_len"))
    if "_two" in rows.columns:
        rows = rows.select("chr", "actual_pos", "actual_len", "orig_pos", "orig_len", F.inline("_two"))
    return rows.select("chr", "strand", "start_vertex", "end_vertex", "actual_pos", "actual_len", "orig_pos", "orig_len", "first_char")


def graph(seqs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``places_of``, vertices, edges) of a set of sequences; the first two are written once."""
    runs = places_of(seqs, k)
    vertex = stored(vertices(runs, k), "vertices")
    if k <= small.MOST:
        return runs, vertex, _edges_of_places(small.named_places(runs, vertex), seqs, k)
    return runs, vertex, edges(vertex_instances(runs, vertex, k), seqs, k)


def plain_edges(windows: DataFrame) -> DataFrame:
    """The graph before condensing: each k-mer and the one a step further, with places."""
    order = Window.partitionBy("chr", "strand").orderBy("pos")
    following = F.when(F.lead("pos").over(order) == F.col("pos") + 1, F.lead("kmer").over(order))
    return windows.withColumn("next_kmer", following).where("next_kmer is not null").select("chr", "strand", "pos", "kmer", "next_kmer")


def edge_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, next_kmer, n, n_positive: how often each edge of ``plain_edges`` is there, and how often on strand 0.

    An edge is a (k + 1)-mer, so no window is needed; both strands of one are counted in one row.
    """
    back = reverse_complement("kmer")
    here = kmers(seqs, k + 1).where("strand = 0").select(F.least("kmer", back).alias("word"), (F.col("kmer") <= back).alias("_as_read"))
    sums = here.groupBy(packed("word", k + 1).alias("key")).agg(F.min("word").alias("word"), F.count_if("_as_read").alias("read"), F.count_if(~F.col("_as_read")).alias("turned"))
    both = sums.select("word", reverse_complement("word").alias("back"), "read", "turned", (F.col("read") + F.col("turned")).alias("n"))
    row = lambda word, n, own: F.struct(F.substring(word, 1, k).alias("kmer"), F.substring(word, 2, k).alias("next_kmer"), n.alias("n"), own.alias("n_positive"))
    # A word that is its own reverse complement is there on both strands at each place.
    own = row("word", 2 * F.col("n"), F.col("n"))
    return both.select(F.inline(F.when(F.col("word") == F.col("back"), F.array(own)).otherwise(F.array(row("word", F.col("n"), F.col("read")), row("back", F.col("n"), F.col("turned"))))))


def substring_ranks(seqs: DataFrame, k: int) -> DataFrame:
    """chr, strand, pos, rank: equal k-mers have equal ranks, in order of k-mers.

    Words of up to 32 letters are ranked as they are: places meet the ranks of the
    different words once. For large k, where k-mers as strings would be n * k letters,
    ranks of length 1 are doubled by joining a place with the one as far on as the rank
    is long.
    """
    if k <= 32:
        whole = strands(seqs).where(F.length("seq") >= k).select("chr", "strand", F.lit(0).alias("at"), F.col("seq").alias("piece"))
        parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tiles = _tiles(_tiles(whole, 1 << 16, k - 1).repartition(parts, "chr", "strand", "at"), 1 << 8, k - 1)
        at = tiles.select("*", F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("q"))
        words = at.select("chr", "strand", (F.col("at") + F.col("q")).alias("pos"), F.substring("piece", F.col("q") + 1, F.lit(k)).alias("word"))
        return words.join(numbered(words.select("word").distinct(), "word", "rank"), "word").select("chr", "strand", "pos", "rank")
    one = strands(seqs).where(F.length("seq") >= k).select("chr", "strand", F.posexplode(F.split("seq", "")).alias("pos", "c")).where("c <> ''")
    now = one.select("chr", "strand", "pos", F.ascii("c").cast("long").alias("rank"))
    have = 1
    while have < k:
        shift = min(have, k - have)
        later = now.select("chr", "strand", (F.col("pos") - shift).alias("pos"), F.col("rank").alias("later"))
        pairs = stored(now.join(later, ["chr", "strand", "pos"]), "rank-pairs")
        named = numbered(pairs.groupBy("rank", "later").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.struct("rank", "later")), "pair", "new_rank")
        now = pairs.join(named.select("rank", "later", "new_rank"), ["rank", "later"]).select("chr", "strand", "pos", F.col("new_rank").alias("rank"))
        have += shift
    return now
