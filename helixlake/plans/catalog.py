"""The registered queries of the sequence engine and their DuckDB equivalents.

Every query runs over whole tables. ``K`` and ``LEAST`` are the k-mer size and the
shortest edge of the graph queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import align, anchors, blocks, conserved, intervals, kmers, multiple, places, postprocess, reports, search, simplify, utilities, variants
from ..session import stored
from ..sources import fixtures
from ..sources.sinks import vcf_header

K, LEAST, REACH = 30, 60, 150

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# ---- common table expressions of the oracles -------------------------------------------------

_SEQS = """seqs AS (SELECT CAST(doc_id AS INTEGER) AS chr, CAST(doc_id % 2 AS INTEGER) AS file_idx,
  'gi|' || doc_id || '|' || source || '|d' || doc_id || '.1|' AS description,
  CASE WHEN doc_id % 5 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq
  FROM (SELECT doc_id, source, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS s FROM documents))"""
_KMERS = f"""{_SEQS},
strands AS (SELECT chr, 0 AS strand, seq FROM seqs UNION ALL SELECT chr, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
places AS (SELECT chr, strand, seq, unnest(range(0, length(seq) - {K} + 1)) AS pos FROM strands WHERE length(seq) >= {K}),
kmers AS (SELECT chr, strand, pos, substr(seq, pos + 1, {K}) AS kmer,
  CASE WHEN pos = 0 THEN '#' ELSE substr(seq, pos, 1) END AS prev,
  CASE WHEN pos + {K} = length(seq) THEN '#' ELSE substr(seq, pos + {K} + 1, 1) END AS next FROM places)"""
_VERTICES = f"""{_KMERS},
ext AS (SELECT kmer, count(*) AS n, count(DISTINCT prev) AS np, count(DISTINCT next) AS nn,
  bool_or(prev = '#') AS pe, bool_or(next = '#') AS ne FROM kmers GROUP BY kmer),
vertices AS (SELECT kmer, n, row_number() OVER (ORDER BY kmer) - 1 AS vertex FROM ext
  WHERE (np > 1 OR pe OR nn > 1 OR ne) AND (n > 1 OR pe OR ne))"""
_INSTANCES = f"""{_VERTICES},
inst AS (SELECT chr, strand, pos, vertex, next FROM kmers JOIN vertices USING (kmer))"""
_EDGES = f"""{_INSTANCES},
steps AS (SELECT *, lead(vertex) OVER o AS end_vertex, lead(pos) OVER o AS stop FROM inst WINDOW o AS (PARTITION BY chr, strand ORDER BY pos)),
edges AS (SELECT s.chr, strand, vertex AS start_vertex, end_vertex,
  CASE WHEN strand = 0 THEN pos ELSE length(seq) - stop - {K} END AS actual_pos, stop - pos + {K} AS actual_len, next AS first_char
  FROM steps s JOIN seqs USING (chr) WHERE stop IS NOT NULL)"""
_GROUPS = f"""{_EDGES},
groups AS (SELECT start_vertex, end_vertex, first_char, count(*) AS multiplicity, count(*) FILTER (strand = 0) AS n_positive,
  min(actual_len) AS min_len, max(actual_len) AS max_len FROM edges WHERE actual_len >= {LEAST}
  GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (strand = 0) >= 1)"""
_BRANCHES = f"""{_INSTANCES},
often AS (SELECT vertex FROM inst GROUP BY vertex HAVING count(*) > 1),
pairs AS (SELECT a.chr, a.strand, a.pos, a.vertex, a.next AS first_char, b.vertex AS meet, b.pos AS m_pos
  FROM inst a JOIN inst b ON a.chr = b.chr AND a.strand = b.strand AND b.pos > a.pos AND b.pos - a.pos < {REACH}
  WHERE a.vertex IN (SELECT vertex FROM often)),
seen AS (SELECT *, max(CASE WHEN meet = vertex THEN 1 ELSE 0 END) OVER (PARTITION BY chr, strand, pos ORDER BY m_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS again FROM pairs),
branch AS (SELECT chr, strand, pos, vertex, first_char, meet, min(m_pos - pos) AS step FROM seen WHERE again = 0 GROUP BY ALL),
bulge AS (SELECT vertex, meet, count(*) AS n_branches, count(DISTINCT first_char) AS n_letters FROM branch WHERE first_char <> '#'
  GROUP BY ALL HAVING count(DISTINCT first_char) > 1)"""
_INTERVALS = """iv AS (SELECT l_suppkey AS seq_id, l_partkey AS block_id, l_orderkey % 5000 AS "start",
  l_orderkey % 5000 + CAST(l_quantity AS BIGINT) AS "end", CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lineitem)"""
_ISLANDS = f"""{_INTERVALS},
mark AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  OR row_number() OVER (PARTITION BY seq_id ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS new FROM iv),
num AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM mark),
islands AS (SELECT seq_id, min("start") AS island_start, max("end") AS island_end, count(*) AS n FROM num GROUP BY seq_id, island)"""
_BLOCKS = """biv AS (SELECT l_suppkey AS seq_id, l_partkey % 4000 + 1 AS block_id, (l_orderkey * 37 + l_linenumber * 811 + l_partkey * 7) % 100000 AS "start",
  (l_orderkey * 37 + l_linenumber * 811 + l_partkey * 7) % 100000 + CAST(l_quantity AS BIGINT) % 30 + 20 AS "end", CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lineitem),
bmark AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  OR row_number() OVER (PARTITION BY seq_id ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS new FROM biv),
bnum AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM bmark),
bislands AS (SELECT seq_id, min("start") AS island_start, max("end") AS island_end FROM bnum GROUP BY seq_id, island),
firsts AS (SELECT seq_id, "start", min(struct_pack(b := block_id, s := sign)) AS m FROM biv GROUP BY ALL),
blocks AS (SELECT CAST(m.b AS INTEGER) AS block_id, m.s AS sign, CAST(i.seq_id AS INTEGER) AS chr,
  CAST(island_start AS INTEGER) AS "start", CAST(island_end AS INTEGER) AS "end" FROM bislands i JOIN firsts f ON i.seq_id = f.seq_id AND i.island_start = f."start")"""
_ALIGNED = f"""{_SEQS},
aligned AS (SELECT CAST(chr AS BIGINT) AS pair_id,
  array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i % 307 = 0 THEN '-' ELSE substr(seq, i, 1) END), '') AS a,
  array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN i % 97 = 0 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA')
    WHEN i % 211 = 0 THEN '-' ELSE substr(seq, i, 1) END), '') AS b FROM seqs WHERE length(seq) > 0)"""
_COLUMNS = f"""{_ALIGNED},
cells AS (SELECT pair_id, a, b, unnest(range(0, length(a))) AS col FROM aligned),
cols AS (SELECT pair_id, col, substr(a, col + 1, 1) AS x, substr(b, col + 1, 1) AS y, substr(a, col + 1, 1) = substr(b, col + 1, 1) AS same FROM cells)"""
_SEGMENTS = f"""{_COLUMNS},
turn AS (SELECT *, CASE WHEN lag(same) OVER o = same THEN 0 ELSE 1 END AS t FROM cols WINDOW o AS (PARTITION BY pair_id ORDER BY col)),
run AS (SELECT *, sum(t) OVER (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS r FROM turn),
runs AS (SELECT pair_id, min(col) AS "start", max(col) + 1 AS "end", bool_and(same) AS same FROM run GROUP BY pair_id, r),
soft AS (SELECT pair_id, "start", "end", same AND NOT (same AND "end" - "start" < 30 AND "start" > 0 AND lead("start") OVER o IS NOT NULL) AS same
  FROM runs WINDOW o AS (PARTITION BY pair_id ORDER BY "start")),
turn2 AS (SELECT *, CASE WHEN lag(same) OVER o = same THEN 0 ELSE 1 END AS t FROM soft WINDOW o AS (PARTITION BY pair_id ORDER BY "start")),
run2 AS (SELECT *, sum(t) OVER (PARTITION BY pair_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS r FROM turn2),
segments AS (SELECT pair_id, min("start") AS "start", max("end") AS "end", bool_and(same) AS same FROM run2 GROUP BY pair_id, r)"""


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sequences_from_documents(spark, sf_dir)


# ---- sequences and k-mers --------------------------------------------------------------------


@query("seq_stats", f"WITH {_SEQS} SELECT chr + 1 AS seq_id, CAST(length(seq) AS INTEGER) AS size, description FROM seqs")
def seq_stats(spark, sf):
    return reports.sequence_list(_seqs(spark, sf))


@query("reverse_complement", f"WITH {_SEQS} SELECT chr, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def reverse_complement(spark, sf):
    return _seqs(spark, sf).select("chr", S.reverse_complement("seq").alias("rc"))


@query(
    "identifiers",
    f"""WITH {_SEQS}, t AS (SELECT chr, description, translate(description, '|.', '  ') AS flat, string_split(description, '|') AS p FROM seqs)
SELECT chr, CASE WHEN len(list_filter(string_split(flat, ' '), lambda x: x <> '')) = 5 THEN list_filter(string_split(flat, ' '), lambda x: x <> '')[4] ELSE flat END AS stripped,
CASE WHEN len(p) = 5 THEN string_split(p[4], '.')[1] ELSE description END AS accession FROM t""",
)
def identifiers(spark, sf):
    return _seqs(spark, sf).select("chr", S.stripped_id("description").alias("stripped"), S.accession("description").alias("accession"))


@query("kmer_spectrum", f"WITH {_KMERS}, c AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer) SELECT n AS occurrences, count(*) AS n_kmers FROM c GROUP BY n")
def kmer_spectrum(spark, sf):
    return kmers.extensions(_seqs(spark, sf), K).withColumnRenamed("n", "occurrences").groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_kmers"))


@query("extension_sets", f"WITH {_KMERS} SELECT kmer, count(*) AS n, CAST(count(DISTINCT prev) AS INTEGER) AS n_prev, CAST(count(DISTINCT next) AS INTEGER) AS n_next FROM kmers GROUP BY kmer")
def extension_sets(spark, sf):
    e = kmers.extensions(_seqs(spark, sf), K)
    return e.select("kmer", "n", F.bit_count("prev_mask").alias("n_prev"), F.bit_count("next_mask").alias("n_next"))


@query("bifurcations", f"WITH {_VERTICES} SELECT kmer, n, vertex FROM vertices")
def bifurcations(spark, sf):
    return kmers.vertices(kmers.places_of(_seqs(spark, sf), K), K).select("kmer", "n", "vertex")


@query("bifurcation_instances", f"WITH {_INSTANCES} SELECT chr, strand, CAST(pos AS INTEGER) AS pos, vertex FROM inst")
def bifurcation_instances(spark, sf):
    runs = kmers.places_of(_seqs(spark, sf), K)
    return kmers.vertex_instances(runs, kmers.vertices(runs, K), K).select("chr", "strand", "pos", "vertex")


@query("vertex_degrees", f"WITH {_INSTANCES} SELECT vertex, count(*) AS n, count(*) FILTER (strand = 0) AS n_positive, count(DISTINCT chr) AS n_chr FROM inst GROUP BY vertex")
def vertex_degrees(spark, sf):
    runs = kmers.places_of(_seqs(spark, sf), K)
    inst = kmers.vertex_instances(runs, kmers.vertices(runs, K), K)
    return inst.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strand") == 0).alias("n_positive"), F.countDistinct("chr").alias("n_chr"))


@query(
    "condensed_edges",
    f"""WITH {_EDGES} SELECT chr, strand, start_vertex, end_vertex, CAST(actual_pos AS INTEGER) AS actual_pos, CAST(actual_len AS INTEGER) AS actual_len,
CAST(actual_pos AS INTEGER) AS orig_pos, CAST(actual_len AS INTEGER) AS orig_len, first_char FROM edges""",
)
def condensed_edges(spark, sf):
    return kmers.graph(_seqs(spark, sf), K)[2]


# Every 500 letters, from 100 on, ten letters give way to fourteen or seven others in turn.
_EDITED = f"""{_SEQS.replace("seqs AS", "base AS", 1)},
pieces AS (SELECT chr, j, CASE WHEN j = 0 THEN 0 ELSE 500 * j - 390 END AS kept_from, CASE WHEN j = m THEN length(seq) ELSE 500 * j + 100 END AS kept_to,
  CASE WHEN j = m THEN 0 WHEN j % 2 = 0 THEN 14 ELSE 7 END AS put, seq FROM (SELECT *, unnest(range(0, m + 1)) AS j FROM (SELECT *, greatest(0, (length(seq) + 390) // 500) AS m FROM base))),
laid AS (SELECT chr, kept_from, kept_to, put, coalesce(sum(kept_to - kept_from + put) OVER (PARTITION BY chr ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_from FROM pieces),
seqs AS (SELECT chr, string_agg(substr(seq, kept_from + 1, kept_to - kept_from) || substr('GATTACAGATTACA', 1, put), '' ORDER BY j) AS seq FROM pieces GROUP BY chr)"""


def _read_at(p: str) -> str:
    """Where the letter that lies as in piece ``p`` was read."""
    off = f"({p}_at - {p}.new_from - ({p}.kept_to - {p}.kept_from))"
    return f"CASE WHEN {off} < 0 THEN {p}.kept_to + {off} ELSE {p}.kept_to + least(9, {off} * 10 // {p}.put) END"


@query(
    "edited_edges",
    f"""WITH {_EDGES.replace(_SEQS, _EDITED)},
ends AS (SELECT *, actual_pos AS f_at, actual_pos + actual_len - 1 AS t_at FROM edges),
ones AS (SELECT e.*, {_read_at("f")} AS a FROM ends e ASOF JOIN laid f ON e.chr = f.chr AND e.f_at >= f.new_from),
spans AS (SELECT e.*, {_read_at("t")} AS b FROM ones e ASOF JOIN laid t ON e.chr = t.chr AND e.t_at >= t.new_from)
SELECT chr, strand, start_vertex, end_vertex, CAST(actual_pos AS INTEGER) AS actual_pos, CAST(actual_len AS INTEGER) AS actual_len,
CAST(least(a, b) AS INTEGER) AS orig_pos, CAST(abs(a - b) + 1 AS INTEGER) AS orig_len, first_char FROM spans""",
)
def edited_edges(spark, sf):
    seqs = simplify.with_places(_seqs(spark, sf)).withColumn("m", F.greatest(F.lit(0), F.floor((F.length("seq") + 390) / 500)).cast("int"))
    put = lambda j: F.when(j == F.col("m"), 0).when(j % 2 == 0, 14).otherwise(7)
    kept = lambda j: F.substring("seq", F.when(j == 0, 1).otherwise(500 * j - 389), F.when(j == F.col("m"), F.length("seq")).when(j == 0, 100).otherwise(490))
    piece = lambda j: F.concat(kept(j), F.substring(F.lit("GATTACAGATTACA"), F.lit(1), put(j)))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.col("m")), lambda j: j < F.col("m"))).alias("j")
    edits = seqs.select("chr", "m", at).select("chr", (500 * F.col("j") + 100).alias("start"), (500 * F.col("j") + 110).alias("end"), put(F.col("j")).alias("size"))
    moved = places.replaced(places.segments(seqs), edits).withColumnRenamed("places", "moved")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("m")), piece), "")
    new = seqs.withColumn("seq", text).join(moved, "chr", "left").withColumn("places", F.coalesce("moved", "places"))
    return kmers.graph(stored(new.select("chr", "seq", "places"), "edited"), K)[2]


@query(
    "raw_kmer_edges",
    f"""WITH {_KMERS}, e AS (SELECT strand, kmer, lead(kmer) OVER (PARTITION BY chr, strand ORDER BY pos) AS next_kmer FROM kmers)
SELECT kmer, next_kmer, count(*) AS n, count(*) FILTER (strand = 0) AS n_positive FROM e WHERE next_kmer IS NOT NULL GROUP BY ALL""",
)
def raw_kmer_edges(spark, sf):
    return kmers.edge_counts(_seqs(spark, sf), K)


@query(
    "graph_dot",
    f"""WITH {_EDGES} SELECT format('{{}} -> {{}} [color="{{}}", label="chr={{}} pos={{}} len={{}} orpos={{}} orlen={{}} ch=''{{}}''"];',
start_vertex, end_vertex, CASE WHEN strand = 0 THEN 'blue' ELSE 'red' END, chr, actual_pos, actual_len, actual_pos, actual_len, first_char) AS value FROM edges""",
)
def graph_dot(spark, sf):
    return reports.dot_edges(kmers.graph(_seqs(spark, sf), K)[2])


_RANK_K = 12
_RANK_KMERS = _KMERS.replace(f"- {K} +", f"- {_RANK_K} +").replace(f">= {K}", f">= {_RANK_K}").replace(f"pos + 1, {K})", f"pos + 1, {_RANK_K})").replace(f"pos + {K} ", f"pos + {_RANK_K} ")


@query("substring_ranks", f"WITH {_RANK_KMERS} SELECT chr, strand, CAST(pos AS INTEGER) AS pos, CAST(dense_rank() OVER (ORDER BY kmer) - 1 AS BIGINT) AS rank FROM kmers")
def substring_ranks(spark, sf):
    return kmers.substring_ranks(_seqs(spark, sf), _RANK_K).select("chr", "strand", "pos", "rank")


# ---- groups and blocks -----------------------------------------------------------------------


@query("edge_groups", f"WITH {_GROUPS} SELECT start_vertex, end_vertex, first_char, multiplicity, n_positive, CAST(min_len AS INTEGER) AS min_len, CAST(max_len AS INTEGER) AS max_len FROM groups")
def edge_groups(spark, sf):
    return blocks.edge_groups(kmers.graph(_seqs(spark, sf), K)[2], LEAST)


@query("group_priority", f"WITH {_GROUPS} SELECT start_vertex, end_vertex, first_char, multiplicity, row_number() OVER (ORDER BY multiplicity DESC, start_vertex, end_vertex, first_char) AS priority FROM groups")
def group_priority(spark, sf):
    g = blocks.prioritised(blocks.edge_groups(kmers.graph(_seqs(spark, sf), K)[2], LEAST))
    return g.select("start_vertex", "end_vertex", "first_char", "multiplicity", "priority")


def _blocks(spark, sf, **options):
    seqs = _seqs(spark, sf)
    return seqs, stored(blocks.find_disjoint_blocks(kmers.graph(seqs, K)[2], seqs, LEAST, **options), "blocks")


@query("block_coords")
def block_coords(spark, sf):
    return blocks.coordinates(_blocks(spark, sf)[1])


@query("block_trim")
def block_trim(spark, sf):
    return blocks.coordinates(_blocks(spark, sf, trim_k=15)[1])


@query("block_reports")
def block_reports(spark, sf):
    seqs, found = _blocks(spark, sf)
    return reports.gff(found, seqs)


@query("block_pipeline")
def block_pipeline(spark, sf):
    from .pipeline import find_blocks

    return blocks.coordinates(find_blocks(_seqs(spark, sf), min_block_size=LEAST).blocks)


@query("bulge_candidates", f"WITH {_BRANCHES} SELECT vertex, meet, n_branches, n_letters FROM bulge")
def bulge_candidates(spark, sf):
    runs = kmers.places_of(_seqs(spark, sf), K)
    inst = stored(kmers.vertex_instances(runs, kmers.vertices(runs, K), K), "instances")
    return simplify.bulge_candidates(simplify.branches(inst, REACH))


@query(
    "bulge_winners",
    f"""WITH {_BRANCHES},
own AS (SELECT b.* FROM branch b JOIN bulge USING (vertex, meet) WHERE first_char <> '#'),
mult AS (SELECT vertex, count(*) AS m FROM inst GROUP BY vertex),
inn AS (SELECT chr, strand, pos AS i_pos, m FROM inst JOIN mult USING (vertex)),
sc AS (SELECT o.chr, o.strand, o.pos, o.vertex, o.meet, max(m) AS score FROM own o JOIN inn i ON o.chr = i.chr AND o.strand = i.strand AND i_pos > o.pos AND i_pos < o.pos + o.step GROUP BY ALL),
scored AS (SELECT o.*, coalesce(score, 0) AS score FROM own o LEFT JOIN sc USING (chr, strand, pos, vertex, meet)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vertex, meet ORDER BY score DESC, strand, chr, pos) AS rk FROM scored),
win AS (SELECT vertex, meet, chr AS w_chr, strand AS w_strand, pos AS w_pos, step AS w_step, first_char AS w_char FROM ranked WHERE rk = 1)
SELECT vertex, meet, chr, strand, CAST(pos AS INTEGER) AS pos, first_char, CAST(step AS INTEGER) AS step, score, w_chr, w_strand, CAST(w_pos AS INTEGER) AS w_pos, CAST(w_step AS INTEGER) AS w_step, w_char
FROM ranked JOIN win USING (vertex, meet) WHERE rk > 1 AND first_char <> w_char""",
)
def bulge_winners(spark, sf):
    runs = kmers.places_of(_seqs(spark, sf), K)
    inst = stored(kmers.vertex_instances(runs, kmers.vertices(runs, K), K), "instances")
    found = stored(simplify.branches(inst, REACH), "branches")
    return simplify.bulge_winners(found).select("vertex", "meet", "chr", "strand", "pos", "first_char", "step", "score", "w_chr", "w_strand", "w_pos", "w_step", "w_char")


@query("bulge_collapse")
def bulge_collapse(spark, sf):
    done = places.expanded(simplify.simplify(_seqs(spark, sf), K, REACH))
    return done.select("chr", F.length("seq").alias("size"), F.size("orig").alias("n_places"), F.sha2("seq", 256).alias("seq_sha256"), F.sha2(F.array_join("orig", ","), 256).alias("orig_sha256"))


# ---- intervals -------------------------------------------------------------------------------


@query("interval_islands", f"WITH {_ISLANDS} SELECT seq_id, island_start, island_end, n FROM islands")
def interval_islands(spark, sf):
    return intervals.islands(fixtures.intervals_from_lineitem(spark, sf), ["seq_id"])


@query("interval_coverage", f"WITH {_ISLANDS} SELECT seq_id, CAST(sum(island_end - island_start) AS BIGINT) AS covered FROM islands GROUP BY seq_id")
def interval_coverage(spark, sf):
    return intervals.covered_length(fixtures.intervals_from_lineitem(spark, sf), ["seq_id"])


@query(
    "interval_complement",
    f"""WITH {_ISLANDS}, ext AS (SELECT s_suppkey AS seq_id, 6000 AS size FROM supplier),
before AS (SELECT seq_id, coalesce(lag(island_end) OVER (PARTITION BY seq_id ORDER BY island_start), 0) AS gap_start, island_start AS gap_end FROM islands),
after AS (SELECT ext.seq_id, coalesce(max(island_end), 0) AS gap_start, any_value(size) AS gap_end FROM ext LEFT JOIN islands USING (seq_id) GROUP BY ext.seq_id)
SELECT seq_id, CAST(gap_start AS BIGINT) AS gap_start, CAST(gap_end AS BIGINT) AS gap_end FROM (FROM before UNION ALL FROM after) WHERE gap_end - gap_start > 2""",
)
def interval_complement(spark, sf):
    extents = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("seq_id"), F.lit(6000).alias("size"))
    return intervals.complement(fixtures.intervals_from_lineitem(spark, sf), extents, ["seq_id"], 2)


@query(
    "nearest_neighbor_block",
    f"""WITH {_BLOCKS} SELECT block_id, chr, "start", "end", lag("end") OVER o AS previous_end, lead("start") OVER o AS next_start FROM blocks WINDOW o AS (PARTITION BY chr ORDER BY "start", "end")""",
)
def nearest_neighbor_block(spark, sf):
    return intervals.neighbours(fixtures.blocks_from_lineitem(spark, sf), ["chr"]).select("block_id", "chr", "start", "end", "previous_end", "next_start")


@query(
    "least_overlapping",
    f"""WITH {_INTERVALS}, t AS (SELECT DISTINCT seq_id, "start", "end" FROM iv WHERE sign = -1 AND "start" < "end")
SELECT t.seq_id, t."start" AS from_pos, t."end" AS to_pos, min(s.block_id) AS block_id FROM t JOIN iv s ON t.seq_id = s.seq_id AND t."start" < s."end" AND s."start" < t."end"
WHERE s."start" < s."end" GROUP BY ALL""",
)
def least_overlapping(spark, sf):
    rows = fixtures.intervals_from_lineitem(spark, sf).where("start < end")
    return intervals.least_overlapping(rows.where("sign = -1"), rows, ["seq_id"], "block_id", 50).select("seq_id", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"), "block_id")


@query(
    "interval_overlap_join",
    f"""WITH {_INTERVALS}
SELECT a.seq_id, a.block_id, a."start", a."end", b.block_id AS r_block_id, b."start" AS r_start, b."end" AS r_end
FROM iv a JOIN iv b ON a.seq_id = b.seq_id AND a."start" < b."end" AND b."start" < a."end" """,
)
def interval_overlap_join(spark, sf):
    iv = fixtures.intervals_from_lineitem(spark, sf).drop("sign")
    return intervals.range_join(iv, iv, ["seq_id"], 64)


@query(
    "coverage_report",
    f"""WITH {_BLOCKS}, deg AS (SELECT block_id, count(*) AS degree FROM blocks GROUP BY block_id),
rows_ AS (SELECT degree, chr, "start", "end", block_id FROM blocks JOIN deg USING (block_id) UNION ALL SELECT 0, chr, "start", "end", block_id FROM blocks),
len_ AS (SELECT degree, chr, sum("end" - "start") AS covered FROM rows_ GROUP BY ALL),
cnt AS (SELECT degree, count(DISTINCT block_id) AS n_blocks FROM rows_ GROUP BY degree),
ext AS (SELECT CAST(s_suppkey AS INTEGER) AS chr, 100100 AS size FROM supplier),
pct AS (SELECT degree, chr, covered * 100.0::DOUBLE / size AS percent FROM len_ JOIN ext USING (chr)
  UNION ALL SELECT degree, NULL, sum(covered) * 100.0::DOUBLE / (SELECT sum(size) FROM ext) FROM len_ GROUP BY degree)
SELECT nullif(degree, 0) AS degree, chr, n_blocks, round(percent, 6) AS percent FROM pct JOIN cnt USING (degree)""",
)
def coverage_report(spark, sf):
    extents = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("chr"), F.lit(fixtures.BLOCK_SPACE).alias("size"))
    return intervals.coverage_by_degree(fixtures.blocks_from_lineitem(spark, sf), extents)


# ---- permutations, gluing, unique blocks -----------------------------------------------------


@query("permutations", f"""WITH {_BLOCKS} SELECT chr, list(sign * block_id ORDER BY "start", "end", sign * block_id) AS permutation FROM blocks GROUP BY chr""")
def permutations(spark, sf):
    return postprocess.permutations(fixtures.blocks_from_lineitem(spark, sf))


_STRIPES = f"""{_BLOCKS}, st AS (SELECT block_id AS first_block, CASE WHEN sign > 0 THEN coalesce(lead(sign * block_id) OVER o, 1073741823)
  ELSE coalesce(-lag(sign * block_id) OVER o, 1073741823) END AS second_block FROM blocks WINDOW o AS (PARTITION BY chr ORDER BY "start", "end", block_id))"""


@query("stripe_table", f"WITH {_STRIPES} SELECT first_block, second_block FROM st")
def stripe_table(spark, sf):
    return postprocess.stripes(fixtures.blocks_from_lineitem(spark, sf))


@query(
    "stripe_glue_round",
    f"""WITH {_STRIPES}, g AS (SELECT first_block, count(*) AS n, min(second_block) AS second_block, max(second_block) AS mx FROM st GROUP BY first_block)
SELECT a.first_block, a.second_block, a.n FROM g a JOIN g b ON abs(a.second_block) = b.first_block AND a.n = b.n
WHERE a.second_block = a.mx AND a.second_block <> 1073741823 AND abs(a.second_block) <> a.first_block""",
)
def stripe_glue_round(spark, sf):
    return postprocess.glue_candidates(postprocess.stripes(fixtures.blocks_from_lineitem(spark, sf)))


@query("stripe_glue")
def stripe_glue(spark, sf):
    return postprocess.glue_stripes(fixtures.blocks_from_lineitem(spark, sf))


@query(
    "shared_only_blocks",
    f"""WITH {_BLOCKS} SELECT block_id FROM blocks GROUP BY block_id HAVING count(*) = 2 AND count(DISTINCT chr) = 2""",
)
def shared_only_blocks(spark, sf):
    return blocks.shared_by_all(fixtures.blocks_from_lineitem(spark, sf), 2)


def _sided(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("chr"), (F.col("s_suppkey") % 2).cast("int").alias("file_idx"))


_UNIQUE = f"""{_BLOCKS}, sided AS (SELECT *, chr % 2 AS file_idx FROM blocks),
uniq AS (SELECT block_id FROM sided GROUP BY block_id HAVING count(*) FILTER (file_idx = 0) = 1 AND count(*) FILTER (file_idx <> 0) = 1)"""


@query(
    "unique_blocks",
    f"""WITH {_UNIQUE} SELECT r.block_id, r.chr AS r_chr, r."start" AS r_start, r."end" AS r_end, a.chr AS a_chr, a."start" AS a_start, a."end" AS a_end, r.sign AS r_sign, a.sign * r.sign AS a_sign
FROM sided r JOIN sided a USING (block_id) JOIN uniq USING (block_id) WHERE r.file_idx = 0 AND a.file_idx <> 0""",
)
def unique_blocks(spark, sf):
    return postprocess.unique_blocks(fixtures.blocks_from_lineitem(spark, sf), _sided(spark, sf))


@query(
    "boundary_windows",
    f"""WITH {_BLOCKS}, nb AS (SELECT *, lag("end") OVER o AS pe, lead("start") OVER o AS ns FROM blocks WINDOW o AS (PARTITION BY chr ORDER BY "start", "end"))
SELECT block_id, chr, "start", "end", sign, least(CASE WHEN pe IS NOT NULL THEN greatest(pe, "start" - 16) + 1 WHEN "start" >= 16 THEN "start" - 15 ELSE 0 END, "start") AS left_from, least("start" + 16, 100100) AS left_to,
greatest("end" - 15, 0) AS right_from, CASE WHEN ns IS NOT NULL THEN least(ns, "end" + 16) ELSE least("end" + 16, 100100) END AS right_to FROM nb""",
)
def boundary_windows(spark, sf):
    seqs = _sided(spark, sf).withColumn("seq", F.repeat(F.lit("A"), F.lit(fixtures.BLOCK_SPACE)))
    return postprocess.boundary_windows(fixtures.blocks_from_lineitem(spark, sf), seqs, 16)


@query(
    "repeat_matches",
    f"""WITH {_BLOCKS}, nb AS (SELECT *, chr % 2 AS file_idx, lag(sign * block_id) OVER o AS l, lead(sign * block_id) OVER o AS r FROM blocks WINDOW o AS (PARTITION BY chr ORDER BY "start", "end", block_id)),
t AS (SELECT *, CASE WHEN sign > 0 THEN l ELSE -r END AS b, CASE WHEN sign > 0 THEN r ELSE -l END AS a FROM nb)
SELECT x.block_id, x.chr AS r_chr, x."start" AS r_start, y.chr AS a_chr, y."start" AS a_start FROM t x JOIN t y ON x.block_id = y.block_id AND x.a = y.a AND x.b = y.b WHERE x.file_idx = 0 AND y.file_idx <> 0""",
)
def repeat_matches(spark, sf):
    return postprocess.match_repeats(fixtures.blocks_from_lineitem(spark, sf), _sided(spark, sf))


@query("boundary_correction")
def boundary_correction(spark, sf):
    seqs, found = _blocks(spark, sf)
    return postprocess.correct_boundaries(found, seqs, LEAST)


# ---- reports ---------------------------------------------------------------------------------


@query(
    "block_gff",
    f"""WITH {_BLOCKS} SELECT 'S' || chr AS seqname, 'helixlake' AS source, 'conserved_block' AS feature, "start" + 1 AS "start", "end", '.' AS score, CASE WHEN sign > 0 THEN '+' ELSE '-' END AS strand, '.' AS frame, CAST(block_id AS VARCHAR) AS attribute FROM blocks""",
)
def block_gff(spark, sf):
    seqs = _sided(spark, sf).withColumn("description", F.concat(F.lit("S"), F.col("chr").cast("string")))
    return reports.gff(fixtures.blocks_from_lineitem(spark, sf), seqs)


@query(
    "block_coordinates",
    f"""WITH {_BLOCKS} SELECT block_id, chr + 1 AS seq_id, CASE WHEN sign > 0 THEN '+' ELSE '-' END AS strand, CASE WHEN sign > 0 THEN "start" + 1 ELSE "end" END AS "start", CASE WHEN sign > 0 THEN "end" ELSE "start" + 1 END AS "end", "end" - "start" AS length FROM blocks""",
)
def block_coordinates(spark, sf):
    return blocks.coordinates(fixtures.blocks_from_lineitem(spark, sf))


@query(
    "block_sequences",
    f"""WITH {_SEQS}, p AS (SELECT chr, CASE WHEN chr % 3 = 0 THEN -1 ELSE 1 END AS sign, seq AS own, length(seq) AS e, description FROM seqs WHERE length(seq) > 0)
SELECT chr AS block_id, chr, 0 AS "start", 'Seq="' || description || '",Strand=''' || CASE WHEN sign > 0 THEN '+' ELSE '-' END || ''',Block_id=' || chr || ',Start=' || CASE WHEN sign > 0 THEN 1 ELSE e END || ',End=' || CASE WHEN sign > 0 THEN e ELSE 1 END AS header,
rtrim(regexp_replace(CASE WHEN sign > 0 THEN own ELSE reverse(translate(own, 'ACGT', 'TGCA')) END, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS body FROM p""".replace("\\\\1", "\\1"),
)
def block_sequences(spark, sf):
    seqs = _seqs(spark, sf)
    found = seqs.where("length(seq) > 0").select(F.col("chr").alias("block_id"), F.when(F.col("chr") % 3 == 0, -1).otherwise(1).alias("sign"), "chr", F.lit(0).alias("start"), F.length("seq").alias("end"))
    return reports.block_sequences(found, seqs)


@query(
    "circos_links",
    f"""WITH {_BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY chr, "start") AS i FROM blocks)
SELECT 'block_' || lpad(CAST(row_number() OVER (ORDER BY a.block_id, a.i, b.i) - 1 AS VARCHAR), 8, '0') AS link_id, a.block_id, a.chr AS chr1, a."start" AS start1, a."end" AS end1, b.chr AS chr2, b."start" AS start2, b."end" AS end2,
CAST(a.block_id % 25 AS INTEGER) AS colour FROM n a JOIN n b ON a.block_id = b.block_id AND a.i < b.i""",
)
def circos_links(spark, sf):
    return reports.links(fixtures.blocks_from_lineitem(spark, sf))


@query("circos_highlights", f"""WITH {_BLOCKS} SELECT chr, "start", "end", CASE WHEN sign > 0 THEN 'green' ELSE 'red' END AS colour FROM blocks""")
def circos_highlights(spark, sf):
    return reports.highlights(fixtures.blocks_from_lineitem(spark, sf))


@query("circos_karyotype", f"WITH {_SEQS}, {_BLOCKS} SELECT chr, 'seq' || (chr + 1) AS name, 'd' || chr AS label, CAST(length(seq) AS INTEGER) AS size FROM seqs WHERE chr IN (SELECT chr FROM blocks)")
def circos_karyotype(spark, sf):
    return reports.karyotype(_seqs(spark, sf), fixtures.blocks_from_lineitem(spark, sf))


@query(
    "d3_imports",
    f"""WITH {_BLOCKS}, n AS (SELECT block_id, block_id || '.' || chr || '.' || "start" AS name, "end" - "start" AS size FROM blocks),
l AS (SELECT block_id, list(name ORDER BY name) AS names FROM n GROUP BY block_id)
SELECT name, size, list_filter(names, lambda x: x <> name) AS imports FROM n JOIN l USING (block_id)""",
)
def d3_imports(spark, sf):
    return reports.diagram(fixtures.blocks_from_lineitem(spark, sf))


@query(
    "stage_tree",
    f"""WITH {_BLOCKS}, s AS (SELECT CAST(block_id % 3 AS INTEGER) AS stage, block_id, chr, "start", "end" + 40 AS "end" FROM blocks)
SELECT DISTINCT p.stage, p.block_id, c.block_id AS child_id FROM s p JOIN s c ON p.stage = c.stage + 1 AND p.chr = c.chr AND p."start" < c."end" AND c."start" < p."end" """,
)
def stage_tree(spark, sf):
    found = fixtures.blocks_from_lineitem(spark, sf).select((F.col("block_id") % 3).cast("int").alias("stage"), "block_id", "chr", "start", (F.col("end") + 40).alias("end"))
    return blocks.stage_tree(found, 256)


@query(
    "contig_unmapped",
    f"""WITH {_BLOCKS}, perm AS (SELECT chr, list(sign * block_id ORDER BY "start", "end") AS p FROM blocks GROUP BY chr),
q AS (SELECT chr, CASE WHEN chr % 2 = 0 THEN p[2:4] ELSE list_transform(list_reverse(p[1:2] || [3, -3]), lambda x: -x) END AS q FROM perm)
SELECT chr, q AS permutation FROM q WHERE NOT EXISTS (SELECT 1 FROM perm r WHERE len(q.q) = 0 OR
  len(list_filter(range(1, len(r.p) - len(q.q) + 2), lambda i: r.p[i:i + len(q.q) - 1] = q.q)) > 0 OR
  len(list_filter(range(1, len(r.p) - len(q.q) + 2), lambda i: r.p[i:i + len(q.q) - 1] = list_transform(list_reverse(q.q), lambda x: -x))) > 0)""",
)
def contig_unmapped(spark, sf):
    perm = stored(postprocess.permutations(fixtures.blocks_from_lineitem(spark, sf)), "permutations")
    even = F.slice("permutation", 2, 3)
    odd = S.reverse_permutation(F.concat(F.slice("permutation", 1, 2), F.array(F.lit(3), F.lit(-3))))
    contigs = perm.select(F.col("chr").alias("name"), F.when(F.col("chr") % 2 == 0, even).otherwise(odd).alias("permutation"))
    return reports.unmapped_contigs(perm, contigs).select(F.col("name").alias("chr"), "permutation")


# ---- variants --------------------------------------------------------------------------------


@query("alignment_segments", f"""WITH {_SEGMENTS} SELECT pair_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", same FROM segments""")
def alignment_segments(spark, sf):
    return variants.segments(variants.columns(fixtures.aligned_from_documents(spark, sf)))


@query(
    "coord_map",
    f"""WITH {_COLUMNS} SELECT pair_id, CAST(col AS INTEGER) AS col, CAST(coalesce(sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ref_offset FROM cols""",
)
def coord_map(spark, sf):
    return variants.columns(fixtures.aligned_from_documents(spark, sf)).select("pair_id", "col", "ref_offset")


@query(
    "variants_from_alignment",
    f"""WITH {_SEGMENTS}, around AS (SELECT *, lag("start") OVER o AS ps, lag("end") OVER o AS pe, lead("start") OVER o AS ns, lead("end") OVER o AS ne FROM segments WINDOW o AS (PARTITION BY pair_id ORDER BY "start")),
v AS (SELECT *, CASE WHEN "start" = 0 OR ("end" - "start" = 1 AND substr(a, CAST("start" + 1 AS BIGINT), 1) <> '-' AND substr(b, CAST("start" + 1 AS BIGINT), 1) <> '-') THEN 0 ELSE 1 END AS shift
  FROM around JOIN aligned USING (pair_id) WHERE NOT same)
SELECT pair_id, CAST(length(replace(substr(a, 1, CAST("start" AS BIGINT)), '-', '')) - shift AS INTEGER) AS "offset",
replace(substr(a, CAST("start" - shift + 1 AS BIGINT), CAST("end" - "start" + shift AS BIGINT)), '-', '') AS ref, replace(substr(b, CAST("start" - shift + 1 AS BIGINT), CAST("end" - "start" + shift AS BIGINT)), '-', '') AS alt,
coalesce(substr(a, CAST(greatest(ps, pe - 30) + 1 AS BIGINT), CAST(least(pe - ps, 30) AS BIGINT)), '') AS before, coalesce(substr(a, CAST(ns + 1 AS BIGINT), CAST(least(ne - ns, 30) AS BIGINT)), '') AS after FROM v""",
)
def variants_from_alignment(spark, sf):
    return variants.from_alignments(fixtures.aligned_from_documents(spark, sf))


def _two_sided(spark, sf):
    """Blocks of the interval fixture with made-up sequences of one letter by position."""
    letters = F.repeat(F.lit("ACGTTGCA"), F.lit(12513))
    return fixtures.blocks_from_lineitem(spark, sf), _sided(spark, sf).withColumn("seq", letters)


_GAPS = f"""{_BLOCKS}, sided AS (SELECT *, chr % 2 AS file_idx FROM blocks),
two AS (SELECT block_id FROM sided GROUP BY block_id HAVING count(DISTINCT file_idx) = 2),
cov AS (SELECT chr, "start", "end" FROM sided JOIN two USING (block_id)),
ext AS (SELECT CAST(s_suppkey AS INTEGER) AS chr FROM supplier),
gaps AS (SELECT chr, coalesce(lag("end") OVER (PARTITION BY chr ORDER BY "start"), 0) AS gap_start, "start" AS gap_end FROM cov
  UNION ALL SELECT ext.chr, coalesce(max("end"), 0), 100104 FROM ext LEFT JOIN cov USING (chr) GROUP BY ext.chr)"""


@query("uncovered_segments", f"""WITH {_GAPS} SELECT chr, CAST(chr % 2 AS INTEGER) AS file_idx, CAST(gap_start AS BIGINT) AS gap_start, CAST(gap_end AS BIGINT) AS gap_end FROM gaps WHERE gap_end - gap_start > 20""")
def uncovered_segments(spark, sf):
    found, seqs = _two_sided(spark, sf)
    return variants.uncovered(found, seqs, 20).select("chr", "file_idx", "gap_start", "gap_end")


@query(
    "uncovered_insertions",
    f"""WITH {_GAPS}, big AS (SELECT chr, gap_start, gap_end, substr(repeat('ACGTTGCA', 12513), CAST(gap_start + 1 AS BIGINT), CAST(gap_end - gap_start AS BIGINT)) AS own FROM gaps WHERE gap_end - gap_start > 10),
uniq AS (SELECT block_id FROM sided GROUP BY block_id HAVING count(*) FILTER (file_idx = 0) = 1 AND count(*) FILTER (file_idx <> 0) = 1 AND min("end" - "start") >= 10),
anch AS (SELECT a.chr, a."end" AS gap_start, r.chr AS r_chr, CASE WHEN a.sign = r.sign THEN r."end" ELSE r."start" END AS r_pos FROM sided r JOIN sided a USING (block_id) JOIN uniq USING (block_id) WHERE r.file_idx = 0 AND a.file_idx <> 0)
SELECT chr, CAST(gap_start AS INTEGER) AS pos, CAST(NULL AS INTEGER) AS contig, CAST(NULL AS INTEGER) AS assembly_pos, CASE WHEN gap_start > 0 THEN substr(repeat('ACGTTGCA', 12513), CAST(gap_start AS BIGINT), 1) ELSE '' END || own AS ref,
  CASE WHEN gap_start > 0 THEN substr(repeat('ACGTTGCA', 12513), CAST(gap_start AS BIGINT), 1) END AS alt FROM big WHERE chr % 2 = 0
UNION ALL SELECT r_chr, r_pos, chr, CAST(gap_start AS INTEGER), substr(repeat('ACGTTGCA', 12513), CAST(r_pos AS BIGINT), 1), substr(repeat('ACGTTGCA', 12513), CAST(r_pos AS BIGINT), 1) || own
  FROM big JOIN anch USING (chr, gap_start) WHERE chr % 2 <> 0 AND r_pos > 0""",
)
def uncovered_insertions(spark, sf):
    found, seqs = _two_sided(spark, sf)
    return variants.large_indels(found, seqs, 10)[0].drop("block_id")


# ---- the same on blocks of every kind --------------------------------------------------------

_LAYOUT = """lay0 AS (SELECT o_orderkey AS k, o_orderkey // 256 AS g, o_orderkey % 256 AS i, o_orderkey % 11 AS kind, 40 + o_orderkey % 30 AS size FROM orders),
lay1 AS (SELECT *, i BETWEEN 64 AND 127 AS turned, CASE WHEN kind = 0 THEN 1 + k % 3 ELSE 10 + k END AS id FROM lay0 WHERE kind <> 1),
lay2 AS (SELECT id, 1 AS sign, 2 * g AS chr, 100 * i + 50 AS "start", size FROM lay1
  UNION ALL SELECT id, CASE WHEN turned THEN -1 ELSE 1 END, 2 * g + 1, 100 * CASE WHEN turned THEN 191 - i ELSE i END + 55, size FROM lay1
  UNION ALL SELECT id, 1, 2 * g + 1, 25700 + 100 * i, size FROM lay1 WHERE kind = 2
  UNION ALL SELECT 4, 1, chr, 0, 40 FROM (SELECT DISTINCT 2 * g + unnest([0, 1]) AS chr FROM lay0)),
blocks AS (SELECT CAST(id AS INTEGER) AS block_id, sign, CAST(chr AS INTEGER) AS chr, CAST("start" AS INTEGER) AS "start", CAST("start" + size AS INTEGER) AS "end" FROM lay2)"""


def _on_layout(name: str) -> str:
    """The SQL of a query on blocks, on these."""
    assert _BLOCKS in _SQL[name]
    return _SQL[name].replace(_BLOCKS, _LAYOUT).replace("SELECT CAST(s_suppkey AS INTEGER) AS chr FROM supplier", "SELECT DISTINCT chr FROM blocks")


def _layout(spark, sf):
    found = fixtures.blocks_from_orders(spark, sf)
    letters = F.repeat(F.lit("ACGTTGCA"), F.lit(12513))
    return found, found.select("chr").distinct().select("chr", (F.col("chr") % 2).cast("int").alias("file_idx"), letters.alias("seq"))


@query("layout_glue_round", _on_layout("stripe_glue_round"))
def layout_glue_round(spark, sf):
    return postprocess.glue_candidates(postprocess.stripes(_layout(spark, sf)[0]))


@query(
    "layout_glue",
    f"""WITH RECURSIVE {_STRIPES.replace(_BLOCKS, _LAYOUT)}, g AS (SELECT first_block, count(*) AS n, min(second_block) AS second_block, max(second_block) AS mx FROM st GROUP BY first_block),
cand AS (SELECT a.first_block, a.second_block FROM g a JOIN g b ON abs(a.second_block) = b.first_block AND a.n = b.n WHERE a.second_block = a.mx AND a.second_block <> 1073741823 AND abs(a.second_block) <> a.first_block),
walk AS (SELECT first_block AS block_id, first_block AS head, 0 AS depth FROM g WHERE first_block NOT IN (SELECT second_block FROM cand)
  UNION ALL SELECT c.second_block, w.head, w.depth + 1 FROM walk w JOIN cand c ON c.first_block = w.block_id),
placed AS (SELECT *, row_number() OVER (ORDER BY chr, "start", "end", block_id) AS nth FROM blocks),
joined AS (SELECT head, chr, max(CASE WHEN depth = 0 THEN sign END) AS sign, min("start") AS "start", max("end") AS "end" FROM placed JOIN walk USING (block_id) GROUP BY head, chr, nth - sign * depth)
SELECT CAST(dense_rank() OVER (ORDER BY head) AS INTEGER) AS block_id, sign, chr, "start", "end" FROM joined""",
)
def layout_glue(spark, sf):
    return postprocess.glue_stripes(_layout(spark, sf)[0])


@query("layout_shared_blocks", f"""WITH {_LAYOUT}, s AS (SELECT count(DISTINCT chr) AS n FROM blocks) SELECT block_id FROM blocks, s GROUP BY block_id, n HAVING count(*) = n AND count(DISTINCT chr) = n""")
def layout_shared_blocks(spark, sf):
    found, seqs = _layout(spark, sf)
    return blocks.shared_by_all(found, seqs.count())


@query("layout_unique_blocks", _on_layout("unique_blocks"))
def layout_unique_blocks(spark, sf):
    return postprocess.unique_blocks(*_layout(spark, sf))


@query("layout_repeat_matches", _on_layout("repeat_matches"))
def layout_repeat_matches(spark, sf):
    return postprocess.match_repeats(*_layout(spark, sf))


@query("layout_insertions", _on_layout("uncovered_insertions"))
def layout_insertions(spark, sf):
    return variants.large_indels(*_layout(spark, sf), 10)[0].drop("block_id")


@query("variant_pipeline")
def variant_pipeline(spark, sf):
    from .pipeline import call_variants

    return call_variants(_seqs(spark, sf), min_block_size=LEAST).variants


# ---- alignment -------------------------------------------------------------------------------


def _frame(s: str, f: int) -> str:
    base = lambda j: f"(strpos('TCAG', substr({s}, i * 3 + {f + j + 1}, 1)) - 1)"
    at = f"1 + 16 * {base(0)} + 4 * {base(1)} + {base(2)}"
    return f"array_to_string(list_transform(range(0, (length({s}) - {f}) // 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', {at}, 1)), '')"


_FRAMES = ", ".join(f"{_frame(s, f)} AS frame{3 * n + f}" for n, s in enumerate(("seq", "rc")) for f in range(3))


@query("codon_translation", f"WITH {_SEQS}, r AS (SELECT chr, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs) SELECT chr, {_FRAMES} FROM r")
def codon_translation(spark, sf):
    return _seqs(spark, sf).select("chr", *[F.get(S.six_frames("seq"), i).alias(f"frame{i}") for i in range(6)])


_WORD = 12
_SEEDS = f"""{_ALIGNED},
free AS (SELECT pair_id, replace(a, '-', '') AS a, replace(b, '-', '') AS b FROM aligned),
xs AS (SELECT pair_id, a AS x FROM free),
ys AS (SELECT pair_id, 0 AS strand, CASE WHEN pair_id % 3 = 0 THEN reverse(translate(b, 'ACGT', 'TGCA')) ELSE b END AS y FROM free
  UNION ALL SELECT pair_id, 1, CASE WHEN pair_id % 3 = 0 THEN b ELSE reverse(translate(b, 'ACGT', 'TGCA')) END FROM free),
wx AS (SELECT pair_id, i, substr(x, i + 1, {_WORD}) AS word, CASE WHEN i = 0 THEN '<' ELSE substr(x, i, 1) END AS b1
  FROM (SELECT *, unnest(range(0, length(x) - {_WORD - 1})) AS i FROM xs)),
wy AS (SELECT pair_id, strand, j, substr(y, j + 1, {_WORD}) AS word, CASE WHEN j = 0 THEN '>' ELSE substr(y, j, 1) END AS b2
  FROM (SELECT *, unnest(range(0, length(y) - {_WORD - 1})) AS j FROM ys)),
seeds AS (SELECT pair_id, strand, i, j FROM wx JOIN wy USING (pair_id, word) WHERE b1 <> b2)"""


@query("strand_seeds", f"WITH {_SEEDS} SELECT pair_id, strand, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM seeds")
def strand_seeds(spark, sf):
    pairs = fixtures.pairs_from_documents(spark, sf)
    return search.seeds(search.frames(pairs, "a", False, False), search.frames(pairs, "b", True, False), _WORD).select("pair_id", "strand", "i", "j")


@query("strand_hits")
def strand_hits(spark, sf):
    return search.search(stored(fixtures.pairs_from_documents(spark, sf), "pairs"), _WORD)


@query("word_pairs", f"""WITH {_SEEDS.replace(" WHERE b1 <> b2", "")} SELECT pair_id, strand, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(j) AS BIGINT) AS sum_j FROM seeds GROUP BY ALL""")
def word_pairs(spark, sf):
    pairs = fixtures.pairs_from_documents(spark, sf)
    found = search.seeds(search.frames(pairs, "a", False, False), search.frames(pairs, "b", True, False), _WORD, every=True)
    return found.groupBy("pair_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


_THREE = f"""{_ALIGNED},
three AS (SELECT pair_id AS aln, a, b, array_to_string(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN i % 101 = 0 OR substr(b, i, 1) = '-' THEN '-' ELSE substr(a, i, 1) END), '') AS c FROM aligned)"""


@query(
    "project_rows",
    f"""WITH {_THREE}, kept AS (SELECT *, list_filter(range(1, length(b) + 1), lambda i: substr(b, i, 1) <> '-' OR substr(c, i, 1) <> '-') AS cols FROM three)
SELECT aln, 'b' AS "row", array_to_string(list_transform(cols, lambda i: substr(b, i, 1)), '') AS body FROM kept
UNION ALL SELECT aln, 'c', array_to_string(list_transform(cols, lambda i: substr(c, i, 1)), '') FROM kept""",
)
def project_rows(spark, sf):
    two = fixtures.aligned_from_documents(spark, sf)
    gapped = F.transform(F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y")), lambda z, i: F.when(((i + 1) % 101 == 0) | (z["y"] == "-"), "-").otherwise(z["x"]))
    rows = F.array(*[F.struct(F.lit(n).alias("row"), F.col(n).alias("body")) for n in "abc"])
    three = two.withColumn("c", F.array_join(gapped, "")).select(F.col("pair_id").alias("aln"), F.inline(rows))
    return utilities.project_rows(three, ["b", "c"])


_MATCH, _MISMATCH, _CHANGE = conserved.scores(70)
_PATH = f"""{_THREE},
rws AS (SELECT aln, 'a' AS r, a AS body FROM three UNION ALL SELECT aln, 'b', b FROM three
  UNION ALL SELECT aln, 'c', array_to_string(list_transform(range(0, length(c)), lambda i: CASE WHEN i // 300 % 2 = 1 THEN translate(c[i + 1], 'ACGT', 'CGTA') ELSE c[i + 1] END), '') FROM three),
prs AS (SELECT x.aln, x.r, y.r AS q, x.body AS a, y.body AS b FROM rws x JOIN rws y ON x.aln = y.aln AND x.r < y.r),
sums AS (SELECT aln, r, q, length(a) AS size, list_filter(list_transform(range(0, length(a)), lambda i: {{'c': i,
  'm': CASE WHEN a[i + 1] = '-' AND b[i + 1] = '-' THEN NULL WHEN a[i + 1] = '-' OR b[i + 1] = '-' THEN -50 WHEN a[i + 1] = b[i + 1] THEN {_MATCH} ELSE {_MISMATCH} END,
  'd': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'kind': -1, 'pl': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT), 'cuts': CAST([] AS STRUCT(kind INTEGER, pl BIGINT, k BIGINT)[])}}), lambda e: e.m IS NOT NULL) AS l FROM prs),
paths AS (SELECT *, list_reduce(l, lambda s, e: {{'c': e.c, 'm': e.m, 'd': greatest({-_CHANGE}, least({_CHANGE}, s.d)) + e.m, 'n': s.n + 1,
  'kind': CASE WHEN s.d > {_CHANGE} THEN 1 WHEN s.d <= {-_CHANGE} THEN 0 ELSE s.kind END,
  'pl': CASE WHEN s.d > {_CHANGE} OR s.d <= {-_CHANGE} THEN e.c ELSE s.pl END, 'k': CASE WHEN s.d > {_CHANGE} OR s.d <= {-_CHANGE} THEN s.n ELSE s.k END,
  'cuts': CASE WHEN (s.d > {_CHANGE} AND s.kind = 0) OR (s.d <= {-_CHANGE} AND s.kind = 1) THEN list_append(s.cuts, {{'kind': s.kind, 'pl': s.pl, 'k': s.k}}) ELSE s.cuts END}},
  {{'c': CAST(0 AS BIGINT), 'm': 0, 'd': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'kind': -1, 'pl': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT), 'cuts': CAST([] AS STRUCT(kind INTEGER, pl BIGINT, k BIGINT)[])}}) AS p FROM sums),
events AS (SELECT aln, r, q, unnest(p.cuts, recursive := true) FROM paths UNION ALL SELECT aln, r, q, p.kind, p.pl, p.k FROM paths WHERE p.kind >= 0
  UNION ALL SELECT aln, r, q, CASE WHEN p.d > 0 THEN 1 ELSE 0 END, size, p.n FROM paths),
turns AS (SELECT * FROM (SELECT *, lead(kind) OVER (PARTITION BY aln, r, q ORDER BY pl) AS next_kind FROM events) WHERE next_kind IS NULL OR next_kind <> kind),
spans AS (SELECT aln, r, q, kind, coalesce(lag(pl) OVER o, 0) AS f, pl AS t, k - coalesce(lag(k) OVER o, 0) AS n FROM turns WINDOW o AS (PARTITION BY aln, r, q ORDER BY pl)),
regions AS (SELECT s.aln, s.r, s.q, min(e.c) AS "start", max(e.c) + 1 AS "end", count(*) AS n FROM spans s JOIN (SELECT aln, r, q, unnest(list_transform(l, lambda e: {{'c': e.c}}), recursive := true) FROM sums) e
  ON s.aln = e.aln AND s.r = e.r AND s.q = e.q AND e.c >= s.f AND e.c < s.t WHERE s.kind = 1 AND s.n > 0 GROUP BY s.aln, s.r, s.q, s.f)"""


def _three_rows(spark, sf):
    """Rows a, b and c of each alignment; every other 300 columns c has other letters than a."""
    two = fixtures.aligned_from_documents(spark, sf)
    gapped = lambda z, i: F.when(((i + 1) % 101 == 0) | (z["y"] == "-"), "-").otherwise(z["x"])
    other = lambda z, i: F.when(F.floor(i / 300) % 2 == 1, F.translate(gapped(z, i), "ACGT", "CGTA")).otherwise(gapped(z, i))
    third = F.transform(F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y")), other)
    rows = F.array(*[F.struct(F.lit(n).alias("row"), F.col(n).alias("body")) for n in "abc"])
    return two.withColumn("c", F.array_join(third, "")).select(F.col("pair_id").alias("aln"), F.inline(rows))


@query("conserved_regions", f"""WITH {_PATH} SELECT aln, r AS "row", q AS r_row, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", n FROM regions""")
def conserved_regions(spark, sf):
    return conserved.conserved_regions(stored(conserved.row_pairs(_three_rows(spark, sf)), "row-pairs"), ["aln", "row", "r_row"])


@query(
    "alignment_score",
    f"""WITH {_PATH}, e AS (SELECT aln, r, q, min("start") AS s, max("end") AS t, sum(n) AS n FROM regions GROUP BY ALL), u AS (SELECT aln, sum(n) AS n, max(s) AS s, min(t) AS t FROM e GROUP BY aln)
SELECT aln, CAST(coalesce(n, 0) AS BIGINT) AS score, CAST(coalesce(s, 0) AS INTEGER) AS "start", CAST(coalesce(t, length(a)) AS INTEGER) AS "end" FROM three LEFT JOIN u USING (aln)""",
)
def alignment_score(spark, sf):
    return conserved.alignment_score(stored(_three_rows(spark, sf), "rows"), bounds="intersection")


@query(
    "window_identity",
    f"""WITH {_COLUMNS}, w AS (SELECT pair_id, col, sum(CASE WHEN same AND x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS hits, count(*) OVER (PARTITION BY pair_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM cols),
good AS (SELECT pair_id, col AS s, col + 50 AS e FROM w WHERE n = 50 AND hits >= 49),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY pair_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY pair_id ORDER BY s) = 1 THEN 1 ELSE 0 END AS new FROM good),
g AS (SELECT *, sum(new) OVER (PARTITION BY pair_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM m)
SELECT pair_id, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end" FROM g GROUP BY pair_id, r""",
)
def window_identity(spark, sf):
    return utilities.conserved_windows(variants.columns(fixtures.aligned_from_documents(spark, sf)), 50, 0.98)


@query(
    "project_alignment",
    f"""WITH {_COLUMNS} SELECT pair_id, string_agg(x, '' ORDER BY col) AS a, string_agg(y, '' ORDER BY col) AS b FROM cols WHERE NOT (x = '-' AND y = '-') GROUP BY pair_id""",
)
def project_alignment(spark, sf):
    return utilities.projected(fixtures.aligned_from_documents(spark, sf))


@query(
    "consensus_column",
    f"""WITH {_COLUMNS}, l AS (SELECT col, x AS base FROM cols WHERE x <> '-' UNION ALL SELECT col, y FROM cols WHERE y <> '-'),
c AS (SELECT col, base, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY col) AS total, row_number() OVER (PARTITION BY col ORDER BY n DESC, base) AS r FROM c)
SELECT CAST(col AS INTEGER) AS col, CASE WHEN n * 10 >= total * 6 THEN base ELSE 'N' END AS consensus, base AS most_frequent, n, CAST(total AS BIGINT) AS total FROM t WHERE r = 1""",
)
def consensus_column(spark, sf):
    return multiple.consensus(multiple.stacked(fixtures.aligned_from_documents(spark, sf)))


def _hits(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    s1, n = F.col("l_orderkey") % 2000, F.col("l_quantity").cast("int")
    s2 = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 2000
    return line.select(F.col("l_suppkey").alias("pair_id"), s1.cast("int").alias("s1"), (s1 + n).cast("int").alias("e1"), s2.cast("int").alias("s2"), (s2 + n).cast("int").alias("e2"), (F.col("l_quantity") * 1.0).alias("score"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))


_HITS = """hits AS (SELECT l_suppkey AS pair_id, CAST(l_orderkey % 2000 AS INTEGER) AS s1, CAST(l_orderkey % 2000 + CAST(l_quantity AS INTEGER) AS INTEGER) AS e1,
  CAST((l_partkey * 7 + l_orderkey) % 2000 AS INTEGER) AS s2, CAST((l_partkey * 7 + l_orderkey) % 2000 + CAST(l_quantity AS INTEGER) AS INTEGER) AS e2, l_quantity AS score,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem)"""


@query("anchor_chain")
def anchor_chain(spark, sf):
    return align.chained(_hits(spark, sf))


@query("pair_similarity", f"WITH {_HITS} SELECT pair_id, round(sum(score) / sum(e1 - s1), 6) AS similarity, count(*) AS n FROM hits GROUP BY pair_id")
def pair_similarity(spark, sf):
    return multiple.similarity(_hits(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("anchor_bounds", f"WITH {_HITS} SELECT pair_id, min(s1) AS from1, max(e1) AS to1, min(s2) AS from2, max(e2) AS to2 FROM hits GROUP BY pair_id")
def anchor_bounds(spark, sf):
    return utilities.bounds(_hits(spark, sf))


@query(
    "hit_containment",
    f"""WITH {_HITS}, o AS (SELECT *, max(e2) OVER (PARTITION BY pair_id ORDER BY s2, e2 DESC, s1, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)
SELECT pair_id, s2, e2, count(*) AS n FROM o WHERE reach IS NULL OR e2 > reach GROUP BY ALL""",
)
def hit_containment(spark, sf):
    return utilities.not_contained(_hits(spark, sf)).groupBy("pair_id", "s2", "e2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fragment_transition_score",
    f"""WITH {_HITS}, t AS (SELECT pair_id, s1, s2, e1, e2, score, lag(score) OVER o AS p, s1 - lag(e1) OVER o AS d1, s2 - lag(e2) OVER o AS d2 FROM hits WINDOW o AS (PARTITION BY pair_id ORDER BY s1, s2, e1, e2, score))
SELECT pair_id, s1, s2, round(p - 50 - 0.05 * least(abs(d1), abs(d2)) - 0.1 * greatest(abs(d1), abs(d2)) - 0.05 * (greatest(abs(d1), abs(d2)) - least(abs(d1), abs(d2))), 6) AS total FROM t WHERE p IS NOT NULL""",
)
def fragment_transition_score(spark, sf):
    order = Window.partitionBy("pair_id").orderBy("s1", "s2", "e1", "e2", "score")
    rows = _hits(spark, sf).select("*", F.lag("score").over(order).alias("p"), (F.col("s1") - F.lag("e1").over(order)).alias("d1"), (F.col("s2") - F.lag("e2").over(order)).alias("d2")).where("p is not null")
    return rows.select("pair_id", "s1", "s2", F.round(align.transition_score(F.col("p"), F.col("d1"), F.col("d2")), 6).alias("total"))


@query(
    "anchor_boxes",
    f"""WITH {_HITS}, c AS (SELECT pair_id, s1, max(e1) AS e1, min(s2) AS s2, max(e2) AS e2 FROM hits WHERE strand = '+' AND s2 >= s1 AND s2 < s1 + 50 GROUP BY ALL),
g AS (SELECT pair_id, coalesce(lag(e1) OVER o, 0) AS f1, s1 AS t1, coalesce(lag(e2) OVER o, 0) AS f2, s2 AS t2 FROM c WINDOW o AS (PARTITION BY pair_id ORDER BY s1))
SELECT pair_id, f1, t1, f2, t2 FROM g WHERE t1 - f1 > 5 AND t2 - f2 > 5 AND (t1 - f1) * (t2 - f2) >= 10""",
)
def anchor_boxes(spark, sf):
    near = _hits(spark, sf).where("strand = '+' and s2 >= s1 and s2 < s1 + 50").groupBy("pair_id", "s1").agg(F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"))
    return utilities.open_boxes(near)


@query(
    "strand_summary",
    f"""WITH {_HITS}, t AS (SELECT *, lag(strand) OVER o AS before, lag(s2) OVER o AS p2 FROM hits WINDOW o AS (PARTITION BY pair_id ORDER BY s1, s2, e1, e2, score, strand))
SELECT pair_id, count(*) AS n, count(*) FILTER (strand = '-') AS n_minus, count(*) FILTER (before <> strand) AS n_switches, count(*) FILTER (s2 < p2) AS n_jumps_back FROM t GROUP BY pair_id""",
)
def strand_summary(spark, sf):
    return utilities.strand_summary(_hits(spark, sf))


@query(
    "seed_matches",
    f"""WITH {_SEQS}, w AS (SELECT chr, file_idx, unnest(range(0, length(seq) - 11)) AS pos, seq FROM seqs WHERE length(seq) >= 12),
k AS (SELECT chr, file_idx, pos, substr(seq, pos + 1, 12) AS word FROM w), c AS (SELECT word, count(*) FILTER (file_idx = 0) AS n0, count(*) FILTER (file_idx <> 0) AS n1 FROM k GROUP BY word)
SELECT word, n0, n1, n0 * n1 AS n_pairs FROM c WHERE n0 > 0 AND n1 > 0""",
)
def seed_matches(spark, sf):
    return utilities.word_matches(_seqs(spark, sf), 12)


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Few bytes, but much work a row: small tables would be joined into one task. Rows of a batch share steps, so tasks are not many."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


@query("local_alignment")
def local_alignment(spark, sf):
    seqs = _seqs(spark, sf).where("length(seq) > 0")
    own = seqs.select("chr", F.col("seq").alias("s"))
    rows = own.join(own.select((F.col("chr") + 1).alias("chr"), F.col("s").alias("t")), "chr")
    return _spread(rows).select("chr", align.local_alignment_udf("s", "t").alias("r")).select("chr", "r.*")


@query("global_alignment")
def global_alignment(spark, sf):
    seqs = _seqs(spark, sf).where("length(seq) > 0")
    own = seqs.select(F.col("chr").cast("long").alias("pair_id"), F.col("seq").alias("a"))
    pairs = own.join(own.select((F.col("pair_id") + 1).alias("pair_id"), F.col("a").alias("b")), "pair_id")
    return align.align_pairs(_spread(pairs))


@query("multiple_alignment")
def multiple_alignment(spark, sf):
    seqs = _seqs(spark, sf).where("length(seq) > 0")
    rows = seqs.select((F.col("chr") / 4).cast("long").alias("group_id"), F.col("chr").alias("row"), "seq")
    return multiple.align_groups(_spread(rows, "group_id"))


@query(
    "pairwise_column_score",
    f"""WITH {_COLUMNS}, s AS (SELECT pair_id, col, CASE WHEN x = '-' OR y = '-' THEN -2 WHEN same THEN 1 ELSE -1 END AS v FROM cols),
p AS (SELECT pair_id, col, sum(v) OVER (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS c FROM s),
m AS (SELECT pair_id, col, c, least(0, min(c) OVER (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING)) AS low FROM p)
SELECT pair_id, CAST(max(c - low) AS BIGINT) AS best FROM m GROUP BY pair_id""",
)
def pairwise_column_score(spark, sf):
    return utilities.best_local_run(variants.columns(fixtures.aligned_from_documents(spark, sf)))


@query(
    "range_cut",
    f"""WITH {_SEQS}, r AS (SELECT chr, CAST(chr % 7 AS INTEGER) AS f, CAST(chr % 7 + 40 AS INTEGER) AS t, chr % 3 = 0 AS flip FROM seqs)
SELECT chr, f AS from_, least(t, length(seq)) - f AS n, CASE WHEN flip THEN reverse(translate(substr(seq, f + 1, t - f), 'ACGT', 'TGCA')) ELSE substr(seq, f + 1, t - f) END AS cut FROM seqs JOIN r USING (chr) WHERE length(seq) > f""",
)
def range_cut(spark, sf):
    seqs = _seqs(spark, sf)
    ranges = seqs.select("chr", (F.col("chr") % 7).cast("int").alias("from_"), (F.col("chr") % 7 + 40).cast("int").alias("to_"), (F.col("chr") % 3 == 0).alias("flip"))
    return utilities.cut_ranges(seqs, ranges)


@query(
    "letter_position_map",
    f"""WITH {_COLUMNS}, m AS (SELECT pair_id, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER o AS pa, sum(CASE WHEN y <> '-' THEN 1 ELSE 0 END) OVER o AS pb, x FROM cols WINDOW o AS (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING))
SELECT pair_id, CAST(pa AS BIGINT) AS letter_a, CAST(pb AS BIGINT) AS letter_b FROM m WHERE x <> '-'""",
)
def letter_position_map(spark, sf):
    return utilities.letter_map(variants.columns(fixtures.aligned_from_documents(spark, sf)))


@query(
    "contig_groups",
    f"""WITH {_ISLANDS} SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY island_start) AS group_no, island_start, island_end, n FROM islands""",
)
def contig_groups(spark, sf):
    return utilities.contig_groups(fixtures.intervals_from_lineitem(spark, sf), ["seq_id"])


@query("event_order_stream", """SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def event_order_stream(spark, sf):
    from ..streaming.events import hourly_counts

    return hourly_counts(spark, sf)


# ---- more of the same relations --------------------------------------------------------------


@query("strand_view", f"WITH {_SEQS} SELECT chr, 0 AS strand, seq FROM seqs UNION ALL SELECT chr, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs")
def strand_view(spark, sf):
    return kmers.strands(_seqs(spark, sf))


@query("hit_merge", f"""WITH {_HITS}, dg AS (SELECT *, s2 - s1 AS dia FROM hits WHERE e2 - s2 = e1 - s1),
m AS (SELECT *, CASE WHEN s1 > max(e1) OVER (PARTITION BY pair_id, dia ORDER BY s1, e1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY pair_id, dia ORDER BY s1, e1) = 1 THEN 1 ELSE 0 END AS new FROM dg),
g AS (SELECT *, sum(new) OVER (PARTITION BY pair_id, dia ORDER BY s1, e1 ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT pair_id, min(s1) AS s1, max(e1) AS e1, min(s1) + dia AS s2, max(e1) + dia AS e2, max(score) AS score FROM g GROUP BY pair_id, dia, g""")
def hit_merge(spark, sf):
    return multiple.merged_hits(_hits(spark, sf).drop("strand"))


_MET = f"""{_HITS}, met AS (SELECT a.*, b.s1 AS r_s1, b.e1 AS r_e1, b.s2 AS r_s2, b.e2 AS r_e2, b.score AS r_score,
  least(least(a.e1, b.e1) - greatest(a.s1, b.s1), least(a.e2, b.e2) - greatest(a.s2, b.s2)) AS shared,
  greatest(greatest(a.e1, b.e1) - least(a.s1, b.s1), greatest(a.e2, b.e2) - least(a.s2, b.s2)) AS spanned
  FROM hits a JOIN hits b ON a.pair_id = b.pair_id AND a.strand = '+' AND b.strand = '-' AND a.s1 < b.e1 AND b.s1 < a.e1 AND a.s2 < b.e2 AND b.s2 < a.e2)"""


def _two_tables(spark, sf):
    hits = _hits(spark, sf)
    return hits.where("strand = '+'").drop("strand"), hits.where("strand = '-'").drop("strand")


@query("anchor_overlap", f"WITH {_MET} SELECT pair_id, s1, e1, s2, e2, score, r_s1, r_e1, r_s2, r_e2, r_score, shared, spanned FROM met")
def anchor_overlap(spark, sf):
    return anchors.overlaps(*_two_tables(spark, sf))


@query(
    "anchor_union",
    f"""WITH {_MET}, gain AS (SELECT *, floor((score + r_score) * shared / spanned) AS joined FROM met)
SELECT pair_id, s1, e1, s2, e2, score FROM hits
UNION ALL SELECT pair_id, least(s1, r_s1), greatest(e1, r_e1), least(s2, r_s2), greatest(e2, r_e2), CAST(joined AS DOUBLE) FROM gain WHERE joined >= score AND joined >= r_score""",
)
def anchor_union(spark, sf):
    return anchors.united(*_two_tables(spark, sf))


@query(
    "anchor_columns",
    f"""WITH {_HITS}, {_COLUMNS}, l AS (SELECT pair_id, col, row_number() OVER (PARTITION BY pair_id ORDER BY col) - 1 AS letter FROM cols WHERE y <> '-')
SELECT h.pair_id, s1, e1, CAST(f.col AS INTEGER) AS s2, CAST(t.col + 1 AS INTEGER) AS e2, score FROM hits h
JOIN l f ON h.pair_id = f.pair_id AND h.s2 = f.letter JOIN l t ON h.pair_id = t.pair_id AND h.e2 - 1 = t.letter WHERE t.col + 1 - f.col >= 10""",
)
def anchor_columns(spark, sf):
    rows = fixtures.aligned_from_documents(spark, sf).select("pair_id", F.col("b").alias("body"))
    return anchors.carried(_hits(spark, sf).drop("strand"), anchors.letter_columns(rows), 2)


@query("reanchored")
def reanchored(spark, sf):
    two = fixtures.aligned_from_documents(spark, sf)
    columns = [anchors.letter_columns(two, body=row) for row in "ab"]
    return anchors.reanchored(*_two_tables(spark, sf), *columns)


@query("hit_swap", f"WITH {_HITS} SELECT pair_id, s2 AS s1, e2 AS e1, s1 AS s2, e1 AS e2, score, strand FROM hits")
def hit_swap(spark, sf):
    return utilities.swapped(_hits(spark, sf))


@query("hit_reflect", f"WITH {_HITS} SELECT pair_id, s1, e1, s2, e2, score, strand, false AS mirrored FROM hits UNION ALL SELECT pair_id, s1, e1, 2100 - e2, 2100 - s2, score, strand, true FROM hits")
def hit_reflect(spark, sf):
    sizes = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("pair_id"), F.lit(2100).alias("size2"))
    return utilities.reflected(_hits(spark, sf), sizes)


@query("hit_regions", f"""WITH {_HITS}, r AS (SELECT s_suppkey AS pair_id, s_suppkey % 500 AS a1, s_suppkey % 500 + 900 AS b1, 100 AS a2, 1500 AS b2 FROM supplier)
SELECT DISTINCT pair_id, s1, e1, s2, e2, score, strand FROM hits JOIN r USING (pair_id) WHERE s1 >= a1 AND e1 <= b1 AND s2 >= a2 AND e2 <= b2""")
def hit_regions(spark, sf):
    k = F.col("s_suppkey")
    regions = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("pair_id"), (k % 500).alias("a1"), (k % 500 + 900).alias("b1"), F.lit(100).alias("a2"), F.lit(1500).alias("b2"))
    return utilities.in_regions(_hits(spark, sf), regions)


@query("hit_crop", f"WITH {_HITS} SELECT pair_id, s1 - 300 AS s1, e1 - 300 AS e1, s2, e2, score, strand FROM hits WHERE s1 >= 300 AND e1 <= 900")
def hit_crop(spark, sf):
    return multiple.cropped(_hits(spark, sf), 300, 900)


@query("overlap_box", f"WITH {_HITS} SELECT coalesce(min(s1), -1) AS from1, coalesce(max(e1), -1) AS to1, coalesce(min(s2), -1) AS from2, coalesce(max(e2), -1) AS to2 FROM hits")
def overlap_box(spark, sf):
    return utilities.overlap_box(_hits(spark, sf))


@query("hit_text", f"""WITH {_HITS} SELECT format('a{{}} {{}} {{}}; b{{}} {{}} {{}}; score = {{:.6f}} ({{}})', pair_id, s1, e1, pair_id, s2, e2, score, strand) AS value FROM hits""")
def hit_text(spark, sf):
    from ..sources.sinks import hit_lines

    return hit_lines(_hits(spark, sf).withColumn("name1", F.concat(F.lit("a"), F.col("pair_id").cast("string"))).withColumn("name2", F.concat(F.lit("b"), F.col("pair_id").cast("string"))))


@query("hit_text_round_trip", f"WITH {_HITS} SELECT 'a' || pair_id AS name1, s1, e1, 'b' || pair_id AS name2, s2, e2, score, strand FROM hits")
def hit_text_round_trip(spark, sf):
    from ..sources.fasta import read_hits

    return read_hits(hit_text(spark, sf))


@query("stage_cover", f"""WITH {_BLOCKS}, s AS (SELECT block_id, chr, "start", "end" + 40 AS "end", CAST("start" % 3 AS INTEGER) AS stage, chr % 2 AS side FROM blocks),
two AS (SELECT block_id FROM s GROUP BY block_id HAVING count(DISTINCT side) = 2), r AS (SELECT s.* FROM s JOIN two USING (block_id)),
cuts AS (SELECT chr, "start" AS c FROM r UNION SELECT chr, "end" FROM r), pc AS (SELECT chr, c AS "start", lead(c) OVER (PARTITION BY chr ORDER BY c) AS "end" FROM cuts)
SELECT p.chr, p."start", p."end", arg_max(r.block_id, r.stage * 100000 + r.block_id) AS block_id FROM pc p JOIN r ON p.chr = r.chr AND p."start" < r."end" AND r."start" < p."end" WHERE p."end" IS NOT NULL GROUP BY ALL""")
def stage_cover(spark, sf):
    found = fixtures.blocks_from_lineitem(spark, sf).select("block_id", "chr", "start", (F.col("end") + 40).alias("end"), (F.col("start") % 3).cast("int").alias("stage"))
    return variants.last_cover(found, _sided(spark, sf))


@query("letter_extract", f"""WITH {_COLUMNS}, n AS (SELECT *, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS a FROM cols)
SELECT pair_id, string_agg(y, '' ORDER BY col) AS letters FROM n WHERE a BETWEEN 90 AND 230 AND y <> '-' GROUP BY pair_id""")
def letter_extract(spark, sf):
    return utilities.extracted(variants.columns(fixtures.aligned_from_documents(spark, sf)), 90, 230)


@query("overlay_letters", f"""WITH {_COLUMNS}, o AS (SELECT CAST(chr AS BIGINT) AS pair_id, translate(seq, 'ACGT', 'acgt') AS t FROM seqs),
n AS (SELECT *, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS a FROM cols)
SELECT pair_id, string_agg(CASE WHEN x = '-' THEN '-' ELSE substr(t, CAST(a AS BIGINT), 1) END, '' ORDER BY col) AS row FROM n JOIN o USING (pair_id) GROUP BY pair_id""")
def overlay_letters(spark, sf):
    own = _seqs(spark, sf).select(F.col("chr").cast("long").alias("pair_id"), F.translate("seq", "ACGT", "acgt").alias("seq"))
    return utilities.overlaid_rows(fixtures.aligned_from_documents(spark, sf).select("pair_id", "a"), own)


@query("mask_ranges", f"""WITH {_SEQS} SELECT chr, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN (i - 1 >= chr % 11 AND i - 1 < chr % 11 + 5) OR (i - 1 >= 30 AND i - 1 < 33) THEN 'N' ELSE substr(seq, i, 1) END), '') AS seq FROM seqs""")
def mask_ranges(spark, sf):
    seqs = _seqs(spark, sf).select("chr", "seq")
    a = (F.col("chr") % 11).cast("int")
    ranges = seqs.select("chr", F.explode(F.array(F.struct(a.alias("from_"), (a + 5).alias("to_")), F.struct(F.lit(30).alias("from_"), F.lit(33).alias("to_")))).alias("r")).select("chr", "r.*")
    return utilities.masked_ranges(seqs, ranges)


_SAM_BLOCKS = """p AS (SELECT chr, chr AS block_id, CASE WHEN chr % 3 = 0 THEN -1 ELSE 1 END AS sign, least(chr % 9, length(seq)) AS s, length(seq) AS e, seq, description FROM seqs WHERE length(seq) > 10)"""


def _own_blocks(seqs):
    return seqs.where("length(seq) > 10").select(F.col("chr").alias("block_id"), F.when(F.col("chr") % 3 == 0, -1).otherwise(1).alias("sign"), "chr", (F.col("chr") % 9).cast("int").alias("start"), F.length("seq").alias("end"))


@query("block_sam", f"""WITH {_SEQS}, {_SAM_BLOCKS} SELECT CAST(block_id AS VARCHAR) AS qname, CASE WHEN sign > 0 THEN 0 ELSE 16 END AS flag, 'd' || chr AS rname, CAST(s + 1 AS INTEGER) AS pos, 255 AS mapq, CAST(e - s AS VARCHAR) || 'M' AS cigar,
'*' AS rnext, 0 AS pnext, 0 AS tlen, substr(seq, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS seq, '*' AS qual FROM p""")
def block_sam(spark, sf):
    seqs = _seqs(spark, sf)
    return reports.sam(_own_blocks(seqs), seqs)


@query("permutation_text", f"""WITH {_SEQS}, {_BLOCKS}, l AS (SELECT chr, string_agg(CASE WHEN sign > 0 THEN '+' ELSE '-' END || block_id, ' ' ORDER BY "start", "end") AS ids FROM blocks GROUP BY chr)
SELECT chr, '>' || description || chr(10) || ids || ' $' AS value FROM l JOIN seqs USING (chr)""")
def permutation_text(spark, sf):
    from ..sources.sinks import permutation_lines

    return permutation_lines(fixtures.blocks_from_lineitem(spark, sf), _seqs(spark, sf))


@query("fasta_text", f"""WITH {_SEQS} SELECT chr, '>' || description || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM seqs""")
def fasta_text(spark, sf):
    from ..sources.sinks import fasta_lines

    return fasta_lines(_seqs(spark, sf))


@query("coordinate_text", f"""WITH {_BLOCKS}, r AS (SELECT block_id, chr, "start", (chr + 1) || chr(9) || CASE WHEN sign > 0 THEN '+' || chr(9) || ("start" + 1) || chr(9) || "end" ELSE '-' || chr(9) || "end" || chr(9) || ("start" + 1) END || chr(9) || ("end" - "start") AS row FROM blocks)
SELECT block_id, 'Block #' || block_id || chr(10) || concat_ws(chr(9), 'Seq_id', 'Strand', 'Start', 'End', 'Length') || chr(10) || string_agg(row, chr(10) ORDER BY chr, "start", row) || chr(10) || repeat('-', 80) AS value FROM r GROUP BY block_id""")
def coordinate_text(spark, sf):
    from ..sources.sinks import coordinate_lines

    return coordinate_lines(fixtures.blocks_from_lineitem(spark, sf))


@query("coordinate_text_round_trip", f"""WITH {_BLOCKS} SELECT block_id, sign, chr, "start", "end" FROM blocks""")
def coordinate_text_round_trip(spark, sf):
    from ..sources.fasta import read_block_coordinates

    return read_block_coordinates(coordinate_text(spark, sf).select("value"))


@query(
    "vcf_records",
    f"""WITH found AS ({_SQL["variants_from_alignment"]}), {_SEQS}, v AS (SELECT CAST("offset" + 1 AS INTEGER) AS pos, ref, alt, description AS id, 'd' || chr AS accession FROM found JOIN seqs ON chr = pair_id)
SELECT 0 AS part, NULL AS id, CAST(NULL AS INTEGER) AS pos, '{vcf_header("d0")}' AS value
UNION ALL SELECT 2, id, pos, concat_ws(chr(9), accession, pos, '.', coalesce(nullif(ref, ''), '.'), coalesce(nullif(alt, ''), '.'), '.', '.', '.') FROM v""",
)
def vcf_records(spark, sf):
    from ..sources.sinks import vcf_lines

    found = variants.from_alignments(fixtures.aligned_from_documents(spark, sf))
    rows = found.select(F.col("pair_id").cast("int").alias("chr"), (F.col("offset") + 1).alias("pos"), "ref", "alt")
    return vcf_lines(rows, _seqs(spark, sf), "d0")


@query("breakend_records", f"""WITH {_GAPS}, big AS (SELECT chr, gap_start, gap_end - gap_start AS n, substr(repeat('ACGTTGCA', 12513), CAST(gap_start + 1 AS BIGINT), CAST(gap_end - gap_start AS BIGINT)) AS alt FROM gaps WHERE gap_end - gap_start > 60 AND chr % 2 <> 0),
o AS (SELECT *, row_number() OVER (ORDER BY chr, gap_start, alt) - 1 AS i FROM big)
SELECT 'ref' AS chrom, 1 AS pos, 'bnd_' || (2 * i + side) AS id, 'A' AS ref, CASE WHEN side = 0 THEN 'A[contig' || chr || ':' || (gap_start + 1) || '[' ELSE ']contig' || chr || ':' || (gap_start + 1 + n) || ']A' END AS alt, 'IMPRECISE;SVTYPE=BND;CIPOS=0,100104' AS info
FROM o CROSS JOIN (SELECT unnest([0, 1]) AS side)""")
def breakend_records(spark, sf):
    found, seqs = _two_sided(spark, sf)
    gaps = variants.uncovered(found, seqs, 60).where("file_idx <> 0").join(seqs.select("chr", "seq"), "chr")
    rows = gaps.select(F.col("chr").alias("contig"), F.col("gap_start").cast("int").alias("assembly_pos"), F.substring("seq", F.col("gap_start") + 1, F.col("gap_end") - F.col("gap_start")).alias("alt"))
    names = seqs.select("chr", F.concat(F.lit("contig"), F.col("chr").cast("string")).alias("description"))
    return variants.breakends(rows, names, "ref", "A", 100_104)


@query("maf_text", f"""WITH {_ALIGNED}, r AS (SELECT pair_id AS block_id, 's ref 0 ' || length(replace(a, '-', '')) || ' + ' || length(replace(a, '-', '')) || ' ' || a AS l FROM aligned
  UNION ALL SELECT pair_id, 's asm ' || (length(a) + 50 - 7 - length(replace(b, '-', ''))) || ' ' || length(replace(b, '-', '')) || ' - ' || (length(a) + 50) || ' ' || b FROM aligned)
SELECT block_id, 'a' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) AS value FROM r GROUP BY block_id""")
def maf_text(spark, sf):
    from ..sources.sinks import maf_lines

    pairs = fixtures.aligned_from_documents(spark, sf)
    ref = pairs.select(F.col("pair_id").alias("block_id"), F.lit("ref").alias("name"), F.lit(0).alias("start"), F.lit("+").alias("strand"), F.length(S.without_gaps("a")).alias("size"), F.col("a").alias("body"))
    asm = pairs.select(F.col("pair_id").alias("block_id"), F.lit("asm").alias("name"), F.lit(7).alias("start"), F.lit("-").alias("strand"), (F.length("a") + 50).alias("size"), F.col("b").alias("body"))
    return maf_lines(ref.unionByName(asm))


@query("seed_value", f"""WITH {_SEQS}, t AS (SELECT CAST(sum(greatest(length(seq) - 11, 0)) AS BIGINT) AS places FROM seqs),
w AS (SELECT substr(seq, unnest(range(1, length(seq) - 10)), 12) AS word FROM seqs WHERE length(seq) >= 12), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, round(ln(places / n) / 12, 6) AS value FROM c, t""")
def seed_value(spark, sf):
    return utilities.seed_values(_seqs(spark, sf), 12)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
