"""The engine's tables against plain Python on small sequences."""

import random
from collections import defaultdict

import pytest

from helixlake.functions import sequence as S
from helixlake.operators import align, blocks, intervals, kmers, places, postprocess, simplify, variants
from helixlake.plans import catalog
from helixlake.plans.pipeline import CALLER, call_variants, find_blocks
from helixlake.sources import fasta, sinks, stages
from plain_gluing import glue_rows
from pyspark.sql import functions as F

FLIP = str.maketrans("ACGT", "TGCA")
SCHEMA = "chr int, file_idx int, description string, seq string"


def rc(s):
    return s.translate(FLIP)[::-1]


def make(spark, *texts):
    return spark.createDataFrame([(i, min(i, 1), f"s{i}", t) for i, t in enumerate(texts)], SCHEMA)


def letters(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def plain_vertices(texts, k):
    prev, nxt, n = defaultdict(set), defaultdict(set), defaultdict(int)
    for t in texts:
        for s in (t, rc(t)):
            for p in range(len(s) - k + 1):
                w = s[p : p + k]
                n[w] += 1
                prev[w].add(s[p - 1] if p else "#")
                nxt[w].add(s[p + k] if p + k < len(s) else "#")
    many = lambda x: len(x) > 1 or "#" in x
    return sorted(w for w in n if (many(prev[w]) or many(nxt[w])) and (n[w] > 1 or "#" in prev[w] | nxt[w]))


@pytest.mark.parametrize("texts", [("ACGTACGGTACGT", "ACGTTACGG"), ("AAAA", ""), ("AC",), ("ACGCGT", "ACGCGT", "TTTT")])
def test_vertices_and_edges(spark, texts):
    k = 3
    seqs = make(spark, *texts)
    windows, vertex, edge = kmers.graph(seqs, k)
    want = plain_vertices(texts, k)
    assert [(r.kmer, r.vertex) for r in vertex.orderBy("vertex").collect()] == [(w, i) for i, w in enumerate(want)]
    got = sorted((r.chr, r.strand, r.start_vertex, r.end_vertex, r.actual_pos, r.actual_len, r.first_char) for r in edge.collect())
    index, expected = {w: i for i, w in enumerate(want)}, []
    for c, t in enumerate(texts):
        for strand, s in enumerate((t, rc(t))):
            at = [p for p in range(len(s) - k + 1) if s[p : p + k] in index]
            for a, b in zip(at, at[1:], strict=False):
                n = b - a + k
                expected.append((c, strand, index[s[a : a + k]], index[s[b : b + k]], a if strand == 0 else len(s) - a - n, n, s[a + k]))
    assert got == sorted(expected)


def test_kmers_skip_ambiguous_letters_and_short_sequences(spark):
    rows = kmers.kmers(make(spark, "ACNGT", "A", ""), 2).collect()
    assert sorted((r.strand, r.pos, r.kmer) for r in rows) == [(0, 0, "AC"), (0, 3, "GT"), (1, 0, "AC"), (1, 3, "GT")]


@pytest.mark.parametrize("k", [1, 2, 5, 7])
def test_substring_ranks_order_kmers(spark, k):
    texts = ("ACGTACGTTT", "TTACGA")
    got = {(r.chr, r.strand, r.pos): r["rank"] for r in kmers.substring_ranks(make(spark, *texts), k).collect()}
    words = {(c, s, p): x[p : p + k] for c, t in enumerate(texts) for s, x in enumerate((t, rc(t))) for p in range(len(x) - k + 1)}
    assert set(got) == set(words)
    assert [w for _, w in sorted((got[p], words[p]) for p in words)] == sorted(words.values())


def test_blocks_do_not_overlap_and_find_an_inversion(spark):
    core = letters(1, 200)
    seqs = make(spark, letters(2, 80) + core + letters(3, 50), letters(4, 40) + rc(core) + letters(5, 90))
    found = find_blocks(seqs, stages=[(15, 60)], min_block_size=100, max_iterations=1)
    rows = blocks.coordinates(found.blocks).orderBy("seq_id").collect()
    assert len(rows) == 2 and {r.strand for r in rows} == {"+", "-"}
    assert all(r.length >= 150 for r in rows)


def test_settled_blocks_are_disjoint(spark):
    parts = [letters(i, 60) for i in range(4)]
    seqs = make(spark, parts[0] + parts[1] + parts[2], parts[1] + parts[0] + parts[3], parts[2] + parts[0])
    got = blocks.find_disjoint_blocks(kmers.graph(seqs, 10)[2], seqs, 30).collect()
    assert got
    by = defaultdict(list)
    for r in got:
        by[r["chr"]].append((r["start"], r["end"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(len([r for r in got if r.block_id == b]) >= 2 for b in {r.block_id for r in got})


def test_a_bulge_of_one_letter_is_collapsed(spark):
    left, right = letters(7, 40), letters(8, 40)
    seqs = make(spark, left + "A" + right, left + "C" + right, left + "A" + right)
    out = places.expanded(simplify.simplify(seqs, 12, 40, 3)).orderBy("chr").collect()
    assert len({r.seq for r in out}) == 1
    assert all(len(r.seq) == len(r.orig) and r.orig == sorted(r.orig) for r in out)


def plain_places(first, last, source, target):
    way = 1 if last >= first else -1
    return [first + way * min(abs(last - first), step * target // source) for step in range(source)]


def test_collapse_equals_edits_made_one_by_one(spark):
    assert plain_places(10, 14, 5, 5) == [10, 11, 12, 13, 14] and plain_places(14, 10, 5, 5) == [14, 13, 12, 11, 10] and max(plain_places(0, 2, 9, 3)) <= 2
    rng = random.Random(1)
    sizes = [0, 60, 200, 900] * 5
    texts = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in sizes]
    origs = [sorted((rng.randrange(2 * n) for _ in range(n)), reverse=c % 3 == 0) for c, n in enumerate(sizes)]
    bulges, want = [], {}
    for c, text in enumerate(texts):
        at, own = 0, []
        while text and c % 5 and at < len(text) - 20:
            a = at + rng.randrange(15)
            b = min(len(text), a + rng.randrange(1, 20))
            at, w, w_a, strand, w_strand = b + rng.randrange(9), rng.choice([i for i, n in enumerate(sizes) if n]), rng.randrange(40), rng.randrange(2), rng.randrange(2)
            w_b = w_a + rng.randrange(20)
            bulges.append((w, c, strand, a, b, w_strand, w_a, w_b))
            new = texts[w][w_a:w_b]
            own.append((a, b, new if strand == w_strand else rc(new)))
        seq, orig = text, list(origs[c])
        for a, b, new in reversed(own):
            put = plain_places(orig[a], orig[b - 1], len(new), b - a) if new else []
            seq, orig[a:b] = seq[:a] + new + seq[b:], put
        want[c] = (seq, orig)
    seqs = spark.createDataFrame([(c, c % 2, f"d{c}", t, [(i, 1, o, 1, 1, 1, 0, 0) for i, o in enumerate(p)]) for c, (t, p) in enumerate(zip(texts, origs, strict=True))], "chr int, file_idx int, description string, seq string, places array<struct<" + ", ".join(f"{f}: int" for f in places.FIELDS) + ">>")
    rows = spark.createDataFrame(bulges, "w_chr int, chr int, strand int, start int, end int, w_strand int, w_start int, w_end int")
    assert {r.chr: (r.seq, list(r.orig)) for r in places.expanded(simplify.collapse(seqs, rows, 5)).collect()} == want
    assert {r.chr: (r.seq, list(r.orig)) for r in places.expanded(simplify.collapse(seqs, rows.limit(0), 5)).collect()} == {c: (t, p) for c, (t, p) in enumerate(zip(texts, origs, strict=True))}


def test_gluing_joins_blocks_that_always_follow_each_other(spark):
    rows = [(1, 1, 0, 0, 10), (2, 1, 0, 12, 20), (3, 1, 0, 30, 40), (2, -1, 1, 0, 8), (1, -1, 1, 9, 19), (3, 1, 2, 0, 10)]
    b = spark.createDataFrame(rows, "block_id int, sign int, chr int, `start` int, `end` int")
    out = sorted(tuple(r) for r in postprocess.glue_stripes(b).collect())
    assert out == [(1, -1, 1, 0, 19), (1, 1, 0, 0, 20), (2, 1, 0, 30, 40), (2, 1, 2, 0, 10)]


def plain_glue(rows):
    """Smallest block first, one pair at a time."""
    perms = defaultdict(list)
    for b, sign, c, s, e in sorted(rows, key=lambda r: (r[2], r[3])):
        perms[c].append([b, sign, s, e])
    while True:
        follow = defaultdict(list)
        for p in perms.values():
            for i, (b, sign, _, _) in enumerate(p):
                j = i + sign
                follow[b].append(sign * p[j][0] * p[j][1] if 0 <= j < len(p) else None)
        pick = next((b for b in sorted(follow) if len(set(follow[b])) == 1 and follow[b][0] is not None and abs(follow[b][0]) != b and len(follow[abs(follow[b][0])]) == len(follow[b])), None)
        if pick is None:
            break
        other = abs(follow[pick][0])
        for c, p in perms.items():
            out = []
            for i, (b, sign, s, e) in enumerate(p):
                if b == pick:
                    out.append([b, sign, s, p[i + 1][3]] if sign > 0 else [b, sign, p[i - 1][2], e])
                elif b != other:
                    out.append([b, sign, s, e])
            perms[c] = out
    ids = {b: i + 1 for i, b in enumerate(sorted({x[0] for p in perms.values() for x in p}))}
    return sorted((ids[b], sign, c, s, e) for c, p in perms.items() for b, sign, s, e in p)


def test_gluing_equals_one_pair_at_a_time():
    for seed in range(3000):
        rng = random.Random(seed)
        n, rows = rng.randint(2, 6), []
        for c in range(rng.randint(1, 3)):
            rows += [(rng.randint(1, n), rng.choice([1, -1]), c, 10 * i, 10 * i + 7) for i in range(rng.randint(0, 7))]
        got = glue_rows(rows)
        ids = {b: i + 1 for i, b in enumerate(sorted({r[0] for r in got}))}
        assert sorted((ids[r[0]], *r[1:]) for r in got) == plain_glue(rows)


def test_islands_and_complement(spark):
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (2, 3, 4)], "k int, `start` int, `end` int")
    got = sorted(tuple(r) for r in intervals.islands(iv, ["k"]).collect())
    assert got == [(1, 0, 7, 2), (1, 9, 12, 1), (2, 3, 4, 1)]
    ext = spark.createDataFrame([(1, 12), (2, 10), (3, 4)], "k int, size int")
    gaps = sorted(tuple(r) for r in intervals.complement(iv, ext, ["k"]).collect())
    assert gaps == [(1, 7, 9), (2, 0, 3), (2, 4, 10), (3, 0, 4)]


def test_range_join_finds_each_pair_once(spark):
    rng = random.Random(6)
    a = [(i, s := rng.randint(0, 60), s + rng.randint(1, 30)) for i in range(40)]
    left = spark.createDataFrame([(1, *x) for x in a], "k int, i int, `start` int, `end` int")
    got = sorted((r.i, r.r_i) for r in intervals.range_join(left, left, ["k"], 8).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in a if x[1] < y[2] and y[1] < x[2])


def literal_segments(a, b, least=30):
    out, last, start = [], None, 0
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        now = x == y
        if last is None:
            last = now
        elif now != last:
            if not last or i - start >= least or start == 0:
                out.append((start, i, last))
                start = i
            elif out:
                start = out.pop()[0]
            last = now
    return [*out, (start, len(a), last)]


def test_segments_equal_a_literal_fold(spark):
    rng = random.Random(9)
    pairs = []
    for p in range(25):
        a = letters(p, 200)
        b = "".join("-" if rng.random() < 0.02 else rng.choice("ACGT") if rng.random() < 0.03 else c for c in a)
        pairs.append((p, a, b))
    df = spark.createDataFrame(pairs, "pair_id long, a string, b string")
    got = defaultdict(list)
    for r in variants.segments(variants.columns(df)).collect():
        got[r.pair_id].append((r.start, r.end, r.same))
    for p, a, b in pairs:
        assert sorted(got[p]) == literal_segments(a, b)


def test_variants_turn_the_reference_into_the_assembly(spark):
    core = letters(11, 300)
    other = core[:100] + ("A" if core[100] != "A" else "C") + core[101:180] + "GGTT" + core[180:]
    found = call_variants(make(spark, core, other), min_block_size=80, stages=[(20, 60)], max_iterations=2)
    rows = sorted((r.pos, r.ref, r.alt) for r in found.variants.collect())
    text = core
    for pos, ref, alt in reversed(rows):
        assert text[pos - 1 : pos - 1 + len(ref)] == ref
        text = text[: pos - 1] + alt + text[pos - 1 + len(ref) :]
    assert text == other


def test_records_name_sequences_and_keep_their_order(spark):
    seqs = spark.createDataFrame([(0, 0, "gi|7|ref|NC_1.2|", "ACGT"), (1, 0, "plain", "AC"), (2, 1, "contig_b", "A" * 80)], SCHEMA)
    found = spark.createDataFrame([(1, 5, "A", ""), (0, 9, "C", "G"), (0, 2, "", "T"), (8, 1, "A", "C")], "chr int, pos int, ref string, alt string")
    unplaced = spark.createDataFrame([(2, 9, "A" * 70)], "contig int, assembly_pos int, alt string")
    mates = variants.breakends(unplaced, seqs, "NC_1", "A", 4)
    rows = [r.value for r in sinks.vcf_lines(found, seqs, "NC_1", mates).orderBy("part", "id", "pos").collect()]
    assert rows[0] == sinks.vcf_header("NC_1")
    tail = "\t.\t.\tIMPRECISE;SVTYPE=BND;CIPOS=0,4"
    assert rows[1:3] == ["NC_1\t1\tbnd_0\tA\tA[contig_b:10[" + tail, "NC_1\t1\tbnd_1\tA\t]contig_b:80]A" + tail]
    assert rows[3:] == [f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t." for c, p, r, a in ((".", 1, "A", "C"), ("NC_1", 2, ".", "T"), ("NC_1", 9, "C", "G"), ("plain", 5, "A", "."))]
    assert [r.value for r in sinks.unplaced_fasta_lines(unplaced, seqs).collect()] == ['>Seq="contig_b",Start=10",End=79\n' + "A" * 60 + "\n" + "A" * 10]
    assert [r.value for r in sinks.unplaced_table_lines(unplaced, seqs).orderBy("part").collect()] == ["SEQ_ID\tPOS\tFRAGMENT", "contig_b\t10\t" + "A" * 70]


def test_blocks_with_more_copies_are_aligned_too(spark):
    core = letters(21, 40)
    seqs = make(spark, core + "GG" + core, rc(core), core[:20] + "T" + core[20:])
    found = spark.createDataFrame([(1, 1, 0, 0, 40), (1, 1, 0, 42, 82), (1, -1, 1, 0, 40), (1, 1, 2, 0, 41), (2, 1, 0, 0, 5), (2, 1, 1, 0, 5)], "block_id int, sign int, chr int, start int, end int")
    rows = variants.copy_alignments(found, seqs, 3).orderBy("row").collect()
    assert [(r.block_id, r.chr, r.start) for r in rows] == [(1, 0, 0), (1, 0, 42), (1, 1, 0), (1, 2, 0)]
    assert [r.body.replace("-", "") for r in rows] == [core, core, core, core[:20] + "T" + core[20:]] and {len(r.body) for r in rows} == {41}
    assert not variants.copy_alignments(found.where("block_id = 2"), seqs, 3).count()


def test_caller_options_turn_the_reference_into_the_assembly(spark):
    core = letters(12, 300)
    other = core[:150] + ("A" if core[150] != "A" else "C") + core[151:]
    found = call_variants(make(spark, core, other), min_block_size=80, stages=[(20, 60)], max_iterations=2, align_copies=True, **CALLER)
    assert [(r.chr, r.pos, r.ref, r.alt) for r in found.variants.collect()] == [(0, 151, core[150], other[150])]
    assert found.copies.count() == 0


def test_identifiers_and_wrapping(spark):
    row = spark.createDataFrame([("gi|1|ref|NC_000.1|", "A" * 165)], "d string, s string").select(S.stripped_id("d"), S.accession("d"), S.wrapped("s"), S.translated(F.lit("ATGGCCTAN")), S.replace_ambiguous(F.lit(1), F.lit("ANNT"))).first()
    assert row[0] == "NC_000" and row[1] == "NC_000" and [len(x) for x in row[2].split("\n")] == [80, 80, 5]
    assert row[3] == "MAX" and len(row[4]) == 4 and set(row[4]) <= set("ACGT") and row[4][0] == "A"


def test_fasta_round_trip_and_errors(spark, tmp_path):
    one, two = tmp_path / "a.fa", tmp_path / "b.fa"
    one.write_text(">first x\nacgt\nAC\n\n>second\nTTNN\n")
    two.write_text(">third\r\nGG\r\n")
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, [str(one), str(two)]).collect())
    assert got == [(0, 0, "first", "ACGTAC"), (1, 0, "second", "TTNN"), (2, 1, "third", "GG")]
    out = str(tmp_path / "out")
    sinks.save(sinks.fasta_lines(fasta.read_fasta(spark, [str(one)])), out, ["chr"])
    again = fasta.read_fasta(spark, [out]).select("description", "seq").collect()
    assert sorted(map(tuple, again)) == [("first", "ACGTAC"), ("second", "TTNN")]
    for bad in ("ACGT\n>x\nAC\n", ">x\n\n>y\nAC\n", ">x\nAC!T\n", "> \nACGT\n"):
        one.write_text(bad)
        with pytest.raises(Exception, match="letter|header|empty"):
            fasta.read_fasta(spark, [str(one)]).collect()


def test_stage_files():
    assert stages.parse_stages("2 30 150 100 500") == [(30, 150), (100, 500)]
    assert stages.parse_stages("0") == []
    for bad in ("", "2 30 150", "1 1 5", "1 5 -1", "x"):
        with pytest.raises(ValueError):
            stages.parse_stages(bad)
    with pytest.raises(ValueError):
        stages.stage_list("none such")


def test_text_formats(spark):
    lines = spark.createDataFrame([("a 1 5; b 2 6; score = 7.5 (-)",), ("(1 5)=(2 6) 3.5",)], "value string")
    assert fasta.read_hits(lines).first().score == 7.5 and fasta.read_anchors(lines).first().e2 == 6
    perm = spark.createDataFrame([("x\n+1 -2 +3 $",)], "value string")
    assert fasta.read_permutations(perm).first().permutation == [1, -2, 3]
    b = spark.createDataFrame([(1, 1, 0, 4, 9), (1, -1, 2, 0, 5)], "block_id int, sign int, chr int, `start` int, `end` int")
    text = sinks.coordinate_lines(b).select("value")
    assert sorted(map(tuple, fasta.read_block_coordinates(text).collect())) == sorted(map(tuple, b.collect()))


def test_runs_of_permutations(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3]), ([1, 2], [2, 1]), ([1], [1, 2]), ([5], [])], "w array<int>, q array<int>")
    assert [r[0] for r in df.select(S.contains_run("w", "q")).collect()] == [True, False, False, True]
    assert df.select(S.reverse_permutation("w")).first()[0] == [-3, -2, -1]


def test_stream_counts(spark):
    from helixlake.streaming.events import hourly_counts

    n = hourly_counts(spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_the_entry_imports_without_the_optional_part():
    import __spark_entry__ as e

    assert "edge_groups" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_alignment_queries_hold_whole_sequences(spark):
    sf = "/root/testdata/sf0.001"
    seqs = {r.chr: r.seq for r in catalog._seqs(spark, sf).collect() if r.seq}
    pairs = {r.pair_id: r for r in catalog.queries()["global_alignment"](spark, sf).collect()}
    assert {p for p in seqs if p - 1 in seqs} == set(pairs)
    assert all((r.a.replace("-", ""), r.b.replace("-", "")) == (seqs[p], seqs[p - 1]) for p, r in pairs.items())
    local = {r.chr: r for r in catalog.queries()["local_alignment"](spark, sf).collect()}
    assert set(local) == set(pairs) and max(r.end1 for r in local.values()) > 100
    for p in sorted(local, key=lambda p: -local[p].end1)[:5]:
        assert tuple(local[p])[1:] == align.local_alignment(seqs[p], seqs[p - 1], *align.LOCAL)
    many = catalog.queries()["multiple_alignment"](spark, sf).collect()
    assert {r.row: r.body.replace("-", "") for r in many} == seqs


def test_block_queries_simplify_in_all_rounds(spark, monkeypatch):
    from helixlake.plans import pipeline

    class Reached(Exception):
        pass

    def stop(*_):
        raise Reached

    seen = []

    def record(seqs, k, distance, max_iterations=4):
        seen.append((k, distance, max_iterations))
        return seqs if "orig" in seqs.columns else simplify.with_places(seqs)

    monkeypatch.setattr(pipeline, "simplify", record)
    monkeypatch.setattr(pipeline, "graph", lambda *_: (None, None, None))
    monkeypatch.setattr(pipeline, "find_disjoint_blocks", stop)
    fine = [(k, d, 4) for k, d in stages.stage_list("fine")]
    for name in ("variant_pipeline", "block_pipeline"):
        with pytest.raises(Reached):
            catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert seen == fine
        seen.clear()
    monkeypatch.setattr(simplify, "simplify", record)
    catalog.queries()["bulge_collapse"](spark, "/root/testdata/sf0.001")
    assert seen == [(catalog.K, catalog.REACH, 4)]


def test_projection_of_many_rows_drops_columns_of_gaps(spark):
    from helixlake.operators import utilities

    rows = [(1, "x", "A-C--"), (1, "y", "A-G-T"), (1, "z", "ACG-T"), (2, "x", "--"), (2, "z", "AC"), (3, "x", ""), (4, "z", "A"), (5, "x", "A-"), (5, "y", "A")]
    df = spark.createDataFrame(rows, "aln long, row string, body string")
    got = sorted(tuple(r) for r in utilities.project_rows(df, ["x", "y"]).collect())
    assert got == [(1, "x", "AC-"), (1, "y", "AGT"), (2, "x", ""), (3, "x", ""), (5, "x", "A"), (5, "y", "A")]
    assert utilities.project_rows(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("k", [1, 2, 6, 31, 40])
def test_super_kmers_give_every_kmer_of_both_strands(spark, k):
    copied = letters(3, 500)
    texts = (copied, rc(copied), "A" * 700, "AT" * 90, letters(4, 300) + "N" + letters(5, 60) + "X", "ACGT", "")
    runs = kmers.super_kmers(make(spark, *texts), k)
    n, before, after, places = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for c, t in enumerate(texts):
        for strand, s in enumerate((t, rc(t))):
            for p in range(len(s) - k + 1):
                w = s[p : p + k]
                if set(w) <= set("ACGT"):
                    n[w] += 1
                    before[w].add(s[p - 1] if p else "#")
                    after[w].add(s[p + k] if p + k < len(s) else "#")
                    places[w].add((c, strand, p))
    bits = {"A": 1, "C": 2, "G": 4, "T": 8, "#": 16, "N": 32, "X": 32}
    mask = lambda found: sum({bits[x] for x in found})
    got = kmers.extension_sets(runs, k).collect()
    assert sorted((r.kmer, r.n, r.prev_mask, r.next_mask) for r in got) == sorted((w, n[w], mask(before[w]), mask(after[w])) for w in n)
    vertex = kmers.vertices(runs, k)
    named = {r.vertex: r.kmer for r in vertex.collect()}
    found = kmers.vertex_instances(runs, vertex, k).collect()
    assert sorted((r.chr, r.strand, r.pos, named[r.vertex]) for r in found) == sorted((*p, w) for w in named.values() for p in places[w])


def test_kmers_of_a_minimiser_are_grouped_without_another_shuffle(spark):
    plan = kmers.extension_sets(kmers.super_kmers(make(spark, letters(6, 200)), 30), 30)._jdf.queryExecution().executedPlan().toString()
    # Tiles, equal runs, minimisers: none of them moves a k-mer.
    assert plan.count("Exchange") == 3
