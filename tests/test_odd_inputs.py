from helixlake.operators import utilities


def test_an_empty_sequence_has_no_letter_to_mask(spark):
    seqs = spark.createDataFrame([(0, ""), (1, "ACGT"), (2, "")], "chr int, seq string")
    ranges = spark.createDataFrame([(0, 0, 5), (1, 0, 2)], "chr int, from_ int, to_ int")
    assert dict(map(tuple, utilities.masked_ranges(seqs, ranges).collect())) == {0: "", 1: "NNGT", 2: ""}


def test_frames_of_a_long_sequence(spark):
    import time

    from pyspark.sql import functions as F

    from helixlake.functions import sequence

    letters = "ACGGTTCANTGCA" * 4_000
    one = spark.createDataFrame([(0, letters), (1, "AC"), (2, ""), (3, "ATGNNN")], "chr int, s string")
    made = one.select("chr", F.regexp_replace(F.upper("s"), "[^ACGTN]", "").alias("s"))
    began = time.time()
    found = {r.chr: r.f for r in made.select("chr", sequence.six_frames("s").alias("f")).collect()}
    assert time.time() - began < 30
    assert [len(x) for x in found[0]] == [(len(letters) - f) // 3 for f in (0, 1, 2)] * 2
    assert found[1] == [""] * 6 and found[2] == [""] * 6 and found[3][0] == "MX"


def test_edges_and_ranks_against_plain_counts(spark):
    from collections import Counter

    from helixlake.operators import kmers

    texts = {0: "ACGTACGTTNACGTA" * 3, 1: "ACGT", 2: "GG", 3: "ACGTACGT"}
    seqs = spark.createDataFrame(list(texts.items()), "chr int, seq string")
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k in (3, 4):  # words of an even length may be their own reverse complements
        plus = Counter((s[i : i + k + 1]) for s in texts.values() for i in range(len(s) - k) if "N" not in s[i : i + k + 1])
        both = plus + Counter({back(w): 0 for w in plus})
        for w, n in plus.items():
            both[back(w)] += n
        found = {r.kmer + r.next_kmer[-1]: (r.n, r.n_positive) for r in kmers.edge_counts(seqs, k).collect()}
        assert found == {w: (n, plus.get(w, 0)) for w, n in both.items()}
    places = {(c, s, i): t[i : i + 5] for c, x in texts.items() for s, t in ((0, x), (1, back(x))) for i in range(len(x) - 4)}
    rank = {w: i for i, w in enumerate(sorted(set(places.values())))}
    assert {(r.chr, r.strand, r.pos): r["rank"] for r in kmers.substring_ranks(seqs, 5).collect()} == {p: rank[w] for p, w in places.items()}


def test_overlaid_rows(spark):
    pairs = spark.createDataFrame([(1, "A-C--GT"), (2, ""), (3, "--")], "pair_id long, a string")
    letters = spark.createDataFrame([(1, "wxyz"), (2, ""), (3, "")], "pair_id long, seq string")
    assert dict(map(tuple, utilities.overlaid_rows(pairs, letters).collect())) == {1: "w-x--yz", 3: "--"}


def test_contigs_of_all_lengths_against_plain_search(spark):
    import random

    from helixlake.operators import reports

    rnd = random.Random(3)
    refs = [[rnd.choice((-1, 1)) * rnd.randrange(1, 4) for _ in range(n)] for n in (0, 3, 40, 1100)]
    asked = [[]]
    for n in (1, 2, 3, 7, 8, 9, 16, 17, 23):
        at = rnd.randrange(len(refs[3]) - n)
        run = refs[3][at : at + n]
        asked += [run, [-x for x in reversed(run)], run[:-1] + [9], [rnd.choice((-3, -2, -1, 1, 2, 3)) for _ in range(n)]]
    asked.append(refs[3][1015:1040])
    holds = lambda p, q: any(p[i : i + len(q)] == q for i in range(len(p) - len(q) + 1))
    want = {i for i, q in enumerate(asked) if not any(holds(p, q) or holds(p, [-x for x in reversed(q)]) for p in refs)}
    reference = spark.createDataFrame(list(enumerate(refs)), "chr int, permutation array<int>")
    contigs = spark.createDataFrame(list(enumerate(asked)), "name int, permutation array<int>")
    assert {r.name for r in reports.unmapped_contigs(reference, contigs).collect()} == want


def test_letters_of_rows_in_tiles(spark):
    from helixlake.operators import variants

    text = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1000))
    seqs = spark.createDataFrame([(0, text), (1, ""), (2, "ACG")], "chr int, seq string")
    spans = [(0, 0, 1000), (0, 5, 5), (0, 15, 16), (0, 15, 17), (0, 16, 300), (0, 990, 1200), (1, 0, 4), (2, 1, 3)]
    rows = spark.createDataFrame(spans, "chr int, a long, b long")
    found = {(r.chr, r.a, r.b): r.w for r in variants.with_letters(rows, seqs, "a", "b", "w", tile=16).collect()}
    assert found == {(c, a, b): (text, "", "ACG")[c][a:b] for c, a, b in spans}


def test_sequences_are_not_sent_through_the_driver(spark):
    from pyspark.sql import functions as F

    from helixlake.operators import variants

    # Judged by its rows, a table of made-up sequences is small; its letters are 30 MB.
    seqs = spark.range(300).select(F.col("id").cast("int").alias("chr"), F.repeat(F.lit("ACGTTGCA"), F.lit(12513)).alias("seq"))
    rows = spark.range(300).select(F.col("id").cast("int").alias("chr"), F.lit(4090).cast("long").alias("a"), (F.col("id") + 4100).alias("b"))
    found = variants.with_letters(rows, seqs, "a", "b", "w")
    assert {r.chr: r.w for r in found.collect()} == {c: ("ACGTTGCA" * 600)[4090 : 4100 + c] for c in range(300)}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
