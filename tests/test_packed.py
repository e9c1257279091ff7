"""Packed k-mers against strings, and where they go."""

import random
from collections import defaultdict

import pytest

from helixlake.operators import kmers, packed
from pyspark.sql import functions as F
from test_engine import letters, make, plain_vertices, rc


@pytest.mark.parametrize("k", [1, 2, 6, 30, 31])
def test_packed_kmers_give_every_kmer_of_both_strands(spark, k):
    copied = letters(3, 500)
    texts = (copied, rc(copied), "A" * 700, "AT" * 90, letters(4, 300) + "N" + letters(5, 60) + "X", "ACGT", "", letters(11, 70_000))
    seqs = make(spark, *texts)
    n, before, after, places = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for c, t in enumerate(texts):
        for strand, s in enumerate((t, rc(t))):
            for p in range(len(s) - k + 1):
                w = s[p : p + k]
                if set(w) <= set("ACGT"):
                    n[w] += 1
                    before[w].add(s[p - 1] if p else "#")
                    after[w].add(s[p + k] if p + k < len(s) else "#")
                    places[w].add((c, strand, p, s[p + k] if p + k < len(s) else "#"))
    bits = {"A": 1, "C": 2, "G": 4, "T": 8, "#": 16, "N": 32, "X": 32}
    mask = lambda found: sum({bits[x] for x in found})
    got = kmers.extensions(seqs, k).collect()
    assert sorted((r.kmer, r.n, r.prev_mask, r.next_mask) for r in got) == sorted((w, n[w], mask(before[w]), mask(after[w])) for w in n)
    runs = kmers.places_of(seqs, k)
    vertex = kmers.vertices(runs, k)
    named = {r.vertex: (r.kmer, r.n) for r in vertex.collect()}
    want = [w for w in plain_vertices(texts, k) if set(w) <= set("ACGT")]
    assert [named[i] for i in range(len(named))] == [(w, n[w]) for w in want]
    found = kmers.vertex_instances(runs, vertex, k).collect()
    assert sorted((r.chr, r.strand, r.pos, r.next, named[r.vertex][0]) for r in found) == sorted((*p, w) for w in want for p in places[w])


def test_edges_of_both_strands_come_from_one(spark):
    rng = random.Random(2)
    part = [letters(i, 40) for i in range(6)]
    texts = ["".join(rng.choice(part) for _ in range(12)) for _ in range(5)] + [rc(part[0] + part[1]), "ACGT"]
    seqs = make(spark, *texts)
    runs, vertex, found = kmers.graph(seqs, 12)
    want = kmers.edges(kmers.vertex_instances(runs, vertex, 12), seqs, 12)
    assert found.columns == want.columns and found.count() > 100
    assert sorted(found.collect()) == sorted(want.collect())


def test_partitions_of_kmers_grow_with_the_letters(spark, monkeypatch):
    monkeypatch.setattr(packed, "PLACES", 1000)
    seqs = make(spark, *[letters(i, 5000) for i in range(8)])
    dealt = packed._dealt(seqs, 30, "key", "info")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8 * (5000 - 29) and max(sizes) < 2000
