"""Bulges: which go in a round, and whole simplifications, against plain Python."""

import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from helixlake.operators import intervals, places, simplify
from test_engine import letters, make, plain_places, plain_vertices, rc


def overlap(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


def plain_greedy(pairs):
    """pairs: (written, read) intervals in order; whole list against whole list."""
    taken = []
    for i, (w, r) in enumerate(pairs):
        if not any(overlap(w, pairs[j][0]) or overlap(w, pairs[j][1]) or overlap(r, pairs[j][0]) for j in taken):
            taken.append(i)
    return taken


def test_least_overlapping_equals_all_pairs(spark):
    rng = random.Random(4)
    for longest in (1, 7, 64, 300):
        span = lambda: (c := rng.randrange(3), a := rng.randrange(900), a + rng.randint(1, longest))  # noqa: B023, E731
        targets, spans = [span() for _ in range(150)], [(*span(), rng.randrange(1000)) for _ in range(120)]
        df = intervals.least_overlapping(spark.createDataFrame(targets, "chr int, start int, end int"), spark.createDataFrame(spans, "chr int, start int, end int, v int"), ["chr"], "v", longest)
        want = {t: min(v for *s, v in spans if overlap(t, s)) for t in targets if any(overlap(t, s) for s in spans)}
        assert {(r.chr, r.start, r.end): r.v for r in df.collect()} == want


def test_rounds_choose_what_one_task_does(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        c, w = rng.randrange(3), rng.randrange(3)
        a, b = rng.randrange(1200), rng.randrange(1200)
        # winners are shared by many pairs, and some losers lie on each other
        b -= b % 40
        size, read = rng.randint(5, 40), 30
        if c == w and a < b + read and b < a + size:
            continue
        rows.append((rng.randrange(40), rng.randrange(40), c, 0, a, a, a + size, w, b, b + read, i))
    pairs = spark.createDataFrame(rows, "vertex long, meet long, chr int, strand int, pos int, start int, end int, w_chr int, w_start int, w_end int, i int")
    pairs = pairs.withColumn("order", F.struct(F.xxhash64("vertex", "meet").alias("h"), "vertex", "meet", "chr", "strand", "pos")).dropDuplicates(["order"])
    listed = pairs.orderBy("order").collect()
    want = {listed[j].i for j in plain_greedy([((r.chr, r.start, r.end), (r.w_chr, r.w_start, r.w_end)) for r in listed])}
    assert 10 < len(want) < len(listed)
    for one_task in (0, 10**6):
        assert {r.i for r in simplify.chosen_bulges(pairs, 41, one_task).collect()} == want
    # what is left is in the way of one that went
    went = [r for r in listed if r.i in want]
    for r in listed:
        own, read = (r.chr, r.start, r.end), (r.w_chr, r.w_start, r.w_end)
        assert r.i in want or any(overlap(own, (t.chr, t.start, t.end)) or overlap(own, (t.w_chr, t.w_start, t.w_end)) or overlap(read, (t.chr, t.start, t.end)) for t in went)
    assert simplify.chosen_bulges(pairs.limit(0), 41).count() == 0


def hashed(vertex, meet):
    h = xxh64_intdigest(struct.pack("<q", meet), xxh64_intdigest(struct.pack("<q", vertex), 42))
    return h - (1 << 64) if h >> 63 else h


def plain_pairs(texts, k, distance, waiting):
    """(order, loser, winner) with intervals, and the vertices; every branch is walked letter by letter."""
    kmer = plain_vertices(texts, k)
    rank = {w: i for i, w in enumerate(kmer)}
    way = {(c, s): [(p, rank[x[p : p + k]], x[p + k] if p + k < len(x) else "#") for p in range(len(x) - k + 1) if x[p : p + k] in rank] for c, t in enumerate(texts) for s, x in enumerate((t, rc(t)))}
    count = Counter(v for own in way.values() for _, v, _ in own)
    reached = defaultdict(list)
    for (c, s), own in way.items():
        for i, (p, v, first) in enumerate(own):
            if count[v] < 2 or first == "#" or (waiting is not None and kmer[v] not in waiting):
                continue
            inside, seen = 0, set()
            for q, meet, _ in own[i + 1 :]:
                if q - p >= distance or meet == v:
                    break
                if meet not in seen:
                    reached[v, meet].append((inside, s, c, p, q - p, first))
                seen.add(meet)
                inside = max(inside, count[meet])
    out = []
    for (v, meet), rows in reached.items():
        if len({r[5] for r in rows}) < 2:
            continue
        rows.sort(key=lambda r: (-r[0], *r[1:4]))
        at = lambda r: (r[2], a := r[3] if r[1] == 0 else len(texts[r[2]]) - r[3] - r[4] - k, a + r[4] + k)
        for r in rows[1:]:
            if r[5] != rows[0][5] and not overlap(at(r), at(rows[0])):
                out.append(((hashed(v, meet), v, meet, r[2], r[1], r[3]), (*at(r), r[1]), (*at(rows[0]), rows[0][1])))
    return sorted(out), kmer


def plain_simplify(texts, k, distance, iterations):
    now = [(t, list(range(len(t)))) for t in texts]
    for _ in range(iterations):
        waiting, changed = None, False
        while True:
            pairs, kmer = plain_pairs([t for t, _ in now], k, distance, waiting)
            taken = plain_greedy([(lost, won) for _, lost, won in pairs])
            if not taken:
                break
            changed = True
            old = [t for t, _ in now]
            for i in sorted(taken, key=lambda i: pairs[i][1], reverse=True):
                (c, a, b, s), (w, x, y, ws) = pairs[i][1:]
                new = old[w][x:y] if s == ws else rc(old[w][x:y])
                seq, orig = now[c]
                now[c] = seq[:a] + new + seq[b:], orig[:a] + plain_places(orig[a], orig[b - 1], len(new), b - a) + orig[b:]
            waiting = {kmer[p[0][1]] for p in pairs} - {kmer[pairs[i][0][1]] for i in taken}
            if not waiting:
                break
        if not changed:
            break
    return now


def mutated(seed, text, every):
    rng = random.Random(seed)
    out = [rng.choice("ACGT") if rng.random() < 1 / every else c for c in text]
    cut = rng.randrange(len(out))
    return "".join(out[:cut] + [rng.choice("ACGT")] * rng.randint(0, 2) + out[cut + rng.randint(0, 2) :])


@pytest.mark.parametrize("one_task", [simplify.ONE_TASK, 0])
def test_simplify_equals_a_plain_version(spark, one_task):
    base = letters(3, 500)
    texts = [base, mutated(1, base, 30), rc(mutated(2, base, 40)), mutated(3, base[:300], 25) + letters(5, 60) + base[200:]]
    out = places.expanded(simplify.simplify(make(spark, *texts), 11, 40, 2 if one_task else 1, one_task)).orderBy("chr").collect()
    want = plain_simplify(texts, 11, 40, 2 if one_task else 1)
    assert [(r.seq, list(r.orig)) for r in out] == want
    assert sum(t != w for t, (w, _) in zip(texts, want, strict=True)) > 1
    pairs, _ = plain_pairs([t for t, _ in want], 11, 40, None)
    assert len(pairs) < len(plain_pairs(texts, 11, 40, None)[0]) / 3


def test_least_overlapping_moves_each_row_once(spark):
    rnd = random.Random(11)
    tile = 1 << 13
    at = [0, tile - 3, tile - 1, tile, tile + 1, 2 * tile - 2, 5 * tile]
    spans = [(c, p, p + rnd.randint(1, 40), (rnd.randint(0, 9), i)) for i, (c, p) in enumerate((rnd.choice([None, 1, 2, 3]), rnd.choice(at) + rnd.randint(0, 30)) for _ in range(300))]
    targets = [(c, p, p + rnd.randint(1, 40)) for c, p in ((rnd.choice([None, 1, 2]), rnd.choice(at) + rnd.randint(0, 30)) for _ in range(120))]
    df = intervals.least_overlapping(
        spark.createDataFrame(targets, "chr int, start int, end int"), spark.createDataFrame(spans, "chr int, start int, end int, v struct<a: int, b: long>"), ["chr"], "v", 40
    )
    expected = {}
    for c, s, e in targets:
        met = [v for d, a, b, v in spans if c is not None and c == d and a < e and s < b]
        if met:
            expected[c, s, e] = min(met)
    found = [((r.chr, r.start, r.end), tuple(r.v)) for r in df.collect()]
    assert len(found) == len(expected) and dict(found) == expected
    assert df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_in_rounds_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(240):
        a, b = rng.randrange(900), rng.randrange(900)
        rows.append((rng.randrange(60), i, rng.randrange(2), 0, a, a, a + rng.randint(5, 40), 2 + rng.randrange(2), b, b + 30, i))
    pairs = spark.createDataFrame(rows, "vertex long, meet long, chr int, strand int, pos int, start int, end int, w_chr int, w_start int, w_end int, i int")
    pairs = pairs.withColumn("order", F.struct(F.xxhash64("vertex", "meet").alias("h"), "vertex", "meet", "chr", "strand", "pos")).localCheckpoint()
    listed = pairs.orderBy("order").collect()
    want = {listed[j].i for j in plain_greedy([((r.chr, r.start, r.end), (r.w_chr, r.w_start, r.w_end)) for r in listed])}
    plans, names = [], []

    def stored(df, name="table", plain=simplify.stored):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(simplify, "stored", stored)
    rounds = []
    for one_task in (0, 150):
        names.clear()
        out = simplify.chosen_bulges(pairs, 41, one_task)
        assert {r.i for r in out.collect()} == want and out.columns == [c for c in pairs.columns if c != "order"]
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        rounds.append(names.count("taken-pairs"))
    # few that are left are settled in one task, and no table of pairs goes through the driver
    assert rounds[1] < rounds[0]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
