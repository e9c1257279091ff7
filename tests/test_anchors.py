"""Anchor tables against plain loops over all pairs."""

import random
from math import floor

from helixlake.operators import align, anchors

SCHEMA = "pair_id long, s1 int, e1 int, s2 int, e2 int, score double"


def rows_of(seed, n, size=400, longest=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randrange(size), rng.randrange(size)
        out.append((rng.randrange(3), a, a + rng.randint(1, longest), b, b + rng.randint(1, longest), float(rng.randrange(1, 90))))
    return out


def plain_union(one, two):
    out = [*one, *two]
    for p, a, b, c, d, x in one:
        for q, e, f, g, h, y in two:
            shared = min(min(b, f) - max(a, e), min(d, h) - max(c, g))
            if p == q and shared > 0:
                gain = float(floor((x + y) * shared / max(max(b, f) - min(a, e), max(d, h) - min(c, g))))
                if gain >= max(x, y):
                    out.append((p, min(a, e), max(b, f), min(c, g), max(d, h), gain))
    return out


def plain_carried(rows, bodies, side, least):
    out = []
    for row in rows:
        place = [i for i, c in enumerate(bodies.get(row[0], "")) if c != "-"]
        s, e = row[2 * side - 1], row[2 * side]
        if e <= len(place) and place[e - 1] + 1 - place[s] >= least:
            out.append((*row[: 2 * side - 1], place[s], place[e - 1] + 1, *row[2 * side + 1 :]))
    return out


def bodies(seed, letters=380):
    rng = random.Random(seed)
    made = {p: "".join("-" * rng.choice([0, 0, 0, 1, 7]) + "A" for _ in range(letters)) + "--" for p in range(2)}
    return made | {2: ""}


def test_unions_and_overlaps_equal_all_pairs(spark):
    one, two = rows_of(1, 120), rows_of(2, 120)
    two += [(p, a, b, c + 1, d + 1, x) for p, a, b, c, d, x in one[:30]]  # nearly the same: these gain
    frames = [spark.createDataFrame(r, SCHEMA) for r in (one, two)]
    for width in (1, 32, 10_000):
        got = sorted(map(tuple, anchors.united(*frames, width).collect()))
        assert got == sorted(plain_union(one, two)) and len(got) > len(one) + len(two) + 5
    assert anchors.united(frames[0].limit(0), frames[1].limit(0)).count() == 0
    assert sorted(map(tuple, anchors.united(frames[0], frames[1].limit(0)).collect())) == sorted(one)


def test_anchors_follow_a_merged_alignment(spark):
    one, two, first, second = rows_of(3, 90), rows_of(4, 90), bodies(5), bodies(6)
    maps = [anchors.letter_columns(spark.createDataFrame(list(b.items()), "pair_id long, body string")) for b in (first, second)]
    frames = [spark.createDataFrame(r, SCHEMA) for r in (one, two)]
    for side in (1, 2):
        got = sorted(map(tuple, anchors.carried(frames[0], maps[0], side, 12).collect()))
        assert got == sorted(plain_carried(one, first, side, 12)) and got
    got = anchors.reanchored(*frames, *maps).collect()
    moved = plain_union(plain_carried(one, first, 1, 10), plain_carried(two, second, 1, 10))
    for p in {r[0] for r in moved}:
        own = sorted(r[1:] for r in moved if r[0] == p)
        total, _ = align.chain_anchors([(a, b, c, d, x) for a, b, c, d, x in own])
        chain = sorted(tuple(r)[1:6] for r in got if r.pair_id == p)
        assert {r.total for r in got if r.pair_id == p} == {total} and sum(r[4] for r in chain) == total
        assert all(x in own for x in chain) and all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(chain, chain[1:], strict=False))
