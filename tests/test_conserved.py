"""Conserved regions against a path that is traced letter by letter."""

import random

import pytest

from helixlake.operators import conserved


def plain_path(a, b, percent, gap):
    """Columns in the conserved state; ties go to the path that was not conserved."""
    match, mismatch, cost = conserved.scores(percent)
    cols = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if (x, y) != ("-", "-")]
    on, off, back = 0, 0, []
    for i in cols:
        x, y = a[i], b[i]
        m = gap if "-" in (x, y) else 0 if "N" in (x, y) else match if x == y else mismatch
        back.append((on > off - cost, on - cost > off))
        on, off = max(on, off - cost) + m, max(on - cost, off)
    state, out = on > off, []
    for i, (if_on, if_off) in zip(reversed(cols), reversed(back), strict=True):
        if state:
            out.append(i)
        state = if_on if state else if_off
    return out[::-1], cols


def plain_regions(a, b, percent, gap):
    on, cols = plain_path(a, b, percent, gap)
    rank, out = {c: n for n, c in enumerate(cols)}, []
    for c in on:
        if out and rank[c] == rank[out[-1][1] - 1] + 1:
            out[-1] = (out[-1][0], c + 1, out[-1][2] + 1)
        else:
            out.append((c, c + 1, 1))
    return out


def alignment(seed, parts, rows=3):
    rng = random.Random(seed)
    out = [""] * rows
    for size, alike in parts:
        for _ in range(size):
            base = rng.choice("ACGT")
            for r in range(rows):
                out[r] += base if rng.random() < alike else rng.choice("ACGTN--")
    return out


MADE = [
    alignment(1, [(300, 0.2), (400, 0.97), (250, 0.1), (500, 0.95), (90, 0.2)]),
    alignment(2, [(700, 0.99)]),
    alignment(3, [(500, 0.1)]),
    alignment(4, [(200, 0.96), (300, 0.05), (10, 0.9), (300, 0.98), (400, 0.0)], 2),
    ["-" * 30 + "ACGT" * 100 + "-" * 9] * 2,
    ["A", "A"],
    ["", ""],
]


@pytest.mark.parametrize(("tile", "gap"), [(7, 0), (64, -20), (4096, -100)])
def test_regions_equal_the_traced_path(spark, tile, gap):
    rows = spark.createDataFrame([(i, r, body) for i, own in enumerate(MADE) for r, body in enumerate(own)], "aln long, row int, body string")
    got = sorted(map(tuple, conserved.conserved_regions(conserved.row_pairs(rows), ["aln", "row", "r_row"], 70, gap, tile).collect()))
    want = {(i, r, q): plain_regions(own[r], own[q], 70, gap) for i, own in enumerate(MADE) for q in range(len(own)) for r in range(q)}
    assert got == sorted((*k, *v) for k, found in want.items() for v in found) and len(got) > 5
    for bounds, low, high in (("union", min, max), ("intersection", max, min)):
        scored = conserved.alignment_score(rows, 70, gap, bounds, tile)
        assert sorted(map(tuple, scored.collect())) == [
            (i, sum(n for f in own for *_, n in f), low(f[0][0] for f in own), high(f[-1][1] for f in own)) if own else (i, 0, 0, len(MADE[i][0]))
            for i in range(len(MADE))
            for own in [[f for k, f in want.items() if k[0] == i and f]]
        ]
    crop = {(r.aln, r.row): r.body for r in conserved.cropped_rows(rows, scored).collect()}
    span = {r.aln: (r.start, max(r.start, r.end)) for r in scored.collect()}
    assert crop == {(i, r): body[slice(*span[i])] for i, own in enumerate(MADE) for r, body in enumerate(own)}
    assert conserved.alignment_score(rows.limit(0)).count() == 0
