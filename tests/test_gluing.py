"""Gluing along chains against gluing one pair at a time."""

import random
from collections import defaultdict

from helixlake.operators import postprocess
from plain_gluing import glue_rows
from test_engine import plain_glue

SCHEMA = "block_id int, sign int, chr int, start int, end int"


def laid(lists, shift_block=0, shift_chr=0):
    """Lists of signed blocks as instances."""
    return [(abs(b) + shift_block, 1 if b > 0 else -1, c + shift_chr, 10 * i, 10 * i + 7) for c, own in enumerate(lists) for i, b in enumerate(own)]


def cases():
    for seed in range(400):
        rng = random.Random(seed)
        if seed % 2:
            n = rng.randint(2, 6)
            yield [[rng.choice([1, -1]) * rng.randint(1, n) for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(1, 3))]
        else:
            # the same stretches, forwards or backwards, in a random order: long chains of either direction
            ids = rng.sample(range(1, 40), rng.randint(3, 14))
            order = [b * rng.choice([1, -1, 1]) for b in ids]
            cut = sorted(rng.sample(range(len(order) + 1), rng.randint(0, 2)))
            parts = [order[a:b] for a, b in zip([0, *cut], [*cut, len(order)], strict=True)]
            lists = []
            for _ in range(rng.randint(1, 3)):
                own = [p if rng.random() < 0.6 else [-b for b in reversed(p)] for p in rng.sample(parts, len(parts))]
                lists.append([b for p in own for b in p])
            yield lists


def test_gluing_along_chains_equals_one_pair_at_a_time(spark):
    rows, want = [], []
    for i, lists in enumerate(cases()):
        own = laid(lists)
        rows += laid(lists, 100 * i, 10 * i)
        want += [(100 * i + b, sign, 10 * i + c, s, e) for b, sign, c, s, e in glue_rows(own)]
        if i < 150:
            ids = {b: k + 1 for k, b in enumerate(sorted({r[0] for r in glue_rows(own)}))}
            assert sorted((ids[r[0]], *r[1:]) for r in glue_rows(own)) == plain_glue(own)
    ids = {b: k + 1 for k, b in enumerate(sorted({r[0] for r in want}))}
    got = postprocess.glue_stripes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == sorted((ids[b], *r) for b, *r in want)
    assert len(ids) < len({r[0] for r in rows}) * 0.8
    assert postprocess.glue_stripes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_chain_is_folded_in_parts(spark):
    rng = random.Random(5)
    order = [b * rng.choice([1, 1, -1]) for b in rng.sample(range(1, 4000), 3000)]
    lists = [order, [-b for b in reversed(order)], order[:1700]]
    want = glue_rows(laid(lists))
    ids = {b: k + 1 for k, b in enumerate(sorted({r[0] for r in want}))}
    got = postprocess.glue_stripes(spark.createDataFrame(laid(lists), SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted((ids[b], *r) for b, *r in want)
    by = defaultdict(list)
    for r in postprocess.chains(postprocess._ends(spark.createDataFrame([(*r, i) for i, r in enumerate(laid(lists[:2]))], SCHEMA + ", at long"))).collect():
        by[tuple(r.chain)].append((r.rank, r.block_id * r.way))
    (chain,) = by.values()
    walked = [b for _, b in sorted(chain)]
    assert walked in (order, [-b for b in reversed(order)])
