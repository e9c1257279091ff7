"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into segments. If two of them differ in at most r bits, then
by the pigeonhole principle some segment differs in few bits: the first
r mod m + 1 of m segments in at most r div m, or another in one bit less. Each
distinct fingerprint is put into a table under each segment's value and probes
the values of a small Hamming ball around it; the larger value of a pair probes
for the smaller, so every pair meets once per segment. Full distances settle the
matches. A bucket of near copies gives a star of links, not all its pairs, and
components are closed by alternating star contractions over written tables.

``alike_groups`` holds to a similarity of shingles, which fingerprints only
estimate. The fingerprints' links are verified on the whole sets of shingles and
closed first, so that groups of copies are one group before anything is compared
pair by pair. Pairs that no fingerprint brought together share a hash of the few
that such texts must share; those between different groups are verified too, so
that no link of that similarity is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._shared import Words, forget, release, sliced, text_bytes, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Pairs that are compared at once in a bucket task, about 50 MB.
_PAIRS = 1 << 20
#: Rows of a bucket up to which all its pairs are compared at once.
_LARGE = 2048
#: Shingles whose bits are counted at once, 64 bytes each.
_RUN = 200_000


def _hashed(joined: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each joined[start:end]."""
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), _RUN):
        spans = zip(starts[k : k + _RUN].tolist(), ends[k : k + _RUN].tolist(), strict=True)
        out[k : k + _RUN] = [xxh64_intdigest(joined[s:e], seed) for s, e in spans]
    return out


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of n (at least 1) hashes each: bits that over half of them have."""
    end = np.cumsum(n)
    begin = end - n
    ones = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(h), _RUN):
        own = h[k : k + _RUN]
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(end, k, "right"), np.searchsorted(begin, k + len(own))
        ones[a:b] += np.add.reduceat(bits, np.maximum(begin[a:b] - k, 0), axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _shingled(batch: pa.RecordBatch, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all rows in order, and how many each row has."""
    data, offsets = text_bytes(batch.column(1))
    words = Words(_LOWER[data], offsets)
    count = np.diff(words.first)
    size = np.minimum(count, shingle)  # a shorter text is one shingle
    n = np.where(count > 0, count - size + 1, 0)
    at = np.arange(n.sum()) + np.repeat(words.first[:-1] - (np.cumsum(n) - n), n)
    return _hashed(words.data.tobytes(), words.start[at], words.end[at + np.repeat(size, n) - 1], seed), n


def _fingerprinter(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            h, n = _shingled(batch, shingle, seed)
            fp = np.zeros(len(n), np.uint64)
            fp[n > 0] = _majority(h, n[n > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long.

    Words are runs of other characters than blank and U+0009 to U+000D, with A-Z
    lower-cased. Shingles of ``shingle`` words, repeats included, are joined by a
    blank and hashed by XXH64 under ``seed``; a bit is 1 if it is set in over half
    of them. Fewer words are one shingle; no word, or null, is fingerprint 0.
    Texts of any length are read whole; their bits are counted in runs.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprinter(shingle, seed), "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def _segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius of the ball, -1: none) of each segment."""
    base, rest = divmod(radius, segments)
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a, base if i <= rest else base - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _united(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The roots once the rows of each link have the same one, the least."""
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _spread(fp: np.ndarray, probe: np.ndarray, radius: int) -> np.ndarray:
    """For each row of a bucket a near one that found it first, or itself.

    From a row on, all that it is near and nobody has found are found, then they go
    on. A large group of near copies is found by its first row, so the work is that
    of the rows that are apart.
    """
    root = np.arange(len(fp))
    left = [np.flatnonzero(~probe), np.flatnonzero(probe)]
    while len(left[0]):
        queue = [left[0][0]]
        left[0] = left[0][1:]
        while queue:
            i = queue.pop()
            for kind in (0,) if probe[i] else (0, 1):  # two probes meet where one is in the table
                near = np.bitwise_count(fp[left[kind]] ^ fp[i]) <= radius
                if near.any():
                    found = left[kind][near]
                    root[found] = i
                    queue += found.tolist()
                    left[kind] = left[kind][~near]
    return root


def _bucket_links(radius: int, direct: bool):
    """Rows sorted by bucket, the table's before the probes: links of each bucket as stars.

    ``direct``: of each row the link to the first that is near itself, which may
    leave apart what a star joins but names no pair that only others connect.
    Buckets of over ``_LARGE`` rows give trees of links that do both.
    """

    def linked(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray, node: np.ndarray):
        n = len(fp)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [n]])
        size = np.diff(edges)
        ends = np.repeat(edges[1:], size)
        table = np.flatnonzero(~probe & np.repeat(size <= _LARGE, size))
        partners = ends[table] - table - 1  # a table row meets every row after it in its bucket
        table, partners = table[partners > 0], partners[partners > 0]
        root = np.arange(n)
        for k in np.flatnonzero(size > _LARGE):
            root[edges[k] : edges[k + 1]] = edges[k] + _spread(fp[edges[k] : edges[k + 1]], probe[edges[k] : edges[k + 1]], radius)
        k = 0
        sums = np.cumsum(partners)
        while k < len(table):
            done = sums[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(sums, done + _PAIRS, "right")))
            t, p = table[k:to], partners[k:to]
            k = to
            left = np.repeat(t, p)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(p) - p, p)
            near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
            left, right = left[near], right[near]
            if direct:
                np.minimum.at(root, right, left)
            else:
                root = _united(root, left, right)
        member = np.flatnonzero(root != np.arange(n))
        a, b = node[root[member]], node[member]
        other = a != b
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[other]), pa.array(np.maximum(a, b)[other])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy())
            if held and new[0][-1] == held[0][0][0]:  # a bucket that goes on
                held.append(new)
                continue
            columns = [np.concatenate(x) for x in zip(*held, new, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
            if cut:
                yield linked(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _keys(i: int, segments: int, first: int, width: int, ball: int):
    """The buckets of a fingerprint in segment i: its own, and the smaller values that it probes."""

    def key(value, probe: bool):
        return F.struct((value * segments + F.lit(i)).alias("bucket"), F.lit(probe).alias("probe"))

    value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    own = F.array(key(value, False))
    if not (masks := _ball(width, ball)):
        return own
    around = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(value))
    return F.concat(own, F.transform(F.filter(around, lambda x: x < value), lambda x: key(x, True)))


def near_links(nodes: DataFrame, radius: int = 4, segments: int = 3, direct: bool = False) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``fp`` that connect all that
    differ in at most ``radius`` bits, as a star for each bucket's groups.

    ``segments`` trades probes for bucket size: a bucket holds about
    N / 2^(64 / segments) fingerprints. Three serve up to some 10^9, two beyond.
    With a column ``node`` links are between nodes, which may have the same
    fingerprint. ``direct`` names only pairs that are near themselves, for each row
    of a bucket at most one.
    """
    keys = [_keys(i, segments, first, width, ball) for i, (first, width, ball) in enumerate(_segments(radius, segments)) if ball >= 0]
    node = F.col("node" if "node" in nodes.columns else "fp").alias("node")
    rows = nodes.select("fp", node, F.explode(F.concat(*keys)).alias("k")).select(F.col("k.bucket").alias("bucket"), "fp", F.col("k.probe").alias("probe"), "node")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "probe", *(["node"] if direct else []))
    return dealt.mapInArrow(_bucket_links(radius, direct), "a long, b long").distinct()


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) of one task to (node, root)."""
    columns = [np.concatenate([np.zeros(0, np.int64), *own]) for own in zip(*([c.to_numpy() for c in batch.columns] for batch in batches), strict=True)] or [np.zeros(0, np.int64)] * 2
    nodes, at = np.unique(np.concatenate(columns), return_inverse=True)
    left, right = np.split(at, 2)
    root = nodes[_united(np.arange(len(nodes)), left, right)]
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (nodes, root)], names=["node", "root"])


def components(links: DataFrame, one_task: int = 1 << 16) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; longs); root is its component's least.

    Up to ``one_task`` links, about 1 MB, are closed in one task, which spares the
    rounds; the answer is the same.

    Alternating large-star and small-star rounds turn the links into stars. Each
    round is written, and a round that changes nothing ends the loop; every other
    brings some node nearer to its component's least, so the loop does end.
    """
    now = written(links.select("a", "b"), "links")
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(_closed, "node long, root long")
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        mid = written(large, "large-star")
        least2 = written(mid.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
        small = (
            mid.select(F.col("b").alias("u"), F.col("a").alias("v"))
            .join(least2, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(small, "links")
        new = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for t in (now, least, mid, least2):
            forget(t)
        now = after
        if new == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = new


def _labelled(prints: DataFrame, node, links_of) -> DataFrame:
    """``prints`` with component_id: the smallest doc_id of all nodes that links reach."""
    prints = written(prints.withColumn("node", node), "fingerprints")
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least_id")), "fp-nodes")
    roots = written(components(links_of(nodes)), "fp-roots")
    rooted = nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "fp-rooted")
    named = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "fp-named")
    labels = written(rooted.join(named, "root").select("node", "component_id"), "fp-labels")
    release(nodes, roots, rooted, named)
    return prints.join(labels, "node").drop("node")


def near_groups(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, segments: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text; others are ignored).

    Fingerprints within ``radius`` bits are linked; component_id is the smallest
    doc_id that links reach, the row's own included. Null and wordless texts all
    have fingerprint 0 and are linked like any others. A null doc_id counts only
    if a component has no other. Rows that repeat get the same answer each. An
    empty table gives an empty one.
    """
    prints = fingerprints(docs, shingle, seed)
    return _labelled(prints, F.col("fp"), lambda nodes: near_links(nodes.select(F.col("node").alias("fp")), radius, segments))


def _sets(batch: pa.RecordBatch, shingle: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's distinct shingle hashes by value, and a digest of them: the row's node."""
    h, n = _shingled(batch, shingle, seed)
    end = np.cumsum(n)
    sets = [np.unique(h[a:b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
    return sets, np.array([xxh64_intdigest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)


def _set_scan(shingle: int, seed: int, common: np.ndarray):
    """(doc_id, text, copy) to (doc_id, copy, node, n, fp, prefix, bits): a text's n distinct
    shingles, their fingerprint, those of them that a set of similarity 4/5 must share
    one of, and which of 2 to 4 n buckets its shingles fall into.

    The prefix has the first in a common order: hashes of ``common`` last, the
    others by value. Sets of similarity 4/5 share at least ceil(4 n / 5) of their
    n, so also one of the first n - ceil(4 n / 5) + 1.
    """
    at = np.argsort(common)
    known = common[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets, node = _sets(batch, shingle, seed)
            n = np.array([len(x) for x in sets], np.int64)
            fp = np.zeros(len(n), np.uint64)
            if n.any():
                fp[n > 0] = _majority(np.concatenate(sets), n[n > 0])
            prefix, bits = [], []
            for own in sets:
                mark = np.zeros(max(64, 1 << (2 * len(own) - 1).bit_length()), bool)
                mark[(own & np.uint64(len(mark) - 1)).view(np.int64)] = True
                bits.append(np.packbits(mark, bitorder="little").tobytes())
                if len(known):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[place] == own, at[place], -1), kind="stable")]
                prefix.append(own[: len(own) - (4 * len(own) + 4) // 5 + 1].tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(node), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "node", "n", "fp", "prefix", "bits"])

    return run


def _whole_sets(shingle: int, seed: int):
    """(node, text) to (node, shingles), for the text that the node is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets, node = _sets(batch, shingle, seed)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])
            yield out.filter(pa.array(node == batch.column(0).to_numpy()))

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a prefix: (token, node, at, grp), at: n and the place in the prefix."""
    for batch in sliced(batches):
        node, n, group = (batch.column(i).to_numpy() for i in (0, 1, 3))
        sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        token = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        columns = [token, np.repeat(node, size), np.repeat(n.astype(np.int64), size) << 32 | place, np.repeat(group, size)]
        for k in range(0, len(token), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names=["token", "node", "at", "grp"])


def _partners(n: np.ndarray, place: np.ndarray, grp: np.ndarray, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (token, n): runs of pairs of a token's rows, of different groups, whose
    sizes and places in the prefix allow similarity 4/5."""
    edges = np.flatnonzero(np.diff(token)) + 1
    ends = np.append(edges, len(token))
    row = np.arange(len(token))
    # Rows of a token go by n: a partner has at most 5/4 of a row's n.
    number = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends]))) << 33
    count = np.searchsorted(number + n, number + n * 5 // 4, "right") - row - 1
    row, count = row[count > 0], count[count > 0]
    sums = np.cumsum(count)
    k = 0
    while k < len(row):
        to = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + _PAIRS, "right")))
        left = np.repeat(row[k:to], count[k:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count[k:to]) - count[k:to], count[k:to])
        k = to
        shared = np.minimum(n[left] - place[left], n[right] - place[right])  # at most, if this is their first common one
        ok = (grp[left] != grp[right]) & (9 * shared >= 4 * (n[left] + n[right]))
        yield left[ok], right[ok]


def _by_token(of_tokens):
    """Rows sorted by their first column: ``of_tokens`` gets whole tokens of a few batches at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            if held and token[-1] == held[0].column(0)[0].as_py():  # a token that goes on
                held.append(batch)
                continue
            cut = int(np.searchsorted(token, token[-1]))  # the last token may go on
            if held or cut:
                every = pa.concat_batches([*held, batch])
                at = every.num_rows - batch.num_rows + cut
                yield from of_tokens(every.slice(0, at))
                held = [every.slice(at)]
            else:
                held = [batch]
        if held:
            yield from of_tokens(pa.concat_batches(held))

    return run


def _met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (token, at, node, grp) sorted by these: those that have a partner."""
    token, at, _, grp = (c.to_numpy() for c in batch.columns)
    met = np.zeros(batch.num_rows, bool)
    for left, right in _partners(at >> 32, at & 0xFFFFFFFF, grp, token):
        met[left] = met[right] = True
    yield batch.filter(pa.array(met))


def _alike_pairs(batch: pa.RecordBatch, first_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (token, at, node, grp, bits) sorted by these: pairs (a, b) of a token's sets, of different
    groups, that may have similarity 4/5. ``first_only``: of each row the pair with the first partner.

    A bucket that only one of two sets has holds a shingle that only this one has. So
    a set's buckets bound what the two share, and no pair of the similarity is lost.
    """
    token, at, node, grp = (c.to_numpy() for c in batch.columns[:4])
    bits, n = batch.column(4), at >> 32
    size = np.array([len(x.as_buffer()) for x in bits], np.int64)
    first = np.cumsum(size) - size
    words = np.frombuffer(b"".join(bits.to_pylist()), "<u8")
    partner = np.full(batch.num_rows, batch.num_rows)
    for left, right in _partners(n, at & 0xFFFFFFFF, grp, token):
        kept = []
        for x, y in np.unique(np.stack([size[left], size[right]]), axis=1).T.tolist():
            mine = np.flatnonzero((size[left] == x) & (size[right] == y))
            step = max(1, (1 << 24) // max(x, y))
            for k in range(0, len(mine), step):
                pair = mine[k : k + step]
                both = []
                for rows in (left[pair], right[pair]):
                    m = words[(first[rows] // 8)[:, None] + np.arange(size[rows[0]] // 8)]
                    while m.shape[1] * 8 > min(x, y):  # half as many buckets
                        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
                    both.append(m)
                shared = [n[rows] - np.bitwise_count(m & ~o).sum(axis=1, dtype=np.int64) for rows, m, o in ((left[pair], *both), (right[pair], *both[::-1]))]
                kept.append(pair[9 * np.minimum(*shared) >= 4 * (n[left[pair]] + n[right[pair]])])
        if kept:
            own = np.concatenate(kept)
            if first_only:
                np.minimum.at(partner, right[own], left[own])
                continue
            a, b = node[left[own]], node[right[own]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
    if first_only:
        own = np.flatnonzero(partner < batch.num_rows)
        a, b = node[partner[own]], node[own]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _first_pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return _alike_pairs(batch, first_only=True)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, a, b, shingles) sorted by cell, its sets (b null) before its pairs:
    the pairs of similarity 4/5."""
    cell, sets = None, {}
    for batch in batches:
        found = []
        for r, i, j, a, b, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r, i, j) != cell:
                cell, sets = (r, i, j), {}
            if b is None:
                sets[a] = np.frombuffer(own, np.uint64)
            elif a in sets and b in sets:
                x, y = sets[a], sets[b]
                every = np.sort(np.concatenate([x, y]), kind="stable")
                if 9 * int((every[1:] == every[:-1]).sum()) >= 4 * len(every):  # shared / (all - shared) >= 4/5
                    found.append((a, b))
        columns = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def verified_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int = 5, seed: int = 42, tile: int = 256) -> DataFrame:
    """The ``pairs`` (a, b; written) of nodes whose sets have a similarity of 4/5, written.

    ``nodes`` has (node, copy, doc_id), one row of ``texts`` (doc_id, text, copy) that
    a node is of. Pairs are verified in cells: a group of connected nodes is dealt
    into tiles of about ``tile``, and a cell has the pairs between two of them. So a
    set travels once for each tile that it has partners in, not for each pair, and a
    task holds the sets of two tiles however large a group is.
    """
    rooted = written(components(pairs), "alike-cells")
    tiles = rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    placed = written(rooted.join(tiles, "root").select("node", "root", F.pmod(F.xxhash64("node"), "tiles").alias("tile")), "alike-tiles")
    ends = [placed.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"), F.col("tile").alias(f"tile_{n}")) for n in "ab"]
    dealt = pairs.join(ends[0], "a").join(ends[1], "b")
    cells = written(dealt.select(F.col("root_a").alias("root"), F.least("tile_a", "tile_b").alias("i"), F.greatest("tile_a", "tile_b").alias("j"), "a", "b"), "alike-pairs")
    needed = nodes.join(rooted.select("node"), "node", "left_semi").select("node", F.col("copy").alias("_copy"), F.col("doc_id").alias("_id"))
    own = texts.join(needed, (F.col("copy") == F.col("_copy")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = written(own.select("node", "text").mapInArrow(_whole_sets(shingle, seed), "node long, shingles binary"), "alike-sets")
    members = cells.select("root", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = members.join(sets.dropDuplicates(["node"]), "node").select("root", "i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = held.unionByName(cells.withColumn("shingles", F.lit(None).cast("binary")))
    met = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", F.col("b").asc_nulls_first())
    links = written(met.mapInArrow(_verified, "a long, b long"), "alike-links")
    release(rooted, placed, cells, sets)
    return links


def alike_groups(docs: DataFrame, shingle: int = 5, seed: int = 42, radius: int = 7, segments: int = 4) -> DataFrame:
    """(doc_id, component_id): texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Linked are exactly the pairs of this similarity; component_id is the smallest
    doc_id that links reach. Words and shorter texts as in ``fingerprints``, each
    shingle once; null and wordless texts are alike. ``radius`` and ``segments`` set
    what the fingerprints find, which is verified and closed first: they change how
    much is left to compare and no result. Shingles that a sample of the texts
    repeats are compared last, which saves pairs and changes no result either.
    Nulls, repeats and empty tables as in ``near_groups``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("copy"))
    schema = "doc_id long, copy long, node long, n int, fp long, prefix binary, bits binary"
    sample = texts.where(F.pmod("copy", F.lit(64)) == 0).select("doc_id", "text").mapInArrow(_set_hashes(shingle, seed), "h long")
    common = [r["h"] for r in sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(100_000).collect()]
    order = np.array(common[::-1], np.int64).view(np.uint64)  # the most common last
    scanned = written(texts.mapInArrow(_set_scan(shingle, seed, order), schema), "shingle-sets")
    one = scanned.groupBy("node").agg(F.min(F.struct("copy", "doc_id")).alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = written(one.select("node", "row.copy", "row.doc_id", "n", "fp", "prefix", "bits"), "alike-nodes")

    def links_of(_: DataFrame) -> DataFrame:
        release(scanned)
        pairs = written(near_links(nodes.select("fp", "node"), radius, segments, direct=True), "simhash-pairs")
        some = verified_links(pairs, nodes, texts, shingle, seed)
        release(pairs)
        groups = written(components(some), "alike-roots")
        rows = nodes.join(groups, "node", "left").select("node", "n", "prefix", F.coalesce("root", "node").alias("grp")).mapInArrow(_prefix_rows, "token long, node long, at long, grp long")
        order = ("token", "at", "node")
        dealt = rows.repartition("token").sortWithinPartitions(*order).select(*order, "grp")
        met = written(dealt.mapInArrow(_by_token(_met), "token long, at long, node long, grp long"), "prefix-rows")
        del rows, dealt
        release(groups)

        def possible(of_tokens) -> DataFrame:
            """The pairs of ``met`` between groups: only what has a partner takes its bits along, and what these rule out is not written."""
            rows = met.drop("grp").join(grouped, "node", "left").withColumn("grp", F.coalesce("grp", "node")) if grouped is not None else met
            bound = rows.join(nodes.select("node", "bits"), "node").repartition("token").sortWithinPartitions(*order).select(*order, "grp", "bits")
            return written(bound.mapInArrow(_by_token(of_tokens), "a long, b long").distinct(), "possible-pairs")

        # First each row's first partner, so that a group of copies that the fingerprints left in parts is one before all its pairs are taken.
        grouped = None
        pairs = possible(_first_pairs)
        more = verified_links(pairs, nodes, texts, shingle, seed)
        release(pairs)
        some = some.unionByName(more)
        grouped = written(components(some).select("node", F.col("root").alias("grp")), "alike-roots")
        pairs = possible(_alike_pairs)
        release(met, grouped)
        rest = verified_links(pairs, nodes, texts, shingle, seed)
        release(pairs)
        return some.unionByName(rest)

    return _labelled(scanned.select("doc_id", "node"), F.col("node"), links_of)


def _set_hashes(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets, _ = _sets(batch, shingle, seed)
            h = np.concatenate([x.view(np.int64) for x in sets]) if sets else np.zeros(0, np.int64)
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000])], names=["h"])

    return run


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component of
    ``alike_groups`` the one with the smallest doc_id. Rows that share an id stay or
    go together."""
    groups = alike_groups(docs, **options)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id"))
    name = next(n for n in (f"_lost{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    lost = groups.groupBy(F.col("doc_id").alias(name)).agg(F.bool_or(keep).alias("kept")).where("not kept").select(name)
    return docs.join(written(lost, "near-lost"), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
