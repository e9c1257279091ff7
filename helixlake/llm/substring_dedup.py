"""Substring dedup by prefix-partitioned suffix trees over words.

A passage of ``window`` words that two documents share is found at the suffixes
that start with the same prefix. Only sampled suffixes are dealt out: of the
``prefix``-word prefixes inside each window the one with the least hash is the
window's anchor, so windows with equal words have equal anchors at equal places,
and about one suffix in eighteen stands for all. An anchor's region is what any
window around it can hold: the words before it (up to window - prefix) and from
it on (up to window).

1. Regions that recur unchanged need no tree: their least document is a sum that
   is taken before the shuffle, however many copies there are.
2. The different regions of one prefix form a group that fits in memory. Its
   subtree is built from sorted suffixes and their common prefix lengths, once
   reading on and once reading back; a window is a pair of nodes, one at depth o
   backwards and one at depth window - o forwards, and deep nodes with several
   leaves give the repeats.
3. A prefix with more regions than a group may hold is made longer, step by step:
   the windows around the anchor are halved by how many words they begin before
   it, and those of one half all hold a longer run of words, the new prefix. What
   the windows of a half can hold of a region is a shorter region; equal ones become
   one, with the least document, before the shuffle. Groups that now fit are built
   as trees, the others are halved again, down to single windows, where all regions
   of a group are one. So a region is a row a step, not a row a window, and no task
   gets a hot prefix whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ._shared import Words, release, sliced, text_bytes, written

#: ``tag`` tells texts of one id apart.
_ANCHORS = "anchor long, region long, doc long, tag long, pos int, before int, after int"
#: A region as a tree sees it: its group, its name, the windows that it is for.
_UNITS = "grp long, ua long, ub long, least long, before int, low int, high int, words string"
_NO_ID = (1 << 63) - 1

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: Words) -> np.ndarray:
    """A hash of each word's length and its first and last eight bytes.

    It only chooses anchors; what they lead to is compared word by word.
    """
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = (words.end - words.start).astype(np.uint64)
    head = np.ascontiguousarray(eight[words.start]).view("<u8").ravel()
    tail = np.ascontiguousarray(eight[np.maximum(words.end - 8, words.start)]).view("<u8").ravel()
    mask = np.where(size < 8, (np.uint64(1) << (np.minimum(size, np.uint64(7)) * np.uint64(8))) - np.uint64(1), np.uint64(2**64 - 1))
    return _mixed((head & mask) * _C[0] + (tail & mask) * _C[3] + size)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width], for every i that has it."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the anchors, and the hashes of their prefixes."""
    n = len(words.start)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _word_hashes(words)
    g = np.zeros(n - prefix + 1, np.uint64)
    for j in range(prefix):
        g += h[j : j + len(g)] * (_C[j % 4] + np.uint64(2 * j))
    g = _mixed(g) | np.uint64(1)
    width = window - prefix + 1
    least = _slide(g, width, np.minimum)  # of the window that starts at word i
    inside = np.zeros(n, bool)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= window:
            inside[a : b - window + 1] = True
    least = np.where(inside[: len(least)], least, np.uint64(0))
    # A prefix is an anchor if it is the least of some window that holds it.
    pad = np.zeros(width - 1, np.uint64)
    held = _slide(np.concatenate([pad, least, pad]), width, np.maximum)[: len(g)]
    at = np.flatnonzero(held == g)
    return at, g[at]


def _scan(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            words = Words(*text_bytes(batch.column(1)))
            at, anchor = _anchors(words, window, prefix)
            row = np.searchsorted(words.first, at, "right") - 1
            before = np.minimum(at - words.first[row], window - prefix)
            after = np.minimum(words.first[row + 1] - at, window)
            body = words.data.tobytes()
            starts, ends = words.start[at - before].tolist(), words.end[at + after - 1].tolist()
            region = np.fromiter((xxh3_64_intdigest(body[s:e], b) for s, e, b in zip(starts, ends, before.tolist(), strict=True)), np.uint64, len(at))
            columns = [anchor.view(np.int64), region.view(np.int64), doc[row], tag[row], (at - words.first[row]).astype(np.int32), before.astype(np.int32), after.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "region", "doc", "tag", "pos", "before", "after"])

    return run


def _as_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, tag) to (doc, tag, n_words, sha): what is kept if nothing is removed."""
    for batch in sliced(batches):
        words = Words(*text_bytes(batch.column(1)))
        body = words.data.tobytes()
        bounds = [(words.start[a], words.end[b - 1]) if b > a else (0, 0) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        sha = [hashlib.sha256(body[s:e]).hexdigest() for s, e in bounds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(words.first)), pa.array(sha, pa.string())], names=["doc", "tag", "n_words", "sha"])


def _regions(window: int, prefix: int):
    """(doc, text, wanted) to a unit for each wanted region, and whether its group is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = Words(*text_bytes(batch.column(1)))
            body = words.data.tobytes()
            rows: list[tuple] = []
            for doc, wanted, first, last in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                for w in wanted:
                    a, b = first + w["pos"] - w["before"], first + w["pos"] + w["after"]
                    if b > last:
                        continue  # another text under the same id
                    own = body[words.start[a] : words.end[b - 1]]
                    if np.uint64(xxh3_64_intdigest(own, w["before"])).view(np.int64) == w["region"]:
                        rows.append((w["anchor"], w["anchor"], w["region"], doc, w["before"], 0, window - prefix, own.decode(), w["many"]))
            yield _batch(rows, _UNITS + ", many boolean")

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _common(a: list[str], b: list[str]) -> int:
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def _levels(suffixes: list[list[str]], depths: np.ndarray) -> tuple[np.ndarray, int]:
    """The tree node of each suffix at each depth, and the depth of the deepest inner node."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = np.array([-1] + [_common(suffixes[i], suffixes[j]) for i, j in zip(order, order[1:], strict=False)])
    nodes = np.empty((len(depths), len(order)), np.int64)
    nodes[:, order] = np.cumsum(common[None, :] < depths[:, None], axis=1)
    return nodes, int(common.max())


def repeated_offsets(texts: list[list[str]], before: list[int], docs: list[int], window: int, prefix: int, low: int = 0, high: int | None = None) -> list[tuple[int, int] | None]:
    """For each region of one prefix: the least and the largest offset o (of ``low`` to
    ``high``, window - prefix if not given) for which the window that starts o words
    before the prefix also starts in a smaller document."""
    n = len(texts)
    if n < 2 or min(docs) == max(docs):
        return [None] * n
    o = np.arange(low, (window - prefix if high is None else high) + 1)
    forward, deep = _levels([t[b:] for t, b in zip(texts, before, strict=True)], window - o)
    backward, back = _levels([t[:b][::-1] for t, b in zip(texts, before, strict=True)], o)
    if deep + back < window:
        return [None] * n
    start, size = np.array(before), np.array([len(t) for t in texts])
    whole = (start >= o[:, None]) & (size - start >= window - o[:, None])
    key = (o[:, None] * (n + 1) + backward) * (n + 1) + forward
    doc = np.array(docs)
    _, at = np.unique(key[whole], return_inverse=True)
    own = np.broadcast_to(doc, key.shape)[whole]
    least = np.full(at.max(initial=-1) + 1, _NO_ID)
    np.minimum.at(least, at, own)
    hit = np.zeros(key.shape, bool)
    hit[whole] = least[at] < own
    return [(low + int(f[0]), low + int(f[-1])) if len(f := np.flatnonzero(hit[:, i])) else None for i in range(n)]


def _trees(window: int, prefix: int):
    """Units sorted by group to (ua, ub, low, high): the offsets that smaller documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            found = repeated_offsets([r[7].split(" ") for r in rows], [r[4] for r in rows], [r[3] for r in rows], window, prefix, rows[0][5], rows[0][6])
            return [(r[1], r[2], *f) for r, f in zip(rows, found, strict=True) if f]

        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield _batch(out, _HITS)
        if held:
            yield _batch(solve(held), _HITS)

    return run


_HITS = "ua long, ub long, low int, high int"
_LINKS = "pa long, pb long, known long, ua long, ub long, low int, high int"


def _halves(window: int, links: bool):
    """Units whose group is too large, as units for each half of their windows.

    ``links``: the names of both instead, with the parent's least document and the
    least and largest offset of the windows that the half has of it.
    """

    def signed(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 10_000):
            out: list[tuple] = []
            for _, ua, ub, least, before, low, high, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split(" ")
                after, middle = len(words) - before, (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(a, window - after), min(b, before)
                    if first > last:
                        continue  # no whole window begins there
                    own_before = min(before, b)
                    own = " ".join(words[before - own_before : before + window - a])
                    name = signed(xxh3_128_digest(f"{a} {b} {own_before} {own}".encode()))
                    if links:
                        out.append((ua, ub, least, *name, first, last))
                    else:
                        key = " ".join(words[before - a : before + window - b])
                        out.append((signed(xxh3_128_digest(f"{a} {b} {key}".encode()))[0], *name, least, own_before, a, b, own))
            yield _batch(out, _LINKS if links else _UNITS)

    return run


def _unit_hits(units: DataFrame, window: int, prefix: int, group_regions: int) -> DataFrame:
    """(ua, ub, low, high) for units (``_UNITS``, many; written, and deleted here): trees of
    the groups that fit, and for the others those of their halves."""
    solved, links, level = [], [], units
    while True:
        trees = level.where("not many").drop("many").repartition("grp").sortWithinPartitions("grp").mapInArrow(_trees(window, prefix), _HITS)
        solved.append(written(trees, "region-hits"))
        hot = level.where("many").drop("many")
        if hot.isEmpty():
            break
        # Equal halves are one unit; a unit without others in its group is like no other.
        rest = [F.first(c).alias(c) for c in ("grp", "before", "low", "high", "words")]
        halves = hot.mapInArrow(_halves(window, False), _UNITS).groupBy("ua", "ub").agg(F.min("least").alias("least"), *rest)
        halves = written(halves.select("grp", "ua", "ub", "least", "before", "low", "high", "words"), "halves")
        names = hot.mapInArrow(_halves(window, True), _LINKS).join(halves.select("ua", "ub", "least"), ["ua", "ub"])
        links.append(written(names.select("pa", "pb", "ua", "ub", "low", "high", (F.col("known") > F.col("least")).alias("whole")), "half-links"))
        groups = halves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("_a"), F.max("least").alias("_b")).where("n > 1 and _a < _b")
        after = written(halves.join(groups.select("grp", (F.col("n") > group_regions).alias("many")), "grp"), "halves-in-groups")
        release(halves, level)
        level = after
    release(level)
    # Back up: a half that a smaller document has is a hit as a whole.
    hits = solved.pop()
    while links:
        names, above = links.pop(), solved.pop()
        found = names.join(hits.select("ua", "ub", F.col("low").alias("_low"), F.col("high").alias("_high")), ["ua", "ub"], "left")
        own = [F.when(F.col("whole"), F.col(n)).otherwise(F.col("_" + n)).alias(n) for n in ("low", "high")]
        up = found.select(F.col("pa").alias("ua"), F.col("pb").alias("ub"), *own).where("low is not null").groupBy("ua", "ub").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        below, hits = hits, written(up.unionByName(above), "region-hits")
        release(below, above, names)
    return hits


def repeats(docs: DataFrame, window: int = 50, prefix: int = 16, group_regions: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of ``docs`` (doc_id, text) whose windows also start in a smaller doc_id.

    Returns (spans, texts, plain): spans (doc, tag, start, stop) in words, stop
    exclusive, their union is what is covered; texts (doc, tag, text) of all documents
    that may have spans; plain (doc, tag, n_words, sha) of every row as it is. ``tag``
    is a hash of the text, as rows may share an id. A group
    of up to ``group_regions`` regions, some 2 MB of words, is one tree.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(doc, text.alias("text"), F.xxhash64(text).alias("tag"))
    plain = rows.mapInArrow(_as_is, "doc long, tag long, n_words long, sha string")
    scanned = written(rows.mapInArrow(_scan(window, prefix), _ANCHORS), "anchors")

    shared = written(scanned.groupBy("anchor").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a < _b").select("anchor"), "shared-anchors")
    anchors = written(scanned.join(shared, "anchor"), "shared")
    release(scanned, shared)
    regions = anchors.groupBy("anchor", "region").agg(F.min(F.struct("doc", "pos")).alias("f"), F.max("before").alias("before"), F.max("after").alias("after"))
    regions = written(regions.select("anchor", "region", F.col("f.doc").alias("least"), F.col("f.pos").alias("pos"), "before", "after"), "regions")
    groups = written(regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefix-groups")

    placed = written(anchors.join(regions.select("anchor", "region", "least"), ["anchor", "region"]), "placed")
    release(anchors)
    copied = placed.where((F.col("doc") > F.col("least")) & (F.col("before") + F.col("after") >= window)).select("doc", "tag", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop"))

    # The words of each region that a tree must tell from others, from its least document.
    wanted = regions.join(groups, "anchor").groupBy(F.col("least").alias("doc")).agg(F.collect_list(F.struct("anchor", "region", "pos", "before", "after", (F.col("n") > group_regions).alias("many"))).alias("wanted"))
    touched = written(placed.select("doc").distinct().join(wanted, "doc", "left"), "touched")
    texts = written(rows.join(touched, "doc"), "touched-texts")
    release(touched, regions, groups)
    units = written(texts.where("wanted is not null").select("doc", "text", "wanted").mapInArrow(_regions(window, prefix), _UNITS + ", many boolean"), "region-words")

    hits = _unit_hits(units, window, prefix, group_regions).select(F.col("ua").alias("anchor"), F.col("ub").alias("region"), "low", "high")
    partly = placed.where("doc = least").join(hits, ["anchor", "region"]).select("doc", "tag", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + window).alias("stop"))
    return copied.unionByName(partly), texts.select("doc", "tag", "text"), plain


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        words = Words(*text_bytes(batch.column(1)))
        body = words.data.tobytes()
        n, gone, sha, kept_text = [], [], [], []
        for spans, a, b in zip(batch.column(2).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            cover = np.zeros(b - a + 1, np.int32)
            for s in spans:
                cover[min(s["start"], b - a)] += 1
                cover[min(s["stop"], b - a)] -= 1
            keep = np.concatenate([[False], np.cumsum(cover)[:-1] == 0, [False]])
            turn = np.flatnonzero(keep[1:] != keep[:-1]) + a
            parts = [body[words.start[s] : words.end[e - 1]] for s, e in zip(turn[::2], turn[1::2], strict=True)]
            text = b" ".join(parts)
            n.append(b - a)
            gone.append(b - a - int(keep.sum()))
            sha.append(hashlib.sha256(text).hexdigest())
            kept_text.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs`` (and kept_text of changed rows).

    Words are runs of other characters than blank and U+0009 to U+000D. Each word
    that is covered by a window of ``window`` consecutive words of its document,
    whose words also start a window in a document with a smaller doc_id, is
    removed. Null and wordless texts have no words; a null doc_id counts as the
    largest; rows that share an id remove nothing from each other, as neither
    id is smaller, and each loses what smaller ids have. An empty table gives an empty one; a
    very long text is held whole by one task. Other columns are ignored.
    """
    spans, texts, plain = repeats(docs, window, **options)
    spans = written(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    changed = texts.join(spans, ["doc", "tag"]).select("doc", "text", "spans").mapInArrow(_cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = plain.join(spans.select("doc", "tag"), ["doc", "tag"], "left_anti").select("doc", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    out = same.unionByName(changed).withColumn("doc_id", F.nullif("doc", F.lit(_NO_ID)))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
