"""K-mers of up to 31 letters as two bits a letter: grouped, and named as junctions, in numpy.

A place of a k-mer is one row for both strands, under the lesser of the k-mer and its
reverse complement; order of packed k-mers is that of their letters. A task gets the
k-mers of some two million places, however large the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Longest k-mer that a long holds.
MOST = 31
#: Places whose k-mers one task groups, some 25 bytes each and as many again a few times while they are sorted.
PLACES = 1 << 21
#: Letters that are gone through at once, and rows that are handed on at once.
_LETTERS, _ROWS = 1 << 19, 1 << 17

_CODE = np.full(256, 5, np.uint8)
for _i, _c in enumerate(b"ACGT#"):
    _CODE[_c] = _i
_FLIP = np.array([3, 2, 1, 0, 4, 5])


def _around() -> np.ndarray:
    """The bits of the letters before and (8 bits up) after the lesser k-mer: it as read, and codes of those before and after it."""
    out = np.zeros(128, np.int64)
    for i in range(128):
        before, after = (i >> 1) & 7, i >> 4
        if before < 6 and after < 6:
            if not i & 1:
                before, after = _FLIP[after], _FLIP[before]
            out[i] = 1 << int(before) | 1 << int(after) + 8
    return out


_AROUND = _around()
_SWAPPED = np.array([sum(1 << int(_FLIP[b]) for b in range(6) if m >> b & 1) for m in range(64)])
_BITS = np.array([m.bit_count() for m in range(64)])


def reversed_kmers(key: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers."""
    x = ~key.astype("<u8")
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def _windows(code: np.ndarray, k: int) -> np.ndarray:
    """The packed k letters from each letter on."""
    now, have, out, done = (code & 3).astype(np.int64), 1, None, 0
    while True:
        if k & have:
            out = now if out is None else out[: len(out) - have] << 2 * have | now[done:]
            done += have
        if 2 * have > k:
            return out
        now = now[:-have] << 2 * have | now[have:]
        have *= 2


def _places(k: int):
    """(chr, len, at, piece) to (key, place, info) of each k-mer of A, C, G, T.

    ``place`` is chr and the k-mer's position, 32 bits each. ``info`` is, from its low bit on, whether the
    k-mer is the lesser of both, the letters before and after it (8 bits each), and the length of the sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = max(1, int(batch.num_rows * _LETTERS / max(1, batch.get_total_buffer_size())))
            for a in range(0, batch.num_rows, each):
                yield from found(batch.slice(a, each))

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chr_, len_, at = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        texts = [t.encode() for t in batch.column(3).to_pylist()]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        code = _CODE[raw]
        size = np.array([len(t) for t in texts], np.int64)
        n = np.maximum(size - k - 1, 0)
        if not n.any():
            return
        row = np.repeat(np.arange(len(n)), n)
        q = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(size) - size)[row] + q + 1
        odd = np.concatenate([[0], np.cumsum(code > 3)])
        ok = odd[start + k] == odd[start]
        row, q, start = row[ok], q[ok], start[ok]
        kmer = _windows(code, k)[start]
        back = reversed_kmers(kmer, k)
        info = len_[row] << 17 | (kmer <= back) | raw[start - 1].astype(np.int64) << 1 | raw[start + k].astype(np.int64) << 9
        columns = [np.minimum(kmer, back), chr_[row] << 32 | (at[row] + q), info]
        for b in range(0, len(row), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[b : b + _ROWS]) for c in columns], names=["key", "place", "info"])

    return run


def _groups(rows: list[np.ndarray], k: int):
    """Rows (key, ..., info) to (their order by key, first of each group, size, key, reverse, n, masks before and after)."""
    key, info = rows[0], rows[-1]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
    size = np.diff(np.append(first, len(key)))
    kind = info & 1 | _CODE[info >> 1 & 255].astype(np.int64) << 1 | _CODE[info >> 9 & 255].astype(np.int64) << 4
    masks = np.bitwise_or.reduceat(_AROUND[kind][order], first)
    before, after = masks & 63, masks >> 8
    key = ordered[first]
    back = reversed_kmers(key, k)
    # A k-mer that is its own reverse complement is there twice at each place.
    own = key == back
    before, after = np.where(own, before | _SWAPPED[after], before), np.where(own, after | _SWAPPED[before], after)
    return order, first, size, key, back, size * (1 + own), before, after


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else None


def _sets(k: int):
    """(key, info) of whole k-mers to (key, back, n, prev_mask, next_mask), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        if rows is None:
            return
        columns = _groups(rows, k)[3:]
        for b in range(0, len(columns[0]), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[b : b + _ROWS]) for c in columns], names=["key", "back", "n", "prev_mask", "next_mask"])

    return run


def _junctions(k: int):
    """(key, place, info) of whole k-mers to those of junctions, with back, n, and first: one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        if rows is None:
            return
        order, first, size, key, back, n, before, after = _groups(rows, k)
        many = (_BITS[before] > 1) | (_BITS[after] > 1) | ((before | after) & 16 > 0)
        kept = np.flatnonzero(many & ((n > 1) | ((before | after) & 16 > 0)))
        group = np.repeat(kept, size[kept])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept])
        at = order[first[group] + nth]
        columns = [key[group], back[group], n[group], nth == 0, rows[1][at], rows[2][at]]
        for b in range(0, len(at), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[b : b + _ROWS]) for c in columns], names=["key", "back", "n", "first", "place", "info"])

    return run


def _dealt(seqs: DataFrame, k: int, *columns: str) -> DataFrame:
    """The places of all k-mers, those of one k-mer in one of as many partitions as there are places for."""
    whole = seqs.select("chr", F.length("seq").alias("len"), F.concat(F.lit("#"), "seq", F.lit("#")).alias("piece"))
    size = 1 << 16
    starts = F.sequence(F.lit(0), F.greatest(F.length("piece") - k - 2, F.lit(0)), F.lit(size))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring("piece", s + 1, F.lit(size + k + 1)).alias("piece")))
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Long sequences are dealt out first, or a chromosome would be one task.
    tiles = stored(whole.select("chr", "len", F.inline(pieces)).repartition(parts, "chr", "at"), "tiles")
    letters = tiles.agg(F.sum(F.length("piece"))).first()[0] or 0
    rows = tiles.mapInArrow(_places(k), "key long, place long, info long").select(*columns)
    return rows.repartition(max(parts, -(-letters // PLACES)), "key")


def extension_sets(seqs: DataFrame, k: int) -> DataFrame:
    """key, back, n, prev_mask, next_mask of each different k-mer, the lesser strand's alone."""
    return _dealt(seqs, k, "key", "info").mapInArrow(_sets(k), "key long, back long, n long, prev_mask long, next_mask long")


def junction_places(seqs: DataFrame, k: int) -> DataFrame:
    """key, back, n, first, place, info: every place of a junction."""
    return _dealt(seqs, k, "key", "place", "info").mapInArrow(_junctions(k), "key long, back long, n long, first boolean, place long, info long")


def both(rows: DataFrame, *fields) -> DataFrame:
    """``fields`` (of key and back) for the k-mer and its reverse complement, once if they are the same."""
    one, other = (F.struct(*f) for f in fields)
    return rows.select(F.inline(F.when(F.col("key") == F.col("back"), F.array(one)).otherwise(F.array(one, other))))


def letters(packed, k: int):
    """A packed k-mer as a string."""
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def letter_after_turned(info):
    """The letter after a place's k-mer on strand 1."""
    return F.translate(F.char(F.shiftright(info, 1).bitwiseAND(255)), "ACGT", "TGCA")


def letter_after(info):
    """The letter after a place's k-mer on strand 0."""
    return F.char(F.shiftright(info, 9).bitwiseAND(255))


def named_places(places: DataFrame, vertex: DataFrame) -> DataFrame:
    """chr, p, len, one and other (the vertices on strands 0 and 1), info."""
    ids = vertex.groupBy("key").agg(F.min(F.when(F.col("code") == F.col("key"), F.col("vertex"))).alias("_key"), F.max("vertex").alias("_back"))
    read = F.col("info").bitwiseAND(F.lit(1)) == 1
    return places.join(ids, "key").select(
        F.shiftright("place", 32).cast("int").alias("chr"),
        F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p"),
        F.shiftright("info", 17).cast("int").alias("len"),
        F.when(read, F.col("_key")).otherwise(F.col("_back")).alias("one"),
        F.when(read, F.col("_back")).otherwise(F.col("_key")).alias("other"),
        "info",
    )
