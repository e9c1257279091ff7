"""Best-fit packing of tokenised documents, improved by swap-based local search.

Texts are tokenised where they are read and only (length, checksum) rows go on.
They are dealt round-robin into shards of equal size; each shard packs its own
sequences, best fit first and then by exchanges between underfull sequences. A
shard of 65,536 pieces loses about one sequence against packing all at once.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache as remembered
from heapq import heapify, heappop, heappush
from itertools import count
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced, written

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACE = _PIECE + ", sequence_id long, `offset` long"

#: White space just before a blank or a line break: splitting there could change ids.
_UNSAFE = re.compile(r"\s[ \n]")
#: Chunks of each of the two generations that one worker remembers, about 100 MB.
_REMEMBER = 600_000
#: Marks that a chunk may end in after its letters; the pre-tokenizer splits there.
_MARKS = frozenset(".,;:!?")


@remembered
def _tokenizer(path: str, special_as_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return t


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer always ends a token before a blank or a line
    break that follows another character than white space. So a text's ids are
    those of the chunks between such places, and a chunk is encoded once and
    remembered. A run of letters is one token of the pre-tokenizer and goes to the
    model itself. Texts with longer runs of white space, or with the string of an
    added token, are encoded whole. Such a string is that token's one id, as the
    tokenizer has it; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        tokenizer = _tokenizer(path, special_as_text)
        added = sorted({t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content}, key=len)
        self.whole = re.compile("|".join([_UNSAFE.pattern, *map(re.escape, added)]))
        letters = _byte_letters()
        self.encode = lambda texts: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        tokenize = tokenizer.model.tokenize
        self.word = lambda w: array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes()
        self.mark = dict(zip(sorted(_MARKS), self.encode(sorted(_MARKS)), strict=True))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        known, older, hard = self.known, self.older, []
        for c in new:
            if (ids := older.get(c)) is not None:
                known[c] = ids
            elif c.isalpha():
                known[c] = self.word(" " + c)
            elif c[-1:] in self.mark and (stem := c[:-1]).isalpha():
                if (ids := known.get(stem) or older.get(stem)) is None:
                    ids = known[stem] = self.word(" " + stem)
                known[c] = ids + self.mark[c[-1]]
            elif c[:1] == "\n" and c[1:].isalpha():
                known[c] = self.newline + self.word(c[1:])
            else:
                hard.append(c)
        known.update(zip(hard, self.encode([c if c[:1] == "\n" else " " + c for c in hard]), strict=True))

    @property
    def newline(self) -> bytes:
        if "\n" not in self.known:
            self.known["\n"] = self.encode(["\n"])[0]
        return self.known["\n"]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _REMEMBER:
            self.older, self.known = self.known, {}
        known = self.known
        # A chunk's key is its text without the blank before it.
        chunks = [None if self.whole.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        self._learn(set().union(*(c[1:] for c in chunks if c)).difference(known))
        whole = [t if c is None else c[0] for t, c in zip(texts, chunks, strict=True)]
        first = self.encode(whole)
        return [f if c is None else f + b"".join(map(known.__getitem__, c[1:])) for f, c in zip(first, chunks, strict=True)]


_ids: dict[tuple[str, bool], TokenIds] = {}


def _tokenise(path: str, most: int, end_id: int, with_ids: bool, special_as_text: bool):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, special_as_text) not in _ids:
            _ids[path, special_as_text] = TokenIds(path, special_as_text)
        ids_of = _ids[path, special_as_text]
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            doc, piece, start, length, crc, body = [], [], [], [], [], []
            for k in range(0, len(texts), 250):
                for d, ids in zip(batch.column(0).slice(k, 250).to_pylist(), ids_of(texts[k : k + 250]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = [0, *range(n % most or most, n + 1, most)] if n > most else [0, n]
                    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                        doc.append(d)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        own = ids[4 * a : 4 * b]
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            body.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(body, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """The pieces of each row of ``docs``: its ids, then ``end_id``, cut if longer than ``most``.

    Ids are those of the tokenizer without its template's special tokens; a special
    token's string in a text is that token unless ``special_as_text``.

    A null text is empty (one id). Of a longer document all pieces but the first
    are full. Rows that repeat are documents of their own; a null doc_id stays
    null; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer, most, end_id, with_ids, special_as_text), _PIECE + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of indices into ``lengths``: longest first, each to the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0  # bit r: some bin has room for r more
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
            room -= n
        else:
            b, room = len(bins), most - n
            bins.append([i])
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins


class _Bins:
    """For each length, the bin with the most room among those that hold a piece of it.

    Length 0 stands for any bin. Entries of bins that have changed stay in the heaps
    until they come to the top.
    """

    def __init__(self, lengths: list[int], most: int):
        self.lengths, self.heaps = lengths, [[] for _ in range(most + 1)]
        self.version: dict[int, int] = {}
        self.room = np.full(most + 1, -1)

    def _sizes(self, pieces: list[int]) -> set[int]:
        return {0, *(self.lengths[i] for i in pieces)}

    def _top(self, size: int) -> None:
        heap = self.heaps[size]
        while heap and self.version.get(heap[0][1]) != heap[0][2]:
            heappop(heap)
        self.room[size] = -heap[0][0] if heap else -1

    def put(self, b: int, pieces: list[int], room: int, now: int) -> None:
        self.version[b] = now
        for size in self._sizes(pieces):
            heappush(self.heaps[size], (-room, b, now))
            self._top(size)

    def take(self, b: int, pieces: list[int]) -> None:
        self.version.pop(b, None)
        for size in self._sizes(pieces):
            self._top(size)

    def best(self, size: int) -> int:
        return self.heaps[size][0][1]


def improve(bins: list[list[int]], lengths: list[int], most: int) -> list[list[int]]:
    """Empties bins by exchanges that raise the sum of squared fills.

    In a pass the emptiest bin that has not had its turn gives one or two pieces to
    a fuller one, for one of its pieces or for none, whichever moves most tokens,
    until it is empty or nothing helps. So the sum grows with every exchange, and a
    bin that had its turn takes none before the next pass. Passes go on until the
    bins are as few as the sum of lengths allows, or to the local optimum: a pass in
    which no bin has an exchange with a fuller one.
    """
    fewest = -(-sum(lengths) // most)
    fill = [sum(lengths[i] for i in b) for b in bins]
    left = sum(1 for b in bins if b)
    tick = count(1)
    under = _Bins(lengths, most)
    changed = left > fewest
    while changed:
        changed = False
        turns = [(fill[b], b) for b in range(len(bins)) if bins[b] and fill[b] < most]
        for _, b in turns:
            under.put(b, bins[b], most - fill[b], next(tick))
        heapify(turns)
        while turns and left > fewest:
            was, source = heappop(turns)
            if was != fill[source]:
                if fill[source] < most:
                    heappush(turns, (fill[source], source))
                continue
            own = bins[source]
            under.take(source, own)
            while own:
                gives: dict[int, tuple[int, ...]] = {}
                for x, i in enumerate(own):
                    gives.setdefault(lengths[i], (i,))
                    for j in own[x + 1 :]:
                        gives.setdefault(lengths[i] + lengths[j], (i, j))
                given = np.array([n for n in gives if n <= most])
                sizes = np.flatnonzero(under.room > 0)
                gain = given[:, None] - sizes[None, :]
                gain[(gain > under.room[sizes][None, :]) | (gain < 0)] = 0
                at = int(gain.argmax()) if gain.size else 0
                if not gain.size or not (moved := int(gain.flat[at])):
                    break
                n, size = int(given[at // len(sizes)]), int(sizes[at % len(sizes)])
                to = under.best(size)
                taken = next((i for i in bins[to] if lengths[i] == size), None) if size else None
                under.take(to, bins[to])
                for i in gives[n]:
                    own.remove(i)
                    bins[to].append(i)
                if taken is not None:
                    bins[to].remove(taken)
                    own.append(taken)
                changed = True
                fill[source] -= moved
                fill[to] += moved
                if fill[to] < most:
                    under.put(to, bins[to], most - fill[to], next(tick))
            if not own:
                left -= 1
        changed = changed and left > fewest
    return [b for b in bins if b]


def _packer(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        shard = pa.Table.from_batches(rows).combine_chunks()
        lengths = shard.column("length").to_pylist()
        part = [i for i, n in enumerate(lengths) if n < most]
        small = [lengths[i] for i in part]
        bins = [[part[i] for i in b] for b in improve(best_fit(small, most), small, most)]
        bins += [[i] for i, n in enumerate(lengths) if n == most]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 36
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        out = shard.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, most: int = 2048, shard_pieces: int = 65_536) -> DataFrame:
    """``pieces`` (written, with a column length of at most ``most``) with sequence_id and offset.

    Offsets of a sequence are gapless from 0. An empty table gives an empty one.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, `offset` long"
    return pieces.repartition(shards).mapInArrow(_packer(most), schema)


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = False, special_as_text: bool = False, **options) -> DataFrame:
    """Tokenised, cut and packed: one row per piece with its place.

    Pieces of equal length are interchangeable; which of them goes where follows
    their order in a shard. Very long texts are cut, empty and null ones are one id,
    repeated rows are packed each.
    """
    return pack(written(token_pieces(docs, tokenizer, most, end_id, with_ids, special_as_text), "pieces"), most, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids): the packed sequences, from rows that hold ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.ids").alias("ids"))
