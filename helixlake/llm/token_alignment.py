"""Alignment of two tokenizers over a corpus, by a cogroup of postings.

Both tokenizers cut the same bytes, so tokens whose bytes overlap are linked. Each batch
of documents is tokenised once and leaves, for every id of the second tokenizer (B), one
row of postings: which document links it to which id of the first (A), and how often. The
postings are shuffled by B id and read as sorted streams: first the counts of its pairs,
then its postings, from which the contributions to each document follow. These are summed
by document.

A frequent B id is split into groups of bounded size, and each gets the counts of that id
(at most one for each A id). Nothing is held but the counts of one id and one batch.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced, written
from .packing import _byte_letters, _tokenizer

#: Fixed value: what the piece tokenizer writes for a blank.
_BLANK = "▁"
#: A blank after anything but white space: both tokenizers end a token before it.
_CUT = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s[ \n]")
#: Chunks of words that one worker remembers, about 100 MB; longer ones than this are not.
_REMEMBER, _LONGEST = 200_000, 100
#: Documents are numbered by batch and place in it.
_LOCAL_BITS = 10

_ROWS = (
    "batch long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
    " b int, docs array<int>, a array<int>, m array<int>, pair_a array<int>, pair_n array<long>, pair_docs array<long>"
)
_SCORES = "batch long, docs array<int>, n_best array<long>, count_sum array<long>"
_SUMS = "batch long, place int, n_best long, count_sum long"


@cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(_BLANK, " ").encode() for i, n in enumerate(names)], names


class Aligner:
    """Groups and links of texts, chunk by chunk.

    A blank after anything but white space begins a token of both tokenizers, whatever
    follows; so does a line break there, and a full stop or comma after a letter or digit,
    as no piece joins them. So a text's alignment is that of the chunks between such places.
    A chunk is aligned once and remembered; when there are too many, those of the batch at
    hand stay. Texts that hold the character for a blank itself, and
    those where either tokenizer's bytes are not the text's, have no tokens.
    """

    def __init__(self, a_path: str, b_path: str):
        self.tokenizer = _tokenizer(a_path, True)
        byte = {c: b for b, c in _byte_letters().items()}
        size = self.tokenizer.get_vocab_size()
        self.a_bytes = [bytes(byte[c] for c in t) if (t := self.tokenizer.id_to_token(i)) and all(c in byte for c in t) else b"" for i in range(size)]
        self.model, self.b_bytes, names = _pieces(b_path)
        if max(size, len(names)) >= 1 << 24:
            raise ValueError("token ids must fit into 24 bits")
        if any(_BLANK in n.lstrip(_BLANK) for n in names):
            raise ValueError("a piece goes on after a blank: texts cannot be cut at blanks")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.name = list(map(str, range(max(size, len(names)))))
        # what may stand before a stop or comma only if the text is cut at blanks alone
        odd = "".join(re.escape(n[n.index(x) - 1]) for n in names for x in ".," if re.search(rf"[^\W_]\{x}", n))
        self.tied = re.compile(rf"[\W_{odd}][.,]")
        self.line_break = self.model.encode("\n")
        self.lone_blank = self.model.piece_to_id(_BLANK)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.bad = array("q"), array("q"), array("q"), array("b")
        self.text: list[str] = []
        self.first, self.pair_a, self.pair_b = array("q", [0]), array("q"), array("q")

    def _groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[str]]:
        """The linked ids of both sides, in order of bytes, and the groups that common ends cut."""
        name, la, lb = self.name, self.a_size, self.b_size
        if len(a) == 1 or len(b) == 1:
            n = max(len(a), len(b))
            return a * (n // len(a)), b * (n // len(b)), [",".join([name[i] for i in a]) + "|" + ",".join([name[i] for i in b])]
        pa_, pb, parts, i, j, ia, jb = [], [], [], 0, 0, 0, 0
        ahead = la[a[0]] - lb[b[0]]  # of the end of A's token over that of B's
        while True:
            pa_.append(a[i])
            pb.append(b[j])
            if ahead > 0:
                j += 1
                ahead -= lb[b[j]]
            elif ahead < 0:
                i += 1
                ahead += la[a[i]]
            else:
                i, j = i + 1, j + 1
                parts.append(",".join([name[x] for x in a[ia:i]]) + "|" + ",".join([name[x] for x in b[jb:j]]))
                if i == len(a):
                    return pa_, pb, parts
                ia, jb = i, j
                ahead = la[a[i]] - lb[b[j]]

    def _add(self, chunk: str, a: list[int], b: list[int]) -> int:
        raw, ab, bb = chunk.encode(), self.a_bytes, self.b_bytes
        good = b"".join([ab[i] for i in a]) == raw and b"".join([bb[i] for i in b]) == raw
        links_a, links_b, groups = self._groups(a, b) if good else ((), (), ())
        self.pair_a.extend(links_a)
        self.pair_b.extend(links_b)
        self.text.append(";".join(groups))
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.n_groups.append(len(groups))
        self.bad.append(not good)
        self.first.append(len(self.pair_a))
        return len(self.text) - 1

    def learn(self, chunks: list[str]) -> dict[str, int]:
        a = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        # the model puts a blank before each text: it is the chunk's own, or goes with a line break
        b = self.model.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        skip = len(self.line_break)
        own = (y if c[0] == " " and c != " " else [self.lone_blank] if c == " " else y[skip:] for c, y in zip(chunks, b, strict=True))
        return {c: self._add(c, x, y) for c, x, y in zip(chunks, a, own, strict=True)}

    def keep(self, chunks: set[str]) -> None:
        """Forgets all chunks but these."""
        old = [(c, self.known[c]) for c in chunks if c in self.known]
        at, names = [i for _, i in old], ("n_a", "n_b", "n_groups", "bad", "text", "first", "pair_a", "pair_b")
        before = {n: getattr(self, n) for n in names}
        self.clear()
        self.known = {c: k for k, (c, _) in enumerate(old)}
        for n in names[:5]:
            getattr(self, n).extend([before[n][i] for i in at])
        first = before["first"]
        for i in at:
            self.pair_a.extend(before["pair_a"][first[i] : first[i + 1]])
            self.pair_b.extend(before["pair_b"][first[i] : first[i + 1]])
            self.first.append(len(self.pair_a))

    def forget_from(self, n: int) -> None:
        """Drops the chunks from number ``n`` on, which are those of one batch alone."""
        pairs = self.first[n]
        for own in (self.n_a, self.n_b, self.n_groups, self.bad, self.text):
            del own[n:]
        del self.first[n + 1 :]
        del self.pair_a[pairs:], self.pair_b[pairs:]

    def chunked(self, texts: list[str | None]) -> tuple[list[list[int]], int]:
        """Numbers of each text's chunks, and from which number on they are not remembered."""
        cut = []
        for t in texts:
            if not t or _BLANK in t:
                cut.append([])
            elif _WIDE.search(t := " " + t) or "\0" in t or self.tied.search(t):
                cut.append(_CUT.split(t))
            else:
                for c in " \n.,":
                    t = t.replace(c, "\0" + c)
                cut.append(t.split("\0")[1:])
        every = set().union(*cut)
        if len(self.known) > _REMEMBER:
            self.keep(every)
        known = self.known
        new = every.difference(known)
        known.update(self.learn([c for c in new if len(c) <= _LONGEST]))
        kept = len(self.text)
        longer = self.learn([c for c in new if len(c) > _LONGEST])
        number = {**{c: known[c] for c in every if len(c) <= _LONGEST}, **longer} if longer else known
        return [[number[c] for c in own] for own in cut], kept


_aligners: dict[tuple[str, str], Aligner] = {}


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end of the last."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _table(columns: dict[str, pa.Array], n: int, names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in names], names=[c for c, _ in names])


def _align(a_path: str, b_path: str, with_groups: bool):
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": ints, "array<long>": longs}
    names = [(c, kinds[t]) for c, t in (x.split() for x in _ROWS.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        own, task = _aligners[a_path, b_path], TaskContext.get().partitionId()
        for k, batch in enumerate(sliced(batches)):
            number, n = (task << 22) + k, batch.num_rows
            chunks, kept = own.chunked(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, chunks), np.int64, n)
            chunk = np.fromiter((c for own_ in chunks for c in own_), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(n), sizes)
            good = np.bincount(doc, np.array(own.bad)[chunk] if len(chunk) else None, n) == 0
            chunk, doc = chunk[good[doc]], doc[good[doc]]

            def summed(values, chunk=chunk, doc=doc, n=n):
                return np.bincount(doc, np.array(values, np.int64)[chunk] if len(chunk) else None, n).astype(np.int64)

            n_a, n_b, n_groups = summed(own.n_a), summed(own.n_b), summed(own.n_groups)
            texts = [";".join([own.text[c] for c in cs]) if g and cs else "" for g, cs in zip(good, chunks, strict=True)]
            yield _table(
                {
                    "batch": pa.array(np.full(n, number)),
                    "place": pa.array(np.arange(n, dtype=np.int32)),
                    "doc_id": batch.column(0),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_groups),
                    "n_links": pa.array(n_a + n_b - n_groups),
                    "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
                    "groups": pa.array(texts if with_groups else [None] * n, pa.string()),
                },
                n,
                names,
            )
            # each chunk of a document once, with how often it occurs
            once, times = np.unique(doc * len(own.text) + chunk, return_counts=True)
            doc, chunk = np.divmod(once, max(1, len(own.text)))
            first = np.array(own.first)
            lens = first[chunk + 1] - first[chunk]
            at = np.repeat(first[chunk] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
            code = np.array(own.pair_b)[at] << 34 | np.array(own.pair_a)[at] << _LOCAL_BITS | np.repeat(doc, lens)
            own.forget_from(kept)
            by = np.argsort(code, kind="stable")
            code, times = code[by], np.repeat(times, lens)[by]
            if not len(code):
                continue
            u = _runs(code)[:-1]
            code, m = code[u], np.add.reduceat(times, u)
            b, pair = code >> 34, code >> _LOCAL_BITS
            at, pairs = _runs(b), _runs(pair)
            inner = np.searchsorted(pairs[:-1], at)
            yield _table(
                {
                    "batch": pa.array(np.full(len(at) - 1, number)),
                    "b": pa.array(b[at[:-1]].astype(np.int32)),
                    "docs": _lists((code & (1 << _LOCAL_BITS) - 1).astype(np.int32), at, pa.int32()),
                    "a": _lists((pair & (1 << 24) - 1).astype(np.int32), at, pa.int32()),
                    "m": _lists(m.astype(np.int32), at, pa.int32()),
                    "pair_a": _lists((pair[pairs[:-1]] & (1 << 24) - 1).astype(np.int32), inner, pa.int32()),
                    "pair_n": _lists(np.add.reduceat(m, pairs[:-1]), inner, pa.int64()),
                    "pair_docs": _lists(np.diff(pairs), inner, pa.int64()),
                },
                len(at) - 1,
                names,
            )

    return run


def aligned_batches(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A written table with a row for each document, and a row of postings for each batch and B id.

    ``groups`` is the alignment itself, ``a1,a2|b1;a3|b2,b3`` in decimal ids, if asked for.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_align(a_path, b_path, with_groups), _ROWS), "alignment")


def pair_counts(batches: DataFrame) -> DataFrame:
    """b, a, n, n_docs: how often the corpus links two ids, and in how many documents.

    Each batch has summed its own pairs, and they are summed again before the shuffle.
    """
    own = batches.where("b is not null").select("b", F.inline(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_n").alias("n"), F.col("pair_docs").alias("d"))))
    return own.groupBy("b", "a").agg(F.sum("n").alias("n"), F.sum("d").alias("n_docs"))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, part, batch): the counts of an id, then its postings."""
    current, counts = None, None
    done: list[tuple[np.ndarray, ...]] = []

    def out():
        key, best, total = map(np.concatenate, zip(*done, strict=True))
        done.clear()
        by = np.argsort(key, kind="stable")
        at = _runs(key[by])[:-1]
        key = key[by][at]
        own = _runs(key >> _LOCAL_BITS)
        sums = [_lists(np.add.reduceat(x[by], at), own, pa.int64()) for x in (best, total)]
        return pa.RecordBatch.from_arrays([pa.array(key[own[:-1]] >> _LOCAL_BITS), _lists((key & (1 << _LOCAL_BITS) - 1).astype(np.int32), own, pa.int32()), *sums], names=["batch", "docs", "n_best", "count_sum"])

    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        number, b, part = (column[c].to_numpy() for c in ("batch", "b", "part"))
        offset = {c: column[c].offsets.to_numpy() for c in ("docs", "n")}
        flat = {c: column[c].values.to_numpy() for c in ("docs", "a", "m", "n")}
        runs = _runs(b.astype(np.int64) << 32 | part)
        for s, e in zip(runs, runs[1:], strict=False):
            if number[s] < 0:
                x, y = column["a"].offsets[int(s)].as_py(), column["a"].offsets[int(s) + 1].as_py()
                u, v = offset["n"][s], offset["n"][s + 1]
                counts, current, s = (flat["a"][x:y], flat["n"][u:v]), (b[s], part[s]), s + 1
            if current is None or s < e and current != (b[s], part[s]):
                raise ValueError("postings came without the counts of their id")
            if s == e:
                continue
            x, y = offset["docs"][s], offset["docs"][e]
            skip = column["a"].offsets[int(s)].as_py() - x  # rows of counts have ids but no documents
            ids, m = flat["a"][x + skip : y + skip], flat["m"][x:y].astype(np.int64)
            n = counts[1][np.searchsorted(counts[0], ids)]
            key = np.repeat(number[s:e], np.diff(offset["docs"][s : e + 1])) << _LOCAL_BITS | flat["docs"][x:y]
            done.append((key, np.where(n == counts[1].max(), m, 0), n * m))
        if sum(len(d[0]) for d in done) > 1 << 20:
            yield out()
    if done:
        yield out()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contributions sorted by batch -> sums by document."""
    own, sums, seen = None, np.zeros((2, 1 << _LOCAL_BITS), np.int64), np.zeros(1 << _LOCAL_BITS, bool)

    def out():
        at = np.flatnonzero(seen)
        done = [pa.array(np.full(len(at), own)), pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in sums)]
        sums[:], seen[:] = 0, False
        return pa.RecordBatch.from_arrays(done, names=["batch", "place", "n_best", "count_sum"])

    for batch in batches:
        number, (docs, *values) = batch.column(0).to_numpy(), batch.columns[1:]
        offset, flat = docs.offsets.to_numpy(), docs.values.to_numpy()
        of = [(v.offsets.to_numpy(), v.values.to_numpy()) for v in values]
        runs = _runs(number)
        for s, e in zip(runs, runs[1:], strict=False):
            if own is not None and own != number[s]:
                yield out()
            own, at = number[s], flat[offset[s] : offset[e]]
            seen[at] = True
            for x, (o, v) in zip(sums, of, strict=True):
                np.add.at(x, at, v[o[s] : o[e]])
    if own is not None:
        yield out()


def document_scores(batches: DataFrame, group_postings: int = 1 << 16) -> DataFrame:
    """batch, place, n_best, count_sum by document, from the postings of all B ids.

    ``n_best`` are links whose pair is as frequent as any of their B id, ``count_sum`` sums
    the frequencies of a document's links. An id with more than ``group_postings`` postings
    is split into parts of about that size.
    """
    size = F.ceil(F.col("postings") / group_postings)
    # One row for each B id with at most as many counts as there are A ids: bounded by the vocabularies.
    table = pair_counts(batches).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("t"), F.sum("n_docs").alias("postings"))
    table = written(table.select("b", F.col("t.a").alias("a"), F.col("t.n").alias("n"), size.cast("int").alias("parts")), "pair-counts")
    none = F.array().cast("array<int>")
    counts = table.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("batch"), none.alias("docs"), "a", none.alias("m"), "n")
    posting = batches.where("b is not null").select("b", "batch", "docs", "a", "m")
    posting = posting.join(F.broadcast(table.select("b", "parts")), "b").withColumn("part", F.pmod(F.xxhash64("batch"), F.col("parts")).cast("int"))
    stream = counts.unionByName(posting.select("b", "part", "batch", "docs", "a", "m", F.array().cast("array<long>").alias("n")))
    own = stream.repartition("b", "part").sortWithinPartitions("b", "part", "batch").mapInArrow(_score, _SCORES)
    # A row has what some ids give to the documents of a batch, so there are not more rows than postings have.
    return own.repartition("batch").sortWithinPartitions("batch").mapInArrow(_sum, _SUMS)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, group_postings: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``groups`` if asked for.

    A tokenizes a blank and the text, as a byte-level vocabulary has it; B the text, before
    which it puts a blank itself. Strings of special tokens are plain text. Null and empty
    texts, and texts whose bytes either tokenizer changes, have no tokens: zeros and an empty
    digest. Rows that repeat, and null ids, are documents of their own and count as such;
    other columns are ignored; an empty table gives an empty one. A very long text is one
    batch and is held whole; pairs as frequent as each other are all the highest.
    """
    batches = aligned_batches(docs, a_path, b_path, id_col, text_col, with_groups)
    key = ["batch", "place"]
    names = ["n_a", "n_b", "n_groups", "n_links"]
    doc = batches.where("place is not null").select(*key, "doc_id", *names, "groups_sha256", *(["groups"] if with_groups else []))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return doc.join(document_scores(batches, group_postings), key, "left").select(F.col("doc_id").alias(id_col), *names, zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
