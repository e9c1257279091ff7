"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles: matrices of at most ``tile_rows`` rows, made where
the rows are read. Each query tile meets each candidate tile once, by an
equi-join on shard numbers; a task multiplies the two, selects k per query in the
tile, and the short lists are merged in two levels of a tree. Work is queries
times candidates, as exactness asks, and no task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import sliced, written

_TILE = "dims int, ids binary, rows binary"
_FOUND = "query_id long, tile int, vec_id long, score long"


def _packer(tile_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dims, parts):
            ids = np.concatenate([p[0] for p in parts])
            rows = np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], names=["dims", "ids", "rows"])

        for batch in sliced(batches, 4096):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                matrix = flat[at[own][:, None] + np.arange(dims)]
                parts = held.setdefault(int(dims), [])
                for k in range(0, len(own), tile_rows):
                    parts.append((ids[own[k : k + tile_rows]].astype(np.int64), matrix[k : k + tile_rows]))
                    if sum(len(p[0]) for p in parts) >= tile_rows:
                        yield tile(int(dims), parts)
                        parts.clear()
        for dims, parts in held.items():
            if parts:
                yield tile(dims, parts)

    return pack


def _tile_topk(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                number += 1
                dims = row["dims"]
                qid, cid = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(row[x], np.float64).reshape(-1, dims) for x in ("q_rows", "rows"))
                large = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * dims
                if large < 2.0**53:  # sums of doubles are exact
                    score = (q @ c.T).astype(np.int64)
                elif large < 2.0**62:
                    score = q.astype(np.int64) @ c.astype(np.int64).T
                else:
                    raise ValueError("an inner product does not fit a long")
                own = qid[:, None] == cid[None, :]
                found_q, found_c = [], []
                for i in range(len(qid)):
                    at = np.flatnonzero(~own[i])
                    if len(at) > k:  # all that reach the k-th score; ties are settled by id
                        kth = np.partition(score[i, at], len(at) - k)[len(at) - k]
                        at = at[score[i, at] >= kth]
                        at = at[np.lexsort((cid[at], -score[i, at]))[:k]]
                    found_q.append(np.full(len(at), i))
                    found_c.append(at)
                fq, fc = np.concatenate(found_q), np.concatenate(found_c)
                yield pa.RecordBatch.from_arrays([pa.array(qid[fq]), pa.array(np.full(len(fq), number % 64), pa.int32()), pa.array(cid[fc]), pa.array(score[fq, fc])], names=["query_id", "tile", "vec_id", "score"])

    return search


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    tile_rows: int = 2048,
    query_rows: int = 1024,
    group_tiles: int = 4,
    group_query_tiles: int = 16,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by inner product.

    Both tables need an id and an array of doubles that hold whole numbers, whose
    products fit a long. Ties go to the smaller id. Rows with a null id, a null
    vector, or a null or non-finite component take no part; vectors are compared
    with those of equal length only. A query never finds rows with its own id. Of
    queries that repeat an id the smallest vector counts; candidate rows that
    repeat are candidates each. Other columns are ignored; with no query or no
    candidate the result is empty.
    """
    def clean(df):
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)

    tiles = written(clean(vectors).mapInArrow(_packer(tile_rows), _TILE), "topk-tiles")
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_packer(query_rows), _TILE)
    asked = written(asked, "topk-queries")
    # Any group will do for a tile, as each group of one side meets all of the other.
    across, down = (max(1, -(-t.count() // n)) for t, n in ((tiles, group_tiles), (asked, group_query_tiles)))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = tiles.select("dims", group(across).alias("c_group"), every(down).alias("q_group"), "ids", "rows")
    asked = asked.select("dims", every(across).alias("c_group"), group(down).alias("q_group"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    met = dealt.join(asked, ["c_group", "q_group", "dims"]).select("dims", "ids", "rows", "q_ids", "q_rows")
    lists = met.mapInArrow(_tile_topk(k), _FOUND)
    order = [F.desc("score"), "vec_id"]
    level = lists.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*order))).where(F.col("_n") <= k)
    return (
        level.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
