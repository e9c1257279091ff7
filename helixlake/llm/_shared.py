"""What the operators share: scratch tables, bounded Arrow batches, words of a batch."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word-based operators, for Spark and for DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base := tempfile.mkdtemp(prefix="helixlake-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that nothing reads any more, and lets Spark delete the shuffle
    files of plans that nothing refers to, which it does when garbage is collected."""
    for t in tables:
        forget(t)
    spark = next((t.sparkSession for t in tables if t is not None), None)
    if spark:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``rows`` rows and, but for a single row, about ``mb`` MB.

    Spark itself bounds what reaches a worker at once (64 MB, or one row); this bounds
    what an operator expands at once, whatever the session's settings are.
    """
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * (mb << 20) / max(1, batch.get_total_buffer_size()))))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of a batch of texts, joined by one space each.

    ``data`` holds every word followed by a space; word w is
    ``data[start[w]:end[w]]`` and row r has the words ``first[r]`` to ``first[r+1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1]
        at = at[at < len(data)]
        begins[at] = inside[at]  # a text's first byte begins a word
        starts = np.flatnonzero(begins)
        self.first = np.searchsorted(starts, offsets)
        letters = np.flatnonzero(inside)
        word = np.cumsum(begins[letters]) - 1
        self.data = np.full(len(letters) + len(starts), 32, np.uint8)
        self.data[np.arange(len(letters)) + word] = data[letters]
        sizes = np.bincount(word, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes


def word_count(column):
    """Words of a text as a long, on the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
