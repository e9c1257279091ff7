"""Session helpers: a local session, and tables that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the folder that spark.checkpoint.dir names.

    It cuts the lineage of loops, is computed once however often it is read, and
    unlike a local checkpoint does not go with an executor.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base := tempfile.mkdtemp(prefix="helixlake-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path:
            spark = table.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unsent(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: it is shuffled, not sent through the driver.

    Spark judges a written table by the bytes of its files; rows that compress well may
    be many times that in memory when they are broadcast.
    """
    return df.hint("merge")
