"""Windowed counts over an event stream, kept up as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def counts(stream: DataFrame, lateness: str = "30 days", window: str = "1 hour") -> DataFrame:
    """Counts per type and window; events later than ``lateness`` behind the newest are dropped."""
    at = F.col("ts").cast("timestamp")
    return stream.withColumn("ts", at).withWatermark("ts", lateness).groupBy("event_type", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``counts`` run once over what is there; the state ends up in a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"events_{uuid.uuid4().hex}"
    q = counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    out = stored(spark.table(name).select("event_type", F.col("window.start").alias("window_start"), "n"), "event-counts")
    spark.catalog.dropTempView(name)
    return out
