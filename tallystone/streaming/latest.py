"""Structured Streaming: the latest row of each key, and quotes that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import scratch


def latest_by_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`, of a stream or a table. The state holds one row for each key."""
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    rows = stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("w"))
    return rows.select(*keys, *[F.col("w")[c].alias(c) for c in (*order, *rest)])


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, and leaves its result as parquet at path; a rerun of a batch writes over it."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_of_files(spark: SparkSession, source: str, schema, keys: Sequence[str], order: Sequence[str], shape: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The latest rows of a folder's parquet files, read as a stream."""
    base = scratch(spark, "stream")
    folder, _, name = source.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = stream.parquet(f"{folder}/{name}") if not name.endswith(".parquet") else stream.parquet(source)
    run_available(latest_by_key(shape(stream), keys, order), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


def append_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what has come since its last run, and adds the result to the parquet files at path. What a checkpoint has seen isn't read again."""
    rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lines_of_files(spark: SparkSession, source: str, schema, glob: str = "*.parquet") -> DataFrame:
    """A folder's files (or one file) as a stream: each file once, when it comes."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(source)


def latest_in_windows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, width: str, late: str) -> DataFrame:
    """The last row of each key by `order` in each window of time, once the watermark has passed the window's end.

    Adds window_start. Rows that come more than `late` behind the newest one are left out, and the state holds
    the open windows only.
    """
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, *[F.col("x")[c].alias(c) for c in (*order, *rest)])
