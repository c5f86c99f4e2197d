"""Structured Streaming: chunking, bounded query logs, dedup across batches, and windowed analytics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.chunking import chunked
from tidewell.session import shared_dir


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, `files` of them in a batch; times without a zone are read as UTC."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # A stream reads folders; a table of one file is picked from its own.
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", where.getName())
        path = where.getParent().toString()
    rows = reader.parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}) if "timestamp_ntz" in dict(rows.dtypes).values() else rows


def drained(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is there and returns what it wrote: a Parquet table in the shared folder, beside its checkpoint.

    With `each`, batches go there instead.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tidewell-stream-{uuid.uuid4().hex}"
    out = df.writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if each:
        out.foreachBatch(each).start().awaitTermination()
        return None
    out.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def chunk_stream(docs: DataFrame, chunker: Callable[[str], list]) -> DataFrame:
    """Chunks of streamed documents; no state."""
    return chunked(docs, chunker)


def dedup_stream(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key; keys are forgotten `late` after their time."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, late: str, length: str, by: str, value: str) -> DataFrame:
    """(start, by, n, mean) of tumbling windows, each once it is closed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: str) -> DataFrame:
    """(by, start, end, n) of sessions that end after a silence of `gap`."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return w.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bounded_log(events: DataFrame, most: int = 100) -> DataFrame:
    """(user_id, held, newest, total) after each batch: how many of each user's latest `most` events the state holds."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, total = state.get if state.exists else ([], 0)
        held = list(held)
        for p in parts:
            held += [int(t.value) for t in pd.to_datetime(p["ts"])]
            total += len(p)
        held = sorted(held)[-most:]
        state.update((held, total))
        yield pd.DataFrame({"user_id": [key[0]], "held": [len(held)], "newest": [held[-1] // 1000], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(keep, "user_id long, held long, newest long, total long", "held array<long>, total long", "append", GroupStateTimeout.NoTimeout)
