"""Incremental rescan: new files of a folder are hashed once and appended to the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mediaframe.operators.hashing import file_sha256
from mediaframe.session import path_exists
from mediaframe.sources.readers import uncached

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def hash_files(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("filesize"), F.col("modificationTime").alias("mod_date"), file_sha256(F.col("content")).alias("file_sha256"))


def rescan(
    spark: SparkSession, folder: str, cache: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = hash_files
) -> StreamingQuery:
    """Process what has come since the last call and stop.  A batch that is run again adds nothing twice, since files
    that the cache holds (path, size, time) are skipped before any work is done on them; order of completion does not
    matter.  A cache that cannot be read is an error, only one that is not there counts as empty."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def commit(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        if path_exists(spark, cache):
            held = spark.read.parquet(cache).select("path", F.col("filesize").alias("length"), F.col("mod_date").alias("modificationTime"))
            fresh = uncached(batch, held, ["path", "length", "modificationTime"])
        work(fresh.select(batch.columns)).write.mode("append").parquet(cache)

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(commit).start()


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per window and type of a stream (or a table), late ones up to the watermark included."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
