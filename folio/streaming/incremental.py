"""Incremental enrichment: a stream of answers upserts into a table, with a budget for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row for each key, that of the latest stamp; undated ones are the oldest."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(stamp, F.lit("")), F.xxhash64(*columns))).alias("r")).select(key, "r.*")


def stale(cache: DataFrame, key: str, stamp: str, before: str) -> DataFrame:
    """Keys to ask for again: fetched before a date, or without one."""
    return cache.where((F.col(stamp) < before) | F.col(stamp).isNull()).select(key)


def upsert(spark: SparkSession, path: str, key: str, stamp: str):
    """A batch writer: the table at ``path`` with the batch's rows, latest wins.

    The table is written beside the old one and named by batch, so a batch that is run again after a
    failure writes the same, and readers of the old table are not disturbed.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = current(spark, path, number)
        both = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        latest(both, key, stamp).write.mode("overwrite").parquet(f"{path}/v={number:06d}")

    return write


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the table (before a batch), or None."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.Path(path)):
        return None
    versions = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(jvm.Path(path)) if s.getPath().getName().startswith("v=") and fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{path}/v={versions[-1]:06d}") if versions else None


def enrich(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str, key: str = "pmid", stamp: str = "fetched", files: int = 100) -> StreamingQuery:
    """Takes in all files that have come since the last run, ``files`` at a time, and stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(incoming)
    return stream.writeStream.foreachBatch(upsert(spark, table, key, stamp)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key of a stream; with an event time the state is bounded by a watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) of tumbling windows, for batch and stream alike; late rows are awaited for ``late``."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def numbered_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Batch form of ``keep_first`` in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
