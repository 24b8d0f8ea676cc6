"""A change feed of source files: new and changed files are extracted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract

SOURCES = "path string, content string, language string, content_hash string, indexed_at bigint"


def arrivals(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of ``sources`` rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(SOURCES).option("maxFilesPerTrigger", max_files).parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """Of each path the row with the greatest indexed_at; of equal ones that with the greatest hash."""
    best = batch.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash", "content", "language")).alias("m"))
    return best.select("path", "m.content", "m.language", "m.content_hash", "m.indexed_at")


def apply_batch(batch: DataFrame, store: str, batch_id: int) -> None:
    """Write what changed: a version of ``files`` and the extracted symbols, each under its batch.

    Rows whose hash is the one stored already change nothing. A batch that is tried again writes the same folders anew,
    so it is applied once. Readers take the latest record of a path (see ``stored_files``).
    """
    spark = batch.sparkSession
    new = latest(batch)
    known = stored_files(spark, store, batch_id)
    if known is not None:
        same = known.select("path", "content_hash")
        new = new.join(same, ["path", "content_hash"], "left_anti")
    out = f"{store}/batch={batch_id}"
    extract(new.select("path", "content", "language")).join(new.select("path", "content_hash", "indexed_at"), "path").write.mode("overwrite").parquet(out)


def stored_files(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """(path, content_hash, indexed_at, node_count, batch) of the latest record of each path; None if nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(store)
    except AnalysisException:
        return None
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    rows = rows.select("path", "content_hash", "indexed_at", F.size("nodes").alias("node_count"), "batch")
    best = rows.groupBy("path").agg(F.max(F.struct("batch", "indexed_at", "content_hash", "node_count")).alias("m"))
    return best.select("path", "m.content_hash", "m.indexed_at", "m.node_count", "m.batch")


def run(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True):
    """Start the feed; with ``once`` it takes all that is there and ends."""
    stream = arrivals(spark, folder).writeStream.foreachBatch(lambda b, i: apply_batch(b, store, i)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or table of events; rows later than ``late`` are dropped in a stream."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


