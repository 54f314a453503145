"""File events as streams: (path, action, ts, sequence)."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EVENTS = "path STRING, action STRING, ts TIMESTAMP, sequence BIGINT"
GAP = "2 seconds"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 50) -> DataFrame:
    """A stream of events from JSON files, a bounded number of files in each batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_notes(spark: SparkSession, folder: str, files_per_trigger: int = 50) -> DataFrame:
    """A stream of new and changed Markdown files as (path, action, ts, sequence, content)."""
    rows = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.select("path", F.lit("index").alias("action"), F.col("modificationTime").alias("ts"), F.lit(0).cast("long").alias("sequence"), F.col("content").cast("string").alias("content"))


def debounce(events: DataFrame, gap: str = GAP, lateness: str = "10 seconds") -> DataFrame:
    """One row (path, action, first, last, events) for each burst: events of a path less than the gap apart; its last action wins.

    Works on tables and streams.  On a stream a burst is given once the
    watermark has passed it, so the last one of a quiet stream stays open.
    """
    rows = events.filter(F.col("path").endswith(".md"))
    rows = rows.withWatermark("ts", lateness) if events.isStreaming else rows
    last = F.max_by("action", F.struct("ts", "sequence"))
    grouped = rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(last.alias("action"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return grouped.select("path", "action", "first", "last", "events")


def apply_batch(table: str, key: str = "path"):
    """A foreachBatch function that keeps ``table``, a view, of the latest row of each key; a deleted key goes.

    Each batch writes a version of its own from the one before it and then turns
    the view to it.  The version before stays until the next batch, so a batch
    that failed anywhere, or that is given again, has the same outcome.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("sequence"))
        latest = batch.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
        rows = latest.filter("action <> 'delete'")
        versions = (re.fullmatch(rf"{re.escape(table)}_v(\d+)", t.name, re.I) for t in spark.catalog.listTables())
        before = sorted(v for v in (int(m[1]) for m in versions if m) if v < number)
        if before:
            rows = spark.table(f"{table}_v{before[-1]}").join(latest.select(key), key, "left_anti").unionByName(rows)
        rows.write.mode("overwrite").saveAsTable(f"{table}_v{number}")
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {table}_v{number}")
        for v in before[:-1]:
            spark.sql(f"DROP TABLE IF EXISTS {table}_v{v}")

    return write
