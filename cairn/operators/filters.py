"""Metadata filters as one column, so that they reach the scan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.text import truncate_snippet


def where(tags: list[str] | None = None, folder: str | None = None, after: float | None = None, before: float | None = None) -> Column:
    """All tags, the folder anywhere in the path, modification time within bounds (seconds); missing fields don't match."""
    parts = [F.array_contains("tags", t) for t in tags or []]
    if folder:
        parts.append(F.col("path").contains(folder.rstrip("/") + "/"))
    if after is not None:
        parts.append(F.col("mtime") >= after)
    if before is not None:
        parts.append(F.col("mtime") <= before)
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def iso_seconds(date: str) -> Column:
    """Seconds of an ISO date in the session's time zone."""
    return F.unix_timestamp(F.to_timestamp(F.lit(date))).cast("double")


def exclude_tags(tags: list[str]) -> Column:
    return ~F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)).cast("array<string>"))


def search_by_tags(chunks: DataFrame, tags: list[str], n: int) -> DataFrame:
    """Notes with all the tags, by path, with a snippet of their first chunk; no tags, no notes."""
    if not tags:
        return chunks.select("path", "title", F.col("document").alias("snippet")).limit(0)
    first = Window.partitionBy("path").orderBy("chunk")
    has_all = F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0
    found = chunks.filter(has_all).withColumn("r", F.row_number().over(first)).filter("r = 1")
    return found.select("path", "title", truncate_snippet(F.col("document")).alias("snippet")).orderBy("path").limit(n)


def without_subjects(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("path").startswith("Subjects/"))


def in_folder(folder: str) -> Column:
    folder = folder.rstrip("/")
    return (F.col("path") == folder) | F.col("path").startswith(folder + "/") if folder else F.lit(True)


def of_entity_type(results: DataFrame, mentions: DataFrame, types: list[str]) -> DataFrame:
    """Results that weren't found by an entity, or that mention an entity of one of the types."""
    typed = mentions.filter(F.col("type").isin(types)).select("path").distinct().withColumn("typed", F.lit(True))
    return results.join(typed, "path", "left").filter(~F.array_contains("matched_by", "entity") | F.col("typed")).drop("typed")
