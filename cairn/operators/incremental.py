"""What has changed between the notes and the state of the last run."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cairn.functions.text import content_hash
from cairn.operators.chunking import apply_delta, chunk_notes

MTIME_TOLERANCE = 0.001


def changes(notes: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status) of every path: new, changed, unchanged or deleted, by content hash."""
    now = notes.select("path", content_hash(F.col("content")).alias("new_hash"))
    was = state.select("path", F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return now.join(was, "path", "full_outer").select("path", status.alias("status"))


def without_untouched(changed: DataFrame, notes: DataFrame, state: DataFrame) -> DataFrame:
    """Changed paths whose modification time has moved by the tolerance at least."""
    times = notes.select("path", F.col("mtime").alias("now")).join(state.select("path", F.col("mtime").alias("was")), "path", "left")
    return changed.join(times, "path").filter(F.col("was").isNull() | (F.abs(F.col("now") - F.col("was")) >= MTIME_TOLERANCE)).select(*changed.columns)


def collect_garbage(state: DataFrame, notes: DataFrame) -> DataFrame:
    """State of paths that still exist."""
    return state.join(notes.select("path").distinct(), "path", "left_semi")


def next_state(notes: DataFrame) -> DataFrame:
    return notes.select("path", content_hash(F.col("content")).alias("content_hash"), "mtime")


def bootstrap_mtimes(chunks: DataFrame) -> DataFrame:
    """The least known modification time of each note, from its chunks."""
    return chunks.groupBy("path").agg(F.min("mtime").alias("mtime"))


@dataclass
class Run:
    chunks: DataFrame
    state: DataFrame
    status: DataFrame


def run_index(notes: DataFrame, old_chunks: DataFrame, state: DataFrame, embed, folder: str = "") -> Run:
    """One incremental run: the new chunks, each new text embedded once and known ones carried over; embed: Column -> Column."""
    from cairn.operators.filters import in_folder

    scoped = notes.filter(in_folder(folder))
    joined = apply_delta(chunk_notes(scoped), old_chunks, ["embedding"])
    texts = joined.filter("embedding IS NULL").select("document").distinct().withColumn("fresh", embed(F.col("document")))
    fresh = joined.join(texts, "document", "left").withColumn("embedding", F.coalesce("embedding", "fresh")).drop("fresh")
    outside = old_chunks.filter(~in_folder(folder)) if folder else old_chunks.limit(0)
    return Run(fresh.unionByName(outside, allowMissingColumns=True), next_state(scoped), changes(scoped, state.filter(in_folder(folder))).groupBy("status").agg(F.count("*").alias("notes")))
