"""Maintenance of the chunk collection; every change gives a new table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.operators.vector import upsert


def put(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(chunks, rows, "chunk_id")


def delete_by_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") != path)


def get_by_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") == path).orderBy("chunk")


def get_by_title(chunks: DataFrame, title: str) -> DataFrame:
    """Notes with a title, the first chunk of each."""
    others = [c for c in chunks.columns if c != "path"]
    return chunks.filter(F.col("title") == title).groupBy("path").agg(F.min_by(F.struct(*others), "chunk").alias("c")).select("path", "c.*").orderBy("path")


def update_metadata(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Values of updates (path and some columns) that aren't null, on all chunks of a note."""
    new = [c for c in updates.columns if c != "path"]
    joined = chunks.join(updates.select("path", *(F.col(c).alias(f"_{c}") for c in new)), "path", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in chunks.columns))


def reset(chunks: DataFrame) -> DataFrame:
    return chunks.limit(0)


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks and distinct notes."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("notes"))
