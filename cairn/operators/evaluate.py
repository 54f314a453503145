"""Retrieval quality: retrieved (query, rank from 1, title), expected (query, title); titles compare folded."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.functions.text import title_of_path


def load_benchmark(spark, path: str) -> DataFrame:
    """Queries from a JSON file; none if it isn't there."""
    kind = "query STRING, expected ARRAY<STRING>, description STRING"
    try:
        return spark.read.schema(kind).option("multiLine", True).json(path).filter("query IS NOT NULL AND trim(query) <> ''")
    except Exception as e:  # the reader's own error for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def titles(found: DataFrame) -> DataFrame:
    return found.withColumn("title", F.lower(title_of_path(F.col("path"))))


def per_query(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """precision and recall at k, and mrr, of each query that expects something or retrieved something."""
    fold = lambda d: d.withColumn("title", F.lower("title"))
    want = fold(expected).select("query", "title").distinct()
    hits = fold(retrieved).join(want, ["query", "title"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    asked = retrieved.select("query").union(expected.select("query")).distinct()
    wanted = want.groupBy("query").agg(F.count("*").alias("wanted"))
    rows = asked.join(hits, "query", "left").join(wanted, "query", "left")
    n = F.coalesce("hits", F.lit(0))
    return rows.select("query", (n / F.lit(k)).alias("precision"), F.coalesce(n / F.col("wanted"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def summary(scored: DataFrame) -> DataFrame:
    """Macro averages to 4 places."""
    return scored.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "mrr")))


def format_results(row, k: int) -> str:
    return f"queries: {row.queries}\nP@{k}: {row.precision:.4f}\nR@{k}: {row.recall:.4f}\nMRR: {row.mrr:.4f}"
