"""Topic clusters: mean vectors of notes, a thresholded cosine graph and its components."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions import vectors as vx
from cairn.lineage import cut
from cairn.operators.graph import components
from cairn.operators.vector import mean_vectors, similar_links


def clusters(chunks: DataFrame, threshold: float = 0.6, min_size: int = 1) -> DataFrame:
    """(path, cluster, size): clusters below min_size fall apart into single notes."""
    means = cut(mean_vectors(chunks))
    pairs = similar_links(means, threshold, "path").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(means, pairs)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    small = F.col("size") < min_size
    rows = found.join(sizes, "component")
    return rows.select("path", F.when(small, F.col("path")).otherwise(F.col("component")).alias("cluster"), F.when(small, F.lit(1).cast("long")).otherwise(F.col("size")).alias("size"))


def _weight(means: DataFrame, key=None) -> DataFrame:
    """(path, weight): cosine summed over all notes, or over those of the same cluster, as a product with the sum of unit vectors."""
    unit = means.withColumn("u", vx.unit(F.col("embedding")))
    keys = [key] if key else []
    size = means.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n")).head().n
    total = unit.groupBy(*keys).agg(F.array_compact(F.array(*(F.sum(F.get("u", F.lit(i))) for i in range(size))).cast("array<double>")).alias("total"))
    joined = unit.join(total, key) if key else unit.crossJoin(F.broadcast(total))  # one vector
    return joined.select("path", *keys, vx.dot(F.col("u"), F.col("total")).alias("weight"))


def describe(chunks: DataFrame, found: DataFrame, members: int = 5) -> DataFrame:
    """One row for each cluster: size, central_note (nearest to all notes), label (nearest within, and first members)."""
    means, found = cut(mean_vectors(chunks)), cut(found)
    everywhere = _weight(means).join(found, "path").groupBy("cluster").agg(F.max_by("path", F.struct("weight", "path")).alias("central_note"), F.first("size").alias("size"))
    inside = _weight(means.join(found.select("path", "cluster"), "path"), "cluster").groupBy("cluster").agg(F.max_by("path", F.struct("weight", "path")).alias("central"))
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("path"))).filter(F.col("r") <= members)
    named = first.groupBy("cluster").agg(F.array_sort(F.collect_list("path")).alias("first_members"))
    rows = everywhere.join(inside, "cluster").join(named, "cluster")
    others = F.filter("first_members", lambda m: m != F.col("central"))
    label = F.when(F.size(others) == 0, F.col("central")).otherwise(F.concat(F.col("central"), F.lit(" (+"), F.array_join(others, ", "), F.when(F.col("size") > members, "…").otherwise(""), F.lit(")")))
    return rows.select("cluster", "size", "central_note", label.alias("label"), "first_members").orderBy(F.desc("size"), "cluster")


def summarise(described: DataFrame, notes: DataFrame, provider, n: int = 10) -> DataFrame:
    """A provider's summary of each cluster's first notes.  provider: Column -> Column."""
    text = described.select("cluster", F.explode(F.slice("first_members", 1, n)).alias("path")).join(notes, "path")
    joined = text.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", F.substring("content", 1, 500).alias("t")))), lambda s: s["t"]), "\n\n").alias("text"))
    return joined.select("cluster", provider(F.col("text")).alias("summary"))
