"""Connected components over a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.operators.graph import linked_components


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the smallest node that links reach."""
    found = linked_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("path").alias("node"), F.col("component").alias("label"))
