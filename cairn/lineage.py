"""Cutting lineage by tables in the folder that driver and executors share."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a narrow lookup table that may be broadcast once they are counted.
BROADCAST_ROWS = 200_000
#: Rows that a task of a shuffled lookup takes of the larger side.
LOOKUP_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one is made only where none is set and all run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined with those of a narrow table, whose keys hardly repeat.

    A table counted as small is broadcast.  Else the number of tasks follows the number of rows, and a task hashes
    its share of the table: rows aren't sorted, so its memory is the same at any size.
    """
    few = table.count()
    if few <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), F.col(key) == F.col(other))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-max(few, rows.count()) // LOOKUP_ROWS))
    return rows.repartition(parts, key).join(table.repartition(parts, other).hint("shuffle_hash"), F.col(key) == F.col(other))
