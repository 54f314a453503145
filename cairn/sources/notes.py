"""Notes: Markdown files as a table (path, content, mtime)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions import text as tx

#: Parts of names that are left out.
EXCLUDED = ("_gsdata_", ".gsbak", ".git", "__pycache__", "node_modules", ".excalidraw.md", ".github")


def is_excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any segment of the path holds a pattern."""
    hit = lambda s: F.greatest(*(s.contains(p) for p in patterns)) if len(patterns) > 1 else s.contains(patterns[0])
    return F.exists(F.split(path, "/"), hit) if patterns else F.lit(False)


def read_notes(spark: SparkSession, folder: str, patterns: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """All Markdown files below a folder, with paths relative to it."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    path = F.substring_index("path", base, -1)
    return rows.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.unix_micros("modificationTime").cast("double").alias("us")).select("path", "content", (F.col("us") / 1e6).alias("mtime")).filter(~is_excluded(F.col("path"), patterns))


def list_folder(notes: DataFrame, folder: str = "") -> DataFrame:
    """Entries of a folder: its notes, and its folders with a slash at the end."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    rows = notes.filter(F.col("path").startswith(prefix)).select(rest.alias("rest"))
    entry = F.when(F.col("rest").contains("/"), F.concat(F.substring_index("rest", "/", 1), F.lit("/"))).otherwise(F.col("rest"))
    return rows.select(entry.alias("entry")).distinct().orderBy("entry")


def list_folder_deep(notes: DataFrame, folder: str) -> DataFrame:
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    return notes.filter(F.col("path").startswith(prefix)).select("path").orderBy("path")


def get_note(notes: DataFrame, path: str) -> DataFrame:
    """A note by its path; .md may be left out, '..' is refused."""
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError("path leaves the vault")
    return notes.filter(F.col("path") == (path if path.endswith(".md") else path + ".md"))


def put_notes(log: DataFrame, notes: DataFrame) -> DataFrame:
    """A log of versions (path, content, mtime) with new ones appended."""
    return log.unionByName(notes.filter(tx.is_valid_path(F.col("path"))))


def latest(log: DataFrame) -> DataFrame:
    """The last version of each note."""
    return log.groupBy("path").agg(F.max_by("content", "mtime").alias("content"), F.max("mtime").alias("mtime"))


def mentioning(notes: DataFrame, name: str) -> DataFrame:
    """Notes that hold the name, letter for letter, by path."""
    return notes.filter(F.col("content").contains(name)).select("path").orderBy("path")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Manual aliases from a JSON object {name: [alias, …]}."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("name", "aliases"))
    return pairs


def save(table: DataFrame, path: str) -> None:
    """A store as Parquet: graph, entities, relations, hashes, times or caches."""
    table.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A store, or an empty one if there is none."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except Exception as e:  # the reader's own error for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)
