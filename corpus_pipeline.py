"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result to
the shared folder and rereads it for the next.

Edge cases: null or empty texts are rejected by the first stage; rows with a null
or repeated doc_id are rows of their own in every stage; other columns of the
documents, whatever their names, are kept up to the last stage; an empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.common import BROADCAST_ROWS, cut, fresh, read_table
from cairn.llm.op4_secret_scans import redact, train_forest
from cairn.llm.op6_ngram_jaccard_join import jaccard_components
from cairn.llm.op7_mixing import mix_rows
from cairn.llm.op8_quality_classifier import classify
from cairn.llm.op9_packing import pack_documents

#: Near duplicates: words of a shingle and least similarity in percent.
WORDS, PERCENT = 5, 80
#: A small source is repeated at most so often while every document is used.
REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = classify(docs, keep_columns=True)
    return judged.filter(F.col(judged.columns[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays; of repeated rows, one.

    Where some doc_id is null or repeated, rows are linked by numbers of their
    own, so each is judged by its own text: rows of one doc_id with unlike texts
    stay both, and a row without doc_id goes if it is linked to another that stays.
    """
    unclear = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not unclear:
        groups = cut(jaccard_components(docs, WORDS, PERCENT))
        return _without(docs, groups.filter("doc_id <> component_id").select("doc_id"))
    row = fresh("_row", docs.columns + ["doc_id", "n_shingles", "component_id"])
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), WORDS, PERCENT)
    groups = cut(rows.select(row, "doc_id").join(groups.withColumnRenamed("doc_id", row), row))
    # Texts without words are linked with nothing; they repeat if they have the same doc_id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row))[row].alias(row)
    linked = groups.filter("n_shingles > 0").groupBy("component_id").agg(first).select(row)
    blank = groups.filter("n_shingles = 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias(row)).select(row)
    stay = linked.union(blank).union(groups.filter("n_shingles = 0 AND doc_id IS NULL").select(row))
    return _without(rows, cut(groups.select(row).join(stay, row, "left_anti"))).select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key, the one column of gone, is in it."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, gone.columns[0], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return redact(docs, train_forest(spark)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is used; those of sources below their weight are repeated."""
    return mix_rows(docs, cover=True, repeats=REPEATS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier, the forest and the tokenizer can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
