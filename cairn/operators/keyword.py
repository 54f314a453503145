"""BM25 (Okapi) over documents (id, document)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.text import tokenize
from cairn.lineage import cut

K1, B, FLOOR = 1.5, 0.75, 0.25


def index(docs: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """(id, tokens, length) of documents that aren't null."""
    text = F.col("document") if text is None else text
    tokens = docs.filter(text.isNotNull()).select(F.col(id_col).alias("id"), tokenize(text).alias("tokens"))
    return tokens.withColumn("length", F.size("tokens"))


def document_frequencies(indexed: DataFrame) -> DataFrame:
    """(term, df, length): documents with each term; the row without a term has the number of documents and of their tokens.

    One pass over the tokens, written as a table as large as the vocabulary; a
    task counts the documents of its terms before anything is shuffled.
    """
    whole = F.array(F.lit(None).cast("string"))
    marked = indexed.select("length", F.explode(F.concat(whole, F.array_distinct("tokens"))).alias("term"))
    return cut(marked.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("length")))


def term_weights(indexed: DataFrame) -> DataFrame:
    """idf of every term; a negative one becomes FLOOR times the mean over the vocabulary."""
    return _idf(document_frequencies(indexed))


def _idf(counts: DataFrame) -> DataFrame:
    n = counts.filter("term IS NULL").select(F.col("df").alias("n"))
    df = counts.filter("term IS NOT NULL").crossJoin(F.broadcast(n))  # one row
    raw = df.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def scores(indexed: DataFrame, query: str) -> DataFrame:
    """(id, score) of all documents; a repeated query term counts each time, a document without any scores 0.

    The query's terms become one expression over a document's own tokens, so
    no posting leaves its row.
    """
    spark, counts = indexed.sparkSession, document_frequencies(indexed)
    terms = spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    mean = counts.filter("term IS NULL").select((F.col("length") / F.col("df")).alias("mean_length"))
    asked = _idf(counts).join(F.broadcast(terms), "term").crossJoin(F.broadcast(mean)).orderBy("term").collect()  # the query's terms
    if not asked:
        return indexed.select("id", F.lit(0.0).alias("score"))
    terms, mean_length = [r.term for r in asked], asked[0].mean_length

    def of_hits(hits: Column, length: Column) -> Column:
        score = F.lit(0.0)
        for r in asked:
            tf = F.size(F.filter(hits, _equals(r.term)))
            score = score + r.times * r.idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        return F.when(F.size(hits) > 0, score).otherwise(0.0)

    # Arrays of one bind the tokens and the hits, so that a text is cut into tokens once.
    hits = lambda w: F.array(F.filter(w, lambda t: t.isin(terms)))
    return indexed.select("id", F.transform(F.array("tokens"), lambda w: F.transform(hits(w), lambda h: of_hits(h, F.size(w)))[0])[0].alias("score"))


def _equals(term: str):
    return lambda t: t == term


def search(docs: DataFrame, query: str, n: int = 20, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """The n best documents, ties by id; documents with score 0 fill up."""
    return scores(index(docs, id_col, text), query).orderBy(F.desc("score"), "id").limit(n)


def normalise(found: DataFrame, column: str = "score") -> DataFrame:
    """Scores of a result list scaled to 0..1; all 1 if they are equal."""
    everything = Window.partitionBy()
    low, high = F.min(column).over(everything), F.max(column).over(everything)
    return found.withColumn(column, F.when(high == low, F.lit(1.0)).otherwise((F.col(column) - low) / (high - low)))


def is_stale(indexed: DataFrame, docs: DataFrame) -> bool:
    """Whether the number of documents has changed since the index was built."""
    return indexed.count() != docs.filter("document IS NOT NULL").count()
