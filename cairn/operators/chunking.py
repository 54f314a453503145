"""Notes to chunks: plain and heading-aware windows of words, and the delta between two states of the index."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text as tx

SIZE, OVERLAP, LEAST_WORDS = 500, 100, 20


def chunk_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks: windows of ``size`` words that begin each ``size - overlap`` words; none without words."""
    return F.transform(F.array(tx.words(text)), lambda held: _windows(held, size, overlap))[0]


def _windows(words: Column, size: int, overlap: int) -> Column:
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def heading_sections(text: Column) -> Column:
    """Array of (heading, body): text under each heading, with the path of headings above it ('# A > ## B').

    One fold over the headings carries the open ones; a heading closes all of
    its own level or deeper.  What stands before the first has the path ''.
    """
    marked = F.regexp_replace(text, r"(?md)^(#{1,6})\s+(.+)$", "\u0001$1 $2\u0002")
    # An array of one binds the parts, so that a text is searched for headings once.
    return F.transform(F.array(F.split(marked, "\u0001")), _sections)[0]


def _sections(parts: Column) -> Column:
    sections = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("heading"), F.substring_index(p, "\u0002", -1).alias("body")))
    kind = "struct<open: array<struct<level: int, heading: string>>, out: array<struct<heading: string, body: string>>>"
    start = F.from_json(F.lit('{"open": [], "out": []}'), kind)

    def step(state: Column, s: Column) -> Column:
        level = F.length(F.substring_index(s["heading"], " ", 1)).cast("int")
        heading = F.trim(s["heading"])
        opened = F.concat(F.filter(state["open"], lambda o: o["level"] < level), F.array(F.struct(level.alias("level"), heading.alias("heading"))))
        return F.struct(opened.alias("open"), F.concat(state["out"], F.array(F.struct(F.array_join(F.transform(opened, lambda o: o["heading"]), " > ").alias("heading"), _strip(s["body"]).alias("body")))).alias("out"))

    under = F.aggregate(sections, start.cast(kind), lambda a, s: step(a, s).cast(kind), lambda a: a["out"])
    before = F.filter(F.array(F.struct(F.lit("").alias("heading"), _strip(F.get(parts, F.lit(0))).alias("body"))), lambda s: s["body"] != "")
    return F.concat(before, under)


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(tx.BLANKS))


def chunk_sections(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (heading, document): short sections as they are, long ones in windows; each below its heading path."""
    def pieces(s: Column) -> Column:
        # The words are split once for each section: an array of one is bound by transform.
        cut = F.transform(F.array(tx.words(s["body"])), lambda w: F.when(F.size(w) <= size, F.array(s["body"])).otherwise(_windows(w, size, overlap)))[0]
        return F.transform(cut, lambda b: F.struct(s["heading"].alias("heading"), F.when(s["heading"] == "", b).otherwise(F.concat(s["heading"], F.lit("\n\n"), b)).alias("document")))

    return F.flatten(F.transform(F.filter(heading_sections(text), lambda s: s["body"] != ""), pieces))


def chunk_notes(notes: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least_words: int = LEAST_WORDS) -> DataFrame:
    """Chunks of all notes (path, content, other columns kept) that have enough words."""
    clean = notes.withColumn("clean", tx.sanitize(F.col("content"))).filter(tx.word_count(F.col("clean")) >= least_words)
    out = clean.select(*notes.columns, F.posexplode(chunk_sections(F.col("clean"), size, overlap)).alias("chunk", "c"))
    document = F.col("c.document")
    return out.drop("content").select(
        F.concat(F.col("path"), F.lit("::chunk_"), F.col("chunk")).alias("chunk_id"), *(c for c in notes.columns if c != "content"), "chunk",
        F.col("c.heading").alias("heading"), tx.word_count(document).alias("word_count"), document.alias("document"), tx.content_hash(document).alias("content_hash"),
    )


def chunk_delta(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks to embed, stale chunks) by path and content hash."""
    keys = ["path", "content_hash"]
    return new.join(old.select(keys).distinct(), keys, "left_anti"), old.join(new.select(keys).distinct(), keys, "left_anti")


def apply_delta(new: DataFrame, old: DataFrame, carried: list[str]) -> DataFrame:
    """The new state: chunks of ``new`` with the carried columns (embeddings, summaries) of equal old chunks."""
    keys = ["path", "content_hash"]
    had = old.select(*keys, *carried).dropDuplicates(keys)
    return new.join(had, keys, "left")


def delete_paths(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A derived table without the rows of deleted notes."""
    return table.join(gone.select("path").distinct(), "path", "left_anti")


def run_status(notes: DataFrame, state: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Notes of a run by status: indexed, unchanged, skipped (too short), failed (null content)."""
    known = state.select("path", F.col("content_hash").alias("old_hash"))
    status = (
        F.when(F.col("content").isNull(), "failed").when(F.col("old_hash") == tx.content_hash(F.col("content")), "unchanged")
        .when(tx.word_count(tx.sanitize(F.col("content"))) < least_words, "skipped").otherwise("indexed")
    )
    return notes.join(known, "path", "left").groupBy(status.alias("status")).agg(F.count("*").alias("notes"))
