"""Hybrid and ranked search.  Signals are rows (path, signal, score, title, snippet_text, chunk); a ranking is one aggregate over them."""
from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import vectors as vx
from cairn.functions.text import tokenize, truncate_snippet, truncate_to_budget
from cairn.lineage import cut
from cairn.operators import entities as en, graph as gr, keyword as kw, vector as ve

SIGNALS = ("semantic", "entity", "graph", "keyword")

#: Weights of the signals by intent.
INTENT_WEIGHTS = {
    "entity": {"semantic": 0.25, "entity": 0.55, "graph": 0.15, "keyword": 0.05},
    "keyword": {"semantic": 0.20, "entity": 0.10, "graph": 0.10, "keyword": 0.60},
    "graph": {"semantic": 0.20, "entity": 0.20, "graph": 0.50, "keyword": 0.10},
    "general": {"semantic": 0.40, "entity": 0.30, "graph": 0.20, "keyword": 0.10},
}
#: Patterns of the intents, in the order in which they are tried; the last two apply to at most five words.
INTENT_PATTERNS = {
    "graph": (r"how does\s+.+\s+relate\s+", r"connection between", r"related to", r"relationship between", r"path (from|between)", r"\blink(s|ed|ing)?\s+(to|between|among)"),
    "keyword": (r"how do (i|you|we)\s+", r"^how to\s+", r"\.\w+", r"\b(config|setup|install|deploy|migrate|build|compile)\b"),
    "entity": (r"^who is\s+", r"^tell me about\s+", r"^what is\s+"),
}


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.40
    entity: float = 0.30
    graph: float = 0.20
    keyword: float = 0.10

    def normalised(self) -> dict[str, float]:
        """Positive weights by their sum; all zero means semantic only."""
        kept = {s: getattr(self, s) for s in SIGNALS if getattr(self, s) > 0}
        total = sum(kept.values())
        return {s: v / total for s, v in kept.items()} if total else {"semantic": 1.0}

    def updated(self, **some: float) -> "Weights":
        return replace(self, **{k: float(v) for k, v in some.items() if k in SIGNALS and v is not None})


def detect_intent(query: Column, known_keys: Column | None = None) -> Column:
    """Intent of a query column; known_keys: array of entity keys and aliases found among its n-grams, if any."""
    q = F.trim(query)
    w = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    any_of = lambda kind: F.coalesce(q.rlike("(?i)" + "|".join(f"(?:{p})" for p in INTENT_PATTERNS[kind])), F.lit(False))
    out = F.when(q == "", "general")
    if known_keys is not None:
        bigrams = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.lower(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))).otherwise(F.array().cast("array<string>"))
        out = out.when(F.arrays_overlap(F.concat(F.array(F.lower(q)), bigrams), known_keys), "entity")
    return out.when(any_of("graph"), "graph").when(any_of("keyword"), "keyword").when((F.size(w) <= 5) & any_of("entity"), "entity").otherwise("general")


def query_probes(query: str) -> list[str]:
    """Names a query may hold: itself, its longer words, its word pairs."""
    w = [x for x in (x.strip(".,!?;:'\"()") for x in query.split())]
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    return list(dict.fromkeys([query.strip(), *(x for x in w if len(x) > 2), *(p for p in pairs if len(p) > 3)]))


def names_table(like: DataFrame, names: list[str]) -> DataFrame:
    return like.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, names or [""])).cast("array<string>")).alias("ordinal", "name")).filter("name <> ''")


def detect_entities(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, query: str, n: int = 10) -> DataFrame:
    """(path, key, canonical, confidence): notes of entities that the query names; a note by the first probe that finds it."""
    probes = names_table(entities, query_probes(query))
    found = en.search(entities, aliases, mentions, probes.select("name"), n=n).join(probes, "name")
    first = Window.partitionBy("path").orderBy("ordinal", F.desc("confidence"))
    return found.withColumn("r", F.row_number().over(first)).filter("r = 1").select("path", en.entity_key(F.col("canonical")).alias("key"), "canonical", "confidence", "context")


def expand_entities(relations: DataFrame, detected: DataFrame) -> DataFrame:
    """Names one relation away from the detected entities, less those."""
    near = en.related(relations, detected.select(F.col("canonical").alias("name")).distinct(), 1)
    return near.select("name").distinct().join(detected.select(F.col("key").alias("name")).distinct(), "name", "left_anti")


def _signal(rows: DataFrame, signal: str, score: Column, title: Column | None = None, text: Column | None = None, chunk: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("path", F.lit(signal).alias("signal"), score.cast("double").alias("score"), (none if title is None else title).alias("title"), (none if text is None else text).alias("text"), (F.lit(0) if chunk is None else chunk).cast("int").alias("chunk"))


@dataclass
class Index:
    """Tables that ranked search reads."""

    chunks: DataFrame  # chunk_id, path, title, chunk, document, tags, embedding
    summaries: DataFrame | None = None
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    mentions: DataFrame | None = None
    relations: DataFrame | None = None
    edges: DataFrame | None = None
    communities: DataFrame | None = None


def hybrid_search(chunks: DataFrame, query: str, vectors: list[list[float]], n: int = 10, keyword_weight: float = 0.3, min_similarity: float = 0.0, diversity: float = 0.0, where: Column | None = None, keyword_text: Column | None = None) -> DataFrame:
    """Passages by the best similarity over the query vectors, blended with BM25.

    Each vector brings n + 10 passages, BM25 n + 15 scaled to 0..1; a penalty
    for diversity leaves the best passage of each note.
    """
    keys = ["path", "chunk"]
    near = None
    for v in vectors:
        hits = ve.nearest(chunks, v, n + 10, "chunk_id", where).select(*keys, "title", "document", F.round(vx.similarity(F.col("distance")), 4).alias("sem"))
        near = hits if near is None else near.union(hits)
    semantic = near.groupBy(*keys).agg(F.max("sem").alias("sem"), F.first("title").alias("title"), F.first("document").alias("document"))
    text = keyword_text if keyword_text is not None else F.concat(F.col("title"), F.lit(": "), F.col("document"))
    best = kw.normalise(kw.search(chunks if where is None else chunks.filter(where), query, n + 15, "chunk_id", text))
    words = chunks.join(F.broadcast(best.withColumnRenamed("id", "chunk_id")), "chunk_id").select(*keys, F.col("title").alias("t2"), F.col("document").alias("d2"), F.col("score").alias("bm25"))
    both = semantic.join(words, keys, "full_outer").withColumn("similarity_score", F.round(F.coalesce("sem", F.lit(0.0)) * (1 - keyword_weight) + F.coalesce("bm25", F.lit(0.0)) * keyword_weight, 4))
    rows = both.select(*keys, F.coalesce("title", "t2").alias("title"), "similarity_score", truncate_snippet(F.coalesce("document", "d2")).alias("snippet")).filter(F.col("similarity_score") >= min_similarity)
    if diversity > 0:
        rows = best_per_note(rows)
    return rows.select("path", "title", F.col("chunk").alias("matched_chunk_idx"), "similarity_score", "snippet").orderBy(F.desc("similarity_score"), "path", "matched_chunk_idx").limit(n)


def best_per_note(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("path").orderBy(F.desc("similarity_score"), "chunk")
    return rows.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def group_by_note(passages: DataFrame, n: int) -> DataFrame:
    """Notes by their best passage, with the number of passages."""
    top = F.max_by(F.struct("title", "snippet"), F.struct("similarity_score", -F.col("matched_chunk_idx")))
    rows = passages.groupBy("path").agg(F.max("similarity_score").alias("similarity_score"), top.alias("t"), F.count("*").alias("chunk_count"))
    return rows.select("path", "t.title", "similarity_score", "t.snippet", "chunk_count").orderBy(F.desc("similarity_score"), "path").limit(n)


def signal_rows(index: Index, query: str, vectors: list[list[float]], n: int, weights: Weights, summary_threshold: float = 0.7, exclude: Column | None = None, entity_names: list[str] | None = None, expand: bool = False) -> DataFrame:
    """All rows of the summary, semantic, keyword and entity signals, weighted."""
    w = weights.normalised()
    parts = []
    if index.summaries is not None and w.get("semantic"):
        found = ve.summary_search(index.summaries, vectors[0], n).filter(F.col("similarity") >= summary_threshold)
        parts.append(_signal(found, "summary", F.col("similarity") * w["semantic"], F.col("title"), F.col("summary")))
    if w.get("semantic"):
        for v in vectors:
            hits = ve.nearest(index.chunks, v, 3 * n, "chunk_id", exclude)
            parts.append(_signal(hits, "semantic", vx.similarity(F.col("distance")) * w["semantic"], F.col("title"), F.col("document"), F.col("chunk")))
    if w.get("keyword"):
        text = F.concat(F.col("title"), F.lit(": "), F.col("document"))
        best = kw.normalise(kw.search(index.chunks if exclude is None else index.chunks.filter(exclude), query, 3 * n, "chunk_id", text)).withColumnRenamed("id", "chunk_id")
        hits = index.chunks.join(F.broadcast(best), "chunk_id")
        parts.append(_signal(hits, "keyword", F.col("score") * w["keyword"], F.col("title"), F.col("document"), F.col("chunk")))
    if index.entities is not None and w.get("entity"):
        found = detect_entities(index.entities, index.aliases, index.mentions, query)
        if expand:
            found = cut(found)
        rows = found.select("path", "confidence", "context")
        names = None
        if entity_names:
            names = names_table(index.entities, entity_names).select("name")
        if expand and index.relations is not None:
            more = expand_entities(index.relations, found)
            names = more if names is None else names.union(more)
        if names is not None:
            rows = rows.union(en.search(index.entities, index.aliases, index.mentions, names).select("path", "confidence", "context"))
        parts.append(_signal(rows, "entity", F.col("confidence") * w["entity"], text=F.col("context")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def community_boost(rows: DataFrame, communities: DataFrame, weights: Weights, boost: float = 0.5, top: int = 3) -> DataFrame:
    """A constant for every scored note in a community of the best semantic notes."""
    leaders = rows.filter("signal = 'semantic'").groupBy("path").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "path").limit(top)
    chosen = leaders.join(communities, "path").select("community").distinct()
    scored = rows.select("path").distinct().join(communities, "path").join(F.broadcast(chosen), "community", "left_semi")  # top rows at most
    return _signal(scored, "community", F.lit(weights.normalised().get("graph", 0.2) * boost))


def graph_signal(rows: DataFrame, edges: DataFrame, weights: Weights, depth: int) -> DataFrame:
    """Notes that links from scored notes reach and no other signal found: the weight over the depth."""
    scored = rows.select("path").distinct()
    reached = gr.bfs(edges, scored.select(F.col("path").alias("start")), depth).groupBy("path").agg(F.min("depth").alias("depth"))
    return _signal(reached.join(scored, "path", "left_anti"), "graph", weights.normalised().get("graph", 0.0) / F.col("depth"))


def blend(rows: DataFrame, n: int, min_similarity: float = 0.0) -> DataFrame:
    """Sum of all signals; of the best 2n those at the threshold, n at most; the snippet is the longest text."""
    longest = F.max_by(F.struct("title", "text"), F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("chunk")))
    total = rows.groupBy("path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("signal")).alias("matched_by"), longest.alias("t"))
    best = total.orderBy(F.desc("score"), "path").limit(2 * n).filter(F.col("score") >= min_similarity)
    return best.select("path", "t.title", F.round("score", 4).alias("similarity_score"), "matched_by", truncate_snippet(F.coalesce("t.text", F.lit(""))).alias("snippet")).orderBy(F.desc("similarity_score"), "path").limit(n)


def ranked_search(index: Index, query: str, vectors: list[list[float]], n: int = 10, weights: Weights = Weights(), depth: int = 1, min_similarity: float = 0.0, summary_threshold: float = 0.7, exclude: Column | None = None, entity_names: list[str] | None = None, expand: bool = False, boost: float = 0.5) -> DataFrame:
    """The ranker: summary, semantic, keyword and entity signals, community boost, graph neighbours, blended."""
    # A few rows for each signal, read by the boost, the links and the blend: the searches behind them run once.
    rows = cut(signal_rows(index, query, vectors, n, weights, summary_threshold, exclude, entity_names, expand))
    extra = []
    if index.communities is not None and boost > 0:
        extra.append(community_boost(rows, index.communities, weights, boost))
    if index.edges is not None and depth > 0 and weights.normalised().get("graph"):
        extra.append(graph_signal(rows, index.edges, weights, depth))
    for e in extra:
        rows = rows.unionByName(e)
    return blend(rows, n, min_similarity)


def composite_search(index: Index, query: str, vector: list[float], n: int = 10, depth: int = 3, min_similarity: float = 0.0) -> DataFrame:
    """Depth 1: summaries; 2: and entities with their relations; 3: and members of the found notes' communities."""
    near = ve.summary_search(index.summaries, vector, 3 * n)
    rows = _signal(near, "summary", F.col("similarity"), F.col("title"), F.col("summary"))
    if depth >= 2 and index.entities is not None:
        found = cut(detect_entities(index.entities, index.aliases, index.mentions, query))
        rows = rows.unionByName(_signal(found, "entity", F.col("confidence"), text=F.col("context")))
        if index.relations is not None:
            more = en.search(index.entities, index.aliases, index.mentions, expand_entities(index.relations, found))
            rows = rows.unionByName(_signal(more, "relation", 0.8 * F.col("confidence"), text=F.col("context")))
    if depth >= 3 and index.communities is not None:
        rows = cut(rows)
        seeds = rows.groupBy("path").agg(F.sum("score").alias("seed_score"))
        near = gr.community_neighbors(index.communities, seeds).join(seeds.select(F.col("path").alias("seed"), "seed_score"), "seed").join(seeds.select("path"), "path", "left_anti")
        first = near.groupBy("path").agg(F.max("seed_score").alias("seed_score"))
        rows = rows.unionByName(_signal(first, "community", 0.6 * F.col("seed_score")))
    total = rows.groupBy("path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("signal")).alias("matched_by"), F.first("title", True).alias("title"), F.max_by("text", F.length("text")).alias("text"))
    return total.filter(F.col("score") >= min_similarity).select("path", "title", F.round("score", 4).alias("similarity_score"), "matched_by", truncate_snippet(F.coalesce("text", F.lit(""))).alias("snippet")).orderBy(F.desc("similarity_score"), "path").limit(n)


def apply_entity_search(results: DataFrame, found: DataFrame) -> DataFrame:
    """The higher of a result's score and 0.9 times the confidence of an entity's note."""
    e = found.groupBy("path").agg(F.round(F.max("confidence") * 0.9, 4).alias("e_score"), F.max_by("context", "confidence").alias("context"))
    return results.join(e, "path", "full_outer").select("path", "title", F.greatest(F.coalesce("similarity_score", F.lit(0.0)), F.coalesce("e_score", F.lit(0.0))).alias("similarity_score"), F.coalesce("snippet", "context").alias("snippet"), F.col("e_score").isNotNull().alias("is_entity_match"))


def apply_graph_boost(results: DataFrame, edges: DataFrame, notes: DataFrame, depth: int = 1, weight: float = 0.2) -> DataFrame:
    """Neighbours of results that aren't results, at weight over depth, with the start of their text."""
    reached = gr.bfs(edges, results.select(F.col("path").alias("start")).distinct(), depth).groupBy("path").agg(F.min("depth").alias("depth"))
    new = reached.join(results.select("path"), "path", "left_anti").join(notes, "path")
    rows = new.select("path", F.round(weight / F.col("depth"), 4).alias("similarity_score"), truncate_snippet(F.substring("content", 1, 500)).alias("snippet"), F.lit(True).alias("is_graph_connected"))
    return results.unionByName(rows, allowMissingColumns=True)


def apply_summary_search(results: DataFrame, summaries: DataFrame, vector: list[float], n: int, threshold: float = 0.7) -> DataFrame:
    found = ve.summary_search(summaries, vector, n).filter(F.col("similarity") >= threshold).select("path", F.col("title").alias("s_title"), F.col("summary"), F.col("similarity"))
    rows = results.join(found, "path", "full_outer")
    kept = [c for c in results.columns if c not in ("path", "title", "similarity_score", "snippet")]
    return rows.select("path", F.coalesce("title", "s_title").alias("title"), F.greatest(F.coalesce("similarity_score", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))).alias("similarity_score"), F.coalesce("snippet", truncate_snippet(F.col("summary"))).alias("snippet"), *kept, F.col("similarity").isNotNull().alias("is_summary_match"))


def read_by_subject(index: Index, notes: DataFrame, query: str, vectors: list[list[float]], n: int = 10) -> DataFrame:
    """A subject's notes: hybrid search over expanded queries, then entities, links and summaries, grouped by note."""
    hits = hybrid_search(index.chunks, query, vectors, 2 * n).select("path", "title", "similarity_score", "snippet")
    if index.entities is not None:
        hits = apply_entity_search(hits, detect_entities(index.entities, index.aliases, index.mentions, query))
    if index.edges is not None:
        hits = apply_graph_boost(hits, index.edges, notes)
    if index.summaries is not None:
        hits = apply_summary_search(hits, index.summaries, vectors[0], n)
    return group_by_note(hits.withColumn("matched_chunk_idx", F.lit(0)), n)


def related_notes(index: Index, path: str, text: str, vector: list[float], k: int = 5, graph_weight: float = 0.3) -> DataFrame:
    """Notes like a note (its first 500 characters) or linked with it in either direction."""
    hits = hybrid_search(index.chunks, text[:500], [vector], 2 * k).filter(F.col("path") != path)
    best = hits.groupBy("path").agg(F.max("similarity_score").alias("sem"), F.first("title").alias("title"))
    near = gr.both_ways(index.edges).filter(F.col("src") == path).select(F.col("dst").alias("path"), F.lit(graph_weight).alias("linked"))
    rows = best.join(near, "path", "full_outer")
    score = F.coalesce(F.col("sem") * (1 - graph_weight), F.lit(0.0)) + F.coalesce("linked", F.lit(0.0))
    return rows.select("path", "title", F.round(score, 4).alias("similarity_score"), F.col("linked").isNotNull().alias("is_graph_connected")).orderBy(F.desc("similarity_score"), "path").limit(k)


def retrieve(ranked: DataFrame, notes: DataFrame, summaries: DataFrame | None, k: int) -> DataFrame:
    """Ranked notes with their text within the word budget and their summary: a model's context."""
    rows = ranked.orderBy(F.desc("similarity_score"), "path").limit(k).join(notes.select("path", "content"), "path")
    if summaries is not None:
        rows = rows.join(summaries.select("path", "summary"), "path", "left")
    return rows.withColumn("content", truncate_to_budget(F.col("content"))).orderBy(F.desc("similarity_score"), "path")


def expand_query(answer: str, query: str, most: int = 5) -> list[str]:
    """A model's phrases, one a line: the query first, then at most ``most`` others of more than three characters."""
    found = [re.sub(r"^[\s\-*\d.)]+", "", line).strip() for line in answer.splitlines()]
    others = list(dict.fromkeys(p for p in found if len(p) > 3 and p.lower() != query.lower()))
    return [query, *others[:most]]
