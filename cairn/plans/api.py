"""The serving surface: one facade over the operators, with actions by tool and a router for plain questions.

Results are DataFrames, or small Python values where a caller needs one.
"""
from __future__ import annotations

import inspect
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import frontmatter as fm, text as tx
from cairn.operators import clustering as cl, entities as en, filters as fi, graph as gr, incremental as inc, ranking as ra, todos as td
from cairn.operators.chunking import chunk_notes
from cairn.sources import notes as sn, store as st
from cairn.sources.providers import LocalProvider

log = logging.getLogger("cairn")

#: Names under which a parameter of a capability may come.
PARAMETER_NAMES = {
    "search": {"query": ["query", "q", "search", "question"]},
    "ask": {"question": ["question", "query", "ask"]},
    "summary": {"topic": ["topic", "subject", "query", "question"]},
    "entity": {"entity_name": ["entity_name", "name", "entity", "query"]},
    "entity_timeline": {"name": ["name", "entity", "entity_name"]},
    "related_entities": {"name": ["name", "entity"]},
    "related_notes": {"path": ["path", "note", "note_path"]},
    "backlinks": {"path": ["path", "note", "note_path"]},
    "outgoing": {"path": ["path", "note", "note_path"]},
    "community_of": {"path": ["path", "note", "note_path"]},
    "subject": {"subject": ["subject", "topic", "query"]},
    "path": {"start": ["start", "from"], "end": ["end", "to"]},
}
#: Capabilities that a tool of another name serves, with its main parameter.
ROUTES = {"subject": ("read_by_subject", "subject"), "summary": ("summarize_topic", "topic"), "tags": ("suggest_tags", "query")}


@dataclass
class Vault:
    """All tables of a collection.  Those that aren't given are derived from the notes when first needed."""

    spark: SparkSession
    notes: DataFrame
    provider: LocalProvider = field(default_factory=LocalProvider)
    summaries: DataFrame | None = None
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    mentions: DataFrame | None = None
    relations: DataFrame | None = None
    timeline: DataFrame | None = None
    todos: DataFrame | None = None
    weights: ra.Weights = ra.Weights()
    today: str = "1970-01-01"
    _kept: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make().cache()
        return self._kept[name]

    def refresh(self) -> None:
        for table in self._kept.values():
            table.unpersist()
        self._kept.clear()

    @property
    def chunks(self) -> DataFrame:
        def make():
            rows = chunk_notes(self.notes.select("path", "content", *(c for c in ("mtime", "tags") if c in self.notes.columns)))
            if "tags" not in rows.columns:
                rows = rows.withColumn("tags", F.array().cast("array<string>"))
            return rows.withColumn("title", tx.title_of_path(F.col("path"))).withColumn("embedding", self.provider.embed(F.col("document")))

        return self._once("chunks", make)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: gr.build_edges(self.notes))

    @property
    def nodes(self) -> DataFrame:
        return self.notes.select("path")

    @property
    def communities(self) -> DataFrame:
        return self._once("communities", lambda: gr.communities(self.nodes, self.edges))

    def vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(self.provider.embed(F.lit(text)).alias("v")).head().v)

    def index(self) -> ra.Index:
        return ra.Index(self.chunks, self.summaries, self.entities, self.aliases, self.mentions, self.relations, self.edges, self.communities)


class Tools:
    """Tools by name; each has actions.  A failed action gives an 'Error: …' text, as a server must answer."""

    def __init__(self, vault: Vault):
        self.vault = vault

    # notes

    def search(self, query: str, n: int = 10, expand: bool = False, min_similarity: float = 0.0) -> DataFrame:
        began, v = time.time(), self.vault
        intent = v.spark.range(1).select(ra.detect_intent(F.lit(query))).head()[0]
        weights = v.weights if intent == "general" else ra.Weights(**ra.INTENT_WEIGHTS[intent])
        out = ra.ranked_search(v.index(), query, [v.vector(query)], n, weights, min_similarity=min_similarity, expand=expand)
        log.info("search %s", json.dumps({"query": query[:80], "n": n, "intent": intent, "ms": round(1000 * (time.time() - began))}))
        return out

    def read(self, path: str) -> DataFrame:
        return sn.get_note(self.vault.notes, path)

    def write(self, path: str, content: str, mtime: float = 0.0) -> tuple[list[str], DataFrame]:
        """Warnings about the frontmatter, and the notes with this one in place."""
        row = self.vault.spark.range(1).select(F.lit(path).alias("path"), F.lit(content).alias("content"), F.lit(float(mtime)).alias("mtime"))
        warnings = list(row.select(fm.validate(F.col("content"))).head()[0])
        kept = self.vault.notes.filter(F.col("path") != path)
        self.vault.notes = kept.unionByName(row.filter(tx.is_valid_path(F.col("path"))), allowMissingColumns=True)
        self.vault.refresh()
        return warnings, self.vault.notes

    def list_notes(self) -> DataFrame:
        return fi.without_subjects(self.vault.notes).select("path").orderBy("path")

    def list_folder(self, folder: str = "") -> DataFrame:
        return sn.list_folder(self.vault.notes, folder)

    def search_by_tags(self, tags: list[str], n: int = 20) -> DataFrame:
        return fi.search_by_tags(self.vault.chunks, tags, n)

    def read_by_title(self, title: str) -> DataFrame:
        return st.get_by_title(self.vault.chunks, title)

    def read_by_subject(self, subject: str, n: int = 10) -> DataFrame:
        return ra.read_by_subject(self.vault.index(), self.vault.notes, subject, [self.vault.vector(subject)], n)

    def related_notes(self, path: str, k: int = 5) -> DataFrame:
        text = sn.get_note(self.vault.notes, path).head().content
        return ra.related_notes(self.vault.index(), path if path.endswith(".md") else path + ".md", text, self.vault.vector(text[:500]), k)

    # answers

    def ask(self, question: str, k: int = 5) -> DataFrame:
        """The context that a model needs, and the provider's answer about it."""
        found = ra.retrieve(self.search(question, 2 * k), self.vault.notes, self.vault.summaries, k)
        context = found.agg(F.array_join(F.collect_list("content"), "\n\n").alias("context"), F.collect_list("path").alias("paths"))
        return context.withColumn("answer", self.vault.provider.answer(F.concat(F.lit(question + "\n\n"), "context")))

    def summarize_topic(self, topic: str, k: int = 5) -> DataFrame:
        return self.ask(f"Summary of {topic}", k)

    def suggest_tags(self, query: str, n: int = 5) -> DataFrame:
        """The most frequent tags of the notes that a query finds."""
        hits = self.search(query, n).select("path")
        return self.vault.chunks.join(hits, "path").select("path", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("notes")).orderBy(F.desc("notes"), "tag")

    # tags

    def tag(self, paths: list[str], tags: list[str], how: str = "add") -> DataFrame:
        change = {"add": fm.add_tags, "remove": fm.remove_tags, "set": fm.set_tags}[how]
        content = F.when(F.col("path").isin(paths), change(F.col("content"), tags)).otherwise(F.col("content"))
        self.vault.notes = self.vault.notes.withColumn("content", content)
        self.vault.refresh()
        return self.vault.notes.filter(F.col("path").isin(paths))

    # links and graph

    def backlinks(self, path: str) -> DataFrame:
        return gr.backlinks(self.vault.edges, path)

    def outgoing(self, path: str) -> DataFrame:
        return gr.outgoing(self.vault.edges, path)

    def broken_links(self) -> DataFrame:
        return gr.broken_links(self.vault.notes)

    def link(self, a: str, b: str) -> DataFrame:
        self.vault.notes = gr.mutual_link(self.vault.notes, a, b)
        self.vault.refresh()
        return self.vault.notes.filter(F.col("path").isin(a, b))

    def communities(self) -> DataFrame:
        return gr.community_list(self.vault.communities)

    def community_of(self, path: str) -> DataFrame:
        return gr.community_info(self.vault.communities, path)

    def orphans(self) -> DataFrame:
        return gr.orphans(self.vault.nodes, self.vault.edges)

    def path(self, start: str, end: str) -> str:
        found = gr.shortest_path(self.vault.edges, start, end)
        return " -> ".join(found) if found else "no path"

    def traverse(self, path: str, depth: int = 2) -> DataFrame:
        return gr.bfs(self.vault.edges, self.vault.nodes.filter(F.col("path") == path).select(F.col("path").alias("start")), depth)

    def graph_stats(self) -> DataFrame:
        m = gr.modularity(self.vault.communities, self.vault.edges)
        count = self.vault.communities.agg(F.countDistinct("community").alias("communities"))
        return gr.stats(self.vault.nodes, self.vault.edges).crossJoin(count).crossJoin(m)  # one row each

    def graph_export(self, form: str = "json"):
        return gr.to_dot(self.vault.nodes, self.vault.edges) if form == "dot" else gr.to_dict(self.vault.nodes, self.vault.edges)

    # entities

    def _names(self, name: str) -> DataFrame:
        return self.vault.spark.range(1).select(F.lit(name).alias("name"))

    def entity(self, entity_name: str, kind: str | None = None, n: int = 10, related: bool = False) -> DataFrame:
        """Notes of an entity; those that only hold the name follow with 0.5, those of related entities with 0.3."""
        v = self.vault
        found = en.search(v.entities, v.aliases, v.mentions, self._names(entity_name), kind, 2 * n).select("path", "confidence")
        out = found.unionByName(sn.mentioning(v.notes, entity_name).join(found, "path", "left_anti").withColumn("confidence", F.lit(0.5)))
        if related and v.relations is not None:
            near = en.search(v.entities, v.aliases, v.mentions, en.related(v.relations, self._names(entity_name), 1).select("name")).select("path")
            out = out.unionByName(near.distinct().join(out, "path", "left_anti").withColumn("confidence", F.lit(0.3)))
        return fi.without_subjects(out).orderBy(F.desc("confidence"), "path").limit(n)

    def note_entities(self, path: str) -> DataFrame:
        return en.note_entities(self.vault.entities, self.vault.mentions, path)

    def list_entities(self, kind: str | None = None, n: int = 1000) -> DataFrame:
        return en.list_entities(self.vault.entities, self.vault.mentions, kind, n)

    def entity_aliases(self, name: str) -> DataFrame:
        return en.entity_aliases(self.vault.entities, self.vault.aliases, self.vault.mentions, name)

    def entity_timeline(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return en.timeline(self.vault.timeline, name, start, end)

    def related_entities(self, name: str, depth: int = 1) -> DataFrame:
        return en.related(self.vault.relations, self._names(name), depth).orderBy("depth", F.desc("confidence"), "name")

    def add_entity(self, name: str, kind: str = "Concept") -> DataFrame:
        self.vault.entities = en.add_manual(self.vault.entities, self._names(name).withColumn("type", F.lit(kind)))
        return self.vault.entities

    def link_note(self, path: str, name: str) -> DataFrame:
        """The note's entities after it mentions one by hand, with confidence 1."""
        v = self.vault
        v.mentions = en.link_note(v.entities, v.aliases, v.mentions, path, name)
        return self.note_entities(path)

    def clear_entities(self) -> None:
        """Empties entities, aliases, mentions, relations and timeline."""
        v = self.vault
        for table in ("entities", "aliases", "mentions", "relations", "timeline"):
            setattr(v, table, None if getattr(v, table) is None else getattr(v, table).limit(0))

    def merge_entities(self, primary: str, secondary: str) -> None:
        v = self.vault
        v.entities, v.aliases, v.mentions = en.merge(v.entities, v.aliases, v.mentions, primary, secondary)

    def change_entity_type(self, name: str, kind: str) -> None:
        self.vault.entities = en.change_type(self.vault.entities, name, kind)

    def import_entities(self, incoming: DataFrame) -> DataFrame:
        v = self.vault
        found = en.match(incoming, v.entities, v.aliases, v.mentions)
        summary = en.import_summary(found)
        v.entities, v.aliases = en.resolve_import(incoming, v.entities, v.aliases, v.mentions)
        return summary

    def entity_kinds(self) -> list[str]:
        return sorted(en.ENTITY_TYPES)

    def get_weights(self) -> dict[str, float]:
        return {s: getattr(self.vault.weights, s) for s in ra.SIGNALS}

    def set_weights(self, **some: float) -> dict[str, float]:
        self.vault.weights = self.vault.weights.updated(**some)
        return self.get_weights()

    # clusters and todos

    def clusters(self, threshold: float = 0.6, min_size: int = 1) -> DataFrame:
        return cl.describe(self.vault.chunks, cl.clusters(self.vault.chunks, threshold, min_size))

    def todo_list(self, **limits) -> DataFrame:
        return td.select(self.vault.todos, self.vault.today, **limits)

    def todo_stats(self) -> DataFrame:
        return td.stats(self.vault.todos, self.vault.today)

    def todo_add(self, task: str, **more) -> DataFrame:
        self.vault.todos = td.add(self.vault.todos, task, **more)
        return self.vault.todos

    def todo_update(self, ident: str, **changes) -> DataFrame:
        self.vault.todos = td.update(self.vault.todos, ident, **changes)
        return self.vault.todos.filter(F.col("id") == ident)

    def todo_complete(self, ident: str) -> DataFrame:
        return self.todo_update(ident, status="completed")

    def todo_delete(self, ident: str) -> DataFrame:
        self.vault.todos = td.delete(self.vault.todos, ident)
        return self.vault.todos

    def todo_from_text(self, text: str) -> DataFrame:
        self.vault.todos = td.add_from_text(self.vault.todos, text, self.vault.provider.answer, self.vault.today)
        return self.vault.todos

    def todo_overdue_summary(self) -> DataFrame:
        return td.overdue_summary(self.vault.todos, self.vault.today, self.vault.provider.answer)

    def todo_ask(self, question: str) -> DataFrame:
        return td.ask(self.vault.todos, question, self.vault.today, self.vault.provider.answer)

    def todo_sync(self, lines: DataFrame) -> DataFrame:
        """The list as its file's lines (line_no, line) have it."""
        self.vault.todos = td.parse(lines)
        return self.vault.todos

    def todo_suggestions(self, task: str) -> DataFrame:
        """One row: a model's priority, due date and parts for a task, valid at any answer."""
        answer = lambda what: self.vault.provider.answer(F.lit(f"{what} of this task: {task}"))
        return self.vault.spark.range(1).select(td.valid_priority(answer("Priority")).alias("priority"), td.valid_date(answer("Due date"), self.vault.today).alias("due"), td.valid_split(answer("Parts"), F.lit(task)).alias("parts"))

    def todo_notes(self) -> DataFrame:
        return td.notes_of_todos(self.vault.todos, self.vault.notes)

    def todo_file(self) -> str:
        return td.render_file(self.vault.todos, self.vault.today).head().content

    # administration

    def health(self) -> dict:
        state = {"provider": self.vault.provider.check_health(), "notes": self.vault.notes.count(), "chunks": self.vault.chunks.count()}
        return state | {"status": "healthy" if state["notes"] and state["chunks"] and self.vault.provider.is_available() else "degraded"}

    def stats(self) -> DataFrame:
        return st.index_stats(self.vault.chunks)

    def reindex(self, folder: str = "", mentioning: str | None = None) -> DataFrame:
        """Chunks of a folder's notes, or of those that mention a name, made anew."""
        self.vault.refresh()
        rows = self.vault.chunks.filter(fi.in_folder(folder))
        return rows if mentioning is None else rows.join(sn.mentioning(self.vault.notes, mentioning), "path", "left_semi")

    def switch_model(self, provider) -> None:
        self.vault.provider = provider
        self.vault.refresh()

    def changes(self, state: DataFrame) -> DataFrame:
        return inc.changes(self.vault.notes, state)

    def dashboard(self) -> dict:
        """Everything a dashboard shows, from small aggregates."""
        rows = lambda t, n=50: [r.asDict(True) for r in t.limit(n).collect()]
        v, out = self.vault, {"stats": rows(self.stats()), "graph": rows(self.graph_stats()), "communities": rows(self.communities()), "hubs": rows(gr.hubs(self.vault.nodes, self.vault.edges))}
        if v.entities is not None:
            out["entities"] = rows(en.stats(v.entities, v.mentions))
        if v.todos is not None:
            out["todos"] = rows(self.todo_stats())
        return out

    # dispatch

    def describe(self) -> dict[str, str]:
        """All tools with their signatures."""
        return {n: str(inspect.signature(f)) for n, f in inspect.getmembers(self, inspect.ismethod) if not n.startswith("_")}

    def call(self, name: str, **params):
        """A tool by name; unset parameters are dropped, errors become text."""
        try:
            if name.startswith("_") or name not in self.describe():
                raise ValueError(f"unknown action: {name}")
            return getattr(self, name)(**{k: v for k, v in params.items() if v is not None})
        except Exception as e:
            log.warning("%s failed: %s", name, e)
            return f"Error: {e}"

    def route(self, question: str, decision: str | None = None):
        """A plain question by a model's decision; what can't be decided or fails is answered from the notes."""
        name, params = decide(question, decision)
        answer = self.call(name, **params)
        return self.ask(question) if isinstance(answer, str) and answer.startswith("Error:") else answer


def own_names(capability: str, params: dict) -> dict:
    """params under the capability's own names; of several names of one parameter the first in the table counts."""
    own = {other: name for name, others in PARAMETER_NAMES.get(capability, {}).items() for other in others}
    given = [other for other in own if other in params]
    return {k: v for k, v in params.items() if k not in own} | {own[k]: params[k] for k in reversed(given)}


def decide(question: str, decision: str | None) -> tuple[str, dict]:
    """(tool, parameters) of a model's decision: JSON, found within other text if need be."""
    text = decision or ""
    try:
        chosen = json.loads(text[text.find("{") : text.rfind("}") + 1])
    except ValueError:
        chosen = None
    if not isinstance(chosen, dict) or "capability" not in chosen:
        return "ask", {"question": question}
    params = own_names(chosen["capability"], dict(chosen.get("params") or {}))
    if chosen["capability"] in ROUTES:
        tool, main = ROUTES[chosen["capability"]]
        return tool, {main: params.get(main, question)}
    return chosen["capability"], params


def validate_config(config: dict) -> list[str]:
    """Warnings about settings that can't work."""
    out = []
    if config.get("chunk_overlap", 100) >= config.get("chunk_size", 500):
        out.append("chunk_overlap must be smaller than chunk_size")
    if config.get("chunk_size", 500) <= 0:
        out.append("chunk_size must be positive")
    for name, value in (config.get("ranking_weights") or {}).items():
        if name not in ra.SIGNALS:
            out.append(f"unknown ranking weight: {name}")
        elif value < 0:
            out.append(f"ranking weight {name} is negative")
    return out
