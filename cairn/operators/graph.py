"""The graph of notes and links: edges (src, dst) and nodes (path)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import text as tx
from cairn.lineage import cut


def title_map(notes: DataFrame) -> DataFrame:
    """title -> the first path that has it."""
    return notes.groupBy(tx.normalize_title(tx.title_of_path(F.col("path"))).alias("title")).agg(F.min("path").alias("path"))


def note_links(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("src"), F.explode(tx.wiki_links(F.col("content"))).alias("target"))


def build_edges(notes: DataFrame) -> DataFrame:
    """Edges of all links that resolve to another note, each once."""
    titles = title_map(notes).withColumnRenamed("path", "dst")
    return note_links(notes).join(titles, F.col("target") == F.col("title")).filter("src <> dst").select("src", "dst").distinct()


def broken_links(notes: DataFrame) -> DataFrame:
    """(path, target) of links to no note."""
    links = note_links(notes)
    return links.join(title_map(notes), F.col("target") == F.col("title"), "left_anti").select(F.col("src").alias("path"), "target")


def resolve_links(notes: DataFrame) -> DataFrame:
    """(src, target, dst) by path or title: an exact path first, then the same folder, then the alphabet."""
    path = F.col("path")
    keys = notes.select(path, F.explode(F.array(F.struct(tx.normalize_link(path).alias("key"), F.lit(1).alias("exact")), F.struct(tx.normalize_title(tx.title_of_path(path)).alias("key"), F.lit(0).alias("exact")))).alias("k"))
    keys = keys.select(path.alias("dst"), "k.key", "k.exact").distinct()
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    rank = Window.partitionBy("src", "target").orderBy(F.desc("exact"), (folder(F.col("src")) == folder(F.col("dst"))).desc(), "dst")
    return note_links(notes).join(keys, F.col("target") == F.col("key")).withColumn("r", F.row_number().over(rank)).filter("r = 1").select("src", "target", "dst")


def backlinks(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("dst") == path).select(F.col("src").alias("path")).orderBy("path")


def outgoing(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("src") == path).select(F.col("dst").alias("path")).orderBy("path")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, undirected: bool = False) -> DataFrame:
    """(start, path, depth, trace) of all nodes within max_depth of each start (column ``start``), without itself.

    One join per level; of several traces of a level the least stays.
    """
    links = cut(both_ways(edges) if undirected else edges.select("src", "dst").distinct())
    seen = cut(starts.select("start", F.col("start").alias("path"), F.lit(0).alias("depth"), F.array("start").alias("trace")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(links, frontier.path == links.src).select("start", F.col("dst").alias("path"), F.concat("trace", F.array("dst")).alias("trace"))
        least = reached.groupBy("start", "path").agg(F.min("trace").alias("trace")).join(seen.select("start", "path"), ["start", "path"], "left_anti")
        frontier = cut(least.select("start", "path", F.lit(depth).alias("depth"), "trace"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 50, undirected: bool = False) -> list[str] | None:
    """Nodes of a shortest directed path (of several the least), or None."""
    if start == end:
        return [start]
    spark = edges.sparkSession
    links = cut(both_ways(edges) if undirected else edges.select("src", "dst").distinct())
    seen = cut(spark.sql("SELECT * FROM VALUES (:a) AS t(path)", {"a": start}).select("path", F.array("path").alias("trace")))
    frontier = seen
    for _ in range(max_depth):
        reached = frontier.join(links, frontier.path == links.src).groupBy(F.col("dst").alias("path")).agg(F.min(F.concat("trace", F.array("dst"))).alias("trace"))
        frontier = cut(reached.join(seen.select("path"), "path", "left_anti"))
        found = frontier.filter(F.col("path") == end).select("trace").head()
        if found:
            return list(found.trace)
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
    return None


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """out_degree, in_degree, and degree = out + 2 * in, as hubs are ranked."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = nodes.select("path").distinct().join(out, "path", "left").join(into, "path", "left").select("path", zero("out_degree").alias("out_degree"), zero("in_degree").alias("in_degree"))
    return d.withColumn("degree", F.col("out_degree") + 2 * F.col("in_degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, avg_degree (edges per node, 2 places), isolated."""
    d = degrees(nodes, edges)
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.round(F.sum("out_degree") / F.count("*"), 2).alias("avg_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "path").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge; entity edges are another table and don't count."""
    linked = edges.select(F.col("src").alias("path")).union(edges.select(F.col("dst").alias("path"))).distinct()
    return nodes.select("path").distinct().join(linked, "path", "left_anti").orderBy("path")


def linked_components(edges: DataFrame) -> DataFrame:
    """(path, component) of all nodes with an edge to another: the least node that links reach.

    Each round moves every linked node to its least neighbour, follows that
    move once more, and contracts the links; what is left of them shrinks by
    half at least, and minima are aggregated before they are shuffled.
    """
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    left = cut(ends.distinct())
    labels = left.select(F.col("src").alias("path"), F.col("src").alias("component")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.select("src", "dst").union(left.select("dst", "src"))
        low = cut(both.groupBy(F.col("src").alias("path")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
        jump = low.select(F.col("path").alias("component"), F.col("component").alias("further"))
        moved = cut(low.join(jump, "component").select("path", F.col("further").alias("component")))
        to = moved.select(F.col("path").alias("component"), F.col("component").alias("to"))
        labels = moved if first else cut(labels.join(to, "component", "left").select("path", F.coalesce("to", "component").alias("component")))
        one, two = (moved.select(F.col("path").alias(end), F.col("component").alias(f"{end}_label")) for end in ("src", "dst"))
        rest = left.join(one, "src").join(two, "dst").filter("src_label <> dst_label")
        left = cut(rest.select(F.least("src_label", "dst_label").alias("src"), F.greatest("src_label", "dst_label").alias("dst")).distinct())
        first = False
    return labels


def components(nodes: DataFrame, edges: DataFrame, node: str = "path") -> DataFrame:
    """(path, component): the least node that links reach; a node without links is its own."""
    every = nodes.select(F.col(node).alias("path")).distinct()
    return every.join(linked_components(edges), "path", "left").select("path", F.coalesce("component", "path").alias("component"))


def _sweep(group: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """In-place label propagation within one component; rows: path, rank, near (array of ranks).

    Nodes are numbered by rank; all neighbours stand in one flat array, each node's between two offsets.
    """
    group = group.sort_values("rank")
    ranks = group["rank"].to_numpy()
    offsets = np.concatenate(([0], np.cumsum(group["near"].map(len))))
    near = np.searchsorted(ranks, np.concatenate([np.asarray(x, np.int64) for x in group["near"]]))
    label, linked = np.arange(len(ranks)), np.flatnonzero(np.diff(offsets))
    for _ in range(rounds):
        before = label.copy()
        for i in linked:
            votes, held = np.unique(label[near[offsets[i] : offsets[i + 1]]], return_counts=True)
            label[i] = votes[held.argmax()]  # votes are sorted: of several the least
        if np.array_equal(label, before):
            break
    return pd.DataFrame({"path": group["path"], "label": ranks[label]})


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(path, community): asynchronous label propagation in path order, majority label, ties to the least.

    The sweep never passes from one connected component to another, so each
    component is swept by itself with the global ranks as first labels.
    """
    every = cut(nodes.select("path").distinct())
    ranked = cut(ranks(every, "path"))
    links = both_ways(edges).filter("src <> dst").join(ranked.select(F.col("path").alias("dst"), F.col("rank").alias("near")), "dst")
    near = links.groupBy(F.col("src").alias("path")).agg(F.collect_list("near").alias("near"))
    rows = ranked.join(near, "path", "left").join(components(every, edges), "path")
    rows = rows.select("path", "rank", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"), "component")
    labels = cut(rows.groupBy("component").applyInPandas(lambda g: _sweep(g, rounds), "path string, label long"))
    numbers = ranks(labels.select(F.col("label").cast("string").alias("key"), "label").distinct(), "label")
    return labels.join(numbers.select("label", F.col("rank").alias("community")), "label").select("path", F.col("community").cast("int").alias("community"))


def ranks(table: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``table`` with its rows' rank (from 0) by the column, by ranges and offsets instead of one sorted task."""
    ordered = cut(table.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # parts rows at most
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    placed = ordered.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.withColumn("rank", F.col("before") + (F.col("at") - F.shiftleft(F.col("part").cast("long"), 33))).drop("part", "before", "at")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, modularity: directed counts are halved downwards, as communities are counted without direction."""
    half = lambda c: F.floor(c / 2)
    deg = edges.select(F.explode(F.array("src", "dst")).alias("path")).groupBy("path").agg(half(F.count("*")).alias("d"))
    by = labels.join(deg, "path", "left").groupBy("community").agg(F.sum(F.coalesce("d", F.lit(0))).alias("d"))
    a, b = labels.select(F.col("path").alias("src"), F.col("community").alias("ca")), labels.select(F.col("path").alias("dst"), F.col("community").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(half(F.count("*")).alias("l"))
    m = edges.agg(half(F.count("*")).alias("m"))
    parts = by.join(inner, "community", "left").crossJoin(F.broadcast(m))  # one row
    q = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return parts.agg(F.round(F.coalesce(F.sum(F.when(F.col("m") > 0, q)), F.lit(0.0)), 4).alias("modularity"))


def community_neighbors(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, path): other members of each seed's community."""
    own = labels.join(seeds.select(F.col("path")).distinct(), "path").select(F.col("path").alias("seed"), "community")
    return own.join(labels, "community").filter("path <> seed").select("seed", "path")


def community_info(labels: DataFrame, path: str, top_k: int = 5) -> DataFrame:
    """Number, size and first members of the community of a note."""
    own = labels.filter(F.col("path") == path).select("community")
    rows = labels.join(F.broadcast(own), "community")  # one row
    first = rows.orderBy("path").limit(top_k).agg(F.array_sort(F.collect_list("path")).alias("members"))
    return rows.groupBy("community").agg(F.count("*").alias("size")).crossJoin(F.broadcast(first))


def community_list(labels: DataFrame, members: int = 50) -> DataFrame:
    rank = Window.partitionBy("community").orderBy("path")
    size = labels.groupBy("community").agg(F.count("*").alias("size"))
    first = labels.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= members).groupBy("community").agg(F.array_sort(F.collect_list("path")).alias("members"))
    return first.join(size, "community").select("community", "size", "members")


def rename_node(edges: DataFrame, old: str, new: str) -> DataFrame:
    to = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return edges.select(to("src"), to("dst")).distinct()


def remove_node(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter((F.col("src") != path) & (F.col("dst") != path))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.select("src", "dst")).filter("src <> dst").distinct()


def mutual_link(notes: DataFrame, a: str, b: str) -> DataFrame:
    """Notes a and b with a link to the other appended where it's missing."""
    def linked(content: Column, other: str) -> Column:
        title = other.rsplit("/", 1)[-1].removesuffix(".md")
        return F.when(content.contains(f"[[{title}]]"), content).otherwise(F.concat(content, F.lit(f"\n\n[[{title}]]")))

    content = F.when(F.col("path") == a, linked(F.col("content"), b)).when(F.col("path") == b, linked(F.col("content"), a)).otherwise(F.col("content"))
    return notes.withColumn("content", content)


def entity_nodes(entity_edges: DataFrame) -> DataFrame:
    """Entities of the graph with their notes."""
    return entity_edges.groupBy("entity_type", "entity_name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph in DOT; an export of a graph that is small enough to be drawn."""
    quote = lambda s: '"' + s.replace('"', '\\"') + '"'
    lines = [f"  {quote(r.path)};" for r in nodes.select("path").distinct().orderBy("path").toLocalIterator()]
    lines += [f"  {quote(r.src)} -> {quote(r.dst)};" for r in edges.orderBy("src", "dst").toLocalIterator()]
    return "\n".join(["digraph notes {", *lines, "}"])


def to_dict(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, links): sorted targets of each node, the JSON export's rows."""
    links = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    return nodes.select("path").distinct().join(links, "path", "left").select("path", F.coalesce("links", F.array().cast("array<string>")).alias("links")).orderBy("path")


def from_dict(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows (path, links)."""
    return table.select("path").distinct(), table.select(F.col("path").alias("src"), F.explode("links").alias("dst")).distinct()
