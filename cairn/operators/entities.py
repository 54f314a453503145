"""Entities (key, canonical, type), their aliases, mentions, timeline and relations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.fuzzy import fuzzy_ratio, may_reach
from cairn.lineage import BROADCAST_ROWS, cut
from cairn.schema import BROADER, ENTITY_TYPES, RELATION_TYPES

FUZZY = 0.85


def entity_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def valid_type(kind: Column) -> Column:
    return F.when(kind.isin(*ENTITY_TYPES), kind).otherwise(F.lit("Concept"))


def is_broader(current: Column, new: Column) -> Column:
    """Whether ``new`` is above ``current`` in the hierarchy of types."""
    pairs = []
    for kind in BROADER:
        up = BROADER.get(kind)
        while up:
            pairs.append((kind, up))
            up = BROADER.get(up)
    out = F.lit(False)
    for low, high in pairs:
        out = out | ((current == low) & (new == high))
    return out


def add_mentions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, mentions) of incoming rows (seq, name, type, confidence, path, chunk_idx, context, aliases).

    Per entity, path and chunk the most confident mention stays.  The type is
    folded in order of seq: a new one replaces the old unless it is broader.
    """
    rows = rows.withColumn("key", entity_key(F.col("name"))).withColumn("type", valid_type(F.col("type")))
    best = F.max_by(F.substring("context", 1, 200), F.struct("confidence", -F.col("seq")))
    mentions = rows.groupBy("key", "path", "chunk_idx").agg(F.round(F.max("confidence"), 4).alias("confidence"), best.alias("context"))
    # Of a type only its last occurrence matters to the fold: what an earlier one did is the same after the last.
    # So rows are counted down within their tasks, and no key's rows are sorted.
    parts = rows.groupBy("key", "name", "type").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    kinds = parts.groupBy("key", "type").agg(F.min_by("name", "first").alias("name"), F.min("first").alias("first"), F.max("last").alias("last"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("last", "type"))), lambda s: s["type"])
    folded = F.aggregate(F.slice(types, 2, 1 << 30), F.get(types, F.lit(0)), lambda a, t: F.when(is_broader(a, t), a).otherwise(t))
    entities = kinds.groupBy("key").agg(F.min_by("name", "first").alias("canonical"), folded.alias("type"))
    aliases = rows.select("key", "aliases").distinct().select("key", F.explode("aliases").alias("alias")).distinct().filter(entity_key(F.col("alias")) != F.col("key"))
    return entities, aliases.select(entity_key(F.col("alias")).alias("alias_key"), "key", "alias"), mentions


def alias_map(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias_key -> key; of several entities with an alias, the last by key; an entity's own key isn't an alias."""
    return aliases.filter("alias_key <> key").groupBy("alias_key").agg(F.max("key").alias("key"))


def resolve_names(entities: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with the key of the entity: its own key first, else an alias; null if unknown."""
    asked = names.withColumn("asked", entity_key(F.col("name")))
    own = entities.select(F.col("key").alias("own"))
    return asked.join(own, F.col("asked") == F.col("own"), "left").join(alias_map(entities, aliases), F.col("asked") == F.col("alias_key"), "left").select("name", F.coalesce("own", "key").alias("key"))


def search(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, names: DataFrame, kind: str | None = None, n: int = 10) -> DataFrame:
    """(name, path, confidence, context): each name's notes by confidence, the best mention of a note."""
    found = resolve_names(entities, aliases, names).join(entities, "key")
    if kind:
        found = found.filter(F.col("type") == kind)
    per_note = Window.partitionBy("name", "path").orderBy(F.desc("confidence"), "chunk_idx")
    per_name = Window.partitionBy("name").orderBy(F.desc("confidence"), "path")
    rows = found.join(mentions, "key").withColumn("r", F.row_number().over(per_note)).filter("r = 1")
    return rows.withColumn("r", F.row_number().over(per_name)).filter(F.col("r") <= n).select("name", "canonical", "type", "path", "chunk_idx", "confidence", "context")


def list_entities(entities: DataFrame, mentions: DataFrame, kind: str | None = None, n: int = 1000) -> DataFrame:
    """Entities by number of mentions."""
    rows = entities if kind is None else entities.filter(F.col("type") == kind)
    counts = mentions.groupBy("key").agg(F.count("*").alias("mention_count"))
    return rows.join(counts, "key", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0))).orderBy(F.desc("mention_count"), "key").limit(n)


def note_entities(entities: DataFrame, mentions: DataFrame, path: str) -> DataFrame:
    """Entities of a note with the confidence of their first mention there."""
    first = mentions.filter(F.col("path") == path).groupBy("key").agg(F.min_by("confidence", "chunk_idx").alias("confidence"))
    return first.join(entities, "key").select("canonical", "type", "confidence").orderBy(F.desc("confidence"), "canonical")


def entity_aliases(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, name: str) -> DataFrame:
    key = resolve_names(entities, aliases, entities.sparkSession.sql("SELECT :n AS name", {"n": name})).select("key")
    own = entities.join(F.broadcast(key), "key")  # one row
    count = mentions.join(F.broadcast(key), "key").agg(F.count("*").alias("mention_count"))
    names = aliases.join(F.broadcast(key), "key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return own.crossJoin(names).crossJoin(count).select("canonical", "type", "aliases", "mention_count")


def merge(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, primary: str, secondary: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The secondary entity becomes an alias of the primary; for a mention of both the primary's stays.  Unknown or equal names change nothing."""
    spark = entities.sparkSession
    found = resolve_names(entities, aliases, spark.sql("SELECT * FROM VALUES (:p), (:s) AS t(name)", {"p": primary, "s": secondary})).collect()
    keys = {r.name: r.key for r in found}
    one, two = keys.get(primary), keys.get(secondary)
    if not one or not two or one == two:
        return entities, aliases, mentions
    moved = lambda c: F.when(F.col(c) == two, F.lit(one)).otherwise(F.col(c))
    canonical = entities.filter(F.col("key") == two).select(F.lit(two).alias("alias_key"), F.lit(one).alias("key"), F.col("canonical").alias("alias"))
    new_aliases = aliases.withColumn("key", moved("key")).unionByName(canonical).filter("alias_key <> key").distinct()
    first = Window.partitionBy("new_key", "path", "chunk_idx").orderBy((F.col("key") != one).cast("int"), F.desc("confidence"))
    new_mentions = mentions.withColumn("new_key", moved("key")).withColumn("r", F.row_number().over(first)).filter("r = 1").withColumn("key", F.col("new_key")).select(*mentions.columns)
    return entities.filter(F.col("key") != two), new_aliases, new_mentions


def link_note(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, path: str, name: str) -> DataFrame:
    """Mentions with one of the named entity in a note, with confidence 1, unless its first chunk mentions it already."""
    named = resolve_names(entities, aliases, entities.sparkSession.sql("SELECT :n AS name", {"n": name})).filter("key IS NOT NULL")
    new = named.select("key", F.lit(path).alias("path"), F.lit(0).alias("chunk_idx"), F.lit("").alias("context"), F.lit(1.0).alias("confidence"))
    return mentions.unionByName(new.join(mentions.select("key", "path", "chunk_idx"), ["key", "path", "chunk_idx"], "left_anti"))


def summaries(extracted: DataFrame, provider_summary, notes: DataFrame) -> DataFrame:
    """(path, summary) of notes: the one within a kept answer (path, response), else the provider's of the note's first 3000 characters.  provider_summary: Column -> Column."""
    known = extracted.select("path", F.nullif(F.trim(parse_extraction(F.col("response"))["summary"]), F.lit("")).alias("known"))
    rows = notes.select("path", "content").join(known, "path", "left")
    return rows.select("path", F.coalesce("known", provider_summary(F.substring("content", 1, 3000))).alias("summary")).filter("summary <> ''")


def change_type(entities: DataFrame, name: str, kind: str) -> DataFrame:
    return entities.withColumn("type", F.when(F.col("key") == entity_key(F.lit(name)), valid_type(F.lit(kind))).otherwise(F.col("type")))


def add_manual(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Entities with those of rows (name, type) added; known ones keep their type."""
    new = rows.select(entity_key(F.col("name")).alias("key"), F.col("name").alias("canonical"), valid_type(F.col("type")).alias("type")).dropDuplicates(["key"])
    return entities.unionByName(new.join(entities, "key", "left_anti"))


def add_aliases(entities: DataFrame, aliases: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases of rows (name, aliases) added; an unknown entity gets a Concept."""
    named = rows.withColumn("key", entity_key(F.col("name")))
    grown = add_manual(entities, named.select("name", F.lit("Concept").alias("type")))
    new = named.select("key", F.explode("aliases").alias("alias")).select(entity_key(F.col("alias")).alias("alias_key"), "key", "alias").filter("alias_key <> key")
    return grown, aliases.unionByName(new).dropDuplicates(["alias_key", "key"])


def from_metadata(chunks: DataFrame) -> DataFrame:
    """Mentions with confidence 1 from chunks' packed entities (',Type:Name,')."""
    items = chunks.select("path", F.col("chunk").alias("chunk_idx"), F.explode(F.filter(F.split("entities_str", ","), lambda x: x.contains(":"))).alias("item"))
    return items.select(F.monotonically_increasing_id().alias("seq"), F.substring_index("item", ":", 1).alias("type"), F.expr("substring(item, instr(item, ':') + 1)").alias("name"), F.lit(1.0).alias("confidence"), "path", "chunk_idx", F.lit("").alias("context"), F.array().cast("array<string>").alias("aliases"))


def add_timeline(rows: DataFrame) -> DataFrame:
    """Entries (entity, date, event, note, confidence): one for each date, event and note, the most confident."""
    return rows.groupBy(entity_key(F.col("entity")).alias("key"), "date", "event", "note").agg(F.max("confidence").alias("confidence"))


def timeline(entries: DataFrame, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries of an entity, both bounds included; dates are text and compare as text."""
    rows = entries.filter(F.col("key") == entity_key(F.lit(name)))
    rows = rows if start is None else rows.filter(F.col("date") >= start)
    rows = rows if end is None else rows.filter(F.col("date") <= end)
    return rows.orderBy("date", "event", "note")


def stats(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities and mentions by type."""
    counts = mentions.groupBy("key").agg(F.count("*").alias("n"))
    return entities.join(counts, "key", "left").groupBy("type").agg(F.count("*").alias("entities"), F.sum(F.coalesce("n", F.lit(0))).alias("mentions"))


def add_relations(rows: DataFrame) -> DataFrame:
    """Triples (source, type, target): known types, confidence within 0 and 1, the highest; the first note that isn't empty."""
    kind = F.when(F.col("type").isin(*RELATION_TYPES), F.col("type")).otherwise(F.lit("related_to"))
    held = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    note = F.min_by("source_note", "seq") if "seq" in rows.columns else F.min("source_note")
    rows = rows.withColumn("type", kind).withColumn("confidence", held).withColumn("source_note", F.nullif("source_note", F.lit("")))
    best = rows.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"))
    notes = rows.filter("source_note IS NOT NULL").groupBy("source", "type", "target").agg(note.alias("source_note"))
    return best.join(notes, ["source", "type", "target"], "left")


def related(relations: DataFrame, names: DataFrame, depth: int = 1, kind: str | None = None) -> DataFrame:
    """(start, name, type, confidence, depth): entities reached along relations in either direction.

    At a depth the type with the highest confidence is reported, of equal ones the least.
    """
    rows = relations if kind is None else relations.filter(F.col("type") == kind)
    a, b = entity_key(F.col("source")), entity_key(F.col("target"))
    one, two = rows.select(a.alias("x"), b.alias("y"), "type", "confidence"), rows.select(b.alias("x"), a.alias("y"), "type", "confidence")
    links = cut(one.union(two).filter("x <> y").groupBy("x", "y", "type").agg(F.max("confidence").alias("confidence")))
    seen = cut(names.select(entity_key(F.col("name")).alias("start")).distinct().select("start", F.col("start").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("depth")))
    frontier = seen
    for d in range(1, depth + 1):
        near = frontier.select("start", F.col("name").alias("x")).join(links, "x").join(seen.select("start", F.col("name").alias("y")), ["start", "y"], "left_anti")
        best = near.groupBy("start", "y").agg(F.min_by(F.struct("type", "confidence"), F.struct(-F.col("confidence"), F.col("type"))).alias("b"))
        frontier = cut(best.select("start", F.col("y").alias("name"), "b.type", "b.confidence", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def relation_stats(relations: DataFrame) -> DataFrame:
    return relations.groupBy("type").agg(F.count("*").alias("relations"))


def match(incoming: DataFrame, entities: DataFrame, aliases: DataFrame, mentions: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """incoming (name, aliases) with matched key and how: exact, alias overlap, or fuzzy (the most mentioned first).

    Fuzzy candidates meet only where they share their first letter's block or
    length band would allow the ratio, so the comparison isn't all with all.
    The entities, their aliases and their mentions' numbers are computed once.
    """
    entities, aliases, counts = cut(entities), cut(aliases), cut(mentions.groupBy("key").agg(F.count("*").alias("mention_count")))
    rows = incoming.withColumn("k", entity_key(F.col("name"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    exact = rows.join(entities.select(F.col("key").alias("k"), F.col("key").alias("exact")), "k").select("row", "exact")
    known = alias_map(entities, aliases).union(entities.select("key", "key"))
    probes = rows.select("row", F.explode(F.concat(F.array("k"), F.transform("aliases", entity_key))).alias("alias_key"))
    by_alias = probes.join(known, "alias_key").groupBy("row").agg(F.min("key").alias("by_alias"))
    open_ = cut(rows.join(exact, "row", "left").join(by_alias, "row", "left"))
    rest = open_.filter("exact IS NULL AND by_alias IS NULL").select("row", "k", F.length("k").alias("n"))
    rest = rest.repartition(4 * rest.sparkSession.sparkContext.defaultParallelism, "row")  # short rows, long work
    sizes = entities.select("key", F.length("key").alias("m"))
    sizes = F.broadcast(sizes) if entities.count() <= BROADCAST_ROWS else sizes  # few lengths: a shuffled join would have a few hot keys
    # Names of a length can reach the ratio with a bounded range of lengths only: an equi-join on the length.
    reach = rest.withColumn("m", F.explode(F.expr(f"sequence(cast(ceil(n * {threshold} / (2 - {threshold})) AS INT), cast(floor(n * (2 - {threshold}) / {threshold}) AS INT))")))
    pairs = reach.join(sizes, "m").filter(may_reach(F.col("k"), F.col("key"), threshold)).withColumn("ratio", fuzzy_ratio(F.col("k"), F.col("key"))).filter(F.col("ratio") >= threshold)
    fuzzy = pairs.join(counts, "key", "left").groupBy("row").agg(F.max_by("key", F.struct(F.coalesce("mention_count", F.lit(0)), "key")).alias("fuzzy"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("new")
    return open_.join(fuzzy, "row", "left").select("name", F.coalesce("exact", "by_alias", "fuzzy").alias("key"), how.alias("matched_by"))


def resolve_import(incoming: DataFrame, entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) after an import of (name, type, aliases): matches give aliases, the rest are new."""
    entities, aliases = cut(entities), cut(aliases)
    found = cut(match(incoming, entities, aliases, mentions)).join(incoming.select("name", "type", "aliases"), "name")
    grown = add_manual(entities, found.filter("key IS NULL").select("name", "type"))
    given = found.select(F.coalesce("key", entity_key(F.col("name"))).alias("key"), F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    new = given.select(entity_key(F.col("alias")).alias("alias_key"), "key", "alias").filter("alias_key <> key")
    return grown, aliases.unionByName(new).dropDuplicates(["alias_key", "key"])


EXTRACTED = "struct<entities: array<struct<name: string, type: string, confidence: double, aliases: array<string>>>, relations: array<struct<source: string, type: string, target: string, confidence: double>>, timeline: array<struct<entity: string, date: string, event: string, confidence: double>>, summary: string>"


def parse_extraction(response: Column) -> Column:
    """A model's JSON answer, found within other text if need be, with valid names, types and confidences only."""
    raw = F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), EXTRACTED)
    held = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    clean = F.transform(F.filter(raw["entities"], lambda e: F.length(F.trim(e["name"])) >= 2), lambda e: F.struct(F.trim(e["name"]).alias("name"), valid_type(e["type"]).alias("type"), held(e["confidence"]).alias("confidence"), F.filter(F.transform(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda t: F.trim(t)), lambda a: a != "").alias("aliases")))
    kinds = F.transform(F.filter(raw["relations"], lambda r: r["source"].isNotNull() & r["target"].isNotNull()), lambda r: F.struct(r["source"].alias("source"), F.when(r["type"].isin(*RELATION_TYPES), r["type"]).otherwise(F.lit("related_to")).alias("type"), r["target"].alias("target"), held(r["confidence"]).alias("confidence")))
    return F.struct(clean.alias("entities"), kinds.alias("relations"), raw["timeline"].alias("timeline"), raw["summary"].alias("summary"))


def extract(notes: DataFrame, cache: DataFrame, provider, least_words: int = 20) -> DataFrame:
    """(path, content_hash, response) of all notes with enough words; answers are reused by content hash.  provider: Column -> Column."""
    from cairn.functions.text import content_hash, word_count

    rows = notes.filter(word_count(F.col("content")) >= least_words).withColumn("content_hash", content_hash(F.col("content")))
    known = rows.join(cache.select("content_hash", "response"), "content_hash").select("path", "content_hash", "response")
    new = rows.join(cache.select("content_hash"), "content_hash", "left_anti")
    answers = new.select("content_hash", "content").dropDuplicates(["content_hash"]).withColumn("response", provider(F.substring("content", 1, 3000)))
    return known.unionByName(new.select("path", "content_hash").join(answers.select("content_hash", "response"), "content_hash"))


def missing_edges(entity_edges: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity edges that the mentions imply and the graph lacks."""
    implied = mentions.join(entities, "key").select(F.col("type").alias("entity_type"), F.col("canonical").alias("entity_name"), "path").distinct()
    return implied.join(entity_edges, ["entity_type", "entity_name", "path"], "left_anti")


def import_summary(found: DataFrame) -> DataFrame:
    """Imported names by how they were matched."""
    return found.groupBy("matched_by").agg(F.count("*").alias("names"))
