"""Tables of the data model, as DDL."""

NOTES = "path STRING, content STRING, mtime DOUBLE"
CHUNKS = (
    "chunk_id STRING, path STRING, title STRING, chunk INT, word_count INT, heading STRING, tags ARRAY<STRING>, links ARRAY<STRING>, mtime DOUBLE, "
    "entities ARRAY<STRUCT<type: STRING, name: STRING>>, summary STRING, created STRING, modified STRING, aliases ARRAY<STRING>, cssclasses ARRAY<STRING>, "
    "document STRING, content_hash STRING, embedding ARRAY<FLOAT>"
)
SUMMARIES = "path STRING, title STRING, summary STRING, embedding ARRAY<FLOAT>"
EDGES = "src STRING, dst STRING"
NODES = "path STRING"
TITLE_MAP = "title STRING, path STRING"
ENTITY_EDGES = "entity_type STRING, entity_name STRING, path STRING"
ENTITIES = "key STRING, canonical STRING, type STRING"
ENTITY_ALIASES = "alias_key STRING, key STRING, alias STRING"
MENTIONS = "key STRING, path STRING, chunk_idx INT, context STRING, confidence DOUBLE"
TIMELINE = "key STRING, date STRING, event STRING, note STRING, confidence DOUBLE"
RELATIONS = "source STRING, type STRING, target STRING, confidence DOUBLE, source_note STRING"
TODOS = "id STRING, task STRING, status STRING, due STRING, priority STRING, tags ARRAY<STRING>, project STRING, ordinal INT"
EVAL_QUERIES = "query STRING, expected ARRAY<STRING>, description STRING"
INDEX_STATE = "path STRING, content_hash STRING, mtime DOUBLE"

#: Labels of the data model.
ENTITY_TYPES = ("Concept", "Event", "Hardware", "Location", "Person", "Project", "Technology")
RELATION_TYPES = ("attends", "created_by", "located_in", "part_of", "related_to", "uses", "works_on")
#: For each entity type, the next broader one.
BROADER = {"Hardware": "Technology", "Technology": "Concept", "Project": "Concept", "Person": "Concept", "Location": "Concept", "Event": "Concept"}
