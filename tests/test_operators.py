"""Small cases with known answers."""
import os

import pytest
from pyspark.sql import functions as F

from cairn.functions import frontmatter as fm, fuzzy, text as tx, vectors as vx
from cairn.operators import chunking as ch, clustering as cl, entities as en, evaluate as ev, filters as fi, graph as gr, incremental as inc, keyword as kw, ranking as ra, todos as td, vector as ve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_sanitize(spark):
    assert one(spark, tx.sanitize(F.lit("visit https://example.com for more"))) == "visit for more"
    assert one(spark, tx.sanitize(F.lit("too   many    spaces"))) == "too many spaces"
    assert one(spark, tx.sanitize(F.lit("a ( ) b\n\n  c"))) == "a b\n\n c"


@pytest.mark.parametrize("words, size, overlap, chunks", [(3, 500, 100, 1), (500, 500, 100, 2), (600, 500, 100, 2), (1000, 500, 100, 3), (20, 10, 3, 3), (0, 500, 100, 0)])
def test_chunk_counts(spark, words, size, overlap, chunks):
    text = " ".join(f"w{i}" for i in range(words))
    assert len(one(spark, ch.chunk_windows(F.lit(text), size, overlap))) == chunks


def test_headings(spark):
    text = "Intro paragraph.\n\n# Top\na\n## Middle\n### Deep\nb\n# New Top\nc"
    found = [(s.heading, s.body) for s in one(spark, ch.heading_sections(F.lit(text)))]
    assert found == [("", "Intro paragraph."), ("# Top", "a"), ("# Top > ## Middle", ""), ("# Top > ## Middle > ### Deep", "b"), ("# New Top", "c")]
    kept = [(s.heading, s.document) for s in one(spark, ch.chunk_sections(F.lit("# Empty\n## Has Content\nx y")))]
    assert kept == [("# Empty > ## Has Content", "# Empty > ## Has Content\n\nx y")]


def test_snippet(spark):
    out = one(spark, tx.truncate_snippet(F.lit("x" * 400)))
    assert len(out) == 303 and out.endswith("...")


@pytest.mark.parametrize("raw, want", [("Project Alpha|display text", "project alpha"), ("Project Alpha#Setup", "project alpha"), ("/Folder\\Project Alpha.md", "folder/project alpha")])
def test_link_targets(spark, raw, want):
    assert one(spark, tx.normalize_link(F.lit(raw))) == want


def test_wiki_links(spark):
    assert one(spark, tx.wiki_links(F.lit("[[Project Alpha]] [[project alpha#Later]] [[Project Beta]]"))) == ["project alpha", "project beta"]
    assert one(spark, tx.wiki_links(F.lit("![[image.png]] [[]] [[#Only Section]] [[Visible]]"))) == ["visible"]


def test_frontmatter(spark):
    note = "---\ntitle: T\ntags: [a, b]\ncreated: 2024-01-01\n---\nBody\n"
    meta = one(spark, fm.parse(F.lit(note)))
    assert (meta.title, meta.tags, meta.created, one(spark, fm.body(F.lit(note)))) == ("T", ["a", "b"], "2024-01-01", "Body")
    assert "- c" in one(spark, fm.add_tags(F.lit(note), ["a", "c"]))
    assert "- a" not in one(spark, fm.remove_tags(F.lit(note), ["a"]))
    assert one(spark, fm.set_tags(F.lit("Body"), ["z"])).startswith("---\ntags:\n- z\n---")
    assert one(spark, fm.validate(F.lit("---\ntags: x\ntags: y\n---\n"))) == ["duplicate key: tags", "tags is a string, not a list"]
    assert one(spark, fm.validate(F.lit("---\nopen"))) == ["frontmatter is not closed"]
    assert one(spark, fm.packed(F.array().cast("array<string>"))) == ",,"


def test_plain_frontmatter_is_read_and_written_as_yaml_does(monkeypatch):
    """Blocks of plain text take the short way and give the library's result; each other block is read once."""
    import itertools

    import yaml

    words = ["a", "b1", "yes", "No", "null", "t 1", "a-b/c", "n", "1", "2024-01-02", "a: b", "'x'", "a  b", "x #y", "#z", "é", "", "~", "x" * 90, "a b " * 30 + "c", "- a", "[a]", "_a", "a "]
    blocks = [f"\n{k}: {v}\n" for k in ("title", "on", "a-b", "x") for v in words] + [f"\n{a}: {v}\ntags:\n{p}- {v}\n{q}- {w}\n" for a in ("title", "tags") for v, w in itertools.product(words, words) for p, q in (("", ""), ("  ", "  "), ("", "  "), (" ", " "))]
    short = 0
    for text in [*blocks, "", "\n", "\n- a\n", "\na:\n", "\na: b", "\na: [\n"]:
        try:
            valid, want = True, yaml.safe_load(text)
        except yaml.YAMLError:
            valid, want = False, None
        assert fm._read(text) == (valid, want)
        short += fm._simple(text) is not None
        if isinstance(want, dict) and all(isinstance(k, str) for k in want):
            assert fm._written(want) == yaml.dump(want, default_flow_style=False, allow_unicode=True).strip()
    assert short > 50
    calls = []
    load = yaml.safe_load
    monkeypatch.setattr(yaml, "safe_load", lambda text: calls.append(text) or load(text))
    assert fm._load("\ntitle: a b\ntags:\n- c\n") == {"title": "a b", "tags": ["c"]} and not calls
    assert list(fm._each(["\ntags: [q]\n"] * 3, fm._load)) == [{"tags": ["q"]}] * 3 and len(calls) == 1


def test_fuzzy_ratio(spark):
    assert one(spark, fuzzy.fuzzy_ratio(F.lit("ESP32"), F.lit("esp-32"))) == pytest.approx(10 / 11)


def notes(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_graph(spark):
    n = notes(spark, [("A.md", "[[B]] [[C]] [[Missing]] [[A]]"), ("B.md", "[[c|x]]"), ("C.md", "")])
    edges = gr.build_edges(n)
    assert {(r.src, r.dst) for r in edges.collect()} == {("A.md", "B.md"), ("A.md", "C.md"), ("B.md", "C.md")}
    assert [tuple(r) for r in gr.broken_links(n).collect()] == [("A.md", "missing")]
    s = gr.stats(n, edges).head()
    assert (s.nodes, s.edges, s.avg_degree, s.isolated) == (3, 3, 1.0, 0)
    assert [r.path for r in gr.backlinks(edges, "C.md").collect()] == ["A.md", "B.md"]


def test_paths_and_reach(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("E", "A")], "src string, dst string")
    assert gr.shortest_path(edges, "D", "E") is None
    assert gr.shortest_path(edges, "E", "D") == ["E", "A", "B", "C", "D"]
    assert gr.shortest_path(edges, "A", "A") == ["A"]
    start = spark.createDataFrame([("A",)], "start string")
    assert {(r.path, r.depth) for r in gr.bfs(edges, start, 2).collect()} == {("B", 1), ("C", 2)}
    assert "A" in gr.to_dot(spark.createDataFrame([("A",)], "path string"), edges)


def test_communities(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDEF"], "path string")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")], "src string, dst string")
    got = {r.path: r.community for r in gr.communities(nodes, edges).collect()}
    assert got["A"] == got["B"] == got["C"] == 0 and got["D"] == got["E"] and len(set(got.values())) == 3


def test_communities_equal_a_plain_sweep(spark):
    """Asynchronous sweeps in path order, written as a plain loop over sets."""
    import random

    r = random.Random(4)
    names = sorted(f"n{i:02d}" for i in range(60))
    pairs = {(a, b) for a, b in ((r.choice(names[:50]), r.choice(names[:50])) for _ in range(70)) if a != b}
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in names}
    label, moved = {x: i for i, x in enumerate(names)}, True
    while moved:
        moved = False
        for x in names:
            seen = [label[y] for y in near[x]]
            if seen:
                new = min(set(seen), key=lambda k: (-seen.count(k), k))
                moved, label[x] = moved or new != label[x], new
    number = {k: i for i, k in enumerate(sorted(set(label.values()), key=str))}
    got = {x.path: x.community for x in gr.communities(spark.createDataFrame([(x,) for x in names], "path string"), spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()}
    groups = lambda of: sorted(sorted(x for x in names if of[x] == k) for k in set(of.values()))
    assert groups(got) == groups({x: number[label[x]] for x in names})


def test_fuzzy_match_equals_difflib(spark):
    import difflib
    import random

    r = random.Random(9)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(40)]
    rows = [(i, w, "Concept", 0.5, f"n{j}", 0, "c", []) for i, w in enumerate(words) for j in range(r.randint(1, 4))]
    e, a, m = en.add_mentions(spark.createDataFrame(rows, "seq long, name string, type string, confidence double, path string, chunk_idx int, context string, aliases array<string>"))
    count = {}
    for row in m.collect():
        count[row.key] = count.get(row.key, 0) + 1
    asked = [w[:k] + r.choice("abcde") + w[k:] for w in words for k in (0, 2)] + ["zzz"]
    got = {x.name: (x.key, x.matched_by) for x in en.match(spark.createDataFrame([(x, []) for x in asked], "name string, aliases array<string>"), e, a, m).collect()}
    for x in asked:
        near = [k for k in count if difflib.SequenceMatcher(None, x, k).ratio() >= en.FUZZY]
        want = (x, "exact") if x in count else (max(near, key=lambda k: (count[k], k)), "fuzzy") if near else (None, "new")
        assert got[x] == want


def test_embedding_cache(spark):
    from cairn.sources.providers import EmbeddingCache, LocalProvider, prompt

    rows = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "other text")], "k int, document string")
    cache = EmbeddingCache(LocalProvider(8))
    first = {r.k: r.embedding for r in cache.embed(rows).collect()}
    assert first[1] == first[2] != first[3] and cache.info() == {"provider": "local", "texts": 2}
    assert {r.k: r.embedding for r in cache.embed(rows.filter("k > 2")).collect()} == {3: first[3]} and cache.info()["texts"] == 2
    cache.switch(LocalProvider(4))
    assert cache.info()["texts"] == 0 and len(cache.embed(rows).head().embedding) == 4
    assert one(spark, prompt(F.lit("hi"), think=False)) == "/no_think hi" and one(spark, prompt(F.lit("hi"))) == "hi"


def test_a_token_is_hashed_once(spark):
    """The embedding is that of a plain loop, and its expression hashes each token at one place."""
    import hashlib
    import math

    words = ["ring", "bolt", "ring", "large", *(f"w{i}" for i in range(40))]
    sums = [0.0] * 64
    for w in words:
        h = hashlib.md5(w.encode()).hexdigest()
        sums[int(h[:7], 16) % 64] += 1.0 if int(h[7], 16) < 8 else -1.0
    length = math.sqrt(sum(x * x for x in sums))
    rows = spark.createDataFrame([(words,)], "w array<string>").select(vx.hashed_embedding(F.col("w")).alias("v"))
    assert rows.head().v == pytest.approx([x / length for x in sums])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    texts = spark.createDataFrame([("a b",), ("c",), (None,), ("a b",)], "document string")
    found = ve.embed_distinct(texts, lambda t: vx.hashed_embedding(F.split(t, " "), 4))
    assert [r.embedding is None for r in found.orderBy("document").collect()] == [True, False, False, False]
    behind = found.select("document", F.explode("embedding").alias("x"))
    assert "md5" not in behind._jdf.queryExecution().optimizedPlan().toString()


def test_queries_in_rounds(spark, monkeypatch):
    """Query vectors sent in many small rounds find the same rows."""
    import random

    r = random.Random(1)
    rows = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(4)]) for i in range(200)], "id long, embedding array<double>")
    asked = rows.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    found = lambda: sorted((x.query_id, x.id, x["rank"]) for x in ve.nearest_many(rows, asked, 3).collect())
    want = found()
    monkeypatch.setattr(ve, "QUERY_NUMBERS", 16)
    assert found() == want and len(want) == 60


def test_searches_in_tiles(spark, monkeypatch):
    """Small tiles, batches and rounds find the rows of a plain loop, copies by their id."""
    import numpy as np

    r = np.random.default_rng(2)
    v = r.normal(size=(150, 5))
    v[100:] = v[:50]  # copies
    rows = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "id long, embedding array<double>")
    asked = rows.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(ve, "TILE", 8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T).round(9)
    want = {q: [int(i) for i in np.lexsort((np.arange(150), -near[q]))[:4]] for q in range(0, 150, 7)}
    found = {}
    for x in ve.nearest_many(rows, asked, 4).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append(x.id)
    assert found == want
    pairs = {(a, b) for a in range(150) for b in range(a + 1, 150) if near[a, b] >= 0.8}
    for blocks in (1, 3):
        assert {(x.a, x.b) for x in ve.similar_pairs(rows, 0.8, blocks=blocks).collect()} == pairs
        links = ve.similar_links(rows, 0.8, blocks=blocks)
        few = [(x.a, x.b) for x in links.collect()]
        assert set(few) <= pairs and (blocks > 1 or len(few) < 150)
        whole = lambda e: {(x.path, x.component) for x in gr.linked_components(spark.createDataFrame(list(e), "src long, dst long")).collect()}
        assert whole(few) == whole(pairs)


def test_a_vector_is_shipped_for_few_blocks(spark):
    """Rows dealt to blocks don't grow with the square of the vectors."""
    rows = spark.range(40000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    plan = ve.similar_pairs(rows, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(id" in plan and ", 16)" in plan


def test_stream_upserts_run_again(spark, tmp_path):
    """The latest row of a key, deletes as of their time, and the same outcome when a batch is given twice."""
    from cairn.streaming import watch

    write = watch.apply_batch("kept_notes")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, action string, ts int, sequence long")
    state = lambda: sorted((x.path, x.ts) for x in spark.table("kept_notes").collect())
    for number, batch, want in (
        (0, frame(("a", "index", 1, 0), ("a", "index", 2, 0), ("b", "index", 3, 0), ("b", "delete", 4, 0), ("c", "index", 1, 0)), [("a", 2), ("c", 1)]),
        (1, frame(("c", "delete", 5, 0), ("b", "delete", 5, 0), ("b", "index", 5, 1)), [("a", 2), ("b", 5)]),
        (2, frame(("a", "index", 6, 0)), [("a", 6), ("b", 5)]),
    ):
        for _ in range(2):
            write(batch, number)
            assert state() == want
    spark.sql("DROP VIEW kept_notes")
    for v in (0, 1, 2):
        spark.sql(f"DROP TABLE IF EXISTS kept_notes_v{v}")


def test_modularity(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")], "src string, dst string")
    labels = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1), ("D", 1)], "path string, community int")
    assert gr.modularity(labels, edges).head().modularity == 0.5


def test_clusters(spark):
    v = {"a": [[1, 0, 0, 0], [0.99, 0.01, 0, 0]], "b": [[0.95, 0.05, 0, 0]], "c": [[0, 1, 0, 0]], "d": [[0, 0.95, 0.05, 0]], "e": [[0, 0, 1, 0]]}
    chunks = spark.createDataFrame([(p, i, [float(x) for x in e]) for p, es in v.items() for i, e in enumerate(es)], "path string, chunk int, embedding array<double>")
    mean = {r.path: r.embedding for r in ve.mean_vectors(chunks).collect()}
    assert mean["a"] == pytest.approx([0.995, 0.005, 0, 0])
    found = {r.path: r.cluster for r in cl.clusters(chunks, 0.5).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_bm25_normalise(spark):
    frame = lambda *x: spark.createDataFrame([(i, float(s)) for i, s in enumerate(x)], "id int, score double")
    got = lambda *x: [r.score for r in kw.normalise(frame(*x)).orderBy("id").collect()]
    assert got(10, 5, 0) == [1, 0.5, 0] and got(3, 3) == [1, 1] and got(7) == [1]


def test_weights_and_intents(spark):
    assert ra.Weights().normalised() == pytest.approx({"semantic": 0.4, "entity": 0.3, "graph": 0.2, "keyword": 0.1})
    assert ra.Weights(0, 0, 0, 0).normalised() == {"semantic": 1.0}
    for q, want in {"what is the meaning of life": "general", "who is alice": "entity", "how to configure a server": "keyword", "how does X relate to Y": "graph"}.items():
        assert one(spark, ra.detect_intent(F.lit(q))) == want


def entity_tables(spark):
    rows = [(1, "ESP32", "Technology", 0.8, "n1", 0, "c", ["esp32 module"]), (2, "ESP32", "Hardware", 0.9, "n1", 0, "d", []), (3, "ESP-32", "Concept", 0.7, "n2", 0, "e", [])]
    return en.add_mentions(spark.createDataFrame(rows, "seq long, name string, type string, confidence double, path string, chunk_idx int, context string, aliases array<string>"))


def test_entities(spark):
    e, a, m = entity_tables(spark)
    kinds = {r.key: r.type for r in e.collect()}
    assert kinds == {"esp32": "Hardware", "esp-32": "Concept"}
    assert {(r.key, r.path): r.confidence for r in m.collect()} == {("esp32", "n1"): 0.9, ("esp-32", "n2"): 0.7}
    e2, a2, m2 = en.merge(e, a, m, "ESP32", "ESP-32")
    assert m2.count() == 2 and e2.count() == 1
    names = spark.createDataFrame([("ESP-32",)], "name string")
    assert {r.path for r in en.search(e2, a2, m2, names).collect()} == {"n1", "n2"}
    assert en.merge(e, a, m, "ESP32", "esp32")[0] is e


def test_types_fold_as_in_a_plain_loop(spark):
    """The type of an entity is that of a loop over all its mentions, and no key's rows are sorted for it."""
    import random

    from cairn.schema import BROADER, ENTITY_TYPES

    def above(a):
        while a in BROADER:
            a = BROADER[a]
            yield a

    r = random.Random(3)
    rows = [(i, r.choice((f"E{k}", f" e{k}")), r.choice(ENTITY_TYPES), 0.5, "n", 0, "c", [f"a{k}"]) for i, k in enumerate(r.choices(range(60), k=700))]
    want = {}
    for _, name, kind, *_ in rows:
        key = name.strip().lower()
        first, held = want.get(key, (name, None))
        want[key] = (first, held if held and kind in above(held) else kind)
    r.shuffle(rows)
    e, a, _ = en.add_mentions(spark.createDataFrame(rows, "seq long, name string, type string, confidence double, path string, chunk_idx int, context string, aliases array<string>"))
    assert {x.key: (x.canonical, x.type) for x in e.collect()} == want
    assert sorted((x.alias_key, x.key) for x in a.collect()) == sorted((k.replace("e", "a"), k) for k in want)
    assert "Window" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_relations(spark):
    rows = [("Alice", "works_on", "ProjectX", 0.8), ("Alice", "works_on", "ProjectX", 0.95), ("ProjectX", "uses", "ESP32", 0.9), ("ESP32", "odd", "IoTKit", 2.0)]
    rel = en.add_relations(spark.createDataFrame(rows, "source string, type string, target string, confidence double").withColumn("source_note", F.lit("")))
    assert {(r.source, r.type, r.confidence) for r in rel.collect()} == {("Alice", "works_on", 0.95), ("ProjectX", "uses", 0.9), ("ESP32", "related_to", 1.0)}
    alice = spark.createDataFrame([("Alice",)], "name string")
    for depth in (1, 2, 3):
        assert en.related(rel, alice, depth).count() == depth


def test_timeline(spark):
    rows = [("X", "2024-06", "m", "n", 0.8), ("X", "2024-06", "m", "n", 0.9), ("X", "2024-01", "a", "n", 1.0), ("X", "2024-12", "z", "n", 1.0)]
    t = en.add_timeline(spark.createDataFrame(rows, "entity string, date string, event string, note string, confidence double"))
    assert [(r.date, r.confidence) for r in en.timeline(t, "x").collect()] == [("2024-01", 1.0), ("2024-06", 0.9), ("2024-12", 1.0)]
    assert [r.event for r in en.timeline(t, "X", "2024-03", "2024-09").collect()] == ["m"]


LIST = """---
total: 4
---
- [ ] first (id: todo-001, due: 2026-06-15, priority: high, tags: home, garden)
- [x] second (id: todo-002)
## Work
- [ ] third (id: todo-003, due: )
- [ ] fourth blocked"""


def test_todos(spark):
    lines = spark.createDataFrame(list(enumerate(LIST.split("\n"))), "line_no int, line string")
    t = td.parse(lines)
    rows = {r.task: r for r in t.collect()}
    assert rows["first"].tags == ["home", "garden"] and rows["third"].due is None and rows["third"].project == "Work" and len(rows["fourth blocked"].id) == 8
    assert td.select(t, "2026-06-10", overdue=True).count() == 0
    assert [r.id for r in td.select(t, "2026-06-16", overdue=True).collect()] == ["todo-001"]
    assert {r.project: r.total for r in td.stats(t, "2026-06-10").collect()} == {None: 4, "General": 2, "Work": 2}
    assert td.complete(t, "todo-001").filter("status = 'completed'").count() == 2
    assert td.delete(t, "todo-001").count() == 3 and td.add(t, "new", "Work").count() == 5
    text = td.render_file(t, "2026-06-10").head().content
    assert "- [ ] first (id: todo-001, due: 2026-06-15, priority: high, tags: home, garden)" in text and "## Work" in text
    again = td.parse(spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string"))
    assert again.count() == 4
    assert one(spark, td.valid_priority(F.lit("I say HIGH."))) == "high" and one(spark, td.valid_date(F.lit("?"), "2026-01-01")) == "2026-01-08"
    assert one(spark, td.valid_split(F.lit('ok ["a", "b"]'), F.lit("t"))) == ["a", "b"] and one(spark, td.valid_split(F.lit("no"), F.lit("t"))) == ["t"]


def test_estimates_beyond_the_year_9999(spark):
    rows = [(f"t{i}", "completed" if i < 3 else "pending", "P") for i in range(3000)]
    todos = spark.createDataFrame(rows, "id string, status string, project string")
    assert td.estimate_completion(todos, "1997-06-15").head().estimate == "10202-12-18"


def test_evaluation(spark):
    got = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate("XAB")], "query string, rank int, title string")
    want = spark.createDataFrame([("q", "a")], "query string, title string")
    r = ev.per_query(got, want, 3).head()
    assert (r.precision, r.recall, r.mrr) == (pytest.approx(1 / 3), 1.0, 0.5)


def test_delta_and_state(spark):
    old = spark.createDataFrame([("a", "h1", 1.0), ("b", "h2", 2.0)], "path string, content_hash string, embedding double")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3")], "path string, content_hash string")
    fresh, stale = ch.chunk_delta(new, old)
    assert [r.content_hash for r in fresh.collect()] == ["h3"] and [r.content_hash for r in stale.collect()] == ["h2"]
    assert {r.path: r.embedding for r in ch.apply_delta(new, old, ["embedding"]).collect()} == {"a": 1.0, "b": None}


def test_tag_exclusion_keeps_untagged(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", ["y"])], "path string, tags array<string>")
    assert {r.path for r in rows.filter(fi.exclude_tags(["x"])).collect()} == {"b", "c"}


def test_tools(spark):
    from cairn.plans.api import Tools, Vault, validate_config

    text = " ".join(f"word{i}" for i in range(30))
    n = notes(spark, [("A.md", f"alpha beta {text} [[B]]"), ("B.md", f"gamma delta {text}"), ("C.md", f"alpha gamma {text}")])
    tools = Tools(Vault(spark, n))
    assert tools.health()["status"] == "healthy" and tools.health()["chunks"] == 3
    assert [r.path for r in tools.backlinks("B.md").collect()] == ["A.md"]
    assert tools.search("alpha", 2).count() == 2
    assert tools.call("nothing") == "Error: unknown action: nothing"
    assert "search" in tools.describe()
    assert [r.path for r in tools.route("?", '{"capability": "backlinks", "params": {"note": "B.md"}}').collect()] == ["A.md"]
    assert tools.route("alpha?", "no json").head().paths
    assert tools.set_weights(graph=0.5)["graph"] == 0.5
    assert validate_config({"chunk_size": 100, "chunk_overlap": 100}) == ["chunk_overlap must be smaller than chunk_size"]
    assert {r.path for r in tools.orphans().collect()} == {"C.md"}


def test_sources(spark, tmp_path):
    from cairn.sources import notes as sn

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.md").write_text("hello Alice")
    (tmp_path / "two.md").write_text("nothing")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "three.md").write_text("no")
    n = sn.read_notes(spark, str(tmp_path))
    assert {r.path for r in n.collect()} == {"x/one.md", "two.md"}
    assert [r.entry for r in sn.list_folder(n).collect()] == ["two.md", "x/"]
    assert [r.path for r in sn.mentioning(n, "Alice").collect()] == ["x/one.md"]
    with pytest.raises(ValueError):
        sn.get_note(n, "../x")
    assert sn.load(spark, str(tmp_path / "none"), "a string").count() == 0
    assert os.path.exists(tmp_path)


def test_stream_debounce(spark, tmp_path):
    import json

    from cairn.streaming import watch

    src = tmp_path / "in"
    src.mkdir()
    rows = [("a.md", "edit", "2024-01-01T00:00:00", 1), ("a.md", "edit", "2024-01-01T00:00:01", 2), ("a.md", "delete", "2024-01-01T00:00:02", 3), ("b.md", "edit", "2024-01-01T00:05:00", 4)]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "action", "ts", "sequence"), r))) for r in rows))
    stream = watch.debounce(watch.read_events(spark, str(src)))
    q = stream.writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.path, r.action, r.events) for r in spark.table("debounced").collect()] == [("a.md", "delete", 3)]


def test_incremental_run(spark):
    text = " ".join(f"w{i}" for i in range(30))
    first = notes(spark, [("a.md", text), ("b.md", text + " b")]).withColumn("mtime", F.lit(1.0))
    embed = lambda c: F.array(F.length(c).cast("double"))
    empty = inc.run_index(first.limit(0), ch.chunk_notes(first).limit(0).withColumn("embedding", F.array(F.lit(0.0))), inc.next_state(first).limit(0), embed)
    run = inc.run_index(first, empty.chunks, inc.next_state(first).limit(0), embed)
    assert run.chunks.filter("embedding IS NOT NULL").count() == 2
    assert {r.status: r.notes for r in inc.run_index(first, run.chunks, run.state, embed).status.collect()} == {"unchanged": 2}
