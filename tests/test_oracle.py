"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""
import pytest
from conftest import SMALL, canonical

from cairn.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, SMALL).toPandas()) == canonical(duck.execute(SQL[name]).df())


def test_communities_refine_components(spark):
    from cairn.operators import graph as gr
    from cairn.plans.queries import links

    nodes, edges = links(spark, SMALL)
    labels = gr.communities(nodes, edges)
    mixed = labels.join(gr.components(nodes, edges), "path").groupBy("community").agg({"component": "min", "path": "count"})
    joined = labels.join(gr.components(nodes, edges), "path").selectExpr("community", "component").distinct()
    assert joined.count() == mixed.count() == labels.select("community").distinct().count()


def test_fuzzy_matches(spark):
    found = {r.name: (r.key, r.matched_by) for r in QUERIES["entity_match"](spark, SMALL).collect()}
    assert found["Part 2"] == ("part 2", "exact")
    assert all(how in ("exact", "alias", "fuzzy", "new") for _, how in found.values())


def test_every_part_is_matched(spark):
    for folder in (SMALL, SMALL.replace("0.001", "0.01")):
        parts = spark.read.parquet(f"{folder}/part.parquet").count()
        assert QUERIES["entity_match"](spark, folder).count() == parts


def test_mentions_are_joined_without_sorting(spark, monkeypatch):
    from cairn import lineage
    from cairn.plans.queries import mention_rows

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        small = mention_rows(spark, SMALL)
        want = sorted(small.select("seq", "name").collect())
        assert "SortMergeJoin" not in plan(small)
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(lineage, "LOOKUP_ROWS", 100)
        dealt = mention_rows(spark, SMALL)
        assert "ShuffledHashJoin" in plan(dealt) and "Sort" not in plan(dealt)
        assert dealt.rdd.getNumPartitions() == -(-len(want) // 100) and sorted(dealt.select("seq", "name").collect()) == want
    finally:
        spark.conf.set(threshold, before)


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["path", "title", "matched_chunk_idx", "similarity_score"]
