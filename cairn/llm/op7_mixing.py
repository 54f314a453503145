"""Mixing sources to target weights, by temperature.

A source's weight is its token share to the power of an exponent between 0 and
1, normalised.  Bisection finds the smallest exponent (the flattest mixture)
at which the entropy of the weights is at most ENTROPY times the greatest
possible and no source is repeated more often than the limit.  The weights
then become token quotas of the budget.  Each source is cut into blocks of
documents; every epoch runs through its blocks in a new permutation, and the
last epoch ends where the quota is used up.

Only SQL: sums run within blocks of about BLOCK_DOCS documents and then over
the blocks of a source, so a hot source is spread over many tasks.  The driver
needs nothing but the plan; one row holds the totals of all sources.

Edge cases: a document has its words and one end as tokens, so one without
text (null or empty) has 1; a null source counts as the source '', a null doc_id
has rows of its own; repeated
rows are documents of their own; other columns, whatever their names, are ignored
(or kept, in ``mix_rows``); an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_ROWS, cut, fresh, read_table

ENTROPY = 0.97
REPEATS = 4.0
BLOCK_DOCS = 1024
STEPS = 50


def _number(text: Column) -> Column:
    """The first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def source_weights(counted: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, cover: bool = False) -> DataFrame:
    """key, docs, tokens, blocks, exponent, weight and quota of each source.

    cover: the budget is the least at which every document is taken at least once.
    """
    totals = counted.groupBy("key").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    given = "NULL" if budget is None else str(int(budget))
    greatest = "pow(p_most / p_least, 1D - a)" if cover else "pow(p_least, a - 1D) / z * budget / total"
    # Sums for exponent a: z of the powers, and the entropy of the weights.
    fits = f"""transform(array(mid), a -> transform(array(aggregate(p, 0D, (s, x) -> s + pow(x, a))), z ->
        (ln(z) - a * aggregate(p, 0D, (s, x) -> s + pow(x, a) * ln(x)) / z <= {float(entropy)!r}D * ln(cast(size(p) AS DOUBLE)) + 1e-12D)
        AND ({greatest} <= {float(repeats)!r}D))[0])[0]"""
    step = f"IF({fits}, named_struct('low', b.low, 'high', mid), named_struct('low', mid, 'high', b.high))"
    return counted.sparkSession.sql(f"""
        WITH t AS (SELECT *, cast(sum(tokens) OVER () AS DOUBLE) AS total FROM {{totals}}),
        r AS (SELECT array_sort(collect_list(tokens / total)) AS p, max(total) AS total, coalesce({given}, max(total)) AS budget FROM t),
        q AS (SELECT *, p[0] AS p_least, p[size(p) - 1] AS p_most FROM r WHERE size(p) > 0),
        e AS (SELECT *, IF({fits.replace("mid", "0D")}, 0D, aggregate(sequence(1, {STEPS}), named_struct('low', 0D, 'high', 1D),
              (b, i) -> transform(array((b.low + b.high) / 2D), mid -> {step})[0], b -> b.high)) AS a FROM q),
        w AS (SELECT a, budget, aggregate(p, 0D, (s, x) -> s + pow(x, a)) AS z FROM e),
        v AS (SELECT t.*, a, pow(tokens / total, a) / z AS weight, budget FROM t CROSS JOIN w)
        SELECT key, docs, tokens, cast(greatest(1, ceil(docs / {BLOCK_DOCS}D)) AS INT) AS blocks, a AS exponent, weight,
               cast({"ceil(weight * max(tokens / weight) OVER () - 1e-6D)" if cover else "floor(weight * budget)"} AS BIGINT) AS quota FROM v
    """, totals=totals)


def schedule(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, cover: bool = False, row: str | None = None) -> DataFrame:
    """doc_id, key, tokens, row (its number, or the column of that name), epoch, start (token of its source's stream) and weight: one row for each use of a document."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    counted = cut(docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("key"), token_count(F.col("text").cast("string")).alias("tokens")))
    weights = cut(source_weights(counted, entropy, repeats, budget, cover))
    small = weights.count() <= BROADCAST_ROWS
    per_source = weights.select("key", "blocks", "weight", "quota", F.col("tokens").alias("all_tokens"))
    placed = counted.join(F.broadcast(per_source) if small else per_source, "key").withColumn("block", F.pmod(_number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("blocks")).cast("int"))
    within = Window.partitionBy("key", "block").orderBy("doc_id", "tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    totals = placed.groupBy("key", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("quota").alias("quota"), F.first("all_tokens").alias("all_tokens"))
    epochs = totals.withColumn("epoch", F.explode(F.expr("sequence(0, cast(greatest(0, ceil(quota / all_tokens) - 1) AS INT))"))).filter("quota > 0")
    order = Window.partitionBy("key", "epoch").orderBy(_number(F.concat_ws("|", "key", "epoch", "block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = epochs.select("key", "block", "epoch", (F.col("epoch") * F.col("all_tokens") + F.coalesce(F.sum("block_tokens").over(order), F.lit(0))).alias("begin"))
    used = placed.join(begins, ["key", "block"]).withColumn("start", F.col("begin") + F.col("inside")).filter("start < quota")
    return used.select("doc_id", "key", "tokens", "row", "epoch", "start", "weight")


def mix_rows(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs with all their columns, each as often as the schedule uses it."""
    row, uses = fresh("_row", docs.columns), fresh("_uses", docs.columns)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    used = schedule(numbered, row=row, **limits).groupBy(F.col("row").alias(row)).agg(F.sequence(F.lit(1), F.count("*").cast("int")).alias(uses))
    return numbered.join(used, row).select(*docs.columns, F.explode(uses).alias(uses)).drop(uses)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("key").alias("source"), "tokens", F.col("epoch").cast("int").alias("epoch"), "start", F.round("weight", 9).alias("weight"))


SQL = f"""
WITH RECURSIVE c AS (SELECT doc_id, coalesce(source, '') AS key, (len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1)::BIGINT AS tokens FROM documents),
t AS (SELECT key, count(*) AS docs, sum(tokens)::BIGINT AS tokens, greatest(1, ceil(count(*) / {BLOCK_DOCS}.0))::BIGINT AS blocks FROM c GROUP BY key),
s AS (SELECT *, tokens / sum(tokens) OVER ()::DOUBLE AS p, sum(tokens) OVER ()::DOUBLE AS total, count(*) OVER () AS n FROM t),
b(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN low ELSE mid END, CASE WHEN f THEN mid ELSE high END FROM (
    SELECT i, low, high, mid, (SELECT (ln(sum(pow(p, mid))) - mid * sum(pow(p, mid) * ln(p)) / sum(pow(p, mid)) <= {ENTROPY} * ln(max(n)) + 1e-12) AND (pow(min(p), mid - 1) / sum(pow(p, mid)) <= {REPEATS}) FROM s) AS f
    FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE i < {STEPS}))),
z AS (SELECT CASE WHEN (SELECT ln(count(*)) <= {ENTROPY} * ln(count(*)) + 1e-12 AND 1 / min(p) / count(*) <= {REPEATS} FROM s) THEN 0 ELSE (SELECT high FROM b WHERE i = {STEPS}) END AS a),
w AS (SELECT s.*, pow(p, a) / (SELECT sum(pow(p, a)) FROM s) AS weight FROM s, z),
q AS (SELECT *, floor(weight * total)::BIGINT AS quota FROM w),
d AS (SELECT c.*, quota, weight, q.tokens AS all_tokens, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block FROM c JOIN q USING (key)),
e AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY key, block ORDER BY doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM d),
k AS (SELECT key, block, sum(tokens) AS block_tokens, any_value(quota) AS quota, any_value(all_tokens) AS all_tokens FROM d GROUP BY key, block),
x AS (SELECT *, unnest(range(0, greatest(1, ceil(quota / all_tokens))::BIGINT)) AS epoch FROM k WHERE quota > 0),
y AS (SELECT *, epoch * all_tokens + coalesce(sum(block_tokens) OVER (PARTITION BY key, epoch ORDER BY ('0x' || substr(md5(key || '|' || epoch || '|' || block), 1, 8))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM x)
SELECT doc_id, key AS source, tokens, epoch::INT AS epoch, (begin + inside)::BIGINT AS start, round(weight, 9) AS weight FROM e JOIN y USING (key, block) WHERE begin + inside < e.quota
"""
