"""Host-level quality rules.

Per document, simple rules fail or hold.  Per host, the failures of each rule
are added up and the failure rate is shrunk by a beta prior that is fitted to
all hosts (moments of the host rates).  A host with a shrunken rate above the
limit is rejected, and its verdict is joined back to its documents.

Edge cases: a null or empty text has no words and fails ``too_short``; a null
host is a host of its own; other columns of the input are ignored; repeated
rows count as often as they occur; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, bound_batches, cut, mix64, read_table, text_parts, WordHasher

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host goes if the shrunken failure rate of any rule is above this.
HOST_LIMIT = 0.6
#: Ways into which the documents of each host are split in the join that takes the place of a broadcast.
SALTS = 64

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): keys[order] is sorted, order stable; same[i] if it equals the one before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.concatenate(([False], ranked[1:] == ranked[:-1])) if len(keys) else np.zeros(0, bool)


def text_counts(hasher: WordHasher, part: list[bytes], symbol: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of each text."""
    hasher.load(part)
    buf, n = hasher.buffer, len(part)
    n_words = np.diff(hasher.word_offsets)
    word_chars = hasher.per_text(~hasher.blank & ((buf & 0xC0) != 0x80))
    n_symbols = hasher.per_text(symbol[buf])

    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    filled = np.concatenate(([0], np.cumsum(~hasher.blank)))
    has_word = filled[ends] > filled[starts]
    starts, ends = starts[has_word], ends[has_word]
    line_text = np.searchsorted(hasher.offsets, starts, side="right") - 1
    order, same = _repeats(mix64(hasher.hash(starts, ends) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n_dup_lines = np.bincount(line_text[order[same]], minlength=n)
    n_lines = np.bincount(line_text, minlength=n)

    windows, offsets = hasher.windows(WINDOW)
    text = np.repeat(np.arange(n), np.diff(offsets))
    order, same = _repeats(mix64(windows + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    found = same.copy()
    found[:-1] |= same[1:]
    at = order[found] + (hasher.word_offsets[:-1] - offsets[:-1])[text[order[found]]]
    cover = np.bincount(at, minlength=len(hasher.words) + WINDOW + 1)
    cover[WINDOW:] -= np.bincount(at, minlength=len(hasher.words) + WINDOW + 1)[:-WINDOW]
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[: len(hasher.words)] > 0)))
    return [n_words, word_chars, n_symbols, n_dup_lines, n_lines, np.diff(covered[hasher.word_offsets])]


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row of counts for each document."""

    def count(batches):
        hasher, symbol = WordHasher(), np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        for batch in batches:
            parts = [text_counts(hasher, part, symbol) for _, part in text_parts(batch.column(2))]
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in STATS.split(", ")])

    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(count, STATS)


def rule_failures() -> dict[str, Column]:
    """The rules, by name: true where a document fails."""
    words, repeats, symbols, dups, lines = (F.col(c) for c in ("n_words", "n_repeat_words", "n_symbols", "n_dup_lines", "n_lines"))
    return {
        "too_short": words < MIN_WORDS,
        "repeated_windows": 100 * repeats > MAX_REPEAT_PERCENT * words,
        "symbols": 100 * symbols > MAX_SYMBOL_PERCENT * words,
        "repeated_lines": 100 * dups > MAX_DUP_LINE_PERCENT * lines,
    }


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each host: documents, failures and shrunken failure rate of each rule, host_kept.

    The prior beta(a, b) of a rule has the mean and the variance of the host
    rates, weighted by documents, less the variance that sampling alone would
    give; its weight a + b lies within 1 and 1000.
    """
    rules = rule_failures()
    hosts = stats.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(rule.cast("long")).alias(f"fail_{name}") for name, rule in rules.items()))
    moments = []
    for name in rules:
        n, k = F.col("n_docs").cast("double"), F.col(f"fail_{name}").cast("double")
        moments += [F.sum(k).alias(f"k_{name}"), F.sum(k * k / n).alias(f"kk_{name}")]
    total = hosts.agg(F.sum("n_docs").cast("double").alias("docs"), F.count("*").cast("double").alias("hosts"), *moments)
    priors = total.select(*(c for name in rules for c in _prior(name)))
    joined = hosts.crossJoin(F.broadcast(priors))  # priors: one row by construction
    for name in rules:
        weight = F.col(f"weight_{name}")
        joined = joined.withColumn(f"rate_{name}", (F.col(f"fail_{name}") + F.col(f"mean_{name}") * weight) / (F.col("n_docs") + weight))
    worst = F.greatest(*(F.col(f"rate_{name}") for name in rules))
    return joined.select("host", "n_docs", *(f"fail_{name}" for name in rules), *(f"rate_{name}" for name in rules), (worst <= limit).alias("host_kept"))


def _prior(name: str) -> list[Column]:
    docs, hosts = F.col("docs"), F.col("hosts")
    mean = F.col(f"k_{name}") / docs
    # Between-host variance by the method of moments; zero or less means that the hosts are alike.
    spread = F.col(f"kk_{name}") / docs - mean * mean
    noise = mean * (1 - mean) * hosts / docs
    between = spread - noise
    weight = F.when((between > 0) & (mean > 0) & (mean < 1), mean * (1 - mean) / between - 1).otherwise(F.lit(1000.0))
    return [F.coalesce(mean, F.lit(0.0)).alias(f"mean_{name}"), F.least(F.greatest(weight, F.lit(1.0)), F.lit(1000.0)).alias(f"weight_{name}")]


def host_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents with their counts, their host's shrunken rates and the verdict ``kept``."""
    stats = cut(document_stats(docs, host))
    verdicts = cut(host_verdicts(stats, limit))
    n_hosts = verdicts.count()
    rules = rule_failures()
    base_failed = rules["too_short"] | rules["repeated_windows"]
    v = verdicts.select(F.col("host").alias("v_host"), "host_kept", *(f"rate_{name}" for name in rules))
    if n_hosts <= broadcast_rows:
        joined = stats.join(F.broadcast(v), F.col("host").eqNullSafe(F.col("v_host")), "left")
    else:  # hot hosts: their documents are salted, the verdicts repeated for each salt
        v = v.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(v, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("salt") == F.col("v_salt")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.coalesce("host_kept", F.lit(True))).alias("kept"), F.col("host").alias("source"), *(f"rate_{name}" for name in rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_quality(read_table(spark, sf_dir, "documents"))
    worst = F.greatest(*(F.col(f"rate_{name}") for name in rule_failures()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.round(worst, 6).alias("host_rate"))


#: DuckDB: base counts, rules, the moments of the host rates, and the verdicts.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g2 WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 10)::INT AS f1, (100 * n_repeat_words > 20 * n_words)::INT AS f2, (100 * n_symbols > 10 * n_words)::INT AS f3, (100 * n_dup_lines > 30 * n_lines)::INT AS f4 FROM s),
h AS (SELECT source, count(*)::DOUBLE AS n, unnest([1, 2, 3, 4]) AS r, unnest([sum(f1), sum(f2), sum(f3), sum(f4)])::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT r, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS second, count(*) / sum(n) AS per FROM h GROUP BY r),
v AS (SELECT r, mean, second - mean * mean - mean * (1 - mean) * per AS between FROM m),
p AS (SELECT r, mean, CASE WHEN between > 0 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / between - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM v),
k AS (SELECT source, max((k + mean * weight) / (n + weight)) AS rate FROM h JOIN p USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 = 1 OR f2 = 1) AS base_failed,
       (f1 = 0 AND f2 = 0 AND rate <= 0.6) AS kept, f.source, round(rate, 6) AS host_rate FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source
"""
