"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Expectation
maximisation over the counts of all vote patterns of the whole table (3 to the
power of the number of labellers at most) estimates how often each labeller
votes which way on good and on bad documents, and with that a posterior for
each pattern.  The posteriors of SAMPLE documents, those with the least hash
of their id, train a linear scorer on hashed word shapes, endings and words;
it scores every document, whole.

Edge cases: a text without words (null, empty or blank) scores 0 and is
rejected; repeated rows count as often as they occur; other columns don't
matter (with keep_columns, the operator's own get other names where theirs are
taken); an empty table gives an empty result, and with only one class in the
sample the posterior decides alone.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, cut, fresh, mix64, read_table, text_parts, WordHasher
from .op1_quality_rules import text_counts

#: Documents that train the scorer, at most.
SAMPLE = 4096
#: Hashed features.
BUCKETS = 4096
EM_STEPS = 200
#: Prior share of good documents that a labeller calls bad.
FALSE_ALARM = 0.005
#: What that prior weighs, in documents.
PRIOR_DOCS = 500
STEPS = 300
THRESHOLD = 0.5

LABELLERS = ("symbols", "capitals", "exclamation", "repetition", "runs", "bars", "plain_words", "repeated_lines", "too_short")


def byte_classes() -> dict[str, np.ndarray]:
    flags = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "bang", "bar", "plain")}
    flags["symbol"][list(b"#*$%&|<>")] = True
    flags["upper"][65:91] = True
    flags["letter"][65:91] = flags["letter"][97:123] = flags["letter"][128:] = True
    flags["bang"][ord("!")] = True
    flags["bar"][ord("|")] = True
    flags["plain"] = flags["letter"].copy()
    flags["plain"][list(b".,;:'?-")] = True
    return flags


def same_as_before(hasher: WordHasher) -> np.ndarray:
    """For each word whether it is the one before it in its text."""
    w = hasher.words
    same = np.concatenate(([False], w[1:] == w[:-1])) if len(w) else np.zeros(0, bool)
    firsts = hasher.word_offsets[:-1]
    same[firsts[firsts < len(w)]] = False
    return same


def votes(hasher: WordHasher, part: list[bytes], flags: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes for each text: 1 good, -1 bad, 0 none."""
    n_words, _, n_symbols, n_dup, n_lines, n_repeat = text_counts(hasher, part, flags["symbol"])
    buf = hasher.buffer
    words = np.maximum(n_words, 1)
    letters = np.maximum(hasher.per_text(flags["letter"][buf]), 1)
    odd = ~hasher.blank & ~flags["plain"][buf]
    seen = np.concatenate(([0], np.cumsum(odd)))
    odd_word = seen[hasher.ends] > seen[hasher.starts]
    odd_words = np.diff(np.concatenate(([0], np.cumsum(odd_word)))[hasher.word_offsets])

    runs = np.diff(np.concatenate(([0], np.cumsum(same_as_before(hasher))))[hasher.word_offsets])

    def vote(share: np.ndarray, good: float, bad: float, least: int = 1) -> np.ndarray:
        return np.where(n_words < least, 0, np.where(share <= good, 1, np.where(share >= bad, -1, 0)))

    return np.stack([
        vote(n_symbols / words, 0.02, 0.1),
        vote(hasher.per_text(flags["upper"][buf]) / letters, 0.15, 0.3, 3),
        vote(hasher.per_text(flags["bang"][buf]) / words, 0.02, 0.2),
        vote(n_repeat / words, 0.05, 0.2, 10),
        vote(runs / words, 0.03, 0.2, 3),
        vote(hasher.per_text(flags["bar"][buf]) / words, 0.01, 0.1),
        vote(odd_words / words, 0.05, 0.2),
        np.where(n_dup > 0.3 * np.maximum(n_lines, 1), -1, 0),
        np.where(n_words == 0, -1, 0),
    ], axis=1).astype(np.int8)


def features(hasher: WordHasher, part: list[bytes], shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of the loaded part, sorted, with the square root of their share of the text's words."""
    n = len(part)
    text = np.repeat(np.arange(n), np.diff(hasher.word_offsets))
    shaped = shape[hasher.buffer].astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((shaped + np.uint64(1)) * hasher.power[: len(shaped)], dtype=np.uint64)))

    def hashed(starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * hasher.inverse[starts] + np.uint64(kind))

    starts, ends = hasher.starts, hasher.ends
    same = same_as_before(hasher)
    run = mix64(np.full(int(same.sum()), 3, np.uint64))
    found = np.concatenate((hashed(np.maximum(ends - 3, starts), ends, 1), hashed(starts, np.minimum(starts + 3, ends), 2), hasher.words, run))
    key = np.concatenate((text, text, text, text[same])) * BUCKETS + (found >> np.uint64(40)).astype(np.int64) % BUCKETS
    unique, count = np.unique(key, return_counts=True)
    of = unique // BUCKETS
    words = np.maximum(np.diff(hasher.word_offsets), 1)
    return of, unique % BUCKETS, np.sqrt(count / words[of])


def shape_of_bytes() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint8)
    shape[65:91], shape[97:123], shape[48:58], shape[128:] = ord("A"), ord("a"), ord("0"), ord("a")
    return shape


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """(share of good, table[class, labeller, vote + 1]) by expectation-maximisation.

    Bad documents are of several kinds, each seen by few labellers, so the
    labellers depend on each other.  Without a prior the two classes would
    settle on the largest kind; a Dirichlet prior of PRIOR_DOCS documents holds
    that a labeller rarely calls a good one bad (FALSE_ALARM).  Rates on both
    classes are estimated; beyond some thousand documents they outweigh it.
    """
    voted = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    total = counts.sum()
    rate = np.einsum("p,plv->lv", counts, voted)
    calm = rate[:, 1:] + 1
    believed = np.concatenate((np.full((len(rate), 1), FALSE_ALARM), (1 - FALSE_ALARM) * calm / calm.sum(axis=1, keepdims=True)), axis=1)
    posterior = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    for _ in range(steps):
        weight = np.stack((counts * (1 - posterior), counts * posterior))
        prior = (weight[1].sum() + 1) / (total + 2)
        table = np.einsum("cp,plv->clv", weight, voted) + 0.5
        table[1] += PRIOR_DOCS * believed
        table /= table.sum(axis=2, keepdims=True)
        new = pattern_posterior(patterns, prior, table)
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return prior, table


def pattern_posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    at = patterns.astype(int) + 1
    logs = [np.log(p) + np.log(table[c][np.arange(patterns.shape[1]), at]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train_scorer(x: np.ndarray, target: np.ndarray, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both classes weigh the same."""
    good = target.sum()
    weight = np.where(target > 0.5, 0.5 / max(good, 1), 0.5 / max(len(target) - good, 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1] + 1, np.float64), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        slope = (p - target) * weight
        gradient = np.append(x.T @ slope.astype(np.float32), slope.sum()) + decay * np.append(w[:-1], 0) / len(w)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def _texts(docs: DataFrame) -> DataFrame:
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id and pattern: the votes as digits 0 (bad), 1 (none), 2 (good) of a number to base 3."""

    def read(batches):
        hasher, flags = WordHasher(), byte_classes()
        power = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for first, part in text_parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array((votes(hasher, part, flags).astype(np.int64) + 1) @ power)], names=["doc_id", "pattern"])

    return _texts(docs).mapInArrow(read, "doc_id long, pattern long")


def unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def fit(docs: DataFrame) -> tuple[float, np.ndarray, np.ndarray, float, bool]:
    """(share of good, labellers' table, scorer's weights, its bias, whether it has seen both classes)."""
    counted = vote_table(docs).groupBy("pattern").count().collect()  # 3 ** len(LABELLERS) rows at most
    patterns = unpack(np.array([r.pattern for r in counted], np.int64))
    prior, table = fit_accuracies(patterns, np.array([r["count"] for r in counted], float)) if counted else (0.5, np.full((2, len(LABELLERS), 3), 1 / 3))

    def sample_features(batches):
        hasher, flags, shape = WordHasher(), byte_classes(), shape_of_bytes()
        for batch in batches:
            for _, part in text_parts(batch.column(1)):
                vote = votes(hasher, part, flags)
                of, bucket, value = features(hasher, part, shape)
                at = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pattern_posterior(vote, prior, table)), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))], names=["posterior", "bucket", "value"])

    ids = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    sample = _texts(docs).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # SAMPLE rows at most
    x, target = np.zeros((SAMPLE, BUCKETS), np.float32), np.zeros(SAMPLE)
    n = 0
    for row in sample.mapInArrow(sample_features, "posterior double, bucket array<int>, value array<float>").limit(SAMPLE).toLocalIterator():
        x[n, row.bucket] = row.value
        target[n] = row.posterior
        n += 1
    both = bool(n) and target[:n].min() < 0.5 <= target[:n].max()
    w, b = train_scorer(x[:n], target[:n]) if both else (np.zeros(BUCKETS, np.float32), 0.0)
    return prior, table, w, b, both


SCHEMA = "doc_id long, posterior double, score double, quality boolean"


def classify(docs: DataFrame, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """doc_id, the labellers' posterior, the scorer's score and the verdict; keep_columns: as the last three, after all columns of docs."""
    prior, table, w, b, both = fit(docs)
    names = docs.columns
    own = [fresh(x, names if keep_columns else []) for x in ("posterior", "score", "quality")]
    taken = fresh("_text", names + own)

    def score(batches):
        hasher, flags, shape = WordHasher(), byte_classes(), shape_of_bytes()
        for batch in batches:
            for first, part in text_parts(batch.column(len(batch.columns) - 1)):
                vote = votes(hasher, part, flags)
                posterior = pattern_posterior(vote, prior, table)
                of, bucket, value = features(hasher, part, shape)
                total = np.bincount(of, weights=value * w[bucket], minlength=len(part)) + b
                filled = np.diff(hasher.word_offsets) > 0
                scored = np.where(filled, 1 / (1 + np.exp(-np.clip(total, -700, 700))) if both else posterior, 0.0)
                kept = [c.slice(first, len(part)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(posterior), pa.array(scored), pa.array(scored >= threshold)], names=[*batch.schema.names[:-1], *own])

    read = F.col("text").cast("string").alias(taken)
    if not keep_columns:
        return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), read).mapInArrow(score, SCHEMA)
    frame = bound_batches(docs).select(*names, read)
    schema = frame.drop(taken).select("*", *(F.lit(None).cast(kind).alias(x) for x, kind in zip(own, ("double", "double", "boolean")))).schema
    return frame.mapInArrow(score, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "quality")
