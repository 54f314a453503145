"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training documents are quantised to
powers of two; a count of level q is stored as q memberships (n-gram, 1) to
(n-gram, q) of one Bloom filter.  The filter is broadcast; a level is read
back by repeated membership probes until one fails.  Pair probabilities are
Dirichlet-smoothed towards the word probabilities, and a text's score mixes
both orders: log10(PAIR_SHARE * P_pairs + (1 - PAIR_SHARE) * P_words).

The filter has 8 bits for each training token at any size, in segments by the
n-gram's top bits.  Up to MAX_FILTER_BITS (128 MB) it is broadcast; a larger one
stays a table of segments, and each block of texts joins its n-grams with the
segments and gets their levels back, so both ways give the same scores.  Exact
word counts are broadcast for at most TOP_WORDS words; all rarer ones are joined,
so the base score is exact at any size; the score takes all counts from the
filter.  Words are told apart by 64-bit hashes, n-grams by their segment and 32
bits more.  Counts are those of the filter's levels and a text's mixture is of its
two whole products, so the probabilities of all texts needn't sum to one.

Edge cases: a null or empty text has the end token only; repeated rows count
as often as they occur; without training documents N and V are 0 and scores
follow from the formulas; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, cut, mix64, read_table, text_parts, WordHasher

FOLDS, HELD_OUT_FOLD = 5, 1
TOP_WORDS = 1 << 20
BITS_PER_TOKEN = 8
#: The largest filter that is broadcast.
MAX_FILTER_BITS = 1 << 30
PRIOR_WEIGHT = 8.0
PAIR_SHARE = 0.5
#: N-grams a task counts before it hands them on.
FLUSH = 1 << 21
#: Training tokens for each segment of the filter, and the bounds of their number (a power of two).
SEGMENT_TOKENS, MIN_SEGMENTS, MAX_SEGMENTS = 1 << 22, 256, 1 << 16

#: Hashes of the tokens that aren't words.
END, START = np.uint64(0x1C69B3F74AC4AE35), np.uint64(0x3C6EF372FE94F82B)
PAIR, SINGLE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
LEVEL = np.uint64(0xD6E8FEB86659FD93)


def token_stream(hasher: WordHasher, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then the end), the token before each, and the texts' offsets."""
    hasher.load(part)
    n = len(part)
    offsets = hasher.word_offsets + np.arange(n + 1)
    tokens = np.empty(len(hasher.words) + n, np.uint64)
    place = np.ones(len(tokens), bool)
    place[offsets[1:] - 1] = False
    tokens[place] = hasher.words
    tokens[~place] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = START
    return tokens, before, offsets


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(before * PAIR + token)


def single_key(token: np.ndarray) -> np.ndarray:
    return mix64(token * SINGLE + LEVEL)


def _select(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash, as a signed long) and n of all training tokens."""

    def count(batches):
        hasher, held = WordHasher(lower=True), []

        def flush():
            words, n = _merge(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        size = 0
        for batch in batches:
            for _, part in text_parts(batch.column(0)):
                words, n = np.unique(token_stream(hasher, part)[0], return_counts=True)
                held.append((words, n.astype(np.int64)))
                size += len(words)
                if size > FLUSH:
                    held[:] = [_merge(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return training.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of one segment: the top 32 bits of each, a byte of count, and the counts of 255 or more again."""
    large = np.flatnonzero(counts >= 255)
    head = np.array([len(keys), len(large)], "<u4").tobytes()
    return b"".join((head, _pack(keys), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes()))


def _unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(raw, "<u4", 2)
    n, m, at = int(n), int(m), 8
    keys = np.frombuffer(raw, "<u4", n, at).astype(np.uint64) << np.uint64(32)
    counts = np.frombuffer(raw, np.uint8, n, at + 4 * n).astype(np.int64)
    at += 5 * n
    counts[np.frombuffer(raw, "<u4", m, at)] = np.frombuffer(raw, "<i8", m, at + 4 * m)
    return keys, counts


def ngram_blobs(training: DataFrame, segments: int) -> DataFrame:
    """Counts of words and pairs, packed for each segment of the keys' top bits."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def count(batches):
        hasher, held, size = WordHasher(lower=True), [], 0

        def flush():
            keys, n = _merge(held)
            held.clear()
            cuts = np.searchsorted(keys >> shift, np.arange(segments + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            # The segment's own bits go; those that follow are kept.
            kept = keys << (np.uint64(64) - shift)
            for some in np.array_split(full, max(1, len(full) // 256)):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_blob(kept[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())], names=["segment", "grams"])

        for batch in batches:
            for _, part in text_parts(batch.column(0)):
                tokens, before, _ = token_stream(hasher, part)
                keys, n = np.unique(np.concatenate((pair_key(before, tokens), single_key(tokens))), return_counts=True)
                held.append((keys, n.astype(np.int64)))
                size += len(keys)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return training.select("text").mapInArrow(count, "segment int, grams binary")


class LogFilter:
    """A log-frequency Bloom filter in segments of equal size."""

    def __init__(self, bits: np.ndarray, segments: int, hashes: int):
        self.bits, self.segments, self.hashes = bits, segments, hashes
        self.shift = np.uint64(64 - (segments.bit_length() - 1))
        self.size = len(bits) * 8 // segments

    @classmethod
    def sized(cls, n_tokens: int) -> LogFilter:
        """A filter for n_tokens training tokens, without its bits."""
        segments = 1 << max(0, (max(1, n_tokens // SEGMENT_TOKENS) - 1).bit_length())
        segments = min(max(segments, MIN_SEGMENTS), MAX_SEGMENTS)
        size = max(64, BITS_PER_TOKEN * n_tokens // segments // 8 * 8)
        hashes = min(max(1, round(size * segments / max(n_tokens, 1) * 0.69)), 6)
        out = cls(np.zeros(0, np.uint8), segments, hashes)
        out.size = size
        return out

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments of keys, and what is told apart within them."""
        return (keys >> self.shift).astype(np.int64), _kept(keys << (np.uint64(64) - self.shift))

    def places(self, keys: np.ndarray, level: int):
        """Bit places of (key, level) within the key's segment, one array for each hash."""
        h = mix64(keys + np.uint64(int(LEVEL) * level & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(self.size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all memberships hold."""
        segment, rest = self.split(keys)
        return self.probe(self.bits, rest, segment * self.size)

    def probe(self, bits: np.ndarray, rest: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Levels of keys whose segments begin at the bits base."""
        out, alive, level = np.zeros(len(rest), np.int64), np.arange(len(rest)), 1
        while len(alive) and level < 64:
            here, key = base[alive], rest[alive]
            hit = np.ones(len(alive), bool)
            for p in self.places(key, level):
                p = p.astype(np.int64) + here
                hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & np.uint8(1)).astype(bool)
            alive = alive[hit]
            out[alive] = level
            level += 1
        return out


def _kept(keys: np.ndarray) -> np.ndarray:
    """What a blob keeps of a key: its top 32 bits."""
    return keys >> np.uint64(32) << np.uint64(32)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Level of a count of one or more: 1 + floor(log2(count))."""
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Mean count of a level; 0 for what isn't stored."""
    return np.where(levels > 0, 0.75 * np.exp2(levels.astype(np.float64)) - 0.5, 0.0)


def filter_segments(training: DataFrame, frame: LogFilter) -> DataFrame:
    """segment and bits of the filter; a segment without n-grams has no row."""

    def fill(table: pa.Table) -> pa.Table:
        keys, counts = _merge([_unblob(x) for x in table.column("grams").to_pylist()])
        level, bits = quantise(counts), np.zeros(frame.size, np.uint8)
        for q in range(1, int(level.max(initial=0)) + 1):
            for p in frame.places(keys[level >= q], q):
                bits[p.astype(np.int64)] = 1
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return ngram_blobs(training, frame.segments).groupBy("segment").applyInArrow(fill, "segment int, bits binary")


def collect_filter(built: DataFrame, frame: LogFilter) -> LogFilter:
    bits = np.zeros((frame.segments, frame.size // 8), np.uint8)
    for segment, raw in zip(*(c.to_pylist() for c in built.toArrow().columns)):  # MAX_FILTER_BITS / 8 bytes at most
        bits[segment] = np.frombuffer(raw, np.uint8)
    return LogFilter(bits.ravel(), frame.segments, frame.hashes)


def _blocks(batches):
    """(block, mark, batch, first, part) of each part of texts; mark is a checksum that tells whether two reads of docs agree."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, part in text_parts(batch.column(2)):
            yield block, zlib.crc32(b"\n".join(part)), batch, first, part
            block += 1


def text_blocks(docs: DataFrame) -> DataFrame:
    """block, mark and the block's rows, as a compressed Arrow stream."""

    def read(batches):
        for block, mark, batch, first, part in _blocks(batches):
            rows = pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(part)) for k in range(2)), pa.array(part, pa.large_binary())], names=["doc_id", "held_out", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([mark]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "mark", "rows"])

    return docs.mapInArrow(read, "block long, mark long, rows binary")


def asked_segments(docs: DataFrame, frame: LogFilter, probes) -> DataFrame:
    """block, mark, segment and the n-grams that the block asks of it, sorted and packed; probes(tokens, before) gives a part's sorted keys."""

    def read(batches):
        hasher = WordHasher(lower=True)
        for block, mark, _, _, part in _blocks(batches):
            tokens, before, _ = token_stream(hasher, part)
            segment, rest = frame.split(probes(tokens, before))
            cuts = np.concatenate((np.flatnonzero(np.diff(segment, prepend=-1)), [len(segment)]))
            for k in range(0, len(cuts) - 1, 1024):
                some = cuts[k : k + 1025]
                n = len(some) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, mark)), pa.array(segment[some[:-1]].astype(np.int32)), pa.array([_pack(rest[i:j]) for i, j in zip(some[:-1], some[1:])], pa.binary())], names=["block", "mark", "segment", "keys"])

    return docs.mapInArrow(read, "block long, mark long, segment int, keys binary")


def _pack(keys: np.ndarray) -> bytes:
    """The top 32 bits of each key."""
    return (keys >> np.uint64(32)).astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.uint64) << np.uint64(32)


def joined_levels(asked: DataFrame, built: DataFrame, frame: LogFilter) -> DataFrame:
    """block, mark, segment and a byte of level for each of its keys, in their order."""
    kinds = pa.schema([("block", pa.int64()), ("mark", pa.int64()), ("segment", pa.int32()), ("levels", pa.binary())])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kinds.empty_table()
        keys = [_unpack(x) for x in left.column("keys").to_pylist()]
        rest = np.concatenate(keys)
        if right.num_rows:
            level = frame.probe(np.frombuffer(right.column("bits")[0].as_py(), np.uint8), rest, np.zeros(len(rest), np.int64)).astype(np.uint8)
        else:
            level = np.zeros(len(rest), np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        return pa.table([left.column("block"), left.column("mark"), left.column("segment"), pa.array([level[e - len(k) : e].tobytes() for e, k in zip(ends, keys)], pa.binary())], schema=kinds)

    return asked.groupBy("segment").cogroup(built.groupBy("segment")).applyInArrow(probe, "block long, mark long, segment int, levels binary")


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"


def score_documents(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS, top_words: int = TOP_WORDS, prior_weight: float = PRIOR_WEIGHT, pair_share: float = PAIR_SHARE) -> DataFrame:
    spark = docs.sparkSession
    docs = _select(docs)
    training = docs.filter(~F.col("held_out"))
    vocabulary = cut(word_counts(training))
    # Words by the power of two of their count: at most 64 rows.
    by_size = vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    n_words, n_tokens = sum(r.words for r in by_size), sum(r.tokens for r in by_size)
    power, held = 64, 0
    for r in sorted(by_size, key=lambda r: -r.power):
        if held + r.words > top_words:
            break
        power, held = r.power, held + r.words
    least = 2**power if power < 64 else 1 << 62
    top = vocabulary.filter(F.col("n") >= least).toArrow()  # top_words rows at most
    top_word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(top_word)
    n_training = int(training.count())
    frame = LogFilter.sized(n_tokens)
    built, whole = filter_segments(training, frame), frame.size * frame.segments <= max_filter_bits
    top_word, top_n = top_word[order], top.column("n").to_numpy()[order]
    top_keys, back = np.unique(single_key(top_word), return_inverse=True)
    # Frequent words are asked of the filter once, not by each block of texts.
    if whole:
        bloom = collect_filter(built, frame)
        top_level = bloom.levels(top_keys)
    else:
        bloom, built = None, cut(built)
        segment, rest = frame.split(top_keys)
        cuts = np.concatenate((np.flatnonzero(np.diff(segment, prepend=-1)), [len(segment)]))
        asked = [(0, 0, int(segment[i]), _pack(rest[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
        got = joined_levels(spark.createDataFrame(asked, "block long, mark long, segment int, keys binary"), built, frame).collect()  # a byte for each of top_words at most
        top_level = np.frombuffer(b"".join(bytes(r.levels) for r in sorted(got, key=lambda r: r.segment)), np.uint8).astype(np.int64)
    # Arrays and numbers only: what is broadcast is pickled by reference, and workers may not have the package.
    model = spark.sparkContext.broadcast((top_word, top_n, top_level[back], (bloom.bits, bloom.segments, bloom.hashes) if whole else None))
    floor = np.log10(n_tokens + 0.5 * (n_words + 1))

    def lookup(tokens):
        """Exact counts and levels of frequent words, and which those are."""
        top_word, top_n, top_level, _ = model.value
        at = np.minimum(np.searchsorted(top_word, tokens), max(len(top_word) - 1, 0))
        found = top_word[at] == tokens if len(top_word) else np.zeros(len(tokens), bool)
        return *(np.where(found, x[at] if len(top_word) else 0, 0) for x in (top_n, top_level)), found

    def probes(tokens, before):
        unique = np.unique(tokens)
        return np.unique(np.concatenate((single_key(unique[~lookup(unique)[2]]), pair_key(before, tokens))))

    def score_part(doc_id, held_out, stream, keys, levels):
        """Scores of a part's texts from the levels of its probes."""
        tokens, before, offsets = stream
        n, text = len(doc_id), np.repeat(np.arange(len(doc_id)), np.diff(offsets))
        unique, inverse = np.unique(tokens, return_inverse=True)
        count, level, found = lookup(unique)
        count = count.astype(np.float64)
        # Words' counts in score come from the filter at any size of the vocabulary; the exact ones are for the base score.
        level[~found] = levels[np.searchsorted(keys, single_key(unique[~found]))]
        estimate = count_of(level)
        log_base = np.where(found, np.log10(count + 0.5), 0.0)
        frequent = found[inverse]
        base = np.bincount(text, log_base[inverse], n)
        known = np.bincount(text, frequent, n).astype(np.int64)
        p_word = (estimate[inverse] + 0.5) / 10**floor
        context = np.empty(len(tokens))
        context[1:] = estimate[inverse][:-1]
        context[offsets[:-1]] = n_training
        pair = count_of(levels[np.searchsorted(keys, pair_key(before, tokens))])
        pair = np.minimum(pair, context)
        p_pair = (pair + prior_weight * p_word) / (context + prior_weight)
        words, pairs = (np.bincount(text, np.log10(p), n) for p in (p_word, p_pair))
        with np.errstate(divide="ignore"):
            a, b = words + np.log10(1 - pair_share), pairs + np.log10(pair_share)
        most = np.maximum(a, b)
        score = most + np.log10(10 ** (a - most) + 10 ** (b - most))
        rare = tokens[~frequent].view(np.int64)
        rare_offsets = np.concatenate(([0], np.cumsum(np.bincount(text[~frequent], minlength=n))))
        return [doc_id, held_out, pa.array(np.diff(offsets).astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(rare_offsets.astype(np.int32)), pa.array(rare))]

    names = [x.split()[0] for x in SCORED.split(", ")]

    def score(batches):
        hasher, held = WordHasher(lower=True), LogFilter(*model.value[3])
        for batch in batches:
            for first, part in text_parts(batch.column(2)):
                stream = token_stream(hasher, part)
                keys = probes(*stream[:2])
                yield pa.RecordBatch.from_arrays(score_part(batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), stream, keys, held.levels(keys)), names=names)

    hashers = []

    def score_block(texts: pa.Table, levels: pa.Table) -> pa.Table:
        texts = pa.ipc.open_stream(texts.column("rows")[0].as_buffer()).read_all().combine_chunks()
        if not hashers:
            hashers.append(WordHasher(lower=True))
        stream = token_stream(hashers[0], texts.column("text").to_pylist())
        levels = np.frombuffer(b"".join(levels.sort_by("segment").column("levels").to_pylist()), np.uint8).astype(np.int64)
        keys = probes(*stream[:2])
        if len(keys) != len(levels):
            raise ValueError("docs gave other blocks of texts when they were read again")
        return pa.table(score_part(texts.column("doc_id"), texts.column("held_out"), stream, keys, levels), names=names)

    if whole:
        rows = docs.mapInArrow(score, SCORED)
    else:
        levels = joined_levels(asked_segments(docs, frame, probes), built, frame)
        rows = text_blocks(docs).groupBy("block", "mark").cogroup(levels.groupBy("block", "mark")).applyInArrow(score_block, SCORED)
    scored = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("word"))
    joined = rare.join(vocabulary.filter(F.col("n") < least), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"), F.count("n").alias("rare_known"))
    total = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(floor))
    return scored.drop("rare").join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"), total.alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
