"""Exact Jaccard join on word n-grams, by universe partition and the pigeonhole principle.

Two sets of sizes a and b with 100 * intersection >= percent * union differ in
at most (a + b) * (100 - percent) / (100 + percent) elements.  Sizes are cut
into bands such that only sets of one band or of neighbouring bands can link.
For each band the universe of shingles is hashed into segments.  Each set
indexes its subset of every segment of its band and, for the segments that have
deletions, the one-deletion neighbourhood.  As the smaller set of a pair it
spends units on the segments of its own and of the next band: 1 unit asks for an
equal subset, 2 ask for a subset that differs in one element, 0 skip the
segment.  If the units exceed the largest possible difference, every linked
set is met in at least one segment.  A set spends its units where lists are
short: the length of a segment's list is bounded by the count of its rarest
shingle (of its second rarest, for deletions), taken from a fixed-size count
sketch of all shingles, so empty segments and those of common passages are
skipped.  How many segments a band has, and how many of them with deletions, is
chosen by cost from the number of its sets.

Equal word sequences are one class from the start.  Sets that meet are first
compared with one of them, the one that meets most others; what this links is one
label.  Where sets of several labels meet, all pairs of different labels are
compared.  A comparison is first of sketches (counts of elements in some cells,
whose distance bounds the difference from below) and then, for the pairs left,
of the words themselves.  No texts move but those of pairs whose sketches agree.

Edge cases: a null text or one without words has an empty set and is linked
with nothing; a text with fewer words than a shingle has its whole sequence as
its one element; rows with the same doc_id count as one document; other
columns don't matter; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_ROWS, bound_batches, cut, mix64, read_table, text_parts, WordHasher
from .graph import components

WORDS = 3
PERCENT = 90
#: Partners of a set in a block of texts, and members of a block of sketches.
BLOCK_PAIRS, BLOCK_SETS = 64, 256
#: Signatures a task holds before it ships them.
HELD = 1 << 18
#: Cost of a pair that meets by chance, in signatures shipped.
PAIR_COST = 0.25
#: Counters of shingles for the lengths of lists, and the blocks in which they are added up.
COUNTER_BITS, COUNTER_BLOCKS = 20, 64
#: A signature's kind: units spent on it (a deletion's: 1 if it is asked for), plus these.
DELETION, ASKS_ONLY = 4, 8

PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(hasher: WordHasher, part: list[bytes], k: int) -> tuple:
    """Distinct shingle hashes of all texts, text by text; their numbers; and two hashes of each word sequence."""
    hasher.load(part)
    n, words = len(part), hasher.words
    windows, offsets = hasher.windows(k)
    n_words = np.diff(hasher.word_offsets)
    sequence = []
    hasher.grow(len(words) + 1)
    for w in (words, mix64(words ^ PRIME)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * hasher.power[: len(w)], dtype=np.uint64)))
        at = hasher.word_offsets
        sequence.append(mix64((sums[at[1:]] - sums[at[:-1]]) * hasher.inverse[at[:-1]] + n_words.astype(np.uint64) * PRIME))
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    values = np.concatenate((windows, sequence[0][short]))
    text = np.concatenate((np.repeat(np.arange(n), np.diff(offsets)), short))
    key = mix64(values + text.astype(np.uint64) * PRIME)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = order[np.concatenate(([True], ranked[1:] != ranked[:-1]))] if len(order) else order
    first = np.sort(first)
    first = first[np.argsort(text[first], kind="stable")]
    return values[first], np.bincount(text[first], minlength=n), np.array(sequence).T if n else np.zeros((0, 2), np.uint64)


def sketches(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Elements of each set in each of its cells (by the hash's top bits, a power of two of them, size to twice the size), up to 255."""
    bits = np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)
    ends = np.cumsum(1 << bits)
    text = np.repeat(np.arange(len(sizes)), sizes)
    cell = (values >> (64 - bits[text]).astype(np.uint64)).astype(np.int64) + (ends - (1 << bits))[text]
    cells = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells.tobytes())])


def cells_of(blobs: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width or more as rows of this width; what is folded is cut off at 255 too, so distances still bound from below."""
    out = np.empty((len(blobs), width), np.int16)
    for wide in {len(b) for b in blobs}:
        at = [i for i, b in enumerate(blobs) if len(b) == wide]
        rows = np.frombuffer(b"".join(blobs[i] for i in at), np.uint8).reshape(len(at), wide).astype(np.int16)
        while rows.shape[1] > width:
            rows = np.minimum(rows[:, 0::2] + rows[:, 1::2], 255)
        out[at] = rows
    return out


def sequence_classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the word sequence's hashes d1, d2, and the sketch of each document."""

    def read(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            for first, part in text_parts(batch.column(1)):
                values, sizes, sequence = shingle_sets(hasher, part, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(sizes.astype(np.int64)), *(pa.array(np.ascontiguousarray(sequence[:, i]).view(np.int64)) for i in (0, 1)), sketches(values, sizes)], names=["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.mapInArrow(read, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


class Bands:
    """Size bands, and for each the number of segments and of those with deletions."""

    def __init__(self, percent: int, sizes: dict[int, int]):
        self.percent = percent
        self.low, low = [], 1
        while low <= max(sizes, default=0):
            self.low.append(low)
            low = low * 100 // percent + 1
        self.low.append(low)
        n = np.array(sorted(sizes), np.int64)
        sets = np.bincount(self.of(n), weights=[sizes[x] for x in n.tolist()], minlength=len(self.low) + 1) if len(n) else np.zeros(len(self.low) + 1)
        self.plan = [self.allocate(self.low[t], self.low[t + 1] - 1, sets[t] + (sets[t - 1] if t else 0)) for t in range(len(self.low) - 1)] + [(1, 0)]
        self.filled = sets > 0

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def difference(self, a, b):
        """The most elements in which linked sets of these sizes can differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def units(self, n: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Units that a set of size n spends to meet all linked sets of its size or more in a band."""
        high = np.array(self.low + self.low[-1:])[table + 1] - 1
        return self.difference(n, np.minimum(high, n * 100 // self.percent)) + 1

    def allocate(self, low: int, high: int, sets: float) -> tuple[int, int]:
        """(segments, of these with deletions) of least cost for sets of these sizes.

        The cost is signatures shipped, plus the units that can't be spent on
        segments of three elements or more (four, for deletions), each at
        PAIR_COST times the list met there: of an empty segment, all sets that
        have it empty; of one or two elements, a list that grows more slowly.
        """
        need, n = self.difference(high, high) + 1, max(low, (low + high) // 2)
        best = None
        for segments in sorted({max(1, math.ceil(need * x / 20)) for x in range(10, 27)}):
            share = [math.comb(n, i) * (1 / segments) ** i * (1 - 1 / segments) ** (n - i) if segments > 1 else float(i == n) for i in range(4)]
            lists = [max(1.0, sets * share[0]), max(1.0, sets**0.5), max(1.0, sets**0.25)]
            for deletions in sorted({math.ceil(segments * x / 20) for x in range(21)}):
                if segments + deletions < need:
                    continue
                lack, cost = max(0.0, need - segments * (1 - sum(share[:3])) - deletions * (1 - sum(share))), segments + deletions * n / segments
                for i in (2, 1, 0):
                    cost += min(lack, segments * share[i]) * lists[i] * PAIR_COST
                    lack = max(0.0, lack - segments * share[i])
                cost += lack * lists[0] * PAIR_COST
                if best is None or cost < best[0]:
                    best = cost, segments, deletions
        return best[1], best[2]


#: Cost of a unit on a segment of so few elements (beyond all counts), for an equal subset and for one that differs in an element.
POOR_EQUAL = np.array([100_000, 1_000, 100] + [0] * 13)
POOR_DELETION = np.array([200_000, 100_000, 1_000, 100] + [0] * 12)


def signatures(values: np.ndarray, sizes: np.ndarray, level: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, kind) of all sets of a part: what they index and ask for in their own band, what they ask for in the next."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8))]
    own = bands.of(sizes)
    segments_of, deletions_of = np.array(bands.plan, np.int64).T
    for shift in (0, 1):
        table = np.minimum(own + shift, len(bands.plan) - 1)
        low = np.array(bands.low)[table]
        takes = (sizes > 0) & (own + shift < len(bands.plan)) & ((shift == 0) | (bands.filled[table] & (sizes * 100 >= low * bands.percent)))
        chosen = np.flatnonzero(takes)
        if not len(chosen):
            continue
        t = table[chosen]
        m, x = segments_of[t], deletions_of[t]
        base = np.concatenate(([0], np.cumsum(m)))
        slots = int(base[-1])
        member = np.repeat(takes, sizes)
        h, counts = values[member], level[member].astype(np.int64)
        text = np.repeat(np.arange(len(chosen)), sizes[chosen])
        mixed = mix64(h ^ PRIME)
        slot = base[text] + (((h >> np.uint64(32)) * m[text].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(slots, np.uint64)
        for bits in (np.uint64(0), np.uint64(32)):  # sums of 32-bit halves are exact in doubles
            half = np.bincount(slot, weights=((mixed >> bits) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=slots)
            total += half.astype(np.uint64) << bits
        held = np.bincount(slot, minlength=slots)
        ranked = np.append(counts[np.argsort(slot * 64 + counts, kind="stable")], (0, 0))
        first = np.cumsum(held) - held
        rarest, second = (np.where(held > i, ranked[np.minimum(first + i, len(h))], 0) for i in (0, 1))
        of = np.repeat(np.arange(len(chosen)), m)
        segment, few = np.arange(slots) - base[of], np.minimum(held, 15)
        has = segment < x[of]
        equal = rarest * 16 - few + POOR_EQUAL[few]
        lacking = np.maximum(second * 16 - few + 48 + POOR_DELETION[few], equal + 1)[has]
        cost, at = np.concatenate((equal, lacking)), np.concatenate((np.arange(slots), np.flatnonzero(has)))
        order = np.lexsort((cost, of[at]))
        rank = np.arange(len(order)) - (np.cumsum(m + x) - m - x)[of[at[order]]]
        spent = rank < bands.units(sizes[chosen], t)[of[at[order]]]
        units = np.bincount(at[order[spent]], minlength=slots)
        name = mix64((t[of].astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64) + np.uint64(1))
        kind = units + ASKS_ONLY * shift
        shown = np.arange(slots) if shift == 0 else np.flatnonzero(units > 0)
        found.append((mix64(total[shown] ^ name[shown]), chosen[of[shown]], kind[shown].astype(np.int8)))
        lacks = np.flatnonzero(has[slot] if shift == 0 else units[slot] == 2)
        at = slot[lacks]
        found.append((mix64((total[at] - mixed[lacks]) ^ name[at]), chosen[text[lacks]], (DELETION + (units[at] == 2) + ASKS_ONLY * shift).astype(np.int8)))
    return tuple(np.concatenate(x) for x in zip(*found))


def shingle_levels(docs: DataFrame, k: int) -> np.ndarray:
    """floor(log2) of the summed set counts of all shingles, by the top bits of their hashes: 2 ** COUNTER_BITS bytes at any size of the table."""
    width = (1 << COUNTER_BITS) // COUNTER_BLOCKS

    def count(batches):
        hasher, total = WordHasher(lower=True), np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, part in text_parts(batch.column(1)):
                values, _, _ = shingle_sets(hasher, part, k)
                total += np.bincount((values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS)
        for block, one in enumerate(total.reshape(COUNTER_BLOCKS, width)):
            if one.any():  # a byte for each counter; counts of 255 or more again
                large = np.flatnonzero(one >= 255)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.minimum(one, 255).astype(np.uint8), large.astype("<u2"), one[large].astype("<i8")))], names=["block", "n", "at", "large"])

    def add(batches):
        blocks = {}
        for batch in batches:
            for block, n, at, large in zip(*(c.to_pylist() for c in batch.columns)):
                one = np.frombuffer(n, np.uint8).astype(np.int64)
                one[np.frombuffer(at, "<u2")] = np.frombuffer(large, "<i8")
                blocks[block] = blocks.get(block, 0) + one
        for block, total in blocks.items():
            level = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    out = np.zeros((COUNTER_BLOCKS, width), np.uint8)
    for row in docs.mapInArrow(count, "block int, n binary, at binary, large binary").repartition("block").mapInArrow(add, "block int, level binary").collect():
        out[row.block] = np.frombuffer(row.level, np.uint8)
    return out.ravel()


def meetings(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """(signature, id, whole): the members of each signature under which some set asks for what another indexes; whole is false for deletions."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, k))

    def read(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in text_parts(batch.column(1), HELD):
                values, sizes, _ = shingle_sets(hasher, part, k)
                signature, text, kind = signatures(values, sizes, levels.value[(values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], bands)
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(ids[first + text].astype(np.int64)), pa.array(kind)], names=["signature", "id", "kind"])

    rows = docs.mapInArrow(read, "signature long, id long, kind byte")
    whole, index = F.expr(f"kind & {DELETION} = 0"), F.expr(f"kind & {ASKS_ONLY} = 0")
    units = F.expr("kind & 3")
    mask = F.when(whole & index, 1).otherwise(0) + F.when(whole & (units >= 1), 2).otherwise(0) + F.when(whole & (units == 2), 4).otherwise(0) + F.when(~whole & index, 8).otherwise(0) + F.when(~whole & (units == 1), 16).otherwise(0)
    group = Window.partitionBy("signature")
    rows = rows.select("signature", "id", whole.alias("whole"), F.bit_or(mask).over(group).alias("mask"), F.count(F.when(whole, 1)).over(group).alias("wholes"))
    has = lambda bits: F.col("mask").bitwiseAND(bits) == bits
    return rows.filter((F.col("wholes") >= 2) & has(3) | has(4 + 8) | has(16 + 1)).select("signature", "id", "whole")


def similar_sizes(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter(similar_sizes(F.col("na"), F.col("nb"), percent))

    def compare(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            shape = np.array([(min(len(x), len(y)), max(len(x), len(y))) for x, y in zip(sa, sb)], np.int64).reshape(-1, 2)
            for width in np.unique(shape[:, 0]):
                at = np.flatnonzero(shape[:, 0] == width)
                for some in np.array_split(at, len(at) * int(width) // (1 << 22) + 1):
                    differ = np.abs(cells_of([sa[i] for i in some], int(width)) - cells_of([sb[i] for i in some], int(width))).sum(axis=1)
                    most = np.array([(na[i] + nb[i]) * (100 - percent) // (100 + percent) for i in some], np.int64)
                    keep.append(some[differ <= most])
            keep = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(compare, "a long, b long").distinct()


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted ids of the distinct shingles of each text; ids stand for the words themselves."""
    ids: dict[bytes, int] = {}
    rows = [np.fromiter((ids.setdefault(w, len(ids)) for w in _split(t.lower())), np.int64) for t in texts]
    bits = max(1, len(ids).bit_length())
    out, other = [], {}
    for row in rows:
        if len(row) >= k and bits * k <= 62:
            key = row[: len(row) - k + 1]
            for j in range(1, k):
                key = (key << bits) | row[j : len(row) - k + 1 + j]
        else:
            parts = {tuple(row[i : i + k].tolist()) for i in range(max(1, len(row) - k + 1))} if len(row) else set()
            key = np.array([-1 - other.setdefault(p, len(other)) for p in parts], np.int64)
        out.append(np.unique(key))
    return out


_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _split(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_BLANKS).split(b" ") if w]


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their words.

    The partners of a are dealt in blocks of about BLOCK_PAIRS, and each block gets the text of a once.
    """
    pairs = cut(pairs)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_PAIRS).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    members = cut(dealt.select("a", "block", F.explode(F.array("a", "b")).alias("node")).distinct())
    placed = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = docs.join(placed, docs.doc_id == placed.node).select("a", "block", (F.col("node") != F.col("a")).alias("partner"), "node", "text")

    def compare(batches):
        key, hubs, held, size = None, [], [], 0

        def done():
            if not hubs or not held:
                return [], []
            sets = exact_sets(hubs + [t for _, t in held], k)
            found = []
            for s, (node, _) in zip(sets[len(hubs) :], held):
                for h in sets[: len(hubs)]:
                    common = np.intersect1d(s, h, assume_unique=True).size
                    if common and 100 * common >= percent * (len(s) + len(h) - common):
                        found.append(node)
                        break
            return [key[0]] * len(found), found

        for batch in batches:
            found = [], []
            for a, block, partner, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.large_binary()).to_pylist()):
                if key != (a, block) or size > 1 << 22:
                    for x, y in zip(found, done()):
                        x += y
                    hubs, held, size = hubs if key == (a, block) else [], [], 0
                    key = a, block
                if partner:
                    held.append((node, text or b""))
                else:
                    hubs.append(text or b"")
                size += len(text or b"")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done()], names=["a", "b"])

    return texts.repartition("a", "block").sortWithinPartitions("a", "block", "partner", "node").mapInArrow(compare, "a long, b long").distinct()


def pairs_across(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb, differ): pairs of different labels that meet, whose sizes and sketches allow a link.

    met: signature, id, label.  A signature with more than BLOCK_SETS members is
    compared block by block, so only sketches are shipped more than once.
    """
    sizes = met.groupBy("signature").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = met.join(sizes, "signature").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.join(sets.select(F.col("doc_id").alias("id"), "n_shingles", "sketch"), "id").select("signature", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "id", "label", (F.col("block") == F.greatest("block", "with")).alias("second"), F.col("n_shingles").alias("n"), "sketch")

    def compare(batches):
        key, held = None, []

        def done():
            out = []
            if len(held) < 2:
                return out
            ids, labels, second, n = (np.array(x) for x in list(zip(*held))[:4])
            cells = cells_of([h[4] for h in held], min(len(h[4]) for h in held))
            across = key[1] != key[2]
            for i in range(len(ids) - (not across)):
                if across and second[i]:
                    continue
                others = np.flatnonzero(second) if across else np.arange(i + 1, len(ids))
                a, b = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                others = others[(labels[others] != labels[i]) & (100 * a >= percent * b)]
                differ = np.abs(cells[others] - cells[i]).sum(axis=1)
                near = differ <= (n[others] + n[i]) * (100 - percent) // (100 + percent)
                for j, d in zip(others[near].tolist(), differ[near].tolist()):
                    x, y = (i, j) if ids[i] < ids[j] else (j, i)
                    out.append((int(ids[x]), int(ids[y]), int(labels[x]), int(labels[y]), d))
            return out

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(5)], names=["a", "b", "la", "lb", "differ"])

        for batch in batches:
            found = []
            for signature, one, two, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (signature, one, two):
                    found += done()
                    key, held = (signature, one, two), []
                held.append(row)
            yield batch_of(found)
        yield batch_of(done())

    dealt = rows.repartition("signature", "one", "two").sortWithinPartitions("signature", "one", "two")
    return dealt.mapInArrow(compare, "a long, b long, la long, lb long, differ long").groupBy("a", "b", "la", "lb").agg(F.min("differ").alias("differ"))


def labelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """rows with the labels (node, label) in place of column, where there are any."""
    of = labels.select(F.col("node").alias(column), F.col("label").alias("_found"))
    return rows.join(of, column, "left").withColumn(column, F.coalesce("_found", column)).drop("_found")


def links_among(docs: DataFrame, sets: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect all that is linked among sets that meet."""
    met = cut(met)
    ids = cut(met.select(F.col("id").alias("doc_id")).distinct())
    sets = cut(sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi"))
    degree = met.groupBy("id").agg(F.count("*").alias("degree"))
    hubs = met.filter("whole").join(degree, "id").groupBy("signature").agg(F.max(F.struct("degree", "id"))["id"].alias("hub"))
    stars = met.join(hubs, "signature").filter("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(verified(docs, agreeing(stars, sets, percent), k, percent))
    labels = components(links)
    # Signatures with the same members (by count and 128 bits of hashes) are compared once.
    rows = cut(labelled(met.select("signature", "id", F.col("id").alias("label")), "label", labels))
    kinds = rows.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = kinds.filter("low < high").groupBy("n", "x", "y").agg(F.min("signature").alias("signature")).select("signature")
    across = cut(pairs_across(rows.join(kept, "signature"), sets, percent))
    # The closest pair of each two labels first; most of the others are connected by these.
    closest = across.groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.min(F.struct("differ", "a", "b")).alias("pair"))
    first = cut(verified(docs, closest.select("pair.a", "pair.b").distinct(), k, percent))
    linked = across.join(first, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(linked)
    rest = labelled(labelled(across, "la", merged), "lb", merged).filter("la <> lb").join(first, ["a", "b"], "left_anti").join(closest.select("pair.a", "pair.b"), ["a", "b"], "left_anti")
    return links.union(first).union(cut(verified(docs, rest.select("a", "b"), k, percent)))


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links of at least percent / 100 reach."""
    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(sequence_classes(docs, k))
    classes = cut(sets.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")))
    # Sizes: as many rows as there are different set sizes, at most some thousands of a long text's words.
    bands = Bands(percent, {r.n: r["count"] for r in classes.groupBy("n").count().toLocalIterator()})
    repeated = classes.filter("copies > 1").select("d1", "d2", "id")
    dropped = cut(sets.join(repeated, ["d1", "d2"]).filter("doc_id <> id").select("doc_id").distinct())
    n_dropped = dropped.count()
    kept = docs.join(F.broadcast(dropped) if n_dropped <= BROADCAST_ROWS else dropped, "doc_id", "left_anti").filter("doc_id IS NOT NULL")
    sized = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "sketch")
    joined = components(links_among(kept, sized, meetings(kept, k, bands), k, percent))
    of_class = cut(classes.join(joined, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("label", "id").alias("component_id")))
    full = sets.filter("n_shingles > 0").join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return full.union(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: DuckDB: shingles, pairs that share one, and components by recursion.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n_shingles
"""
