"""Sharding by minimax contiguous partition.

Documents with equal texts form one group.  Groups are ordered by the SHA-256
of their text; the smallest capacity for which a greedy pass over the ordered
group sizes needs no more shards than asked for is found by binary search, and
the shards are cut there.

The group sizes stay distributed.  The driver holds sums over hash ranges: the
search brackets the capacity with them, and only ranges in which a cut could
fall are opened one level (three hexadecimal digits) further, until the
capacity is exact.  A level holds at most 4096 sums for each opened range.

Edge cases: a null text has no bytes, so its size is 8 and its CRC is 0, as
has an empty one; both belong to one group.  A group larger than the mean
shard stays whole and has a shard of its own.  Repeated rows share a group.
An empty table gives an empty result; more shards than groups leaves some
empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, read_table

SHARDS = 24
ROW_BYTES = 8
DIGITS = 3
#: Ways into which the rows of each shard are numbered; SHARDS * SLOT_BUCKETS rows are broadcast.
SLOT_BUCKETS = 1024


class Ranges:
    """Ordered key ranges (prefix, bytes, largest group in it, whole): whole ranges hold one group and aren't cut."""

    def __init__(self, rows: list[tuple[str, int, int, bool]]):
        self.rows = sorted(rows)

    def opened(self, inner: dict[str, list[tuple[str, int, int, bool]]]) -> "Ranges":
        return Ranges([x for row in self.rows for x in inner.get(row[0], [row])])

    def greedy(self, capacity: int, shards: int, split: bool) -> list[tuple[int, int]] | None:
        """Cuts (range, bytes of it before the cut), or None if there would be too many shards.

        split: ranges of many groups are taken as divisible, which no true
        partition beats; else they stay whole, which a true partition reaches.
        """
        cuts, held = [], 0
        for i, (_, size, _, whole) in enumerate(self.rows):
            done = 0
            while held + size - done > capacity:
                if split and not whole:
                    done += capacity - held
                elif size > capacity:
                    return None
                cuts.append((i, done))
                if len(cuts) >= shards:
                    return None
                held = 0
            held += size - done
        return cuts


def least(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(capacity, first key of each shard but the first) for groups (key, bytes); keys are hexadecimal digests."""

    def level(frame: DataFrame, digits: int) -> list[tuple[str, int, int, bool]]:
        found = frame.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.count("*").alias("n"), F.min("key").alias("first"))
        return [(r.first if r.n == 1 else r.prefix, r.bytes, r.largest, r.n == 1) for r in found.collect()]

    digits = DIGITS
    ranges = Ranges(level(groups, digits))
    if not ranges.rows:
        return 0, []
    total, largest = sum(r[1] for r in ranges.rows), max(r[2] for r in ranges.rows)
    low = max(largest, -(-total // shards))
    while True:
        low = least(lambda c: ranges.greedy(c, shards, True) is not None, low, total)
        high = least(lambda c: ranges.greedy(c, shards, False) is not None, low, total)
        if low == high:
            cuts = ranges.greedy(low, shards, False)
            return low, [ranges.rows[i][0] for i, _ in cuts]
        # The k-th cut moves on as the capacity grows: it lies between that of whole ranges at low and of divisible ones at high.
        first, last = _positions(ranges, low, shards), ranges.greedy(high, shards, True)
        last = [i for i, _ in last] + [len(ranges.rows) - 1] * shards
        at = {i for k, i in enumerate(first) for i in range(i, last[k] + 1) if not ranges.rows[i][3]}
        digits += DIGITS
        prefixes = sorted(ranges.rows[i][0] for i in at)
        inner: dict[str, list] = {p: [] for p in prefixes}
        wanted = groups.filter(F.substring("key", 1, digits - DIGITS).isin(prefixes))
        for row in level(wanted, digits):
            inner[row[0][: digits - DIGITS]].append(row)
        ranges = ranges.opened(inner)


def _positions(ranges: Ranges, capacity: int, shards: int) -> list[int]:
    """Earliest ranges of the cuts at this capacity: ranges stay whole, and one above the capacity is taken as reached."""
    at, held = [], 0
    for i, (_, size, _, _) in enumerate(ranges.rows):
        if held + size > capacity and len(at) < shards:
            at.append(i)
            held = min(size, capacity)
        else:
            held += size
    return at


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard (null, as the law is ``bytes``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    _, firsts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for first in firsts:  # at most shards - 1 terms
        shard = shard + (F.col("key") >= F.lit(first)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    # starts: at most shards * SLOT_BUCKETS rows
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
