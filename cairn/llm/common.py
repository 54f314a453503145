"""Shared pieces: lineage cuts, checked broadcasts and vectorised word hashing."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.lineage import BROADCAST_ROWS, cut, shared_folder  # noqa: F401

#: Texts of an Arrow batch; two workers of an executor hold one each.
BATCH_ROWS = 1024


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are within the limit, else df as it is."""
    return F.broadcast(df) if rows <= limit else df


def bound_batches(docs: DataFrame) -> DataFrame:
    """docs; whole texts go to Python in batches of BATCH_ROWS at most, unless the session already asks for less."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def fresh(name: str, taken: list[str]) -> str:
    """name, or a longer one that no column of taken has (in either case of letters)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_parts(column: pa.ChunkedArray | pa.Array, part_bytes: int = 1 << 20):
    """Cut a text column into parts of about part_bytes: (first row, list of bytes). Null is empty."""
    rows = column.cast(pa.large_binary()).to_pylist()
    first, held, part = 0, 0, []
    for i, row in enumerate(rows):
        row = row or b""
        part.append(row)
        held += len(row) + 1
        if held >= part_bytes:
            yield first, part
            first, held, part = i + 1, 0, []
    if part:
        yield first, part


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multipliers, a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of all words of a part at once.

    Texts are joined by a separator byte; a polynomial prefix sum modulo 2**64
    gives the hash of any byte range by one subtraction and one product.
    """

    BASE = 0x9E3779B97F4A7C15
    SEPARATORS = (0x20, 9, 10, 11, 12, 13)

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.separator = np.zeros(256, bool)
        self.separator[list(self.SEPARATORS)] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 20)
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (self.BASE, inverse))

    def load(self, part: list[bytes]) -> None:
        """Set buffer, text offsets, word bounds, word hashes, and words of each text (as offsets)."""
        raw = b"\n".join(part) + b"\n"
        if self.lower:
            raw = raw.lower()  # bytes.lower changes A-Z only
        self.buffer = buf = np.frombuffer(raw, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part]))).astype(np.int64)
        self.grow(len(buf) + 1)
        self.blank = blank = self.separator[buf]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        values = (buf.astype(np.uint64) + np.uint64(1)) * self.power[: len(buf)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        self.words = self.hash(self.starts, self.ends)
        self.word_offsets = np.searchsorted(self.starts, self.offsets)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows that lie in one text, and the texts' offsets into them."""
        w, n = self.words, np.diff(self.word_offsets)
        count = np.maximum(n - k + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(count)))
        if not offsets[-1]:
            return np.zeros(0, np.uint64), offsets
        h = w[: len(w) - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(0xA0761D6478BD642F) + w[j : len(w) - k + 1 + j]
        start = np.repeat(self.word_offsets[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
        return mix64(h[start]), offsets

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-byte flags for each text."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.offsets])
