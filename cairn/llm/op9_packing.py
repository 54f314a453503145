"""Cost-balanced packing of documents into token sequences.

Tokens: byte-level BPE ids and one end id.  The cost of a piece of n tokens is
LINEAR * n + QUADRATIC * n * n (attention).  Full pieces of a document take a
sequence each; what is left goes, in descending length, to the sequence of
least cost that has room.  Where none has room for all of a piece, it is cut
at the room of the cheapest one.  As many sequences are opened as the tokens
need, so at most the last of each group has padding.

Groups are runs of documents within a partition, so nothing is shuffled and a
lost task is computed again from its own input.  Token ids of a text are put
together from the ids of its units (a run of white space and the word after
it, beyond which no pre-token reaches); each distinct unit is encoded once, new
units of a part as running text, cut into units by the bytes of its tokens.

Edge cases: a null or empty text has the end id only; equal rows are packed
each; documents of any length are cut; an empty table gives an empty result.
"""
from __future__ import annotations

import os
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, read_table, text_parts, WordHasher

LENGTH = 1024
END_ID = 0
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
#: Tokens after which a group is closed.
GROUP_TOKENS = 1 << 20
#: Distinct units whose ids a worker keeps; beyond it starts anew.
KEPT_UNITS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Units of a text that is put together of new units.
RUN_UNITS = 1024
#: White space beyond ASCII, or what regex dialects differ on: such texts are encoded as a whole.
_OTHER_SPACE = [chr(c).encode() for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
_OTHER_FIRST = np.isin(np.arange(256), [c[0] for c in _OTHER_SPACE])
_OTHER_KEYS = [np.array([int.from_bytes(c) for c in _OTHER_SPACE if len(c) == n], np.uint32) for n in (1, 2, 3)]


def other_space(buf: np.ndarray) -> np.ndarray:
    """Where a character of other white space begins."""
    at = np.flatnonzero(_OTHER_FIRST[buf])
    last = len(buf) - 1
    key, found = np.zeros(len(at), np.uint32), np.zeros(len(at), bool)
    for i, keys in enumerate(_OTHER_KEYS):
        key = (key << np.uint32(8)) | buf[np.minimum(at + i, last)]
        found |= np.isin(key, keys)
    return at[found]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitTokenizer:
    """Token ids of texts, by way of the ids of their distinct units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.hasher = WordHasher()
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token, where a token's characters stand for bytes.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.clear()

    @classmethod
    def of_worker(cls, path: str) -> "UnitTokenizer":
        """The one that this worker process keeps from task to task."""
        store = sys.modules.setdefault("cairn_worker_store", types.ModuleType("cairn_worker_store"))
        if path not in store.__dict__:
            store.__dict__[path] = cls(path)
        return store.__dict__[path]

    def clear(self) -> None:
        self.known, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def run(self, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units in order and the number of each, encoded as running text; None if its tokens don't end with the units."""
        stop = np.cumsum(size)
        raw = self.hasher.buffer[np.repeat(starts - stop + size, size) + np.arange(stop[-1])].tobytes()
        edges = [0, *stop[RUN_UNITS - 1 : -1 : RUN_UNITS], stop[-1]]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])])])
        ends = np.cumsum(self.sizes[ids])
        last = np.searchsorted(ends, stop)
        if ends[-1:].tolist() != [stop[-1]] or (ends[last] != stop).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Keep the ids of new units.  Plain ones begin with white space and end with a word: no pre-token reaches over their bounds."""
        length, size = np.zeros(len(hashes), np.int64), ends - starts
        joined, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        found = self.run(starts[joined], size[joined]) if len(joined) else None
        if found is None:
            joined, alone, found = joined[:0], np.arange(len(hashes)), (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        buf = self.hasher.buffer
        encoded = self.encode([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[alone], ends[alone])])
        length[joined], length[alone] = found[1], [len(x) for x in encoded]
        start, order = np.zeros(len(hashes), np.int64), np.concatenate((joined, alone))
        start[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        self.ids = np.concatenate((self.ids, found[0], np.fromiter((i for x in encoded for i in x), np.uint32)))
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.length = (np.insert(a, at, b) for a, b in ((self.known, hashes), (self.start, start), (self.length, length)))

    def part(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text of a part, the end id included."""
        h, n = self.hasher, len(texts)
        h.load(texts)
        word_text = np.repeat(np.arange(n), np.diff(h.word_offsets))
        first = np.concatenate(([True], word_text[1:] != word_text[:-1])) if len(word_text) else np.zeros(0, bool)
        begins = np.where(first, h.offsets[word_text], np.concatenate(([0], h.ends[:-1])) if len(h.ends) else 0)
        # What follows the last word of a text is a unit too.
        last = h.word_offsets[1:] - 1
        tail = np.where(np.diff(h.word_offsets) > 0, h.ends[np.maximum(last, 0)] if len(h.ends) else 0, h.offsets[:-1])
        stop = h.offsets[1:] - 1
        more = np.flatnonzero(tail < stop)
        starts, ends = np.concatenate((begins, tail[more])), np.concatenate((h.ends, stop[more]))
        of_text = np.concatenate((word_text, more))
        order = np.argsort(starts, kind="stable")
        starts, ends, of_text = starts[order], ends[order], of_text[order]
        hashes = h.hash(starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KEPT_UNITS:
            self.clear()
        at = np.searchsorted(self.known, unique)
        missing = np.flatnonzero(np.append(self.known, np.uint64(0))[at] != unique) if len(self.known) else np.arange(len(unique))
        missing = missing if len(self.known) == 0 else np.union1d(missing, np.flatnonzero(at == len(self.known)))
        other = np.zeros(n, bool)
        other[np.searchsorted(h.offsets, other_space(h.buffer), "right") - 1] = True
        if len(missing):
            new = index[missing]
            self.learn(unique[missing], starts[new], ends[new], h.blank[starts[new]] & ~h.blank[ends[new] - 1] & ~other[of_text[new]])
        at = np.searchsorted(self.known, unique)[inverse]
        length, begin = self.length[at], self.start[at]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])] if len(at) else np.zeros(0, np.uint32)
        cuts = total[np.searchsorted(of_text, np.arange(n + 1))]
        out = []
        for i, text in enumerate(texts):
            own = ids[cuts[i] : cuts[i + 1]] if not other[i] else np.array(self.encode([text.decode("utf-8", "replace")])[0], np.uint32)
            out.append(np.append(own, np.uint32(END_ID)).astype("<u4"))
        return out


def assign(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of these lengths; sequences count from 0."""
    pieces, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % length, length):
            pieces.append((d, start, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((n % length, d, n - n % length))
    open_ = -(-sum(r[0] for r in rest) // length)
    cost, room = np.zeros(open_), np.full(open_, length)
    rest.sort(key=lambda r: (-r[0], r[1]))
    while rest:
        again = []
        for n, d, start in rest:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room > 0)
            s = int(fits[np.argmin(cost[fits])])
            take = min(n, int(room[s]))
            pieces.append((d, start, take, sequence + s, length - int(room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            if take < n:
                again.append((n - take, d, start + take))
        rest = sorted(again, key=lambda r: (-r[0], r[1]))
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row for each piece.  sequence_id: partition * 2**33 + number in it."""
    path = tokenizer or default_tokenizer()

    def pack(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        unit = UnitTokenizer.of_worker(path)
        ids, tokens, held, used = [], [], 0, 0

        def close():
            nonlocal ids, tokens, held, used
            pieces = assign([len(t) for t in tokens], length, linear, quadratic)
            rows = [(ids[d], start, n, zlib.crc32(tokens[d][start : start + n].tobytes()), len(tokens[d]), base + used + s, offset) for d, start, n, s, offset in pieces]
            used += max((p[3] for p in pieces), default=-1) + 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, part in text_parts(batch.column(1)):
                found = unit.part(part)
                ids += doc_ids[first : first + len(part)]
                tokens += found
                held += sum(map(len, found))
                if held >= GROUP_TOKENS:
                    yield close()
        if ids:
            yield close()

    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
