"""Media columns: baseline JPEG.

``decode_dc`` parses the markers of baseline JPEGs, Huffman-decodes their
scans and rebuilds the DC-only luminance thumbnail (one sample for each 8x8
block).  All restart intervals of a part of the table are decoded in step, one
symbol at a time, so the work is done in numpy whatever the number of files.

``encode_samples`` stores bytes losslessly: each byte is the DC coefficient of
one block (quantiser 8, level shift 128), 64 blocks in a row, one restart
interval for each row.  An image has 8191 rows at most; longer payloads are
stored as several images, one after the other.

Edge cases: a null or empty text is stored as 64 zero bytes; equal texts give
equal values; repeated rows and other columns don't matter; an empty table
gives an empty result.  A file that isn't a baseline JPEG raises ValueError in
``decode_dc`` and has nulls in ``describe_media``.
"""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, fresh, read_table, text_parts

ROW = 64
MAX_ROWS = 8191
TAIL = 64

#: Huffman tables of the stored form: DC sizes 0 to 8 with 4 bits each, AC with end-of-block only.
DC_COUNTS = bytes([0, 0, 0, 9] + [0] * 12)
DC_SYMBOLS = bytes(range(9))
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = b"\0"


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\0" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole block for each DC difference + 255: size code, value bits, end of block."""
    diff = np.arange(-255, 256)
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(int) + 1)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return ((((size << size) | extra) << 1).astype(np.uint64), (size + 5).astype(np.int64))


def encode_samples(payloads: list[bytes]) -> list[bytes]:
    """The stored form of payloads, each a positive multiple of 64 bytes long."""
    value, length = _codes()
    lanes = np.array([len(p) // ROW for p in payloads])
    v = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, ROW) - 128
    diff = np.diff(v, axis=1, prepend=np.int16(0)) + 255
    code, bits = value[diff], length[diff]
    for _ in range(2):  # four blocks of 13 bits at most make one item of 52
        code = (code[:, 0::2] << bits[:, 1::2].astype(np.uint64)) | code[:, 1::2]
        bits = bits[:, 0::2] + bits[:, 1::2]
    at = np.cumsum(bits, axis=1)
    lane_bits = at[:, -1]
    lane_end = np.cumsum((lane_bits + 7) // 8 + 2) - 2  # two bytes are left for the marker after each interval
    at = (at - bits + (lane_end - (lane_bits + 7) // 8)[:, None] * 8).ravel()
    code, bits = code.ravel(), bits.ravel()
    n = int(lane_end[-1]) + 2
    words = np.zeros(n // 8 + 2, np.uint64)
    index, room = at >> 6, 64 - (at & 63) - bits
    over = np.flatnonzero(room < 0)
    part = code << np.maximum(room, 0).astype(np.uint64)
    part[over] = code[over] >> (-room[over]).astype(np.uint64)
    first = np.flatnonzero(np.diff(index, prepend=-1))
    words[index[first]] = np.bitwise_or.reduceat(part, first)
    words[index[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    stream = words.byteswap().view(np.uint8)[:n]
    stream[lane_end - 1] |= ((1 << (-lane_bits % 8)) - 1).astype(np.uint8)
    marker = lane_end + np.searchsorted(np.flatnonzero(stream == 0xFF), lane_end)
    out = np.frombuffer(bytearray(stream.tobytes().replace(b"\xff", b"\xff\0")), np.uint8)
    number = (np.arange(len(lane_end)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) % MAX_ROWS
    out[marker], out[marker + 1] = 0xFF, 0xD0 + number % 8
    raw, files, lane = out.tobytes(), [], 0
    ends = np.concatenate(([0], marker + 2))
    for count in lanes:
        file = []
        for start in range(lane, lane + count, MAX_ROWS):
            stop = min(start + MAX_ROWS, lane + count)
            file += [_header(stop - start), raw[ends[start] : ends[stop] - 2], b"\xff\xd9"]
        files.append(b"".join(file))
        lane += count
    return files


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[list[int]] = field(default_factory=list)  # id, h, v, quantiser, DC table, AC table
    quantisers: dict[int, int] = field(default_factory=dict)  # DC term
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    scan: bytes = b""

    def coding(self) -> tuple:
        """What images that are decoded together have in common."""
        return (tuple((h, v, self.tables.get(dc), self.tables.get(16 + ac)) for _, h, v, _, dc, ac in self.components),)

    def mcus(self) -> tuple[int, int]:
        h, v = self.largest()
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def largest(self) -> tuple[int, int]:
        if len(self.components) == 1:  # a single component isn't interleaved
            return 1, 1
        return max(c[1] for c in self.components), max(c[2] for c in self.components)


_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def parse(data: bytes) -> list[Image]:
    """The images of a file, with their tables and entropy-coded bytes."""
    images, image, i = [], None, 0
    while i < len(data):
        if data[i] != 0xFF or i + 1 >= len(data):
            raise ValueError("not a JPEG marker")
        marker, i = data[i + 1], i + 2
        if marker == 0xFF:
            i -= 1
            continue
        if marker == 0xD8:
            image = Image()
            continue
        if image is None:
            raise ValueError("no start of image")
        if marker == 0xD9:
            if not image.scan:
                raise ValueError("no scan")
            images.append(image)
            image = None
            continue
        size = struct.unpack(">H", data[i : i + 2])[0]
        body, i = data[i + 2 : i + size], i + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not image.height or not image.width:
                raise ValueError("not a baseline JPEG")
            image.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if body[0] != len(image.components):
                raise ValueError("scans of some components only aren't read")
            for k in range(body[0]):
                for c in image.components:
                    if c[0] == body[1 + 2 * k]:
                        c[4], c[5] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            end = _MARKER.search(data, i)
            stop = end.start() if end else len(data)
            image.scan, i = data[i:stop], stop
    if image is not None and image.scan:
        images.append(image)
    if not images:
        raise ValueError("no image")
    return images


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow: code length * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length * 256 + table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For each 16 bits: bits of a whole block * 65536 + DC difference + 32768, where it has no AC term and fits; else -1."""
    x = np.arange(1 << 16)
    found = dc[x]
    size = np.minimum(found & 255, 15)
    rest = (x << (found >> 8)) & 0xFFFF
    extra = rest >> (16 - size)
    end = ac[(rest << size) & 0xFFFF]
    bits = (found >> 8) + size + (end >> 8)
    diff = np.where(size == 0, 0, np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra))
    return np.where((found > 0) & (end > 0) & ((end & 255) == 0) & (bits <= 16), bits * 65536 + diff + 32768, -1)


def _one_block(dc: np.ndarray, ac: np.ndarray, peek, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC differences and end positions of the blocks that begin at p, symbol by symbol."""
    found = dc[peek(p)]
    p = p + (found >> 8)
    size = found & 255
    if (found == 0).any() or (size > 11).any():
        raise ValueError("broken Huffman code")
    extra = peek(p).astype(np.int64) >> (16 - size)
    p = p + size
    diff = np.where(size == 0, 0, np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra))
    left, coefficient = np.arange(len(p)), np.zeros(len(p), np.int64)
    while len(left):
        found = ac[peek(p[left])]
        if (found == 0).any():
            raise ValueError("broken Huffman code")
        run, size = (found >> 4) & 15, found & 15
        p[left] += (found >> 8) + size
        coefficient[left] += run + 1
        left = left[((size > 0) | (run == 15)) & (coefficient[left] < 63)]
    return diff, p


def _decode_lanes(images: list[Image]) -> list[np.ndarray]:
    """Dequantised luminance DC terms of images of one coding, a plane each."""
    data = np.frombuffer(b"".join(x.scan for x in images) + b"\xff" * 8, np.uint8)
    scan_end = np.cumsum([len(x.scan) for x in images])
    follows = data[:-1] == 0xFF
    restart = np.flatnonzero(follows & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    keep = np.ones(len(data), bool)
    keep[1:][follows & (data[1:] == 0)] = False
    keep[restart] = keep[restart + 1] = False
    place = np.cumsum(keep) - keep
    starts = np.sort(np.concatenate((scan_end - [len(x.scan) for x in images], restart + 2)))
    lane_image = np.searchsorted(scan_end, starts, side="right")
    position = place[starts] * 8
    data = data[keep].astype(np.uint32)
    word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    word = np.concatenate((word, np.full(8, 0xFFFFFFFF, np.uint32)))
    limit = len(word) * 8 - 8

    total = np.array([np.prod(x.mcus()) for x in images])
    interval = np.array([x.restart for x in images])
    interval = np.where(interval > 0, interval, total)
    within = np.arange(len(starts)) - np.searchsorted(lane_image, lane_image)
    first_mcu = within * interval[lane_image]
    todo = np.minimum(interval[lane_image], total[lane_image] - first_mcu)
    coding = images[0].components
    blocks = [(k, b) for k, c in enumerate(coding) for b in range(1 if len(coding) == 1 else c[1] * c[2])]
    dc = [_lookup(images[0].tables[c[4]]) for c in coding]
    ac = [_lookup(images[0].tables[16 + c[5]]) for c in coding]
    luma = 1 if len(coding) == 1 else coding[0][1] * coding[0][2]
    planes = np.zeros((int(total.sum()), luma), np.int64)
    base = np.concatenate(([0], np.cumsum(total)))[lane_image] + first_mcu
    predictor = np.zeros((len(coding), len(starts)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, limit)
        return (word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    whole = [_whole_blocks(d, a) for d, a in zip(dc, ac)]

    for step in range(int(todo.max(initial=0))):
        lane = slice(None) if step < todo.min() else np.flatnonzero(todo > step)
        p = position[lane]
        for k, block in blocks:
            found = whole[k][peek(p)]
            diff = (found & 0xFFFF) - 32768
            slow = np.flatnonzero(found < 0)
            start = p[slow]
            p = p + (found >> 16)
            if len(slow):
                diff[slow], p[slow] = _one_block(dc[k], ac[k], peek, start)
            predictor[k, lane] += diff
            if k == 0:
                planes[base[lane] + step, block] = predictor[k, lane]
        position[lane] = p
    out, at = [], 0
    for image, n in zip(images, total):
        (wide, high), (h, v) = image.mcus(), (1, 1) if len(coding) == 1 else coding[0][1:3]
        plane = planes[at : at + n].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        largest = image.largest()
        rows, columns = -(-image.height * v // (8 * largest[1])), -(-image.width * h // (8 * largest[0]))
        out.append(plane[:rows, :columns] * image.quantisers[image.components[0][3]])
        at += n
    return out


def decode_dc(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each file, the DC-only luminance thumbnails (uint8) of its images."""
    parsed = [parse(f) for f in files]
    by_coding: dict[tuple, list[tuple[int, int]]] = {}
    for i, images in enumerate(parsed):
        for j, image in enumerate(images):
            by_coding.setdefault(image.coding(), []).append((i, j))
    out: list[list] = [[None] * len(images) for images in parsed]
    for members in by_coding.values():
        for (i, j), plane in zip(members, _decode_lanes([parsed[i][j] for i, j in members])):
            out[i][j] = np.clip(np.rint(plane / 8.0) + 128, 0, 255).astype(np.uint8)
    return out


def thumbnail_hash(plane: np.ndarray) -> str:
    """Average hash: 8x8 means of the thumbnail against their mean, as 16 hexadecimal digits."""
    cells = plane.astype(np.float64)
    for axis in (0, 1):
        n = cells.shape[axis]
        edges = np.arange(8) * n // 8
        count = np.maximum(np.diff(np.append(edges, n)), 1)
        cells = np.add.reduceat(cells, edges, axis=axis) / (count[:, None] if axis == 0 else count)
    bits = cells.ravel() > cells.mean()
    return np.packbits(bits).tobytes().hex()


def describe_media(files: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height, thumbnail (bytes, row by row) and thumbnail_hash of the first image, under longer names where these are taken; null where it can't be read."""
    names = files.columns
    own = [fresh(x, names) for x in ("width", "height", "thumbnail", "thumbnail_hash")]
    schema = files.select("*", *(F.lit(x).alias(name) for name, x in zip(own, (0, 0, b"", "")))).schema

    def describe(batches):
        for batch in batches:
            rows = []
            for data in batch.column(names.index(column)).to_pylist():
                try:
                    image, plane = parse(data or b"")[0], decode_dc([data])[0][0]
                    rows.append((image.width, image.height, plane.tobytes(), thumbnail_hash(plane)))
                except (ValueError, IndexError, KeyError, struct.error):
                    rows.append((None, None, None, None))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[*names, *own])

    for f in schema.fields[-4:]:
        f.nullable = True
    return files.mapInArrow(describe, schema)


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each text as JPEG, reads it back and describes it; keep_media adds the stored bytes."""

    def store(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, part in text_parts(batch.column(1), 1 << 19):
                payloads = [t + bytes(-len(t) % ROW if t else ROW) for t in part]
                files = encode_samples(payloads)
                rows = []
                for text, file, planes in zip(part, files, decode_dc(files)):
                    plane = planes[0] if len(planes) == 1 else np.concatenate(planes)
                    back = plane.tobytes()
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(file), hashlib.sha256(file).hexdigest(), thumbnail_hash(plane), 8 * plane.shape[1], 8 * plane.shape[0], *([file] * keep_media)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *([pa.binary()] * keep_media)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in COLUMNS.split(", ")] + ["media"] * keep_media)

    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, COLUMNS + ", media binary" * keep_media)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_table(spark, sf_dir, "documents"))
