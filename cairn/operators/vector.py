"""Nearest neighbours, duplicates and mean vectors over tables with an ``embedding`` column."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import vectors as vx
from cairn.lineage import cut

#: Vectors of one block in all-pairs comparisons: the least and the most, and the number of blocks between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1024, 1 << 15, 16
#: Numbers of the query vectors that are sent to all tasks at once (32 MB).
QUERY_NUMBERS = 1 << 22
#: Rows and columns of a matrix product that a task holds at once (8 MB).
TILE = 1024


def nearest(table: DataFrame, query: list[float], n: int, id_col: str = "id", where: Column | None = None) -> DataFrame:
    """The n rows of least cosine distance to the query, ties by id; the filter reaches the scan."""
    rows = table if where is None else table.filter(where)
    return rows.withColumn("distance", 1 - vx.cosine(F.col("embedding"), vx.literal(query))).orderBy("distance", id_col).limit(n)


def nearest_many(table: DataFrame, queries: DataFrame, n: int, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """For each query (query_id, embedding), its n nearest rows of the table.

    Queries go to the table in rounds of QUERY_NUMBERS numbers at most, so what
    is sent at once doesn't grow with their number.  A task compares them with
    its rows in tiles and keeps n candidates for each query:
    no pair is shuffled that isn't among the n best of its task.  Cosines have
    12 digits, as a product's last bits depend on the tile: equal vectors tie.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*table.schema.fields, *queries.schema.fields]}
    schema = f"{query_col} {kinds[query_col]}, {id_col} {kinds[id_col]}, cosine double"
    numbers = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("n")).head().n
    rounds = max(1, -(-numbers // QUERY_NUMBERS))
    found = None
    for k in range(rounds):
        some = queries.filter(F.pmod(F.xxhash64(query_col), F.lit(rounds)) == k) if rounds > 1 else queries
        asked = some.select(query_col, "embedding").toArrow()  # QUERY_NUMBERS numbers, or about that
        part = table.select(id_col, "embedding").mapInArrow(_best(asked.column(0).to_numpy(), _matrix(asked.column(1)), n, query_col, id_col), schema)
        found = part if found is None else found.union(part)
    rank = Window.partitionBy(query_col).orderBy(F.desc("cosine"), id_col)
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def _matrix(column) -> np.ndarray:
    """An Arrow column of vectors of one length as a matrix; no Python object is made for a number."""
    if not len(column):
        return np.zeros((0, 0))
    held = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(held.flatten(), float).reshape(len(column), -1)


def _units(column) -> np.ndarray:
    v = _matrix(column)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), vx.TINY)


def _best(ids: np.ndarray, matrix: np.ndarray, n: int, query_col: str, id_col: str):
    """A function that gives a task's n best rows for each query, ties by id."""
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), vx.TINY)

    def best(batches):
        held_ids = held = None  # (queries, up to n): the best so far
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            every, v = batch.column(0).to_numpy(zero_copy_only=False), _units(batch.column(1))
            for low in range(0, len(every), TILE):
                rows, part = every[low : low + TILE], v[low : low + TILE].T
                tops = []
                for first in range(0, len(ids), TILE):
                    near = matrix[first : first + TILE] @ part
                    names = np.broadcast_to(rows, near.shape)
                    if held is not None:
                        near = np.concatenate([held[first : first + TILE], near], 1)
                        names = np.concatenate([held_ids[first : first + TILE], names], 1)
                    if near.shape[1] > n:
                        # What is below the n-th best goes, with some room for what ties with it but for rounding.
                        least = np.partition(near, near.shape[1] - n, 1)[:, near.shape[1] - n, None] - 1e-11
                        most = int((near >= least).sum(1).max())
                        at = np.argpartition(-near, most - 1, 1)[:, :most] if most < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
                        near, names = np.take_along_axis(near, at, 1), np.take_along_axis(names, at, 1)
                        by = np.lexsort((names, -near.round(12)), axis=1)[:, :n]
                        near, names = np.take_along_axis(near, by, 1), np.take_along_axis(names, by, 1)
                    tops.append((names, near))
                held_ids, held = np.concatenate([t[0] for t in tops]), np.concatenate([t[1] for t in tops])
        if held is not None:
            k = held.shape[1]
            for first in range(0, len(ids), 1 << 14):
                some = slice(first, first + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], k)), pa.array(held_ids[some].ravel()), pa.array(held[some].ravel().round(12))], names=[query_col, id_col, "cosine"])

    return best


def _compared(table: DataFrame, threshold: float, id_col: str, blocks: int | None, forest: bool) -> DataFrame:
    kind = table.schema[id_col].dataType.simpleString()
    if blocks is None:
        n = table.count()
        blocks = max(1, -(-n // MOST_BLOCK), min(BLOCKS, -(-n // LEAST_BLOCK)))
    dealt = table.select(F.col(id_col).alias("id"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = dealt.withColumn("with", other).select(F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "id", "v")

    def compare(key, batches):
        one, two = key[0].as_py(), key[1].as_py()
        ids, of, v = [], [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            of.append(batch.column("block").to_numpy())
            v.append(_units(batch.column("v")))
        ids, of, v = np.concatenate(ids), np.concatenate(of), np.concatenate(v)
        order = np.argsort(ids, kind="stable")
        ids, of, v = ids[order], of[order], v[order]
        left, right = np.flatnonzero(of == one), np.flatnonzero(of == two)
        label = np.arange(len(ids))  # of the forest so far, each node with its root
        for i0 in range(0, len(left), TILE):
            rows = left[i0 : i0 + TILE]
            for j0 in range(0, len(right), TILE):
                columns = right[j0 : j0 + TILE]
                if one == two and columns[-1] <= rows[0]:
                    continue
                near = v[rows] @ v[columns].T
                i, j = np.nonzero(near >= threshold)
                c, i, j = near[i, j], rows[i], columns[j]
                keep = ids[i] < ids[j] if one == two else ids[i] != ids[j]
                c, i, j = c[keep], i[keep], j[keep]
                if forest and len(i):
                    i, j = _spanning(label, i, j)
                    c = np.ones(len(i))
                if len(i):
                    low, high = np.minimum(i, j), np.maximum(i, j)  # ids are in order
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[high]), pa.array(c.astype(float))], names=["a", "b", "cosine"])

    # Annotations (as objects) tell Spark that a group comes and goes in batches.
    compare.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.groupBy("one", "two").applyInArrow(compare, f"a {kind}, b {kind}, cosine double")


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (i, j) that connect what earlier ones don't; ``label`` (each node's root, the least of its tree) is brought up to date."""
    kept_i, kept_j = [], []
    while True:
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        if not len(i):
            break
        a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        roots, first = np.unique(b, return_index=True)  # each root is hung once, below a smaller one: no circle
        kept_i.append(i[first])
        kept_j.append(j[first])
        to = np.arange(len(label))
        to[roots] = a[first]
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        label[:] = to[label]
    none = np.zeros(0, int)
    return np.concatenate(kept_i) if kept_i else none, np.concatenate(kept_j) if kept_j else none


def similar_pairs(table: DataFrame, threshold: float, id_col: str = "id", blocks: int | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs a < b with at least this cosine, exact.

    Vectors are dealt into blocks; every pair of blocks is one task's matrix
    product, in tiles, and only pairs above the threshold leave it.  A vector is
    shipped once for each block: BLOCKS times up to BLOCKS * MOST_BLOCK vectors.
    """
    return _compared(table, threshold, id_col, blocks, False)


def similar_links(table: DataFrame, threshold: float, id_col: str = "id", blocks: int | None = None) -> DataFrame:
    """(a, b) of pairs as in ``similar_pairs``, as many as connect what all of them connect: a forest for each pair of blocks."""
    return _compared(table, threshold, id_col, blocks, True).select("a", "b")


def mean_vectors(chunks: DataFrame, key: str = "path") -> DataFrame:
    """The element-wise mean vector of each note: one mean for each position, so a chunk stays one row."""
    held = chunks.select(key, F.col("embedding").cast("array<double>").alias("v"))
    size = held.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).head().n
    means = F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(size))).cast("array<double>")
    return held.filter(F.size("v") > 0).groupBy(key).agg(F.array_compact(means).alias("embedding"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each note."""
    others = [c for c in chunks.columns if c != "path"]
    return chunks.groupBy("path").agg(F.min_by(F.struct(*others), "chunk").alias("c")).select("path", "c.*")


def duplicate_notes(chunks: DataFrame, threshold: float = 0.9, n: int = 20) -> DataFrame:
    """The n most similar pairs of notes by their first chunks: path_a < path_b and their cosine, to 4 places."""
    pairs = similar_pairs(first_chunks(chunks), threshold, "path")
    return pairs.select(F.col("a").alias("path_a"), F.col("b").alias("path_b"), F.round("cosine", 4).alias("cosine")).orderBy(F.desc("cosine"), "path_a", "path_b").limit(n)


def summary_search(summaries: DataFrame, query: list[float], n: int) -> DataFrame:
    """Summaries near the query, with the ranking similarity to 4 places."""
    found = nearest(summaries, query, n, "path").withColumn("similarity", F.round(vx.similarity(F.col("distance")), 4))
    return found.select("path", "title", "summary", "similarity").orderBy(F.desc("similarity"), "path")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those with equal keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_summaries(summaries: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(summaries, rows.filter(F.length(F.trim("summary")) > 0), "path")


def embed_distinct(table: DataFrame, embed, column: str = "document") -> DataFrame:
    """``table`` with an embedding: each distinct text is embedded once.  embed: Column -> Column.

    The embedded texts are written before they are joined, so that nothing behind the
    join is pushed into the embedding again; they are broadcast if they are few.
    """
    texts = cut(table.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("embedding", embed(F.col(column))))
    if texts.count() * _width(texts) <= QUERY_NUMBERS:
        return table.join(F.broadcast(texts), column, "left")
    return table.join(texts, column, "left")


def _width(table: DataFrame) -> int:
    """The most numbers in a vector of the table, 1 at least."""
    return max(1, table.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("n")).head().n)
