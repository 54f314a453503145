"""Embedding and language models as column expressions, with deterministic local defaults.

A provider has ``embed(text)`` and ``answer(prompt)``, each Column -> Column.
The local one needs no network; ``CallableProvider`` wraps Python functions in
batches, with retries, and makes its client once for each task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.text import content_hash, tokenize
from cairn.functions.vectors import hashed_embedding
from cairn.lineage import cut

ATTEMPTS, WAIT = 2, 2.0


class LocalProvider:
    """Feature hashing, capitalised names as entities, and leading sentences as summaries."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: Column) -> Column:
        return hashed_embedding(tokenize(text), self.size)

    def summary(self, text: Column, sentences: int = 2) -> Column:
        parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?]) ")
        return F.trim(F.array_join(F.slice(parts, 1, sentences), " "))

    def answer(self, prompt: Column) -> Column:
        """Entities and a summary of the text as the JSON that a model would give."""
        names = F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1)))
        found = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Concept").alias("type"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("aliases")))
        return F.to_json(F.struct(found.alias("entities"), self.summary(prompt).alias("summary")))

    def is_available(self) -> bool:
        return True

    def check_health(self) -> dict:
        return {"provider": "local", "embed": True, "chat": True}


def _retrying(call: Callable, attempts: int, wait: float):
    import time

    def run(x):
        for k in range(attempts):
            try:
                return call(x)
            except (ConnectionError, TimeoutError, OSError):
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return run


class CallableProvider:
    """make_client() gives an object with embed(list of texts) -> vectors and chat(text) -> text."""

    def __init__(self, make_client: Callable, attempts: int = ATTEMPTS, wait: float = WAIT):
        self.make_client, self.attempts, self.wait = make_client, attempts, wait

    def embed(self, text: Column) -> Column:
        make, attempts, wait = self.make_client, self.attempts, self.wait

        @F.pandas_udf("array<float>")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = make()
            many = _retrying(client.embed, attempts, wait)
            for texts in batches:
                try:
                    vectors = many(list(texts))
                except Exception:  # a batch that fails is tried text by text
                    vectors = [many([t])[0] for t in texts]
                yield pd.Series([[float(x) for x in v] for v in vectors])

        return call(text)

    def answer(self, prompt: Column) -> Column:
        make, attempts, wait = self.make_client, self.attempts, self.wait

        @F.pandas_udf("string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = make()
            one = _retrying(client.chat, attempts, wait)
            for texts in batches:
                yield pd.Series([one(t) for t in texts])

        return call(prompt)

    def is_available(self) -> bool:
        try:
            return bool(self.make_client())
        except Exception:
            return False

    def check_health(self) -> dict:
        return {"provider": "callable", "embed": self.is_available(), "chat": self.is_available()}


def prompt(text: Column, think: bool = True) -> Column:
    """A chat model's prompt; without thinking it begins with the switch that such models read."""
    return text if think else F.concat(F.lit("/no_think "), text)


class EmbeddingCache:
    """Embeddings by content hash, kept as a table; switching the provider empties it."""

    def __init__(self, provider, table: DataFrame | None = None):
        self.provider, self.table = provider, table

    def embed(self, rows: DataFrame, column: str = "document") -> DataFrame:
        """rows with an embedding; only texts that aren't kept are embedded, each once, and are kept then."""
        hashed = rows.withColumn("_hash", content_hash(F.col(column)))
        texts = hashed.select("_hash", F.col(column).alias("_text")).dropDuplicates(["_hash"])
        texts = texts if self.table is None else texts.join(self.table, "_hash", "left_anti")
        new = texts.select("_hash", self.provider.embed(F.col("_text")).alias("embedding"))
        self.table = cut(new if self.table is None else self.table.union(new))
        return hashed.join(self.table, "_hash", "left").drop("_hash")

    def clear(self) -> None:
        self.table = None

    def switch(self, provider) -> None:
        self.provider = provider
        self.clear()

    def info(self) -> dict:
        return {"provider": self.provider.check_health()["provider"], "texts": 0 if self.table is None else self.table.count()}


_REGISTRY: dict[str, Callable] = {"local": LocalProvider}


def register(name: str, make: Callable) -> None:
    _REGISTRY[name] = make


def provider(name: str = "local", **options):
    if name not in _REGISTRY:
        raise ValueError(f"unknown provider: {name}")
    return _REGISTRY[name](**options)
