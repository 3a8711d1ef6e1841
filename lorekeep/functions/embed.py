"""Embedding providers: text to vectors of one length, inside vectorised functions that load a model once a worker."""

from __future__ import annotations

import abc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(abc.ABC):
    """What a provider offers. It is pickled to the executors; models are to be loaded on first use there."""

    @abc.abstractmethod
    def embed_texts(self, texts: list[str], batch_size: int = 64) -> list[list[float]]: ...

    def embed_query(self, query: str) -> list[float]:
        return self.embed_texts([query])[0]

    @property
    @abc.abstractmethod
    def dimension(self) -> int: ...

    @property
    @abc.abstractmethod
    def model_name(self) -> str: ...


class HashingProvider(EmbeddingProvider):
    """Signed hashing of words and character trigrams: offline, deterministic, alike for like texts; not a semantic model."""

    def __init__(self, dimension: int = 384):
        self._dim = dimension

    dimension = property(lambda self: self._dim)
    model_name = property(lambda self: f"hashing-{self._dim}")

    def embed_texts(self, texts: list[str], batch_size: int = 64) -> list[list[float]]:
        out = np.zeros((len(texts), self._dim), np.float64)
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                for f in (w, *(w[k : k + 3] for k in range(len(w) - 2))):
                    h = zlib.crc32(f.encode())
                    out[i, h % self._dim] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


class CallableProvider(EmbeddingProvider):
    """A model behind a function that makes it on first use: a local runtime, or a client of a service. A second maker is the fallback."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, name: str, fallback: Callable | None = None):
        self._make, self._fallback, self._dim, self._name, self._model = make, fallback, dimension, name, None

    dimension = property(lambda self: self._dim)
    model_name = property(lambda self: self._name)

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def embed_texts(self, texts: list[str], batch_size: int = 64) -> list[list[float]]:
        if self._model is None:
            try:
                self._model = self._make()
            except Exception:
                if self._fallback is None:
                    raise
                self._model = self._fallback()
        return [v for k in range(0, len(texts), batch_size) for v in self._model(texts[k : k + batch_size])]


PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingProvider, "callable": CallableProvider}


def get_provider(name: str, **options) -> EmbeddingProvider:
    if name not in PROVIDERS:
        raise ValueError(f"Unknown embedding provider: {name}")
    return PROVIDERS[name](**options)


def embed(provider: EmbeddingProvider, text: Column) -> Column:
    """A vector for each text, within the row: no join brings vectors back to their texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider.embed_texts(texts.fillna("").tolist()))

    return run(text)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def embed_distinct(df: DataFrame, provider: EmbeddingProvider, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """df with a column vector; each distinct text is embedded once, and not at all if known (content_hash, vector) has it."""
    from lorekeep.functions.text import content_hash

    hashed = df.withColumn("lk_hash", content_hash(F.col(text)))
    new = hashed.groupBy("lk_hash").agg(F.first(text).alias("lk_text"))
    if known is not None:
        known = known.select(F.col("content_hash").alias("lk_hash"), "vector").dropDuplicates(["lk_hash"])
        new = new.join(known, "lk_hash", "left_anti")
    made = new.select("lk_hash", embed(provider, F.col("lk_text")).alias("vector"))
    return hashed.join(made if known is None else made.unionByName(known), "lk_hash").drop("lk_hash")


#: Prices in dollars of a thousand tokens.
PRICES = {"text-embedding-3-small": 0.00002, "text-embedding-3-large": 0.00013, "text-embedding-ada-002": 0.0001}


def cost(model: Column, tokens: Column, prices: dict[str, float] = PRICES) -> Column:
    """Tokens in thousands times the model's price; an unknown model is free."""
    table = F.create_map(*(x for k, v in prices.items() for x in (F.lit(k), F.lit(v))))
    return tokens / 1000 * F.coalesce(F.try_element_at(table, model), F.lit(0.0))


def requests(n: Column, batch: int = 100) -> Column:
    return F.ceil(n / batch)


def token_count(text: Column, counter: Callable[[str], int] | None = None) -> Column:
    """By a tokenizer's counter, or a quarter of the characters."""
    if counter is None:
        return F.ceil(F.length(text) / 4)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(counter)

    return run(text)
