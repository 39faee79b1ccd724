"""Embeddings: text preparation, a pluggable embedder, and the cache in front of it."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import trim_all
from quern.operators.distributed_rank import rank_values
from quern.staging import staged

#: Tokens a provider takes; characters are estimated as four a token.
MAX_TOKENS = {"openai": 8192, "gemini": 2048, "voyage": 32000, "ollama": 2048}
REDUCED_DIMENSIONS = (3072, 1536, 768, 256)


def prepare(text: Column, max_tokens: int = 8192) -> Column:
    """Empty text becomes a blank; longer text is cut."""
    return F.when(text == "", F.lit(" ")).otherwise(F.substring(text, 1, 4 * max_tokens))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def content_hash(text: Column) -> Column:
    """The cache key: over the text without white space at its ends."""
    return F.sha2(trim_all(text), 256)


def reduced(vector: Column, dimension: int) -> Column:
    """The first values of a nested embedding, at unit length. Above the smallest of REDUCED_DIMENSIONS only these are allowed."""
    if dimension > min(REDUCED_DIMENSIONS) and dimension not in REDUCED_DIMENSIONS:
        raise ValueError(f"{dimension} is none of {REDUCED_DIMENSIONS}")
    head = F.transform(F.slice(vector, 1, dimension), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(head, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))


class Embedder(ABC):
    """Turns texts into vectors, a batch at a time, in the worker process."""

    @abstractmethod
    def dimension(self) -> int: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> list[np.ndarray]: ...

    def provider(self) -> str:
        return type(self).__name__

    def max_tokens(self) -> int:
        return 8192


class HashingEmbedder(Embedder):
    """Words hashed to signed places, at unit length: the same everywhere, without a network."""

    def __init__(self, dimension: int = 64):
        self._dimension = dimension

    def dimension(self) -> int:
        return self._dimension

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(self._dimension, np.float32)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[(h >> 1) % self._dimension] += 1 if h & 1 else -1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out


def embed(rows: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """rows with `vector`; null texts count as empty."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    most = 4 * embedder.max_tokens()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(vector=embedder.embed([(t or " ")[:most] for t in p[text]]) if len(p) else [])

    return rows.mapInPandas(run, fields + ", vector array<float>")


# --- the cache: (content_hash, embedding, dimension, created_at) -----------------------------------------------------------


def latest(cache: DataFrame) -> DataFrame:
    """One row per hash: of several the one stored last (null times first)."""
    return cache.where("content_hash is not null").groupBy("content_hash").agg(F.max_by(F.struct("embedding", "dimension", "created_at"), F.coalesce(F.col("created_at"), F.timestamp_micros(F.lit(0)))).alias("r")).select("content_hash", "r.*")


def hits(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows (content_hash, ...) with `embedding` where the cache has one of it."""
    return rows.join(latest(cache).where("embedding is not null").select("content_hash", "embedding"), "content_hash", "left")


def misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct hashes that the cache has no embedding of: each is embedded once, however often it occurs."""
    known = cache.where("embedding is not null").select("content_hash")
    return rows.where("content_hash is not null").join(known, "content_hash", "left_anti").select("content_hash").distinct()


def stored(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after new rows: each replaces what its hash had. Of several new rows of a hash the one created last holds."""
    return latest(new).unionByName(cache.join(new.select("content_hash").distinct(), "content_hash", "left_anti"))


CACHE = "content_hash string, embedding array<float>, dimension int, created_at timestamp"


def embed_new(rows: DataFrame, cache: DataFrame, embedder: Embedder, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows with `vector`, what is new for the cache): what is cached at the embedder's dimension is taken from there, each missing text
    embedded once. Nothing that is cached is embedded again; the new rows are staged."""
    keyed = rows.withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    known = latest(cache.where(F.col("embedding").isNotNull() & (F.col("dimension") == embedder.dimension())))
    missing = keyed.join(known.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first(text).alias(text))
    made = staged(embed(missing, embedder, text).select("content_hash", F.col("vector").alias("embedding"), F.size("vector").alias("dimension"), F.current_timestamp().alias("created_at")))
    vectors = known.select("content_hash", "embedding").unionByName(made.select("content_hash", "embedding"))
    return keyed.join(vectors, "content_hash", "left").withColumnRenamed("embedding", "vector").drop("content_hash"), made


def embed_cached(rows: DataFrame, cache: DataFrame, embedder: Embedder, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows with `vector`, the cache after it)."""
    out, made = embed_new(rows, cache, embedder, text)
    return out, stored(cache, made)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(4 * F.when(F.col("embedding").isNotNull(), F.size("embedding"))), F.lit(0)).cast("long").alias("bytes"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def evict_older(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """What is not older than `days`; rows without a time stay."""
    return cache.where(F.col("created_at").isNull() | (F.col("created_at") >= now - F.make_dt_interval(F.lit(days))))


def evict_largest(cache: DataFrame, max_bytes: int, share: float = 0.1) -> DataFrame:
    """If the cache is larger than max_bytes, without its oldest `share` (rounded up; ties by hash, null times first); else as it is.

    The places are found by distributed ranks, not in one task.
    """
    key = F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("t"), F.col("content_hash").alias("h"))
    totals = cache.agg(F.count("*").alias("n"), F.sum(4 * F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("bytes"))
    keyed = cache.withColumn("_all", F.lit(0)).withColumn("_key", key)
    places = rank_values(keyed, ["_all"], "_key").select("_key", "n_before")
    out = keyed.join(places, "_key").crossJoin(F.broadcast(totals))  # one row
    gone = (F.coalesce("bytes", F.lit(0)) > max_bytes) & (F.col("n_before") < F.ceil(F.col("n") * share))
    return out.where(~gone).select(*cache.columns)


