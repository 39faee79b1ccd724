"""Ranked lists put together, weighted, reranked and merged."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.paths import file_weight
from quern.operators.distributed_rank import rank_values


def list_ranks(scored: DataFrame, groups: list[str], item: str = "id") -> DataFrame:
    """scored (groups, item, score, ...) with `rank` from 1 in its group: the larger score first, ties by item. Groups may have any size."""
    keyed = scored.withColumn("_key", F.struct((-F.col("score")).alias("s"), F.col(item).alias("i")))
    places = rank_values(keyed, groups, "_key").select(*groups, F.col("_key.i").alias(item), (F.col("n_before") + 1).cast("int").alias("rank"))
    return scored.join(places, [*groups, item])


def reciprocal_ranks(lists: DataFrame, k: int = 60, most: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of lists (query_id, list_no, id, rank): the sum of 1 / (k + rank), ties by id.

    With `most` each task keeps at most so many of a query before the shuffle; the whole order is made by distributed ranks.
    """
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))
    if most is None:
        return list_ranks(fused, ["query_id"]).select("query_id", "id", "score", "rank")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def weighted_scores(lists: DataFrame, weight: Column | None = None) -> DataFrame:
    """(query_id, id, score) of lists (query_id, list_no, id, score): scores scaled to 0..1 within their list, weighted and summed.

    A list whose scores are all equal counts 1 for each. The bounds are partial aggregates joined back, so that no list is gathered.
    """
    bounds = lists.groupBy("query_id", "list_no").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return (
        lists.join(bounds, ["query_id", "list_no"])
        .withColumn("s", scaled * (F.lit(1.0) if weight is None else weight))
        .groupBy("query_id", "id")
        .agg(F.round(F.sum("s"), 6).alias("score"))
    )


def weigh_files(results: DataFrame) -> DataFrame:
    """results (query_id, ..., relative_path, file_extension, score, rank) with scores of test files lowered, and ranked anew; ties keep their order."""
    weighted = results.withColumn("score", F.round(F.col("score") * file_weight(F.col("relative_path"), F.col("file_extension")), 9)).withColumnRenamed("rank", "before")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return weighted.withColumn("rank", F.row_number().over(w)).drop("before")


def candidates(top: int, hybrid: bool, rerank: bool) -> int:
    """How many results are fetched for `top`: more if they are to be reranked, 50 at most."""
    return top if not rerank else min((3 if hybrid else 2) * top, 50)


def rerank_text(path: Column, content: Column, most: int = 2000) -> Column:
    """What a reranker reads of a row."""
    text = F.concat(F.lit("File: "), F.coalesce(path, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def overlap(query: str, text: str) -> float:
    """The share of a query's words that a text has: the scorer where no model is at hand."""
    words = set(query.lower().split())
    return len(words & set(text.lower().split())) / len(words) if words else 0.0


class Reranker(ABC):
    """Scores pairs of a query and a document, `batch` at a time, in the worker process."""

    batch = 16

    @abstractmethod
    def score(self, queries: list[str], documents: list[str]) -> list[float]: ...


class Each(Reranker):
    """A scorer of one pair as a reranker; a pair it fails on does not touch the others."""

    batch = 1

    def __init__(self, scorer: Callable[[str, str], float]):
        self.scorer = scorer

    def score(self, queries: list[str], documents: list[str]) -> list[float]:
        return [float(self.scorer(q, d)) for q, d in zip(queries, documents, strict=True)]


def rerank(results: DataFrame, top: int, scorer: Reranker | Callable[[str, str], float] = overlap, neutral: float = 0.5) -> DataFrame:
    """results (query_id, id, text, doc, rank, ...) ordered by a reranker of (query text, document text); a batch that fails, or that has not
    one number for each pair, counts `neutral` for each.

    The score of the retrieval stays; `rerank_score` is added. Scored in Arrow batches by whatever the reranker loads once per process.
    """
    by = scorer if isinstance(scorer, Reranker) else Each(scorer)

    def scores(queries: list[str], documents: list[str]) -> list[float]:
        try:
            found = [round(float(x), 6) for x in by.score(queries, documents)]
        except Exception:
            found = []
        return found if len(found) == len(queries) else [neutral] * len(queries)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            q, d = [x or "" for x in p.text], [x or "" for x in p.doc]
            yield p.assign(rerank_score=[x for i in range(0, len(p), by.batch) for x in scores(q[i : i + by.batch], d[i : i + by.batch])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields)
    scored = results.mapInPandas(run, fields + ", rerank_score double").withColumnRenamed("rank", "before")
    w = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "before")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("before")


def merge_ordered(first: DataFrame, second: DataFrame, key: list[str], top: int) -> DataFrame:
    """Two results (query_id, key..., rank): all of the first, then of the second what is new, each key once, `top` a query."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    best = both.groupBy("query_id", *key).agg(F.min(F.struct("source", "rank")).alias("at"))
    w = W.partitionBy("query_id").orderBy("at.source", "at.rank", *key)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", *key, F.col("at.source").alias("source"), F.col("place").alias("rank"))


def match_class(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")
