"""Dense retrieval: exact cosine top-k of a set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors that one pass over the rows takes along, and scores that a task holds at a time.
BYTES_A_PASS, SCORES_AT_ONCE = 16 << 20, 1 << 22

#: Rows that a task multiplies at a time, and in a batch that it returns.
ROWS_AT_ONCE, ROWS_A_BATCH = 1 << 15, 200_000

#: A score is rounded to six digits: one that is smaller by no more than this may still round to the same.
SLACK = 1.1e-6


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length, in double precision, within [-1, 1]; 0 where one has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.slice(F.transform(v, lambda e: e.cast("double")), F.lit(1), n) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    size = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    value = F.nanvl(F.coalesce(F.try_divide(dot, size), F.lit(0.0)), F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector can be compared: of `dim` finite values, not all zero."""
    v = F.transform(vector, lambda e: e.cast("double"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def top_k_one(rows: DataFrame, vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """(id, score, rank) of the k rows most similar to one vector; the filter is applied before anything is scored."""
    rows = rows if where is None else rows.where(where)
    scored = rows.where(usable(F.col("vector"), len(vector))).select("id", F.round(cosine(F.col("vector"), F.array(*map(F.lit, vector))), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # over k rows


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): for every query vector the k most similar rows, ties by id.

    rows (id, vector), queries (query_id, vector). Unusable vectors are in no result; scores are rounded to 6 digits
    before they are ranked. Each task multiplies its rows with all query vectors of the pass and keeps k a query, so that what is
    shuffled is k rows a query and task. Queries beyond BYTES_A_PASS take further passes.
    """
    asked = queries.where(usable(F.col("vector"), dim)).select("query_id", "vector")
    parts, repeated = [], False
    count = asked.count()
    passes = max(1, -(-count * dim * 8 // BYTES_A_PASS))
    for i in range(passes):
        block = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        own = block.toArrow().combine_chunks()  # about BYTES_A_PASS
        if not own.num_rows:
            continue
        ids = own.column("query_id").combine_chunks()
        repeated |= pc.count_distinct(ids, mode="all").as_py() < len(ids)
        sent = rows.sparkSession.sparkContext.broadcast((ids, _directions(own.column("vector").combine_chunks(), dim)))
        kind = queries.schema["query_id"].dataType.simpleString()
        parts.append(rows.where(usable(F.col("vector"), dim)).select("id", "vector").mapInArrow(_best(sent, k, dim, least), f"query_id {kind}, id string, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, id string, score double, rank int")
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.distinct() if repeated else found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _directions(vectors: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors as rows of length 1, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is out of range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(sent, k: int, dim: int, least: float | None):
    """A function over Arrow batches of rows (id, vector): the task's k best of each query that was sent, exactly.

    Of as many groups of rows the k-th best maximum is a bound that k rows reach, as is the k-th best score so far; only scores that reach it are
    rounded and sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        bound = np.full(len(q), -np.inf if least is None else least - SLACK)
        ids: list[pa.Array] = []
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, row, score

        def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of each query, ordered; ties by id."""
            c, d, v = best
            every = pa.concat_arrays(ids)
            by_id = np.empty(len(every), np.int64)
            by_id[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
            order = np.lexsort((by_id[d], -v, c))
            first = np.searchsorted(c[order], np.arange(len(q)))
            kept = order[np.arange(len(order)) - first[c[order]] < k]
            return c[kept], d[kept], v[kept]

        for lo, own, x in _blocks(batches, dim):
            ids.append(own)
            found = [best]
            groups = min(len(x), max(512, 4 * k))
            step = max(1, SCORES_AT_ONCE // len(x))
            for a in range(0, len(q), step):
                s = q[a : a + step] @ x.T
                if len(x) > k:
                    cut = len(x) // groups * groups
                    top = s[:, :cut].reshape(len(s), -1, groups).max(axis=1)
                    np.maximum(bound[a : a + step], np.partition(top, groups - k, axis=1)[:, groups - k] - SLACK if groups > k else -np.inf, out=bound[a : a + step])
                c, d = np.nonzero(s >= bound[a : a + step, None])
                v = np.round(np.clip(s[c, d], -1, 1), 6) + 0.0
                if least is not None:
                    c, d, v = (y[v >= least] for y in (c, d, v))
                found.append((c + a, d + lo, v))
                if a + step >= len(q) or sum(len(y[2]) for y in found) > SCORES_AT_ONCE:  # many equal scores
                    best = tuple(np.concatenate(y) for y in zip(*found, strict=True))
                    best = reduced()
                    found = [best]
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
            last = np.searchsorted(best[0], full, "right") - 1
            bound[full] = np.maximum(bound[full], best[2][last] - SLACK)
        if ids:
            every, (c, d, v) = pa.concat_arrays(ids), best
            for i in range(0, len(c), ROWS_A_BATCH):
                at = slice(i, i + ROWS_A_BATCH)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(c[at])), every.take(pa.array(d[at])), pa.array(v[at])], ["query_id", "id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(rows before, ids, directions) of up to about ROWS_AT_ONCE rows."""
    before, held, n = 0, [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ROWS_AT_ONCE:
            yield before, pa.concat_arrays([h.column("id") for h in held]), _directions(pa.concat_arrays([h.column("vector") for h in held]), dim)
            before, held, n = before + n, [], 0
    if n:
        yield before, pa.concat_arrays([h.column("id") for h in held]), _directions(pa.concat_arrays([h.column("vector") for h in held]), dim)
