"""Ranks within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.staging import staged


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; nulls are equal."""
    same = pc.fill_null(pc.equal(a, b), False)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)


def _running(groups: list[str]):
    """A function over sorted Arrow batches: adds `_inside`, the sum of n_equal of the rows of the group before each in this task, and `_range`, the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, carried = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_equal").to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(b.num_rows, bool)
            for g in groups:
                c = b.column(g)
                new[1:] |= _differs(c[1:], c[:-1])
                new[0] |= last is None or bool(_differs(c[:1], last.column(g))[0])
            total = np.cumsum(n)
            start = np.flatnonzero(new)
            before = total - n
            base = np.zeros(b.num_rows, np.int64)
            if len(start):
                base[start] = before[start] - np.append(0, before[start[:-1]])
            own = before - np.cumsum(base)
            if len(start) == 0 or start[0] > 0:  # the group of the batch before goes on
                own[: start[0] if len(start) else None] += carried
            carried = int(own[-1] + n[-1])
            last = b.slice(b.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.full(b.num_rows, task, np.int32))], [*b.schema.names, "_inside", "_range"])

    return run


def rank_values(df: DataFrame, groups: list[str], key: str, weight: Column | None = None) -> DataFrame:
    """For every distinct (groups, key): `n_before` rows of the group with a smaller key, and `n_equal` with this one.

    A window over a group would gather it in one task. Here the distinct values are counted first (so ties shrink to
    one row each), laid out by range over (groups, key) and summed up where they lie; groups that lie in several ranges add the totals of
    the ranges before. These are two rows a range at most, and are sent to all tasks. A group with a third of all rows is spread over as many
    tasks as its size asks for. `weight` counts a row as more than one. Null keys sort first.
    """
    counted = df.groupBy(*groups, key).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n_equal"))
    sorted_ = counted.repartitionByRange(*groups, key).sortWithinPartitions(*groups, key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields)
    laid = staged(sorted_.mapInArrow(_running(groups), fields + ", _inside long, _range int"))
    totals = laid.groupBy(*groups, "_range").agg(F.max(F.col("_inside") + F.col("n_equal")).alias("_total"))
    every = W.partitionBy(*groups)
    before = every.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_ranges", F.count("*").over(every)).where("_ranges > 1").select(*groups, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    offsets = F.broadcast(offsets.select(*[F.col(g).alias(f"_of_{g}") for g in [*groups, "_range"]], "_offset"))
    condition = F.lit(True)
    for g in [*groups, "_range"]:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return laid.join(offsets, condition, "left").select(*groups, key, (F.col("_inside") + F.coalesce("_offset", F.lit(0))).alias("n_before"), "n_equal")
