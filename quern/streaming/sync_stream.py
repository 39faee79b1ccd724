"""Periodic sync as a stream: change events arrive as files, each micro-batch updates a collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.catalog import Store

CHANGES = "relative_path string, content string, deleted boolean, at timestamp"


def changes(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of change events (CHANGES) from Parquet files that are put into a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def last_of_each(events: DataFrame) -> DataFrame:
    """Of several events of a path the last."""
    return events.groupBy("relative_path").agg(F.max_by(F.struct("content", "deleted"), "at").alias("r")).select("relative_path", "r.*")


def apply_changes(store: Store, name: str, events: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: chunks of the named paths go, those of what is not deleted come. `chunk` turns (relative_path, content) into rows of the collection.

    Only these are written, and become valid as a whole; a batch that runs again replaces the same paths with the same rows.
    """
    latest = last_of_each(events)
    new = chunk(latest.where(~F.coalesce("deleted", F.lit(False)) & F.col("content").isNotNull()).select("relative_path", "content"))
    store.change(name, latest.select("relative_path"), "relative_path", new)


def start(events: DataFrame, store: Store, name: str, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = "5 minutes"):
    """Run the sync: every 5 minutes, or with every=None until all that is there is done."""
    writer = events.writeStream.foreachBatch(lambda df, _: apply_changes(store, name, df, chunk)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def activity(events: DataFrame, late: str = "2 days", width: str = "1 hour") -> DataFrame:
    """Lookups by window of request time and codebase, late ones within the watermark counted: for a stream or a table."""
    return (
        events.withWatermark("requested_at", late)
        .groupBy(F.window("requested_at", width).alias("w"), "codebase_path")
        .agg(F.count("*").alias("lookups"))
        .select(F.col("w.start").alias("window_start"), "codebase_path", "lookups")
    )
