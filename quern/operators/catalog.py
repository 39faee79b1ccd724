"""Collections as tables, and the catalog of what is indexed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.operators import filters
from quern.staging import shared_folder

STATES = ("indexing", "indexed", "indexfailed")
QUERY_LIMIT = 16384


def latest_state(catalog: DataFrame) -> DataFrame:
    """One row per codebase: the one updated last (ties: the later status of indexing, indexed, indexfailed)."""
    rest = [c for c in catalog.columns if c != "codebase_path"]
    order = F.struct(F.col("last_updated"), F.array_position(F.array(*map(F.lit, STATES)), F.col("status")))
    return catalog.where("codebase_path is not null").groupBy("codebase_path").agg(F.max_by(F.struct(*rest), order).alias("r")).select("codebase_path", "r.*")


def active(catalog: DataFrame) -> DataFrame:
    """What is searchable after a restart: indexed codebases; an interrupted indexing is not taken up."""
    return latest_state(catalog).where("status = 'indexed'").select("codebase_path")


def reconciled(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Catalog rows whose codebase the store still has (by its rows' metadata). None are added; an empty store leaves none."""
    found = chunks.select(F.get_json_object("metadata", "$.codebasePath").alias("codebase_path")).where("codebase_path is not null").distinct()
    return latest_state(catalog).join(found, "codebase_path", "left_semi")


def parent_index(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, indexed): the codebase itself, or the nearest one above it, that is indexed; null if there is none.

    Each path is exploded into itself and its ancestors and joined by equality: no pattern is tried against every codebase.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    steps = paths.select("path", F.explode(above).alias("codebase_path"))
    found = steps.join(active(catalog), "codebase_path").groupBy("path").agg(F.max_by("codebase_path", F.length("codebase_path")).alias("indexed"))
    return paths.join(found, "path", "left").select("path", "indexed")


def status_text(catalog: DataFrame) -> DataFrame:
    """(codebase_path, message): what the latest state says."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    text = (
        F.when(F.col("status") == "indexed", F.concat(F.lit("indexed: "), n("indexed_files"), F.lit(" files, "), n("total_chunks"), F.lit(" chunks"), F.when(F.col("index_status") == "limit_reached", F.lit(" (limit reached)")).otherwise(F.lit(""))))
        .when(F.col("status") == "indexing", F.concat(F.lit("indexing: "), F.format_string("%.1f", F.coalesce("indexing_percentage", F.lit(0.0))), F.lit("%")))
        .otherwise(F.concat(F.lit("failed: "), F.coalesce("error_message", F.lit("unknown error"))))
    )
    return latest_state(catalog).select("codebase_path", text.alias("message"))


def recent(repos: DataFrame, most: int = 5, since: Column | None = None) -> DataFrame:
    """The repositories indexed last, each once; with `since` none that were indexed before."""
    latest = repos.groupBy("id").agg(F.max("indexed_at").alias("indexed_at"))
    latest = latest if since is None else latest.where(F.col("indexed_at") >= since)
    return latest.orderBy(F.desc("indexed_at"), "id").limit(most)


def select_rows(rows: DataFrame, expression: str = "", columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows by a filter expression; without one at most QUERY_LIMIT, ordered by id where a limit holds."""
    condition: Column | None = filters.parse(expression)
    out = rows if condition is None else rows.where(condition)
    if limit is None and condition is None:
        limit = QUERY_LIMIT
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return out.select(*(columns or rows.columns))


class Store:
    """Collections kept as Parquet parts and a list of them for each version.

    A change is written beside what is there: rows that come as a new part, keys of rows that go as another. It becomes valid with the list
    that names it, whose number only one writer can take; what a failed write leaves is in no list. After MOST_PARTS changes the parts are
    written as one.
    """

    MOST_PARTS = 8

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/store"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, name: str) -> dict[int, list[list[str]]]:
        """The parts of each whole version: [kind, folder, key], oldest first."""
        fs, p = self._fs(f"{self.folder}/{name}/lists")
        out = {}
        for s in fs.listStatus(p) if fs.exists(p) else []:
            lines = self._text(s.getPath().toString()).splitlines()
            if lines and lines[-1] == "end":  # else its writer is not done
                out[int(s.getPath().getName())] = [x.split(" ") for x in lines[:-1]]
        return dict(sorted(out.items()))

    def _publish(self, name: str, number: int, parts: list[list[str]]) -> None:
        fs, p = self._fs(f"{self.folder}/{name}/lists/{number}")
        stream = fs.create(p, False)  # fails if another writer has taken the number
        try:
            stream.write(bytearray("\n".join([*(" ".join(x) for x in parts), "end"]), "utf-8"))
        finally:
            stream.close()
        versions = self._versions(name)
        kept = {x[1] for n in [*versions][-2:] for x in versions[n]}
        for n in [*versions][:-2]:  # those of the last two versions stay for whoever reads them
            for x in {x[1] for x in versions[n]} - kept:
                fs.delete(self._fs(f"{self.folder}/{name}/{x}")[1], True)
            fs.delete(self._fs(f"{self.folder}/{name}/lists/{n}")[1], True)

    def _part(self, name: str, rows: DataFrame) -> str:
        folder = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}/{folder}")
        return folder

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def names(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if self.has(n := s.getPath().getName()))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise AnalysisException(f"no collection {name}")
        return self._composed(name, versions[max(versions)])

    def _composed(self, name: str, parts: list[list[str]]) -> DataFrame:
        out: DataFrame | None = None
        for kind, folder, key in parts:
            df = self.spark.read.parquet(f"{self.folder}/{name}/{folder}")
            if kind == "rows":
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
            elif out is not None:
                out = out.join(df, key, "left_anti").select(out.columns)
        return out

    def write(self, name: str, rows: DataFrame) -> None:
        """The collection's new state, whole."""
        number = max(self._versions(name), default=0) + 1
        self._publish(name, number, [["rows", self._part(name, rows), "-"]])

    def change(self, name: str, gone: DataFrame | None = None, key: str = "id", rows: DataFrame | None = None) -> None:
        """Rows whose `key` is in `gone` go, then `rows` come; only these are written. A collection that is not there begins with `rows`."""
        versions = self._versions(name)
        number = max(versions, default=0)
        parts = list(versions[number]) if versions else []
        if gone is not None and parts:
            parts.append(["gone", self._part(name, gone.select(key).where(F.col(key).isNotNull()).distinct()), key])
        if rows is not None:
            parts.append(["rows", self._part(name, rows), "-"])
        if len(parts) > self.MOST_PARTS:
            parts = [["rows", self._part(name, self._composed(name, parts)), "-"]]
        if parts:
            self._publish(name, number + 1, parts)

    def insert(self, name: str, rows: DataFrame) -> None:
        self.change(name, rows=rows)

    def delete(self, name: str, ids: DataFrame) -> None:
        self.change(name, ids, "id")

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)
