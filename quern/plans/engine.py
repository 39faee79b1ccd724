"""The engine's front: index folders, search them, keep them in step; settings in one place."""

from __future__ import annotations

import os
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths, query_prep
from quern.functions.text import trim_all
from quern.operators import bm25, chunking, dense, embedding, filters, fusion, prf, reading, sync
from quern.operators import catalog as states
from quern.operators.catalog import Store
from quern.sources import files as sources
from quern.staging import once, staged

#: Results of search_code where no number is asked for, and at most.
LIMIT, MOST_RESULTS = 15, 50

#: The catalog's rows, as index and reindex write them.
CATALOG = (
    "codebase_path string, status string, indexed_files int, total_chunks int, index_status string, indexing_percentage double, error_message string, "
    "last_attempted_percentage double, collection_name string"
)


def results_of(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found (query_id, id, score, rank) with the fields of a search result; language from the metadata, else 'unknown'."""
    fields = rows.select("id", "content", "relative_path", "start_line", "end_line", "file_extension", F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("unknown")).alias("language"))
    return found.join(fields, "id")


def hybrid_search(rows: DataFrame, vectors: DataFrame, index: tuple[DataFrame, DataFrame], queries: DataFrame, top: int = 5, fetch: int = 50, k: int = 60, dim: int = 64, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, ...) for queries (query_id, text, vector): the `fetch` best by cosine and by BM25, fused by reciprocal
    ranks, weighed by kind of file, the `top` best. rows must be distinct by id; index: stored postings and their statistics (bm25). `among` (id):
    only these are searched, vectors as well as postings. Contents are looked up for the results only, if at all."""
    if among is not None:
        vectors = vectors.join(among.select("id"), "id", "left_semi")
    lists = (
        dense.top_k(vectors, queries, fetch, dim).select("query_id", F.lit(0).alias("list_no"), "id", "rank")
        .unionByName(bm25.top_k_of(*index, queries, fetch, among).select("query_id", F.lit(1).alias("list_no"), "id", "rank"))
    )
    fused = staged(fusion.reciprocal_ranks(lists, k, fetch))
    return fusion.weigh_files(results_of(fused, rows)).where(F.col("rank") <= top)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Stored rows, each id once: of rows that disagree the one whose fields sort last."""
    return once(rows, "id", lambda rest: F.max(F.struct(*rest)))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    return once(vectors.where("vector is not null").select("id", "vector"), "id", lambda rest: F.min(F.struct(*rest)))


@dataclass(frozen=True)
class Settings:
    extensions: list[str] = field(default_factory=lambda: list(paths.EXTENSIONS))
    ignore: list[str] = field(default_factory=lambda: list(paths.IGNORE))
    splitter: chunking.Splitter = field(default_factory=chunking.Splitter)
    embedder: embedding.Embedder = field(default_factory=embedding.HashingEmbedder)
    hybrid: bool = True
    preprocessing: bool = True
    feedback: bool = False
    reranking: bool = False
    reranker: fusion.Reranker | Callable[[str, str], float] = fusion.overlap
    #: At most so many chunks of a codebase; None: all.
    chunk_limit: int | None = None


@dataclass(frozen=True)
class Indexed:
    files: int
    chunks: int
    status: str


class Engine:
    """Indexes codebases into a store and searches them."""

    def __init__(self, spark: SparkSession, store: Store | None = None, settings: Settings = Settings()):  # noqa: B008
        self.spark, self.store, self.settings = spark, store or Store(spark), settings
        self.feedback = prf.Feedback()

    # --- settings

    def add_extensions(self, more: str | list[str]) -> None:
        self.settings = replace(self.settings, extensions=paths.with_extensions(self.settings.extensions, more))

    def add_ignore(self, more: str | list[str]) -> None:
        self.settings = replace(self.settings, ignore=paths.ignore_patterns(self.settings.ignore, more))

    def reset_ignore(self, more: str | list[str] = ()) -> None:
        self.settings = replace(self.settings, ignore=paths.ignore_patterns(paths.IGNORE, list(more) if not isinstance(more, str) else more))

    def from_environment(self, file: str | None = None, ignore_file: str | None = None) -> None:
        """Further extensions and ignore patterns as CUSTOM_EXTENSIONS and CUSTOM_IGNORE_PATTERNS name them (with commas; of the process, else of a
        file of NAME=value lines), and the lines of a user's own ignore file."""
        if more := sources.env_value("CUSTOM_EXTENSIONS", file):
            self.add_extensions(more)
        if more := sources.env_value("CUSTOM_IGNORE_PATTERNS", file):
            self.add_ignore(more.split(","))
        if ignore_file and os.path.exists(ignore_file):
            with open(ignore_file, encoding="utf-8") as f:
                self.settings = replace(self.settings, ignore=paths.ignore_patterns(self.settings.ignore, f.read()))

    def use(self, **changes) -> None:
        self.settings = replace(self.settings, **changes)

    def collection(self, codebase: str) -> str:
        import hashlib

        return ("hybrid_code_chunks_" if self.settings.hybrid else "code_chunks_") + hashlib.md5(codebase.encode()).hexdigest()[:8]

    def has_index(self, codebase: str) -> bool:
        return self.store.has(self.collection(codebase))

    def clear(self, codebase: str) -> None:
        name = self.collection(codebase)
        for part in (name, name + "_files", name + "_postings"):
            if self.store.has(part):
                self.store.drop(part)
        if self.store.has("catalog"):
            self.store.change("catalog", self.spark.createDataFrame([(codebase,)], "codebase_path string"), "codebase_path")

    # --- the catalog

    def _record(self, codebase: str, status: str, **fields) -> None:
        """Replace the codebase's row of the catalog."""
        row = {"codebase_path": codebase, "status": status, "collection_name": self.collection(codebase), **fields}
        rows = self.spark.createDataFrame([tuple(row.get(f.split()[0]) for f in CATALOG.split(", "))], CATALOG).withColumn("last_updated", F.current_timestamp())
        self.store.change("catalog", rows.select("codebase_path"), "codebase_path", rows)

    def catalog(self) -> DataFrame:
        """The state of every codebase that was indexed here."""
        if not self.store.has("catalog"):
            return self.spark.createDataFrame([], CATALOG + ", last_updated timestamp")
        return self.store.read("catalog")

    def status(self, codebase: str) -> str:
        """What the catalog says of a codebase, in words."""
        found = states.status_text(self.catalog().where(F.col("codebase_path") == codebase)).first()
        return found.message if found else "not indexed"

    # --- indexing

    def _chunks(self, code: DataFrame) -> DataFrame:
        return chunking.split_files(code, self.settings.splitter).where(trim_all(F.col("content")) != "")

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Rows with vectors: what was embedded before comes from the cache, what was not goes into it."""
        cache = self.store.read("embedding_cache") if self.store.has("embedding_cache") else self.spark.createDataFrame([], embedding.CACHE)
        out, made = embedding.embed_new(rows, cache, self.settings.embedder)
        self.store.change("embedding_cache", rows=made)
        return out

    def _posted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows with the number of their terms, their postings laid out by term)."""
        found = bm25.postings(rows.select("id", "content", "relative_path"), "relative_path")
        laid = found.repartitionByRange("term").sortWithinPartitions("term")
        return rows.withColumn("n_terms", F.size(bm25.terms(F.coalesce("content", F.lit(""))))), laid

    def index(self, codebase: str, files: DataFrame | None = None, force: bool = False) -> Indexed:
        """Index a folder (or given files (relative_path, content)). An index that is there is kept unless force is set.

        The catalog tells from the first step on how far it is, and of a failure why. With a limit of chunks, files that are not stored
        whole are not in the snapshot, so that the next reindex finds them.
        """
        name = self.collection(codebase)
        status = "completed"
        if not self.has_index(codebase) or force:
            self._record(codebase, "indexing", indexing_percentage=0.0)
            try:
                status = self._index(codebase, name, files)
            except Exception as e:
                self._record(codebase, "indexfailed", error_message=str(e)[:1000], last_attempted_percentage=0.0)
                raise
        counts = self.store.read(name).agg(F.count_distinct("relative_path"), F.count("*")).first()
        self._record(codebase, "indexed", indexed_files=counts[0], total_chunks=counts[1], index_status=status)
        return Indexed(counts[0], counts[1], status)

    def _index(self, codebase: str, name: str, files: DataFrame | None) -> str:
        if files is None:
            self.add_ignore(sources.read_ignore_files(self.spark, codebase))
            files = sources.read_folder(self.spark, codebase, self.settings.extensions, self.settings.ignore)
        code = sources.code_files(files, self.settings.extensions, self.settings.ignore)
        chunks, status, left_out = staged(self._chunks(code)), "completed", None
        self._record(codebase, "indexing", indexing_percentage=float(sync.progress_percent(1, 4)))
        if self.settings.chunk_limit is not None:
            kept, status = chunking.capped(chunks, self.settings.chunk_limit)
            if status != "completed":
                kept = staged(kept)
                place = ["relative_path", "chunk_index"]
                left_out = chunks.join(kept.select(place), place, "left_anti").select("relative_path").distinct()
                chunks = kept
        rows = staged(self._embedded(staged(distinct_rows(chunking.rows_to_store(chunks, codebase)))))
        self._record(codebase, "indexing", indexing_percentage=float(sync.progress_percent(2, 4)))
        rows, found = self._posted(rows)
        self.store.write(name + "_postings", found)
        self._record(codebase, "indexing", indexing_percentage=float(sync.progress_percent(3, 4)))
        snapshot = sync.snapshot(code)
        self.store.write(name + "_files", snapshot if left_out is None else snapshot.join(left_out, "relative_path", "left_anti"))
        self.store.write(name, rows)  # the index is there from now on
        return status

    def reindex(self, codebase: str, files: DataFrame | None = None, only: list[str] | None = None) -> dict[str, int]:
        """Bring an index in step with its files: numbers of added, modified and removed ones. `only`: files or folders to look at.

        Only chunks, postings and hashes of the files that changed are written. Equal roots of the two snapshots' trees end it at once.
        """
        name = self.collection(codebase)
        files = sources.read_folder(self.spark, codebase, self.settings.extensions, self.settings.ignore) if files is None else files
        code = sources.code_files(files, self.settings.extensions, self.settings.ignore)
        before, after = self.store.read(name + "_files"), staged(sync.snapshot(code))
        same = only is None and sync.unchanged(before, after)
        differences = sync.compare(before, after)
        if only is not None:
            under = F.lit(False)
            for p in only:
                under = under | (F.col("relative_path") == p) | F.col("relative_path").startswith(p.rstrip("/") + "/")
            differences = differences.where(under)
        differences = staged(differences) if not same else None
        counts = {} if same else {r["change"]: r["count"] for r in differences.groupBy("change").count().collect()}
        if counts:
            gone, touched = differences.select("relative_path"), differences.where("change <> 'removed'").select("relative_path")
            chunks = self._chunks(code.join(touched, "relative_path", "left_semi"))
            rows = staged(self._embedded(staged(distinct_rows(chunking.rows_to_store(chunks, codebase)))))
            rows, found = self._posted(rows)
            self.store.change(name + "_postings", gone, "relative_path", found)
            self.store.change(name, gone, "relative_path", rows)
            self.store.change(name + "_files", gone, "relative_path", after.join(touched, "relative_path", "left_semi"))
            totals = self.store.read(name).agg(F.count_distinct("relative_path"), F.count("*")).first()
            self._record(codebase, "indexed", indexed_files=totals[0], total_chunks=totals[1], index_status="completed")
        return {c: counts.get(c, 0) for c in ("added", "modified", "removed")}

    # --- searching

    def search(self, codebase: str, queries: DataFrame, top: int = 5, threshold: float = 0.5, filter_expression: str = "") -> DataFrame:
        """Results for queries (query_id, text): (query_id, rank, score, content, relative_path, start_line, end_line, language).

        An index that is not there gives no results. Hybrid search takes no threshold; dense search keeps scores of at least it.
        """
        s, name = self.settings, self.collection(codebase)
        if not self.store.has(name):
            return self.spark.createDataFrame([], "query_id long, rank int, score double, content string, relative_path string, start_line long, end_line long, language string")
        rows = self.store.read(name)
        condition = filters.parse(filter_expression)
        among = None if condition is None else staged(rows.where(condition).select("id"))
        prepared = queries.select("query_id", "text")
        if s.preprocessing:
            p = query_prep.best(query_prep.preprocess(prepared))
            prepared = query_prep.top(p).select("query_id", F.when(F.col("multi"), F.get("top", F.lit(0))).otherwise(F.col("best")).alias("text"))
        plain = self._search(name, rows, among, prepared, top, threshold)
        if not s.feedback:
            return plain
        try:
            return self._search_twice(name, rows, among, prepared, top, threshold)
        except Exception as e:  # a search must not fail because its expansion does
            warnings.warn(f"without feedback: {str(e)[:300]}", stacklevel=2)
            return plain

    def _search_twice(self, name: str, rows: DataFrame, among: DataFrame | None, prepared: DataFrame, top: int, threshold: float) -> DataFrame:
        """A first pass, its expansion, and a second pass before it. The first pass ever takes a few results more."""
        least = 15 if not self.feedback.queries else 12
        first = staged(self._search(name, rows, among, prepared, max(least, 2 * top), 0.8 * threshold))  # read three times
        began = time.perf_counter()
        expanded = staged(prf.expand(prepared, first.select("query_id", F.col("rank").alias("doc"), "content")))
        counts = expanded.agg(F.count("*"), F.count(F.when(F.size("terms") > 0, 1))).first()
        self.feedback.took(counts[0], counts[1], time.perf_counter() - began)
        again = expanded.where(F.size("terms") > 0).select("query_id", F.col("expanded").alias("text"))
        second = staged(self._search(name, rows, among, again, top, threshold))
        key = ["relative_path", "start_line", "end_line"]
        merged = fusion.merge_ordered(second.select("query_id", *key, "rank"), first.select("query_id", *key, "rank"), key, top)
        both = second.withColumn("source", F.lit(0)).unionByName(first.withColumn("source", F.lit(1))).drop("rank")
        return merged.join(both, ["query_id", *key, "source"]).select("query_id", "rank", "score", "content", *key, "language")

    def browse(self, codebase: str, queries: DataFrame, top: int = 20, least: float = 0.3) -> DataFrame:
        """The `top` rows most similar to each query by cosine alone, of at least this, with their class (high, medium, low)."""
        name = self.collection(codebase)
        rows = self.store.read(name)
        asked = embedding.embed(queries.select("query_id", "text"), self.settings.embedder, "text")
        found = results_of(dense.top_k(rows.select("id", "vector"), asked, top, self.settings.embedder.dimension(), least), rows)
        return found.select("query_id", "rank", "score", fusion.match_class(F.round(F.col("score") * 100)).alias("class"), "content", "relative_path", "start_line", "end_line", "language")

    def search_code(self, codebase: str, query: str, limit: int = LIMIT, extensions: list[str] = (), **flags) -> DataFrame:
        """Results for one query as a reader sees them: (rank, score, text), `limit` of them but no more than MOST_RESULTS.

        `extensions` keeps files of these only, and must name extensions; `flags` are settings (feedback, reranking, ...) for this call. A folder
        within an indexed codebase is searched in that one.
        """
        kept = paths.checked_extensions(list(extensions))
        listed = ", ".join("'" + e.replace("'", "") + "'" for e in kept)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        if not self.has_index(codebase):
            above = states.parent_index(self.spark.createDataFrame([(codebase,)], "path string"), self.catalog()).first()
            codebase = above.indexed or codebase
        before, self.settings = self.settings, replace(self.settings, **flags)
        try:
            found = self.search(codebase, asked, max(1, min(limit, MOST_RESULTS)), 0.3, f"fileExtension in [{listed}]" if kept else "")
        finally:
            self.settings = before
        return reading.formatted(found.withColumn("codebase", F.lit(os.path.basename(codebase.rstrip("/"))))).select("rank", "score", "text")

    def _search(self, name: str, rows: DataFrame, among: DataFrame | None, queries: DataFrame, top: int, threshold: float) -> DataFrame:
        s = self.settings
        fetch = fusion.candidates(top, s.hybrid, s.reranking)
        asked = embedding.embed(queries, s.embedder, "text")
        dim = s.embedder.dimension()
        if s.hybrid:
            index = self.store.read(name + "_postings"), bm25.statistics(rows.select(F.col("n_terms").alias("dl")))
            found = hybrid_search(rows, rows.select("id", "vector"), index, asked, fetch, max(fetch, 10), 60, dim, among)
        else:
            vectors = rows.select("id", "vector")
            vectors = vectors if among is None else vectors.join(among, "id", "left_semi")
            found = results_of(dense.top_k(vectors, asked, fetch, dim, threshold), rows)
        if s.reranking:
            texts = found.join(queries, "query_id").withColumn("doc", fusion.rerank_text(F.col("relative_path"), F.col("content")))
            found = fusion.rerank(texts, top, s.reranker).drop("text", "doc", "rerank_score")
        return found.where(F.col("rank") <= top).select("query_id", "rank", "score", "content", "relative_path", "start_line", "end_line", "language")


