"""Queries of sources, chunking, embedding cache, sync, catalog, evaluation and reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths
from quern.functions.text import trim_all
from quern.operators import catalog, chunking, embedding, evaluation, reading, sync
from quern.plans.engine import distinct_rows
from quern.plans.search_queries import LISTS, ROWS, _lists, _rows
from quern.sources import files as sources
from quern.staging import staged, table

NOW = "2025-03-05 00:00:00"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files: a path from source, number and language."""
    ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXT.items() for x in kv]), F.col("code_lang")), F.lit(".md"))
    return table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("relative_path"), "doc_id", F.col("text").alias("content"))


EXT = {"python": ".py", "typescript": ".ts", "javascript": ".js", "go": ".go", "rust": ".rs", "java": ".java", "cpp": ".cpp", "csharp": ".cs", "ruby": ".rb", "tsx": ".tsx", "php": ".php", "kotlin": ".kt", "scala": ".scala", "c": ".c"}
FILES = f"""
files AS (SELECT concat(coalesce(source, 'none'), '/doc_', doc_id, CASE code_lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EXT.items())} ELSE '.md' END) AS relative_path, doc_id, text AS content FROM documents)"""


def _code(spark, d):
    """code_chunks, each number once, as chunks of files."""
    rest = ["content", "start_line", "end_line", "language", "file_path"]
    once = table(spark, d, "code_chunks").where("chunk_no is not null").groupBy("chunk_no").agg(F.max(F.struct(*rest)).alias("r")).select(F.col("chunk_no").alias("seq"), "r.*")
    return once.withColumn("relative_path", F.coalesce("file_path", F.lit("?")))


CODE = """
code AS (SELECT chunk_no AS seq, r.content AS content, r.start_line AS start_line, r.end_line AS end_line, r.language AS language, coalesce(r.file_path, '?') AS relative_path FROM (
  SELECT chunk_no, max(struct_pack(content := content, start_line := start_line, end_line := end_line, language := language, file_path := file_path)) AS r FROM code_chunks WHERE chunk_no IS NOT NULL GROUP BY chunk_no))"""


# --- sources


def scan_classified(spark, d):
    path = table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct()
    return sources.classified(path).select("relative_path", "reason", F.coalesce("pattern", F.lit("")).alias("pattern"))


def scan_counters(spark, d):
    path = table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct()
    return sources.scan_counters(path).withColumn("pattern", F.coalesce("pattern", F.lit("")))


def scan_code_files(spark, d):
    more = paths.with_extensions(paths.EXTENSIONS, "yaml, .json,.yaml")
    path = table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct()
    return sources.code_files(path, more, paths.ignore_patterns(paths.IGNORE, "# tests\n__tests__/\n\n!dist/**\nsrc/*/index/*.ts\n"))


def language_map(spark, d):
    return _rows(spark, d).select("id", paths.language_of(paths.extension(F.col("relative_path"))).alias("language"))


def language_routing(spark, d):
    return _code(spark, d).select("seq", chunking.grammar_of(F.col("language")).alias("grammar"))


def remote_tree_files(spark, d):
    tree = _rows(spark, d).select(F.col("relative_path").alias("path"), F.when(F.length("content") > 200, "blob").otherwise("tree").alias("type")).distinct()
    return sources.remote_files(tree)


def sync_ignored_files(spark, d):
    patterns = ["*.min.js", "vendors/", "services/*/channel/", "src/archive/*", "assets", "*.yaml"]
    path = table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct()
    return path.where(sync.sync_ignored(F.col("relative_path"), patterns))


def resume_instances(spark, d):
    asked = table(spark, d, "queries").select(F.col("query_id").cast("string").alias("instance_id")).distinct()
    done = table(spark, d, "ranked").where("list_no = 2").select(F.col("query_id").cast("string").alias("instance_id"))
    return sources.not_done(asked, done)


# --- chunks


def chunk_ids(spark, d):
    return _rows(spark, d).select("id", chunking.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"))


def collection_names(spark, d):
    return table(spark, d, "index_catalog").select("codebase_path", chunking.collection_name(F.col("codebase_path")).alias("hybrid"), chunking.collection_name(F.col("codebase_path"), False).alias("dense")).distinct()


def store_rows(spark, d):
    """Rows built for the store, metadata as JSON."""
    chunks = _code(spark, d).where("content is not null").select("relative_path", "language", F.col("seq").cast("int").alias("chunk_index"), "content", "start_line", "end_line")
    return chunking.rows_to_store(chunks, "/srv/code").select("id", "relative_path", "start_line", "end_line", "file_extension", "metadata")


def chunk_line_greedy(spark, d):
    return chunking.split_pieces(_code(spark, d), "seq", 2500).select("seq", "piece", F.md5("content").alias("digest"), "start_line", "end_line")


def chunk_window(spark, d):
    return chunking.split_pieces(_code(spark, d).withColumn("start_line", F.lit(1)), "seq", chunking.WINDOW_SIZE, "window").select("seq", "piece", F.md5("content").alias("digest"), "start_line", "end_line")


def chunk_range_dedupe(spark, d):
    return chunking.dedupe_ranges(_code(spark, d)).select("relative_path", "start_line", "end_line", "seq")


def chunk_overlap(spark, d):
    return chunking.add_overlap(_code(spark, d), 40).select("seq", "relative_path", "start_line", "end_line", F.md5("content").alias("digest"))


def chunk_refined(spark, d):
    """Oversized chunks cut by lines, ranges once, overlap: in this order."""
    pieces = chunking.split_pieces(_code(spark, d), "seq", 2500).join(_code(spark, d).select("seq", "relative_path"), "seq")
    pieces = pieces.withColumn("seq", F.col("seq") * 100000 + F.col("piece"))
    return chunking.add_overlap(chunking.dedupe_ranges(pieces), 40).select("seq", "relative_path", "start_line", "end_line", F.md5("content").alias("digest"))


def chunk_declarations(spark, d):
    files = _files(spark, d).withColumn("language", paths.language_of(paths.extension(F.col("relative_path"))))
    return chunking.split_files(files).select("relative_path", "chunk_index", "start_line", "end_line", F.length("content").alias("n"))


def chunk_gaps(spark, d):
    files = _files(spark, d).withColumn("language", paths.language_of(paths.extension(F.col("relative_path"))))
    return chunking.split_files(files, chunking.Splitter("gaps")).select("relative_path", "chunk_index", "start_line", "end_line", F.length("content").alias("n"))


def chunk_recursive(spark, d):
    files = _files(spark, d).withColumn("language", paths.language_of(paths.extension(F.col("relative_path"))))
    return chunking.split_files(files, chunking.Splitter("recursive", 1000, 200)).select("relative_path", "chunk_index", "start_line", "end_line", F.length("content").alias("n"))


def chunk_long_enough(spark, d):
    return table(spark, d, "documents").where(chunking.long_enough(F.col("text"))).select("doc_id")


def chunk_cap(spark, d):
    rows = _code(spark, d).select("relative_path", F.col("seq").alias("chunk_index"))
    kept, status = chunking.capped(rows, 120)  # the feature is the cap: one that every size of the table reaches or not
    return kept.withColumn("status", F.lit(status))


def token_estimate(spark, d):
    return _rows(spark, d).groupBy("file_extension").agg(F.sum(embedding.token_estimate(F.col("content"))).cast("long").alias("tokens"))


# --- embedding and its cache


def embedding_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(embedding.prepare(F.col("text"))).alias("digest"))


def embedding_reduced(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", embedding.reduced(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"))


def embedding_hashed(spark, d):
    rows = embedding.embed(_rows(spark, d).select("id", "content"), embedding.HashingEmbedder(64))
    return rows.select("id", F.size("vector").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length"))


def content_hashes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", embedding.content_hash(F.col("text")).alias("hash"))


def cache_latest(spark, d):
    return embedding.latest(table(spark, d, "embedding_cache")).select("content_hash", F.coalesce("dimension", F.lit(-1)).alias("dimension"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def cache_hits(spark, d):
    asked = table(spark, d, "cache_lookups").where("content_hash is not null").select("lookup_id", "content_hash").distinct()
    return embedding.hits(asked, table(spark, d, "embedding_cache")).select("lookup_id", "content_hash", F.col("embedding").isNotNull().alias("hit"))


def cache_misses(spark, d):
    return embedding.misses(table(spark, d, "cache_lookups").select("content_hash"), table(spark, d, "embedding_cache"))


def cache_upsert(spark, d):
    cache = table(spark, d, "embedding_cache").where("content_hash is not null")
    new = cache.where("dimension = 64").select("content_hash", "embedding", F.lit(128).alias("dimension"), F.lit(NOW).cast("timestamp").alias("created_at"))
    return embedding.stored(cache, new).select("content_hash", F.coalesce("dimension", F.lit(-1)).alias("dimension")).distinct()


def cache_stats(spark, d):
    stats = embedding.cache_stats(table(spark, d, "embedding_cache"))
    return stats.select("entries", "bytes", F.col("oldest").cast("timestamp_ntz").alias("oldest"), F.col("newest").cast("timestamp_ntz").alias("newest"))


def cache_evict_ttl(spark, d):
    return embedding.evict_older(table(spark, d, "embedding_cache"), F.lit(NOW).cast("timestamp"), 30).select("content_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def cache_evict_size(spark, d):
    cache = embedding.latest(table(spark, d, "embedding_cache"))
    return embedding.evict_largest(cache, 100_000).select("content_hash")


# --- sync


def _versions(spark, d):
    """Two snapshots of the documents as files: some missing before, some after, some changed."""
    files = _files(spark, d)
    before = files.where("doc_id % 10 <> 3")
    after = files.where("doc_id % 10 <> 7").withColumn("content", F.when(F.col("doc_id") % 10 == 5, F.concat(F.coalesce("content", F.lit("")), F.lit("!"))).otherwise(F.col("content")))
    return sync.snapshot(before), sync.snapshot(after)


def snapshot_hashes(spark, d):
    return sync.snapshot(_files(spark, d))


def snapshot_diff(spark, d):
    return sync.compare(*_versions(spark, d))


def merkle_root(spark, d):
    return sync.merkle_root(sync.snapshot(_files(spark, d)))


def merkle_diff(spark, d):
    a, b = _versions(spark, d)
    node = lambda x: x.select(sync.leaf_hash(F.col("relative_path"), F.col("hash")).alias("id"))
    return sync.compare_nodes(node(a), node(b))


def merkle_nodes(spark, d):
    return sync.merkle_nodes(sync.snapshot(_files(spark, d))).select("id", "data", F.size("parents").alias("parents"), F.size("children").alias("children"))


def _changed_collection(spark, d):
    rows = distinct_rows(table(spark, d, "chunks").select("id", "content", "relative_path"))
    number = F.pmod(F.conv(F.substring(F.md5("relative_path"), 1, 6), 16, 10).cast("long"), F.lit(10))
    changes = rows.select("relative_path").distinct().withColumn("change", F.when(number == 1, "removed").when(number == 2, "modified").when(number == 3, "added")).where("change is not null")
    new = rows.withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" (new)"))).withColumn("id", F.concat("id", F.lit("n")))
    return rows.where(F.coalesce(number != 3, F.lit(True))), changes, new


def reindex_delta(spark, d):
    return sync.after_change(*_changed_collection(spark, d)).select("id", "relative_path")


def targeted_update(spark, d):
    return sync.after_change(*_changed_collection(spark, d), only=F.col("relative_path").startswith("src/")).select("id", "relative_path")


def index_progress(spark, d):
    c = catalog.latest_state(table(spark, d, "index_catalog"))
    return c.where("indexed_files is not null").select("codebase_path", sync.progress(F.coalesce("total_chunks", F.lit(0)) % (F.col("indexed_files") + 1), F.col("indexed_files")).alias("percent"))


# --- catalog


def catalog_latest_state(spark, d):
    c = catalog.latest_state(table(spark, d, "index_catalog"))
    return c.select("codebase_path", "status", F.coalesce("indexed_files", F.lit(-1)).alias("indexed_files"), F.coalesce("total_chunks", F.lit(-1)).alias("total_chunks"), F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


def catalog_active(spark, d):
    return catalog.active(table(spark, d, "index_catalog"))


def catalog_reconcile(spark, d):
    return catalog.reconciled(table(spark, d, "index_catalog"), table(spark, d, "chunks")).select("codebase_path", "status")


def catalog_status(spark, d):
    return catalog.status_text(table(spark, d, "index_catalog"))


def recent_repos(spark, d):
    repos = table(spark, d, "index_catalog").select(F.col("codebase_path").alias("id"), F.col("last_updated").alias("indexed_at"))
    return catalog.recent(repos).select("id", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"))


def delete_by_ids(spark, d):
    rows = distinct_rows(table(spark, d, "chunks").select("id", "relative_path"))
    return rows.join(table(spark, d, "expansion_terms").select("id").distinct(), "id", "left_anti")


def lookup_activity(spark, d):
    from quern.streaming.sync_stream import activity

    rows = table(spark, d, "cache_lookups").where("lookup_id is not null").groupBy("lookup_id").agg(F.max(F.struct("codebase_path", "requested_at")).alias("r")).select("r.*")
    return activity(rows).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "codebase_path", "lookups")


# --- evaluation


def _runs(spark, d):
    """Each further list of a query held against its first one: paths found and paths wanted, of the whole lists."""
    rows = _rows(spark, d).select("id", F.concat(F.lit("/"), "relative_path").alias("path"))
    listed = staged(_lists(spark, d).join(rows, "id").groupBy("query_id", "list_no").agg(F.collect_set("path").alias("paths")))  # a list is some tens of rows
    wanted = listed.where("list_no = 0").select("query_id", F.transform("paths", lambda p: F.substring(p, 2, 1 << 30)).alias("oracles"))
    return listed.where("list_no > 0").select("query_id", "list_no", F.col("paths").alias("hits")).join(wanted, "query_id").withColumn("instance_id", F.col("query_id").cast("string"))


def retrieval_metrics(spark, d):
    return evaluation.with_metrics(_runs(spark, d)).select("query_id", "list_no", "precision", "recall", "f1")


def run_aggregates(spark, d):
    return evaluation.run_aggregates(evaluation.with_metrics(_runs(spark, d)), ["list_no"], ["precision", "f1"])


def relative_change(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return e.select("event_type", F.round(evaluation.change_percent(F.col("a"), F.col("b")), 6).alias("change"))


def _patches(spark, d):
    p = F.col("relative_path")
    one = lambda x: F.concat(F.lit("diff --git a/"), x, F.lit(" b/"), x, F.lit("\n--- a/"), x, F.lit("\n+++ b/"), x, F.lit("\n@@ -1 +1 @@\n-old\n+new\n"))
    return table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct().withColumn("patch", F.concat(one(p), F.when(F.length(p) % 2 == 0, one(F.concat(F.lit("doc/"), p))).otherwise(F.lit(""))))


def patch_files(spark, d):
    return _patches(spark, d).select("relative_path", F.array_join(evaluation.patched_files(F.col("patch")), "|").alias("files"), evaluation.patch_file_count(F.col("patch")).alias("n"))


def _transcripts(spark, d):
    """For each file a log of work on it: two edits that were made, and two that were asked for."""
    p = F.col("relative_path")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    text = say("Reading ", p, "\n  Successfully modified file: /repo/", p, " (1 change)\nTool edit, {\"file_path\": \"", p, "\"}\nSuccessfully modified file: /else/", p, "\nEDIT {'file_path': '/repo/doc/", p, "'} then Successfully modified file: ", p)
    return table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct().select(p.alias("doc_id"), text.alias("text"))


def edited_paths(spark, d):
    return evaluation.edited_paths(_transcripts(spark, d), "/repo")


def patch_subset(spark, d):
    hard = F.when(F.length("relative_path") % 3 == 0, "15 min - 1 hour").otherwise("<15 min fix")
    return evaluation.subset_share(_patches(spark, d).withColumn("difficulty", hard), "15 min - 1 hour", 2)


def token_totals(spark, d):
    """Events as the messages of their users: what went in and out, and of two in three the total."""
    n = F.floor("value").cast("long")
    total = F.when(F.col("event_id") % 3 != 0, n + F.length("event_type") + 1)
    messages = table(spark, d, "events").select(F.col("user_id").alias("instance_id"), n.alias("input_tokens"), F.length("event_type").alias("output_tokens"), total.alias("total_tokens"))
    return evaluation.token_totals(messages)


def tool_counts(spark, d):
    """Events as calls of tools by their users."""
    stats = evaluation.tool_stats(table(spark, d, "events").select(F.col("user_id").alias("instance_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("tool")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("tool_call_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats.select("instance_id", shown.alias("tools"), "total_tool_calls")


def edit_calls(spark, d):
    """Edits written into logs and read from them again."""
    plain = F.substring(F.regexp_replace("content", "[^A-Za-z0-9_ ]", ""), 1, 60)
    q = F.lit("'")
    log = F.concat(F.lit("Tool Call: 'edit'\n   Arguments: {'file_path': '"), "relative_path", F.lit("', 'old_string': \""), plain, F.lit("\\n\", 'new_string': "), q, F.lit("new "), plain, q, F.lit("}\n   Arguments: {'path': 'x'}\n"))
    return evaluation.edit_calls(_code(spark, d).where("content is not null").select(F.col("seq").alias("doc_id"), log.alias("text")))


def test_paths(spark, d):
    return table(spark, d, "chunks").where("relative_path is not null").select("relative_path").distinct().where(evaluation.is_test(F.col("relative_path")))


def truncated_lines(spark, d):
    return _rows(spark, d).select("id", F.md5(evaluation.first_lines(F.col("content"), 10)).alias("digest"))


def edit_places(spark, d):
    """On which line an edit of a passage in the middle of a text begins."""
    files = _files(spark, d)
    calls = files.where("length(content) > 80").select(F.col("relative_path").alias("file_path"), F.substring("content", 41, 40).alias("old"), F.lit("x").alias("new"))
    return evaluation.edit_diffs(calls, files).select("file_path", "line")


def chunk_line_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", chunking.line_estimate(F.col("text"), F.substring("text", 101, 50)).alias("line"))


def grep_anchored(spark, d):
    return reading.grep(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), r"^(?:def|func|class) [A-Za-z_]+", "doc_id")


def edit_diffs(spark, d):
    rows = _code(spark, d).where("content is not null").select("seq", F.col("relative_path").alias("name"), F.col("content").alias("old"), F.regexp_replace("content", "return", "yield").alias("new"))
    return evaluation.unified_diffs(rows).select("seq", F.length("diff").alias("n"))


# --- reading


def grep_lines(spark, d):
    return reading.grep(_rows(spark, d).select("id", "content"), r"return [a-z]+", "id")


def read_slice(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(reading.read_slice(F.col("text"), 2, 5)).alias("digest"))


def list_directory(spark, d):
    return reading.list_directory(table(spark, d, "chunks").where("relative_path is not null").select("relative_path"), "src")


def directory_tree(spark, d):
    return reading.directory_tree(table(spark, d, "chunks").where("relative_path is not null").select("relative_path"))


def tree_lines(spark, d):
    return reading.tree(table(spark, d, "chunks").select("relative_path"), 2)


def trimmed_lengths(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(trim_all(F.col("text"))).alias("n"))


def queries():
    each = (
        scan_classified, scan_counters, scan_code_files, language_map, language_routing, remote_tree_files, sync_ignored_files, resume_instances,
        chunk_ids, collection_names, store_rows, chunk_line_greedy, chunk_window, chunk_range_dedupe, chunk_overlap, chunk_refined, chunk_declarations, chunk_gaps, chunk_recursive,
        chunk_long_enough, chunk_cap, token_estimate, embedding_text, embedding_reduced, embedding_hashed, content_hashes,
        cache_latest, cache_hits, cache_misses, cache_upsert, cache_stats, cache_evict_ttl, cache_evict_size,
        snapshot_hashes, snapshot_diff, merkle_root, merkle_diff, merkle_nodes, reindex_delta, targeted_update, index_progress,
        catalog_latest_state, catalog_active, catalog_reconcile, catalog_status, recent_repos, delete_by_ids, lookup_activity,
        retrieval_metrics, run_aggregates, relative_change, patch_files, patch_subset, edited_paths, token_totals, tool_counts, test_paths, truncated_lines, edit_calls, edit_places, edit_diffs,
        grep_lines, grep_anchored, chunk_line_estimate, read_slice, list_directory, directory_tree, tree_lines, trimmed_lengths,
    )
    return {f.__name__: f for f in each}


# --- SQL ---------------------------------------------------------------------------------------------------------------------

PATHS = "p AS (SELECT DISTINCT relative_path FROM chunks WHERE relative_path IS NOT NULL)"
TRIMMED = lambda c: f"regexp_replace({c}, '^[\\s\\x{{FEFF}}\\p{{Z}}]+|[\\s\\x{{FEFF}}\\p{{Z}}]+$', '', 'g')"
LATEST = "lc AS (SELECT * FROM embedding_cache WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(epoch_us(created_at), 0) DESC) = 1)"
CATALOG = "cat AS (SELECT * FROM index_catalog WHERE codebase_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY codebase_path ORDER BY last_updated DESC, list_position(['indexing', 'indexed', 'indexfailed'], status) DESC) = 1)"
NTZ = lambda c: f"{c} AT TIME ZONE 'UTC'"


def _ignored_sql(patterns: list[str]) -> str:
    out = "FALSE"
    for p in patterns:
        regex, negated = paths.glob_regex(p)
        out = f"CASE WHEN regexp_matches(relative_path, '{regex}') THEN {'FALSE' if negated else 'TRUE'} ELSE {out} END"
    return out


def _extension_sql(c: str) -> str:
    return f"regexp_extract({c}, '[^/](\\.[^./]*)$', 1)"


def _language_sql(ext: str) -> str:
    return f"CASE {ext} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in paths.LANGUAGE_OF.items())} ELSE 'text' END"


def _scan_sql(extensions: list[str], patterns: list[str]) -> str:
    listed = ", ".join(f"'{e}'" for e in extensions)
    first = " ".join(f"WHEN regexp_matches(relative_path, '{paths.glob_regex(p)[0]}') THEN '{p}'" for p in patterns if not p.startswith("!"))
    return f"""{PATHS}, scan AS (SELECT *, CASE WHEN reason = 'ignored' THEN CASE {first} ELSE 'unknown-pattern' END ELSE '' END AS pattern FROM (
  SELECT relative_path, CASE WHEN {_ignored_sql(patterns)} THEN 'ignored' WHEN {_extension_sql('relative_path')} NOT IN ({listed}) THEN 'unsupported' ELSE 'included' END AS reason FROM p))"""


GREEDY = """
ln AS (SELECT seq, start_line, string_split(content, chr(10)) AS l FROM code WHERE content IS NOT NULL),
st AS (
  SELECT seq, start_line AS base, l, len(l) AS n, 1 AS i, CASE WHEN len(l) = 1 THEN l[1] ELSE l[1] || chr(10) END AS held, start_line AS s, 1 AS c, 0 AS k, CAST(NULL AS VARCHAR) AS done, 0 AS ds, 0 AS de FROM ln
  UNION ALL
  SELECT seq, base, l, n, i + 1,
    CASE WHEN i = n THEN '' WHEN full_ THEN nx ELSE held || nx END, CASE WHEN full_ THEN base + i ELSE s END, CASE WHEN full_ THEN 1 ELSE c + 1 END, CASE WHEN full_ THEN k + 1 ELSE k END,
    CASE WHEN full_ OR i = n THEN held END, s, s + c - 1
  FROM (SELECT *, CASE WHEN i < n THEN l[i + 1] || CASE WHEN i + 1 < n THEN chr(10) ELSE '' END ELSE '' END AS nx, i < n AND length(held) > 0 AND length(held) + length(l[i + 1]) + CASE WHEN i + 1 < n THEN 1 ELSE 0 END > 2500 AS full_ FROM st WHERE i <= n)),
out0 AS (SELECT seq, k, i, n, done, ds, de FROM st WHERE done IS NOT NULL)"""


def _greedy_sql() -> str:
    trim = lambda c: f"regexp_replace({c}, '^[\\s]+|[\\s]+$', '', 'g')"
    return f"""RECURSIVE {CODE}, {GREEDY},
pieces AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY i) - 1 AS INTEGER) AS piece, {trim('done')} AS content, ds AS start_line, de AS end_line FROM out0 WHERE i <= n OR {trim('done')} <> '')"""


WINDOWED = """
ln AS (SELECT seq, string_split(content, chr(10)) AS l FROM code WHERE content IS NOT NULL),
st AS (
  SELECT seq, l, len(l) AS n, 1 AS i, 1 AS s, length(l[1]) + 1 AS cost, CAST(NULL AS VARCHAR) AS done, 0 AS ds, 0 AS de FROM ln
  UNION ALL
  SELECT seq, l, n, i + 1, CASE WHEN full_ THEN i + 1 - keep ELSE s END,
    CASE WHEN full_ THEN CASE WHEN keep > 0 THEN length(array_to_string(l[i + 1 - keep:i], chr(10))) ELSE 0 END + length(l[i + 1]) + 1 WHEN i < n THEN cost + length(l[i + 1]) + 1 ELSE cost END,
    CASE WHEN full_ OR i = n THEN array_to_string(l[s:i], chr(10)) END, s, i
  FROM (SELECT *, least(200 * (i - s + 1) // greatest(1, length(array_to_string(l[s:i], chr(10)))), i - s + 1) AS keep, i < n AND cost + length(l[i + 1]) + 1 > 1000 AS full_ FROM st WHERE i <= n)),
pieces AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY de, ds) - 1 AS INTEGER) AS piece, done AS content, ds AS start_line, de AS end_line FROM st WHERE done IS NOT NULL AND regexp_matches(done, '[^\\s]'))"""


def _versions_sql() -> str:
    return f"""{FILES}, a AS (SELECT relative_path, sha256(coalesce(content, '')) AS hash FROM files WHERE doc_id % 10 <> 3),
b AS (SELECT relative_path, sha256(CASE WHEN doc_id % 10 = 5 THEN coalesce(content, '') || '!' ELSE coalesce(content, '') END) AS hash FROM files WHERE doc_id % 10 <> 7)"""


WHOLE = f"{FILES}, a AS (SELECT relative_path, sha256(coalesce(content, '')) AS hash FROM files)"


def _root_sql() -> str:
    return """leaf AS (SELECT sha256(relative_path || ':' || hash) AS id, relative_path || ':' || hash AS data FROM a),
bk AS (SELECT substr(id, 1, 3) AS b, sha256(string_agg(id, '' ORDER BY id)) AS h FROM leaf GROUP BY 1),
rt AS (SELECT sha256('root:' || coalesce(string_agg(h, '' ORDER BY b), '')) AS root FROM bk)"""


def _changed_sql(only: str = "TRUE") -> str:
    number = "CAST('0x' || substr(md5(relative_path), 1, 6) AS BIGINT) % 10"
    return f"""WITH r AS (SELECT id, max(relative_path) AS relative_path FROM (SELECT id, relative_path FROM chunks WHERE id IS NOT NULL) GROUP BY id),
m AS (SELECT *, CAST({number} AS INTEGER) AS k FROM r)
SELECT id, relative_path FROM m WHERE coalesce(k <> 3, TRUE) AND NOT coalesce(k IN (1, 2) AND {only}, FALSE) UNION ALL SELECT id || 'n', relative_path FROM m WHERE k IN (2, 3) AND {only}"""


RUNS = f"""{ROWS}, {LISTS}, listed AS (SELECT query_id, list_no, list(DISTINCT relative_path) AS p FROM lists JOIN rows USING (id) WHERE relative_path IS NOT NULL GROUP BY query_id, list_no),
runs AS (SELECT x.query_id, x.list_no, x.p AS h, y.p AS o FROM listed x JOIN listed y ON x.query_id = y.query_id AND y.list_no = 0 WHERE x.list_no > 0),
met AS (SELECT *, len(list_intersect(h, o)) AS c FROM runs),
me AS (SELECT query_id, list_no, CASE WHEN len(h) = 0 THEN 0 ELSE c / len(h) END AS p, CASE WHEN len(o) = 0 THEN 0 ELSE c / len(o) END AS r FROM met),
metrics AS (SELECT query_id, list_no, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM me)"""
PATCHES = f"""{PATHS}, one AS (SELECT relative_path, concat('diff --git a/', relative_path, ' b/', relative_path, chr(10), '--- a/', relative_path, chr(10), '+++ b/', relative_path, chr(10), '@@ -1 +1 @@', chr(10), '-old', chr(10), '+new', chr(10)) AS x,
  concat('diff --git a/doc/', relative_path, ' b/doc/', relative_path, chr(10), '--- a/doc/', relative_path, chr(10), '+++ b/doc/', relative_path, chr(10), '@@ -1 +1 @@', chr(10), '-old', chr(10), '+new', chr(10)) AS y FROM p),
patches AS (SELECT relative_path, CASE WHEN length(relative_path) % 2 = 0 THEN x || y ELSE x END AS patch FROM one)"""


def oracle_sql() -> dict[str, str]:
    more = paths.with_extensions(paths.EXTENSIONS, "yaml, .json,.yaml")
    ignore = paths.ignore_patterns(paths.IGNORE, "# tests\n__tests__/\n\n!dist/**\nsrc/*/index/*.ts\n")
    ext = _extension_sql("relative_path")
    grammars = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.GRAMMARS.items())
    cid = "concat('chunk_', substr(sha256(concat_ws(':', relative_path, start_line, end_line, content)), 1, 16))"
    lines = "string_split({c}, chr(10))"
    body, docs = lines.format(c="content"), lines.format(c="text")
    return {
        "scan_classified": f"WITH {_scan_sql(paths.EXTENSIONS, paths.IGNORE)} SELECT relative_path, reason, pattern FROM scan",
        "scan_counters": f"WITH {_scan_sql(paths.EXTENSIONS, paths.IGNORE)} SELECT reason, pattern, count(*) AS files FROM scan GROUP BY ALL",
        "scan_code_files": f"WITH {_scan_sql(more, ignore)} SELECT relative_path, {_language_sql(ext)} AS language FROM scan WHERE reason = 'included'",
        "language_map": f"WITH {ROWS} SELECT id, {_language_sql(ext)} AS language FROM rows",
        "language_routing": f"WITH {CODE} SELECT seq, CASE lower(language) {grammars} ELSE 'fallback' END AS grammar FROM code",
        "remote_tree_files": f"WITH {ROWS} SELECT DISTINCT relative_path AS path, 'blob' AS type FROM rows WHERE length(content) > 200 AND regexp_matches(relative_path, '{paths.REMOTE}')",
        "sync_ignored_files": f"WITH {PATHS} SELECT relative_path FROM p WHERE regexp_matches(relative_path, '(^|/)\\.') OR regexp_matches(relative_path, '(^|/)[^/]*\\.min\\.js(/|$)|(^|/)vendors/|^services/.*/channel/|^src/archive/.*(/|$)|(^|/)assets(/|$)|(^|/)[^/]*\\.yaml(/|$)')",
        "resume_instances": "SELECT DISTINCT CAST(query_id AS VARCHAR) AS instance_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM ranked WHERE list_no = 2 AND query_id IS NOT NULL)",
        "chunk_ids": f"WITH {ROWS} SELECT id, {cid} AS chunk_id FROM rows",
        "collection_names": "SELECT DISTINCT codebase_path, concat('hybrid_code_chunks_', substr(md5(codebase_path), 1, 8)) AS hybrid, concat('code_chunks_', substr(md5(codebase_path), 1, 8)) AS dense FROM index_catalog",
        "store_rows": f"""WITH {CODE} SELECT {cid} AS id, relative_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, {ext} AS file_extension,
  concat('{{"codebasePath":"/srv/code","language":"', coalesce(language, 'unknown'), '","chunkIndex":', seq, '}}') AS metadata FROM code WHERE content IS NOT NULL""",
        "chunk_line_greedy": f"WITH {_greedy_sql()} SELECT seq, piece, md5(content) AS digest, start_line, end_line FROM pieces",
        "chunk_window": f"WITH RECURSIVE {CODE}, {WINDOWED} SELECT seq, piece, md5(content) AS digest, start_line, end_line FROM pieces",
        "chunk_range_dedupe": f"WITH {CODE} SELECT relative_path, start_line, end_line, min(seq) AS seq FROM code GROUP BY ALL",
        "chunk_overlap": f"""WITH {CODE}, t AS (SELECT *, right(lag(content) OVER (PARTITION BY relative_path ORDER BY seq), 40) AS tail FROM code)
SELECT seq, relative_path, CASE WHEN tail IS NULL THEN start_line ELSE greatest(1, start_line - len(string_split(tail, chr(10)))) END AS start_line, end_line, md5(CASE WHEN tail IS NULL THEN content ELSE concat(tail, chr(10), content) END) AS digest FROM t""",
        "chunk_refined": f"""WITH {_greedy_sql()}, d AS (SELECT seq * 100000 + piece AS seq, relative_path, p.content AS content, p.start_line AS start_line, p.end_line AS end_line FROM pieces p JOIN (SELECT seq, relative_path FROM code) c USING (seq)
  QUALIFY row_number() OVER (PARTITION BY relative_path, p.start_line, p.end_line ORDER BY seq * 100000 + piece) = 1),
t AS (SELECT *, right(lag(content) OVER (PARTITION BY relative_path ORDER BY seq), 40) AS tail FROM d)
SELECT seq, relative_path, CASE WHEN tail IS NULL THEN start_line ELSE greatest(1, start_line - len(string_split(tail, chr(10)))) END AS start_line, end_line, md5(CASE WHEN tail IS NULL THEN content ELSE concat(tail, chr(10), content) END) AS digest FROM t""",
        "chunk_long_enough": f"SELECT doc_id FROM documents WHERE length({TRIMMED('text')}) > 10",
        "chunk_cap": f"WITH {CODE} SELECT relative_path, seq AS chunk_index, CASE WHEN (SELECT count(*) FROM code) > 120 THEN 'limit_reached' ELSE 'completed' END AS status FROM code ORDER BY relative_path, seq LIMIT 120",
        "token_estimate": f"WITH {ROWS} SELECT file_extension, CAST(sum(ceil(length(content) / 4)) AS BIGINT) AS tokens FROM rows GROUP BY ALL",
        "embedding_text": "SELECT doc_id, md5(CASE WHEN text = '' THEN ' ' ELSE substr(text, 1, 32768) END) AS digest FROM documents",
        "embedding_reduced": """WITH v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS h FROM embeddings), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS s FROM v)
SELECT vec_id, len(h) AS n, round(h[1] / s, 6) AS first, round(h[16] / s, 6) AS last FROM n""",
        "content_hashes": f"SELECT doc_id, sha256({TRIMMED('text')}) AS hash FROM documents WHERE text IS NOT NULL",
        "cache_latest": f"WITH {LATEST} SELECT content_hash, coalesce(dimension, -1) AS dimension, {NTZ('created_at')} AS created_at FROM lc",
        "cache_hits": f"WITH {LATEST} SELECT DISTINCT lookup_id, content_hash, content_hash IN (SELECT content_hash FROM lc WHERE embedding IS NOT NULL) AS hit FROM cache_lookups WHERE content_hash IS NOT NULL",
        "cache_misses": "SELECT DISTINCT content_hash FROM cache_lookups WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM embedding_cache WHERE embedding IS NOT NULL AND content_hash IS NOT NULL)",
        "cache_upsert": """WITH c AS (SELECT content_hash, dimension FROM embedding_cache WHERE content_hash IS NOT NULL), n AS (SELECT DISTINCT content_hash FROM c WHERE dimension = 64)
SELECT DISTINCT content_hash, 128 AS dimension FROM n UNION SELECT content_hash, coalesce(dimension, -1) FROM c WHERE content_hash NOT IN (SELECT content_hash FROM n)""",
        "cache_stats": f"SELECT count(*) AS entries, CAST(coalesce(sum(4 * len(embedding)), 0) AS BIGINT) AS bytes, {NTZ('min(created_at)')} AS oldest, {NTZ('max(created_at)')} AS newest FROM embedding_cache",
        "cache_evict_ttl": f"SELECT content_hash, {NTZ('created_at')} AS created_at FROM embedding_cache WHERE created_at IS NULL OR {NTZ('created_at')} >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY",
        "cache_evict_size": f"""WITH {LATEST}, t AS (SELECT *, row_number() OVER (ORDER BY coalesce(epoch_us(created_at), -1), content_hash) AS k, count(*) OVER () AS n, sum(4 * len(embedding)) OVER () AS b FROM lc)
SELECT content_hash FROM t WHERE NOT (coalesce(b, 0) > 100000 AND k <= ceil(n * 0.1::DOUBLE))""",
        "snapshot_hashes": f"WITH {WHOLE} SELECT * FROM a",
        "snapshot_diff": f"""WITH {_versions_sql()} SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.relative_path = b.relative_path WHERE a.hash IS DISTINCT FROM b.hash""",
        "merkle_root": f"WITH {WHOLE}, {_root_sql()} SELECT root FROM rt",
        "merkle_diff": f"WITH {_versions_sql()}, x AS (SELECT sha256(relative_path || ':' || hash) AS id FROM a), y AS (SELECT sha256(relative_path || ':' || hash) AS id FROM b) SELECT id, 'added' AS side FROM y WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'removed' FROM x WHERE id NOT IN (SELECT id FROM y)",
        "merkle_nodes": f"WITH {WHOLE}, {_root_sql()} SELECT id, data, 1 AS parents, 0 AS children FROM leaf UNION ALL SELECT root, 'root', 0, 0 FROM rt",
        "reindex_delta": _changed_sql(),
        "targeted_update": _changed_sql("starts_with(relative_path, 'src/')"),
        "index_progress": f"WITH {CATALOG} SELECT codebase_path, CAST(CASE WHEN indexed_files = 0 THEN 100 ELSE round(10 + 90 * (coalesce(total_chunks, 0) % (indexed_files + 1)) / indexed_files) END AS INTEGER) AS percent FROM cat WHERE indexed_files IS NOT NULL",
        "catalog_latest_state": f"WITH {CATALOG} SELECT codebase_path, status, coalesce(indexed_files, -1) AS indexed_files, coalesce(total_chunks, -1) AS total_chunks, {NTZ('last_updated')} AS last_updated FROM cat",
        "catalog_active": f"WITH {CATALOG} SELECT codebase_path FROM cat WHERE status = 'indexed'",
        "catalog_reconcile": f"WITH {CATALOG} SELECT codebase_path, status FROM cat WHERE codebase_path IN (SELECT CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.codebasePath') END FROM chunks)",
        "catalog_status": f"""WITH {CATALOG} SELECT codebase_path, CASE status WHEN 'indexed' THEN concat('indexed: ', coalesce(indexed_files, 0), ' files, ', coalesce(total_chunks, 0), ' chunks', CASE WHEN index_status = 'limit_reached' THEN ' (limit reached)' ELSE '' END)
  WHEN 'indexing' THEN concat('indexing: ', printf('%.1f', coalesce(indexing_percentage, 0)), '%') ELSE concat('failed: ', coalesce(error_message, 'unknown error')) END AS message FROM cat""",
        "recent_repos": f"SELECT codebase_path AS id, {NTZ('max(last_updated)')} AS indexed_at FROM index_catalog GROUP BY codebase_path ORDER BY max(last_updated) DESC, codebase_path LIMIT 5",
        "delete_by_ids": "SELECT id, max(relative_path) AS relative_path FROM chunks WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM expansion_terms WHERE id IS NOT NULL) GROUP BY id",
        "lookup_activity": f"""WITH l AS (SELECT lookup_id, max(struct_pack(c := codebase_path, t := requested_at)) AS r FROM cache_lookups WHERE lookup_id IS NOT NULL GROUP BY lookup_id)
SELECT date_trunc('hour', {NTZ('r.t')}) AS window_start, r.c AS codebase_path, count(*) AS lookups FROM l WHERE r.t IS NOT NULL GROUP BY ALL""",
        "retrieval_metrics": f"WITH {RUNS} SELECT query_id, list_no, precision, recall, f1 FROM metrics",
        "run_aggregates": f"""WITH {RUNS} SELECT list_no, round(avg(precision), 6) AS avg_precision, round(stddev_pop(precision), 6) AS std_precision, round(avg(f1), 6) AS avg_f1, round(stddev_pop(f1), 6) AS std_f1,
  count(*) AS runs, count(DISTINCT query_id) AS instances FROM metrics GROUP BY 1""",
        "relative_change": "SELECT event_type, round(CASE WHEN max(value) = 0 THEN 0 ELSE (avg(value) - max(value)) / max(value) * 100 END, 6) AS change FROM events GROUP BY event_type",
        "patch_files": f"WITH {PATCHES} SELECT relative_path, array_to_string(regexp_extract_all(patch, '--- a/([^\\n]+)', 1), '|') AS files, len(regexp_extract_all(patch, '(?m)^diff --git a/')) AS n FROM patches",
        "edited_paths": f"""WITH {PATHS} SELECT relative_path AS doc_id, unnest([relative_path, concat('/else/', relative_path), concat('doc/', relative_path)]) AS path, unnest([1, 2, 3]) AS place FROM p""",
        "patch_subset": f"""WITH {PATCHES}, x AS (SELECT length(relative_path) % 3 = 0 AND len(regexp_extract_all(patch, '(?m)^diff --git a/')) = 2 AS c FROM patches)
SELECT count(*) AS total, count(*) FILTER (c) AS chosen, round(100 * count(*) FILTER (c) / count(*), 1) AS percent FROM x""",
        "token_totals": """WITH m AS (SELECT user_id AS instance_id, CAST(floor(value) AS BIGINT) AS i, length(event_type) AS o, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS BIGINT) + length(event_type) + 1 END AS t FROM events),
x AS (SELECT instance_id, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(t, coalesce(i, 0) + coalesce(o, 0)) AS t FROM m)
SELECT instance_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(CASE WHEN sum(t) > 0 THEN sum(t) ELSE sum(i) + sum(o) END AS BIGINT) AS total_tokens, greatest(max(t), 0) AS max_single_turn_tokens FROM x GROUP BY instance_id""",
        "tool_counts": """WITH c AS (SELECT user_id AS instance_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'unknown') AS tool, count(*) AS n FROM events GROUP BY ALL)
SELECT instance_id, string_agg(concat(tool, '=', n), ',' ORDER BY tool) AS tools, CAST(sum(n) AS BIGINT) AS total_tool_calls FROM c GROUP BY instance_id""",
        "edit_calls": f"""WITH {CODE}, x AS (SELECT seq, relative_path, substr(regexp_replace(content, '[^A-Za-z0-9_ ]', '', 'g'), 1, 60) AS t FROM code WHERE content IS NOT NULL)
SELECT seq AS doc_id, 1 AS call_no, relative_path AS file_path, t || chr(10) AS old, 'new ' || t AS new FROM x""",
        "edit_places": f"""WITH {FILES}, x AS (SELECT relative_path, content, substr(content, 41, 40) AS o FROM files WHERE length(content) > 80)
SELECT relative_path AS file_path, len(string_split(substr(content, 1, instr(content, o) - 1), chr(10))) AS line FROM x""",
        "chunk_line_estimate": """WITH x AS (SELECT doc_id, text, instr(text, substr(text, 101, 50)) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN pos > 0 THEN len(string_split(substr(text, 1, pos - 1), chr(10))) ELSE 1 END AS line FROM x""",
        "grep_anchored": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_content, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, line_content, regexp_extract(line_content, '^(?:def|func|class) [A-Za-z_]+') AS match FROM l WHERE regexp_matches(line_content, '^(?:def|func|class) [A-Za-z_]+')""",
        "test_paths": f"WITH {PATHS} SELECT relative_path FROM p WHERE len(list_intersect(regexp_split_to_array(lower(relative_path), '[ _/.]'), ['test', 'tests', 'testing'])) > 0",
        "truncated_lines": f"WITH {ROWS} SELECT id, md5(CASE WHEN len({body}) > 10 THEN concat(array_to_string({body}[1:10], chr(10)), chr(10), '... ', len({body}) - 10, ' more lines') ELSE content END) AS digest FROM rows",
        "grep_lines": f"""WITH {ROWS}, l AS (SELECT id, unnest({body}) AS line_content, generate_subscripts({body}, 1) AS line_number FROM rows)
SELECT id, CAST(line_number AS INTEGER) AS line_number, line_content, regexp_extract(line_content, '(return [a-z]+)', 1) AS match FROM l WHERE regexp_matches(line_content, 'return [a-z]+')""",
        "read_slice": f"""SELECT doc_id, md5(CASE WHEN len({docs}) > 7 THEN concat('[File content truncated: showing lines 3-', least(7, len({docs})), ' of ', len({docs}), ' total lines]', chr(10), array_to_string({docs}[3:7], chr(10))) ELSE coalesce(array_to_string({docs}[3:7], chr(10)), '') END) AS digest
FROM documents WHERE text IS NOT NULL""",
        "list_directory": "SELECT DISTINCT regexp_extract(substr(relative_path, 5), '^[^/]+') AS name, CASE WHEN contains(substr(relative_path, 5), '/') THEN 'directory' ELSE 'file' END AS kind FROM chunks WHERE starts_with(relative_path, 'src/')",
        "directory_tree": f"""WITH {PATHS}, s AS (SELECT string_split(relative_path, '/') AS x FROM p WHERE NOT regexp_matches(relative_path, '(^|/)\\.')), e AS (SELECT x, unnest(range(1, least(3, len(x) - 1) + 1)) AS level FROM s WHERE len(x) > 1)
SELECT array_to_string(x[1:level], '/') AS path, CAST(level AS INTEGER) AS level, count(*) AS files FROM e GROUP BY ALL""",
        "tree_lines": f"""WITH {PATHS}, s AS (SELECT string_split(relative_path, '/') AS x FROM p),
e AS (SELECT DISTINCT x[1] AS path, '' AS parent, x[1] AS name, 1 AS level FROM s UNION SELECT DISTINCT x[1] || '/' || x[2], x[1], x[2], 2 FROM s WHERE len(x) > 1),
k AS (SELECT path, parent, name, level, path IN (SELECT x[1] FROM s WHERE len(x) > 1 UNION SELECT x[1] || '/' || x[2] FROM s WHERE len(x) > 2) AS is_dir, name = max(name) OVER (PARTITION BY parent) AS is_last FROM e),
v AS (SELECT * FROM k WHERE name NOT IN ({', '.join(_sq(x) for x in reading.SKIPPED)}) AND (NOT starts_with(name, '.') OR name IN ({', '.join(_sq(x) for x in reading.SHOWN)})))
SELECT v.path, concat(CASE WHEN v.level = 1 THEN '' WHEN u.is_last THEN '    ' ELSE '│   ' END, CASE WHEN v.is_last THEN '└── ' ELSE '├── ' END, v.name, CASE WHEN v.is_dir THEN '/' ELSE '' END) AS line
FROM v LEFT JOIN v u ON v.parent = u.path WHERE v.level = 1 OR u.path IS NOT NULL""",
        "trimmed_lengths": f"SELECT doc_id, length({TRIMMED('text')}) AS n FROM documents WHERE text IS NOT NULL",
    }


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
