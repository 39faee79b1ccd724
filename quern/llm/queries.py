"""The queries of the ten problems, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import sql_code_tokens
from quern.llm import p1_rank, p2_seen, p3_terms, p4_similar, p5_credentials, p6_split, p7_machine_made, p8_pack, p9_mix, p10_one_form
from quern.staging import staged, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_rank.first_items(p1_rank.median_ranks(table(spark, d, "ranked")), 3).select("query_id", "id")


def p1_order(spark: SparkSession, d: str) -> DataFrame:
    weights = p1_rank.list_weights(table(spark, d, "queries"))
    return p1_rank.full_order(p1_rank.median_ranks(table(spark, d, "ranked"), weights))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_seen.seen_before(table(spark, d, "embedding_cache"), table(spark, d, "cache_lookups")).where("seen").select("lookup_id")


def p2_error(spark: SparkSession, d: str) -> DataFrame:
    """At 24 bits, where wrong answers are many enough to be measured."""
    return p2_seen.error_report(table(spark, d, "embedding_cache"), table(spark, d, "cache_lookups"), bits=24)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms.most_distinctive(p3_terms.distinctive_terms(table(spark, d, "chunks"), table(spark, d, "expansion_terms")))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms.distinctive_terms(table(spark, d, "chunks"), table(spark, d, "expansion_terms")).withColumn("score", F.round("score", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar.similar_pairs(table(spark, d, "vectors"), 0.95)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar.similar_degree(table(spark, d, "vectors"), 0.95)


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar.nearest(table(spark, d, "vectors"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar.recall_report(table(spark, d, "vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_credentials.credential_lines(table(spark, d, "chunks"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    found = p5_credentials.find_credentials(table(spark, d, "chunks"))
    return found.select("id", F.size("credentials").alias("places"), F.col("redacted").alias("content"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut = p6_split.split_oversized(table(spark, d, "code_chunks"), table(spark, d, "splitter_config"))
    return cut.where("piece_no = 0 and n_pieces > 1").select("chunk_no")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p6_split.split_oversized(table(spark, d, "code_chunks"), table(spark, d, "splitter_config"))


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """The own parts of each chunk's pieces, joined again; and the longest piece."""
    own = F.struct("piece_no", F.expr("substring(content, own_start - start + 1)").alias("own"), "content")
    joined = p6_pieces(spark, d).groupBy("chunk_no").agg(F.array_sort(F.collect_list(own)).alias("p"), F.max("chunk_size").alias("chunk_size"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return joined.select("chunk_no", F.md5(text).alias("digest"), F.forall("p", lambda x: F.length(x["content"]) <= F.col("chunk_size")).alias("fits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_machine_made.machine_made(table(spark, d, "chunks")).where("why is not null").select("relative_path")


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    return p7_machine_made.machine_made(table(spark, d, "chunks"))


def p7_vendored(spark: SparkSession, d: str) -> DataFrame:
    """With a share so low that files of the tables have it."""
    return p7_machine_made.shared_lines(table(spark, d, "chunks"), 0.05)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack.room_left(staged(p8_packed(spark, d)))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return p9_mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return p9_mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_one_form.found_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return p10_one_form.reading_classes(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return p10_one_form.normalized(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        p1_found, p1_order, p2_found, p2_error, p3_found, p3_scores, p4_found, p4_groups, p4_nearest, p4_recall, p5_found, p5_redacted,
        p6_found, p6_pieces, p6_whole, p7_found, p7_files, p7_vendored, p8_packed, p8_room, p9_mixture, p9_shares, p10_found, p10_classes, p10_forms,
    )
    return {f.__name__: f for f in each}


def _ranks_sql(weighted: bool) -> str:
    return f"""
entries AS (
  SELECT query_id, list_no, id, min(CASE WHEN metric = 'L2' THEN score ELSE -score END) AS key
  FROM ranked WHERE score IS NOT NULL AND isfinite(score) AND query_id IS NOT NULL AND list_no IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY query_id, list_no, key) - 1) / 2.0 AS place
  FROM entries WINDOW w AS (PARTITION BY query_id, list_no ORDER BY key)),
lists AS (
  SELECT query_id, list_no, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY list_no) AS i FROM entries GROUP BY query_id, list_no),
options AS (SELECT query_id, max(rerank) AS o FROM queries GROUP BY query_id),
weights AS (
  SELECT query_id, CAST(json_extract(o, '$.params.weights') AS DOUBLE[]) AS ws FROM options
  WHERE {'TRUE' if weighted else 'FALSE'} AND json_valid(o) AND json_extract_string(o, '$.strategy') = 'weighted' AND json_extract(o, '$.params.weights') IS NOT NULL),
weighed AS (
  SELECT l.*, CASE WHEN ws IS NULL OR ws[i] IS NULL THEN 1 WHEN ws[i] <= 0 THEN 0 ELSE ws[i] END AS w0 FROM lists l LEFT JOIN weights USING (query_id)),
all_lists AS (SELECT *, CASE WHEN sum(w0) OVER (PARTITION BY query_id) <= 0 THEN 1 ELSE w0 END AS w FROM weighed),
cells AS (
  SELECT q.query_id, q.id, l.w, coalesce(p.place, l.n + 1) AS r
  FROM (SELECT DISTINCT query_id, id FROM entries) q JOIN all_lists l USING (query_id) LEFT JOIN placed p USING (query_id, list_no, id)),
upto AS (
  SELECT *, sum(w) OVER (PARTITION BY query_id, id ORDER BY r, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY query_id, id) / 2 AS half FROM cells),
medians AS (
  SELECT query_id, id, (min(r) FILTER (c >= half) + coalesce(min(r) FILTER (c > half), max(r))) / 2 AS median_rank, sum(w * r) / sum(w) AS mean_rank
  FROM upto GROUP BY query_id, id),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, id) AS place FROM medians)"""


_CLEAN = """regexp_replace(regexp_replace(lower(content_hash), '^[^0-9a-z]*(sha-?_?256|sha2|0x)[^0-9a-z]*', ''), '[\\s:_.\\-{}"''<>\\[\\]()]', '', 'g')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_ranks_sql(False)} SELECT query_id, id FROM ordered WHERE place <= 3",
        "p1_order": f"WITH {_ranks_sql(True)} SELECT query_id, id, place, round(median_rank, 6) AS median_rank, round(mean_rank, 6) AS mean_rank FROM ordered",
        "p2_found": f"""
WITH l AS (SELECT lookup_id, min(h) AS h FROM (SELECT lookup_id, {_CLEAN} AS h FROM cache_lookups) WHERE regexp_full_match(h, '[0-9a-f]{{64}}') AND lookup_id IS NOT NULL GROUP BY lookup_id),
c AS (SELECT DISTINCT {_CLEAN} AS h FROM embedding_cache)
SELECT lookup_id FROM (SELECT lookup_id, h, min(lookup_id) OVER (PARTITION BY h) AS first FROM l) WHERE lookup_id > first OR h IN (SELECT h FROM c WHERE h IS NOT NULL)""",
        "p3_scores": f"WITH {_terms_sql()} SELECT id, term, round(score, 6) AS score, frequency, document_count FROM scored",
        "p3_found": f"WITH {_terms_sql()} SELECT id, term FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS k FROM scored) WHERE k = 1",
        "p4_found": """
WITH v AS (
  SELECT id, min(list_transform(vector, lambda x: CAST(x AS DOUBLE))) AS v FROM vectors
  WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(vector, lambda x: x * x)) > 0 GROUP BY id)
SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95""",
        "p6_whole": """
SELECT chunk_no, md5(max(content)) AS digest, TRUE AS fits FROM code_chunks WHERE chunk_no IS NOT NULL AND content IS NOT NULL GROUP BY chunk_no""",
        "p7_vendored": f"""
WITH c AS (SELECT max(struct_pack(p := relative_path, r := collection_name, t := coalesce(content, ''))) AS x FROM chunks WHERE id IS NOT NULL AND relative_path IS NOT NULL GROUP BY id),
r AS (SELECT x.p AS p, min(x.r) AS repo FROM c GROUP BY x.p),
l AS (SELECT DISTINCT p, trim(line) AS h FROM (SELECT x.p AS p, unnest(string_split(x.t, chr(10))) AS line FROM c) WHERE length(trim(line)) >= {p7_machine_made.LINE}),
f AS (SELECT p, any_value(repo) AS repo, count(*) AS n, regexp_matches(p, '(^|/)({'|'.join(p7_machine_made.VENDOR_DIRS)})/') AS m FROM l JOIN r USING (p) GROUP BY p HAVING count(*) >= {p7_machine_made.LEAST_LINES}),
s AS (SELECT a.p AS relative_path, b.p AS origin, count(*) / any_value(fa.n) AS containment FROM l a JOIN f fa ON fa.p = a.p AND NOT fa.m JOIN l b ON a.h = b.h JOIN f fb ON fb.p = b.p AND fb.m
  WHERE fa.repo <> fb.repo GROUP BY a.p, b.p HAVING count(*) / any_value(fa.n) >= 0.05)
SELECT relative_path, arg_max(origin, struct_pack(c := containment, o := origin)) AS origin, round(max(containment), 6) AS containment FROM s GROUP BY relative_path""",
        "p6_found": """
WITH c AS (SELECT language, min(chunk_size) AS size FROM splitter_config WHERE language IS NOT NULL AND chunk_size > 0 GROUP BY language),
r AS (SELECT chunk_no, max(content) AS content, max(language) AS language FROM code_chunks WHERE chunk_no IS NOT NULL GROUP BY chunk_no)
SELECT chunk_no FROM r LEFT JOIN c USING (language) WHERE length(content) > coalesce(size, (SELECT size FROM c WHERE language = 'default'))""",
    }


def _terms_sql() -> str:
    return f"""
texts AS (SELECT id, coalesce(max(content), '') AS content FROM chunks WHERE id IS NOT NULL GROUP BY id),
tokens AS (SELECT id, list_filter(string_split({sql_code_tokens('content')}, ' '), lambda x: x <> '') AS t FROM texts),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tokens),
counts AS (SELECT id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM tokens) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (
  SELECT id, term, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 0) AS score,
    CAST(coalesce(tf, 0) AS BIGINT) AS frequency, CAST(coalesce(df, 0) AS BIGINT) AS document_count
  FROM (SELECT DISTINCT id, term FROM expansion_terms WHERE id IS NOT NULL AND term IS NOT NULL) LEFT JOIN counts USING (id, term) LEFT JOIN dfs USING (term), stats)"""
