"""Queries of retrieval, fusion, feedback and query rewriting, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths, query_prep
from quern.functions.text import sql_code_tokens
from quern.operators import bm25, catalog, dense, fusion, prf, reading
from quern.plans.engine import distinct_rows, distinct_vectors, hybrid_search, results_of
from quern.staging import once, staged, table

#: A fixed query vector, for searches with one query.
AXIS = [round(((7 * i) % 13 - 6) / 10, 1) for i in range(64)]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return distinct_rows(table(spark, d, "chunks").select("id", "content", "relative_path", "start_line", "end_line", "file_extension", "metadata"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return distinct_vectors(table(spark, d, "vectors"))


_indexes: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The corpus's postings, by term within each batch of documents, and their statistics: written once a session, where the contents lie."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        rows = _rows(spark, d).select("id", "content")
        found = bm25.postings(rows)
        _indexes[key] = found, staged(bm25.statistics_of(found, rows))
    return _indexes[key]


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """ranked, each entry once, with finite scores that are all the better the larger, and ranks from them."""
    s = F.when(F.col("metric") == "L2", -F.col("score")).otherwise(F.col("score"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    once = table(spark, d, "ranked").where(finite).groupBy("query_id", "list_no", "metric", "id").agg(F.max(s).alias("score"))
    return fusion.list_ranks(once, ["query_id", "list_no"])


def flagship_hybrid_search(spark, d):
    found = hybrid_search(_rows(spark, d), _vectors(spark, d), _index(spark, d), table(spark, d, "queries"), top=10, fetch=20)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "relative_path", "start_line", "end_line", "language")


def dense_topk(spark, d):
    return dense.top_k_one(_vectors(spark, d), AXIS, 10)


def dense_topk_batch(spark, d):
    return dense.top_k(_vectors(spark, d), table(spark, d, "queries"), 10)


def dense_threshold(spark, d):
    return dense.top_k(_vectors(spark, d), table(spark, d, "queries"), 20, least=0.3)


def dense_filtered(spark, d):
    used = table(spark, d, "chunks").where("file_extension in ('.ts', '.py') and start_line < 50").select("id")
    return dense.top_k(_vectors(spark, d).join(used, "id", "left_semi"), table(spark, d, "queries"), 5)


def cosine_kernel(spark, d):
    """The kernel by itself, over all rows: against the fixed vector, whose dimension not every row has."""
    rows = once(table(spark, d, "vectors").where("vector is not null and not exists(vector, x -> x is null or isnan(x))").select("id", "vector"), "id", lambda rest: F.min(F.struct(*rest)))
    return rows.select("id", F.round(dense.cosine(F.col("vector"), F.array(*map(F.lit, AXIS))), 6).alias("score"))


def index_statistics(spark, d):
    """What the stored index of the corpus holds."""
    found, stats = _index(spark, d)
    sums = found.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("words"))
    return sums.crossJoin(F.broadcast(stats)).select("postings", "terms", "words", "n_docs", F.round("avgdl", 6).alias("avgdl"))  # one row each


def bm25_topk(spark, d):
    return bm25.top_k_of(*_index(spark, d), table(spark, d, "queries"), 10)


def rrf_fusion(spark, d):
    return fusion.reciprocal_ranks(_lists(spark, d), 60)


def rrf_fusion_top(spark, d):
    return fusion.reciprocal_ranks(_lists(spark, d), 100, 5)


def weighted_fusion(spark, d):
    return fusion.weighted_scores(_lists(spark, d), F.when(F.col("metric") == "BM25", 0.4).otherwise(0.6))


def file_type_weight(spark, d):
    return _rows(spark, d).select("id", paths.file_weight(F.col("relative_path"), F.col("file_extension")).alias("weight"))


def weighted_resort(spark, d):
    fused = fusion.reciprocal_ranks(_lists(spark, d), 60, 20)
    return fusion.weigh_files(results_of(fused, _rows(spark, d))).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def rerank_texts(spark, d):
    text = fusion.rerank_text(F.col("relative_path"), F.col("content"))
    return _rows(spark, d).select("id", F.md5(text).alias("digest"), F.length(text).alias("n"))


def rerank_lexical(spark, d):
    found = fusion.reciprocal_ranks(_lists(spark, d), 60, 15).join(table(spark, d, "queries").select("query_id", "text"), "query_id")
    docs = _rows(spark, d).select("id", fusion.rerank_text(F.col("relative_path"), F.col("content")).alias("doc"))
    return fusion.rerank(found.join(docs, "id"), 5).select("query_id", "id", "rerank_score", "rank")


def result_projection(spark, d):
    found = fusion.reciprocal_ranks(_lists(spark, d), 60, 3)
    shown = results_of(found, _rows(spark, d)).withColumn("codebase", F.lit("all"))
    return reading.formatted(shown).select("query_id", "rank", "id", F.md5("text").alias("digest"))


def result_previews(spark, d):
    return _rows(spark, d).orderBy("id").limit(20).select("id", reading.preview(F.col("content")).alias("preview"))


def filter_expression(spark, d):
    e = "fileExtension in ['.ts', '.py'] and (startLine < 40 or endLine >= 200) and not relativePath like '%test%'"
    used = catalog.select_rows(table(spark, d, "chunks"), e, ["id", "relative_path", "start_line", "end_line"])  # before rows are made distinct: the filter reaches the scan
    return distinct_rows(used)


def filter_default_limit(spark, d):
    return catalog.select_rows(_rows(spark, d), "", ["id", "file_extension"])


def merge_dedupe_topk(spark, d):
    lists = _lists(spark, d)
    return fusion.merge_ordered(lists.where("list_no = 1").select("query_id", "id", "rank"), lists.where("list_no = 0").select("query_id", "id", "rank"), ["id"], 10)


def match_class(spark, d):
    return _lists(spark, d).select("query_id", "list_no", "id", fusion.match_class(F.round(F.col("score") * 100)).alias("class"))


def parent_index(spark, d):
    asked = table(spark, d, "queries").where("codebase_path is not null").select(F.concat("codebase_path", F.lit("/src/main")).alias("path")).distinct()
    return catalog.parent_index(asked, table(spark, d, "index_catalog"))


def prf_code_tokens(spark, d):
    return _rows(spark, d).select("id", F.array_join(prf.corpus(F.col("content")), " ").alias("tokens"))


def _best_documents(spark, d):
    """Of each query the rows of its first list, as documents from 1."""
    first = _lists(spark, d).where("list_no = 0").select("query_id", F.col("rank").alias("doc"), "id")
    return first.join(_rows(spark, d).select("id", "content"), "id")


def _asked(spark, d):
    return table(spark, d, "queries").where("text is not null").select("query_id", "text")


def prf_term_statistics(spark, d):
    docs = _best_documents(spark, d).where(F.col("doc") <= prf.TOP_DOCUMENTS)
    return prf.term_statistics(docs).select("query_id", "term", F.round("score", 6).alias("score"), "frequency", "document_count", "first_doc", "first_pos")


def prf_expansion_terms(spark, d):
    docs = _best_documents(spark, d).where(F.col("doc") <= prf.TOP_DOCUMENTS)
    found = prf.expansion_terms(prf.term_statistics(docs), _asked(spark, d))
    return found.withColumn("score", F.round("score", 6))


def prf_expanded_query(spark, d):
    return prf.expand(_asked(spark, d), _best_documents(spark, d)).select("query_id", "expanded", F.array_join("terms", ",").alias("terms"), "documents")


def prf_reasoning(spark, d):
    return prf.expand(_asked(spark, d), _best_documents(spark, d)).select("query_id", "reasoning")


def prf_two_pass(spark, d):
    """The first pass, its expansion, and the second pass merged before it. Queries without text have a first pass only, by their vectors."""
    rows, vectors, index, asked = _rows(spark, d), _vectors(spark, d), _index(spark, d), table(spark, d, "queries").select("query_id", "text", "vector")
    first = staged(hybrid_search(rows, vectors, index, asked, top=12, fetch=20).select("query_id", "id", "rank", "content"))
    grown = prf.expand(asked.where("text is not null"), first.select("query_id", F.col("rank").alias("doc"), "content")).where(F.size("terms") > 0)
    again = staged(grown.select("query_id", F.col("expanded").alias("text")).join(asked.select("query_id", "vector"), "query_id"))
    second = hybrid_search(rows, vectors, index, again, top=5, fetch=20)
    return fusion.merge_ordered(second.select("query_id", "id", "rank"), first.select("query_id", "id", "rank"), ["id"], 5).select("query_id", "id", "rank")


def tfidf_rank(spark, d):
    return prf.tfidf_rank(_rows(spark, d).select("id", "content"), _asked(spark, d))


def query_variants(spark, d):
    return query_prep.preprocess(table(spark, d, "queries")).select("query_id", F.array_join("variants", "|").alias("variants"), F.size("variants").alias("n"))


def query_patterns(spark, d):
    return query_prep.preprocess(table(spark, d, "queries")).select("query_id", F.array_join("patterns", "|").alias("patterns"), "multi")


def query_reasoning(spark, d):
    return query_prep.preprocess(table(spark, d, "queries")).select("query_id", "normalized", "reasoning")


def query_best(spark, d):
    return query_prep.best(query_prep.preprocess(table(spark, d, "queries"))).select("query_id", "best")


def query_top(spark, d):
    return query_prep.top(query_prep.preprocess(table(spark, d, "queries"))).select("query_id", F.array_join("top", "|").alias("top"))


def queries():
    each = (
        flagship_hybrid_search, dense_topk, dense_topk_batch, dense_threshold, dense_filtered, cosine_kernel, index_statistics, bm25_topk, rrf_fusion, rrf_fusion_top, weighted_fusion,
        file_type_weight, weighted_resort, rerank_texts, rerank_lexical, result_projection, result_previews, filter_expression, filter_default_limit,
        merge_dedupe_topk, match_class, parent_index, prf_code_tokens, prf_term_statistics, prf_expansion_terms, prf_expanded_query, prf_reasoning,
        prf_two_pass, tfidf_rank, query_variants, query_patterns, query_reasoning, query_best, query_top,
    )
    return {f.__name__: f for f in each}


# --- SQL -------------------------------------------------------------------------------------------------------------------

ROWS = """
rows AS (
  SELECT id, r.content AS content, r.relative_path AS relative_path, r.start_line AS start_line, r.end_line AS end_line, r.file_extension AS file_extension, r.metadata AS metadata FROM (
    SELECT id, max(struct_pack(content := content, relative_path := relative_path, start_line := start_line, end_line := end_line, file_extension := file_extension, metadata := metadata)) AS r
    FROM chunks WHERE id IS NOT NULL GROUP BY id))"""
VECTORS = """
vs AS (
  SELECT id, v FROM (SELECT id, min(list_transform(vector, lambda x: CAST(x AS DOUBLE))) AS v FROM vectors WHERE id IS NOT NULL AND vector IS NOT NULL GROUP BY id)
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
qs AS (SELECT query_id, text, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS q FROM queries)"""
LISTS = """
once AS (
  SELECT query_id, list_no, metric, id, max(CASE WHEN metric = 'L2' THEN -score ELSE score END) AS score FROM ranked WHERE score IS NOT NULL AND isfinite(score) GROUP BY ALL),
lists AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, id) AS rank FROM once)"""


def _dense_sql(k: int, source: str = "vs", least: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS score FROM {source}, qs WHERE q IS NOT NULL AND len(q) = 64) {least}) WHERE rank <= {k}"""


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda w: w <> '')"


def _postings_sql() -> str:
    return f"""toks AS (SELECT id, {_words_sql("coalesce(content, '')")} AS t FROM rows),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _ranked_sql(k: int, source: str = "qs", to: str = "") -> str:
    return f"""wanted{to} AS (SELECT DISTINCT query_id, unnest({_words_sql('text')}) AS term FROM {source}),
bm{to} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
    FROM wanted{to} JOIN post USING (term) JOIN dfs USING (term), st GROUP BY query_id, id) QUALIFY rank <= {k})"""


def _bm25_sql(k: int) -> str:
    return f"{_postings_sql()}, {_ranked_sql(k)}"


def _found_sql(fetch: int, source: str = "qs", to: str = "") -> str:
    """The weighed results of a hybrid search for the queries of a source, as found{to} with their rank."""
    dense = _dense_sql(fetch).replace("FROM vs, qs", f"FROM vs, {source}")
    return f"""{_ranked_sql(fetch, source, to)}, dn{to} AS ({dense}),
fused{to} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r0 FROM (
    SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dn{to} UNION ALL SELECT query_id, id, rank FROM bm{to}) GROUP BY query_id, id) QUALIFY r0 <= {fetch}),
wt{to} AS (SELECT f.query_id, f.id, round(score * {paths.sql_file_weight('relative_path', 'file_extension')}, 9) AS score, r0, content, relative_path, start_line, end_line,
    coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.language') END, 'unknown') AS language FROM fused{to} f JOIN rows USING (id)),
found{to} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM wt{to})"""


def _hybrid_sql(top: int, fetch: int) -> str:
    return f"""WITH {ROWS}, {VECTORS}, {_postings_sql()}, {_found_sql(fetch)}
SELECT query_id, rank, id, round(score, 6) AS score, relative_path, start_line, end_line, language FROM found WHERE rank <= {top}"""


def _two_pass_sql() -> str:
    expansion = _stats_sql("docs AS (SELECT query_id, rank AS doc, content FROM found WHERE rank <= 12)")
    return f"""WITH {VECTORS}, {expansion.replace(ROWS + ', ', ROWS + ', ' + _postings_sql() + ', ' + _found_sql(20) + ', ')},
again AS (SELECT query_id, concat(text, ' ', array_to_string(terms, ' ')) AS text, q FROM expanded JOIN (SELECT query_id, q FROM qs) USING (query_id) WHERE len(terms) > 0),
{_found_sql(20, 'again', '2')},
both_ AS (SELECT query_id, id, 0 AS source, rank FROM found2 WHERE rank <= 5 UNION ALL SELECT query_id, id, 1, rank FROM found WHERE rank <= 12),
merged AS (SELECT query_id, id, min(struct_pack(source := source, rank := rank)) AS a FROM both_ GROUP BY query_id, id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a.source, a.rank, id) AS rank FROM merged QUALIFY rank <= 5"""


RRF = lambda k: f"""fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0 / ({k} + rank)), 9) AS score FROM lists GROUP BY query_id, id))"""  # noqa: E731


def _stats_sql(docs: str = "docs AS (SELECT query_id, rank AS doc, content FROM lists JOIN rows USING (id) WHERE list_no = 0)") -> str:
    stop = ", ".join(f"'{w}'" for w in prf.STOP_WORDS)
    return f"""{ROWS}, {LISTS},
{docs},
used AS (SELECT *, string_split({sql_code_tokens("coalesce(content, '')")}, ' ') AS t FROM docs WHERE doc <= 7),
ws AS (SELECT query_id, doc, len(t) AS len, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM used),
cn AS (SELECT query_id, term, doc, any_value(len) AS len, count(*) AS c, min(pos) AS pos FROM ws GROUP BY query_id, term, doc),
nn AS (SELECT query_id, count(*) AS n FROM used GROUP BY query_id),
stats AS (
  SELECT query_id, term, round(tf * (ln(n / (document_count + 1)) + 1), 9) AS score, frequency, document_count, f.doc AS first_doc, f.pos AS first_pos FROM (
    SELECT query_id, term, max(c / (len + 1)) AS tf, CAST(sum(c) AS BIGINT) AS frequency, count(*) AS document_count, min(struct_pack(doc := doc, pos := pos)) AS f FROM cn GROUP BY query_id, term) JOIN nn USING (query_id)),
asked AS (SELECT query_id, text FROM queries WHERE text IS NOT NULL),
best AS (
  SELECT query_id, term, score, frequency, document_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_doc, first_pos) AS rank FROM stats JOIN asked USING (query_id)
  WHERE length(term) >= 3 AND term NOT IN ({stop}) AND NOT contains(lower(text), term) AND regexp_matches(term, '^[a-zA-Z]') AND NOT regexp_matches(term, '{prf.NOISE}') QUALIFY rank <= 8),
ex AS (
  SELECT query_id, a.text, coalesce(documents, 0) AS documents, found,
    CASE WHEN trim(coalesce(a.text, '')) = '' THEN 'Empty query' WHEN documents IS NULL THEN 'No search results provided' WHEN documents < 3 THEN 'Insufficient documents for reliable expansion' END AS refused
  FROM asked a LEFT JOIN (SELECT query_id, n AS documents FROM nn) USING (query_id) LEFT JOIN (SELECT query_id, list(struct_pack(term := term, score := score) ORDER BY rank) AS found FROM best GROUP BY query_id) USING (query_id)),
expanded AS (SELECT *, CASE WHEN refused IS NULL THEN coalesce(list_transform(found, lambda x: x.term), []) ELSE [] END AS terms FROM ex)"""


TRIM = lambda x: f"regexp_replace({x}, '^[\\s\\x{{FEFF}}\\p{{Z}}]+|[\\s\\x{{FEFF}}\\p{{Z}}]+$', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prep_sql() -> str:
    p = query_prep
    any_of = lambda c, ws: "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in ws) + ")"
    langs = ", ".join("CASE WHEN regexp_matches(%s, " + _q("(?i)" + "|".join(f"(?:{x})" for x in ps)) + f") THEN {_q(n)} END" for n, ps in p.LANGUAGES.items())
    languages = lambda c: f"list_filter([{langs.replace('%s', c)}], lambda x: x IS NOT NULL)"
    once = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
    files = lambda c: "list_concat(" + ", ".join(f"regexp_extract_all({c}, {_q(x)}, 1)" for x in p.FILENAMES) + ")"
    abbr = ", ".join(f"CASE WHEN contains(lower(q), {_q(a)}) THEN regexp_replace(q, {_q(chr(92) + 'b' + a + chr(92) + 'b')}, {_q(f)}, 'gi') END" for a, f in p.ABBREVIATIONS.items())
    concepts = ", ".join(f"CASE WHEN contains(lower(q), {_q(c)}) THEN [{', '.join(map(_q, [*ts, c]))}] ELSE [] END" for c, ts in p.CONCEPTS.items())
    put = lambda to: f"concat(substr(q, 1, instr(q, x) - 1), {to}, substr(q, instr(q, x) + length(x)))"
    camel = "CASE WHEN regexp_matches(x, '[a-z][A-Z]') THEN " + put(r"regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g')") + " END"
    snake = "CASE WHEN contains(x, '_') AND NOT starts_with(x, '_') THEN " + put("replace(x, '_', ' ')") + " END"
    hit = ", ".join(f"CASE WHEN contains(lower(text), {_q(c)}) THEN {_q(c)} END" for c in p.CONCEPTS)
    return f"""
a0 AS (SELECT query_id, text, {TRIM('text')} AS q FROM queries),
a1 AS (SELECT *, {languages('q')} AS qlangs, {files('q')} AS qf, {languages('text')} AS tlangs, {files('text')} AS tf FROM a0),
a2 AS (SELECT *, {once('qf')} AS qfiles, {once('tf')} AS tfiles FROM a1),
a3 AS (SELECT *, CASE WHEN text IS NULL OR q = '' THEN [text] ELSE list_concat([q], list_filter([{abbr}], lambda x: x IS NOT NULL AND x <> q), flatten([{concepts}]),
    list_filter(flatten(list_transform(regexp_split_to_array(q, '\\s+'), lambda x: [{camel}, {snake}])), lambda x: x IS NOT NULL),
    list_transform(qlangs, lambda x: concat(q, ' ', x)), list_transform(qfiles, lambda x: concat(q, ' ', regexp_replace(x, '\\.[^.]*$', ''))),
    list_filter([CASE WHEN {any_of('lower(q)', p.BUILDING)} THEN concat(q, ' function class method implementation') END,
      CASE WHEN regexp_matches(q, {_q(p.CODE_WORDS)}) THEN concat(q, ' implementation definition') END], lambda x: x IS NOT NULL)) END AS vall FROM a2),
a4 AS (SELECT *, CASE WHEN text IS NULL OR q = '' THEN vall ELSE list_slice({once('vall')}, 1, 20) END AS v,
    CASE WHEN text IS NULL OR q = '' THEN [] ELSE list_concat(list_transform(tfiles, lambda x: concat('filename:', x)), list_transform(tlangs, lambda x: concat('language:', x))) END AS pats,
    CASE WHEN q = '' THEN text ELSE q END AS normalized FROM a3),
prep AS (SELECT *, (len(v) > 2 AND len(pats) > 0) AS multi,
    CASE WHEN text IS NULL OR q = '' THEN 'Empty query requires no preprocessing' ELSE coalesce(nullif(concat_ws('; ',
      CASE WHEN len(v) > 1 THEN concat('Generated ', len(v) - 1, ' query variants') END,
      CASE WHEN len(pats) > 0 THEN concat('Detected patterns: ', array_to_string(pats, ', ')) END,
      CASE WHEN {any_of('lower(text)', p.ABBREVIATIONS)} THEN 'Expanded programming abbreviations' END,
      CASE WHEN len(list_filter([{hit}], lambda x: x IS NOT NULL)) > 0 THEN concat('Mapped concepts: ', array_to_string(list_filter([{hit}], lambda x: x IS NOT NULL), ', ')) END), ''), 'Basic query preprocessing applied') END AS reasoning FROM a4),
named AS (SELECT *, list_transform(list_filter(pats, lambda x: starts_with(x, 'filename:')), lambda x: substr(x, 10)) AS fs, list_transform(list_filter(pats, lambda x: starts_with(x, 'language:')), lambda x: substr(x, 10)) AS ls FROM prep),
picks AS (SELECT *,
    list_filter(v, lambda x: len(list_filter(fs, lambda n: contains(x, n))) > 0)[1] AS f1,
    list_filter(v, lambda x: x <> text AND len(list_filter(ls, lambda n: contains(lower(x), n))) > 0)[1] AS l1,
    list_filter(v, lambda x: x <> text AND {any_of('lower(x)', p.IMPLEMENTATION)})[1] AS i1,
    list_filter(v, lambda x: x <> text AND {any_of('x', p.TECHNICAL)})[1] AS t1,
    list_filter(v, lambda x: length(x) = list_max(list_transform(v, lambda y: length(y))))[1] AS longest FROM named),
best AS (SELECT query_id, coalesce(CASE WHEN f1 <> text THEN f1 END, l1, i1, t1, CASE WHEN len(v) > 1 AND longest <> text THEN longest END, normalized) AS best FROM picks),
p2 AS (SELECT *, list_filter(v, lambda x: x <> text AND x IS DISTINCT FROM f1 AND {any_of('x', p.TECHNICAL)})[1] AS s2 FROM picks),
p3 AS (SELECT *, list_filter(v, lambda x: x <> text AND x IS DISTINCT FROM f1 AND x IS DISTINCT FROM s2 AND {any_of('lower(x)', p.IMPLEMENTATION[:4])})[1] AS s3 FROM p2),
p4 AS (SELECT *, list_filter([f1, s2, s3], lambda x: x IS NOT NULL) AS taken FROM p3),
p5 AS (SELECT *, list_filter(v, lambda x: x <> text AND NOT list_contains(taken, x)) AS rest FROM p4),
p6 AS (SELECT *, list_slice(list_concat(taken, list_transform(list_sort(list_transform(rest, lambda x, i: struct_pack(n := -length(x), i := i, x := x))), lambda s: s.x)), 1, 3) AS chosen FROM p5),
tops AS (SELECT query_id, CASE WHEN len(chosen) = 0 THEN [normalized] ELSE chosen END AS top FROM p6)"""


def oracle_sql() -> dict[str, str]:
    axis = "[" + ", ".join(map(str, AXIS)) + "]"
    weight = paths.sql_file_weight("relative_path", "file_extension")
    doc = "concat('File: ', coalesce(relative_path, ''), ' ', coalesce(content, ''))"
    cut = f"CASE WHEN length({doc}) > 2000 THEN concat(substr({doc}, 1, 2000), '...') ELSE {doc} END"
    split = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x{{85}}]+'), lambda w: w <> ''))"
    lang = "coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.language') END, 'unknown')"
    return {
        "flagship_hybrid_search": _hybrid_sql(10, 20),
        "dense_topk": f"WITH {VECTORS} SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(list_cosine_similarity(v, {axis}::DOUBLE[]), 6) AS score FROM vs) QUALIFY rank <= 10",
        "dense_topk_batch": f"WITH {VECTORS} {_dense_sql(10)}",
        "dense_threshold": f"WITH {VECTORS} {_dense_sql(20, least='WHERE score >= 0.3')}",
        "dense_filtered": f"WITH {ROWS}, {VECTORS}, vf AS (SELECT * FROM vs WHERE id IN (SELECT id FROM rows WHERE file_extension IN ('.ts', '.py') AND start_line < 50)) {_dense_sql(5, 'vf')}",
        "cosine_kernel": f"""WITH v AS (SELECT id, min(vector) AS v FROM vectors WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY id),
q AS (SELECT {axis}::DOUBLE[] AS q),
p AS (SELECT id, list_transform(list_slice(v, 1, least(len(v), len(q))), lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_slice(q, 1, least(len(v), len(q))), lambda x: CAST(x AS DOUBLE)) AS b FROM v, q)
SELECT id, round(CASE WHEN list_sum(list_transform(a, lambda x: x * x)) = 0 OR list_sum(list_transform(b, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(a, b) END, 6) AS score FROM p""",
        "index_statistics": f"WITH {ROWS}, {_postings_sql()} SELECT count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS words, any_value(n) AS n_docs, round(any_value(a), 6) AS avgdl FROM post, st",
        "bm25_topk": f"WITH {ROWS}, {VECTORS}, {_bm25_sql(10)} SELECT * FROM bm",
        "rrf_fusion": f"WITH {LISTS}, {RRF(60)} SELECT * FROM fused",
        "rrf_fusion_top": f"WITH {LISTS}, {RRF(100)} SELECT * FROM fused WHERE rank <= 5",
        "weighted_fusion": f"""WITH {LISTS}, b AS (SELECT query_id, list_no, min(score) AS lo, max(score) AS hi FROM lists GROUP BY ALL)
SELECT query_id, id, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END * CASE WHEN metric = 'BM25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END), 6) AS score FROM lists JOIN b USING (query_id, list_no) GROUP BY ALL""",
        "file_type_weight": f"WITH {ROWS} SELECT id, CAST({weight} AS DOUBLE) AS weight FROM rows",
        "weighted_resort": f"""WITH {ROWS}, {LISTS}, {RRF(60)}, w AS (SELECT query_id, id, round(score * {weight}, 9) AS score, rank AS r0 FROM fused JOIN rows USING (id) WHERE rank <= 20)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM w""".replace("round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC", "round(w.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY w.score DESC"),
        "rerank_texts": f"WITH {ROWS}, t AS (SELECT id, {cut} AS x FROM rows) SELECT id, md5(x) AS digest, length(x) AS n FROM t",
        "rerank_lexical": f"""WITH {ROWS}, {LISTS}, {RRF(60)}, d AS (SELECT id, {cut} AS x FROM rows),
w AS (SELECT f.query_id, f.id, f.rank AS r0, {split('q.text')} AS a, {split('d.x')} AS b FROM fused f JOIN queries q USING (query_id) JOIN d USING (id) WHERE f.rank <= 15),
s AS (SELECT query_id, id, r0, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS rerank_score FROM w)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r0) AS rank FROM s QUALIFY rank <= 5""",
        "prf_two_pass": _two_pass_sql(),
        "result_projection": f"""WITH {ROWS}, {LISTS}, {RRF(60)}, t AS (SELECT query_id, rank, id, CASE WHEN length(content) > 5000 THEN concat(substr(content, 1, 5000), '...') ELSE content END AS body, {lang} AS language, relative_path, start_line, end_line FROM fused JOIN rows USING (id) WHERE rank <= 3)
SELECT query_id, rank, id, md5(concat(rank, '. Code snippet (', language, ') [all]', chr(10), '   Location: ', relative_path, ':', start_line, '-', end_line, chr(10), '   Rank: ', rank, chr(10), '   Context: ', chr(10), '```', language, chr(10), body, chr(10), '```', chr(10))) AS digest FROM t""",
        "result_previews": f"WITH {ROWS} SELECT id, CASE WHEN length(content) > 150 THEN concat(substr(content, 1, 150), '...') ELSE content END AS preview FROM rows ORDER BY id LIMIT 20",
        "filter_expression": f"WITH {ROWS} SELECT id, relative_path, start_line, end_line FROM rows WHERE file_extension IN ('.ts', '.py') AND (start_line < 40 OR end_line >= 200) AND NOT relative_path LIKE '%test%'",
        "filter_default_limit": f"WITH {ROWS} SELECT id, file_extension FROM rows ORDER BY id LIMIT 16384",
        "merge_dedupe_topk": f"""WITH {LISTS}, u AS (SELECT query_id, id, min(struct_pack(source := 1 - list_no, rank := rank)) AS a FROM lists WHERE list_no IN (0, 1) GROUP BY query_id, id)
SELECT query_id, id, a.source AS source, row_number() OVER (PARTITION BY query_id ORDER BY a.source, a.rank, id) AS rank FROM u QUALIFY rank <= 10""",
        "match_class": f"WITH {LISTS} SELECT query_id, list_no, id, CASE WHEN round(score * 100) >= 80 THEN 'high' WHEN round(score * 100) >= 60 THEN 'medium' ELSE 'low' END AS class FROM lists",
        "parent_index": """WITH cat AS (SELECT codebase_path, status FROM index_catalog QUALIFY row_number() OVER (PARTITION BY codebase_path ORDER BY last_updated DESC, status DESC) = 1),
act AS (SELECT codebase_path AS c FROM cat WHERE status = 'indexed'),
p AS (SELECT DISTINCT concat(codebase_path, '/src/main') AS path FROM queries WHERE codebase_path IS NOT NULL)
SELECT path, arg_max(c, length(c)) AS indexed FROM p LEFT JOIN act ON path = c OR starts_with(path, concat(c, '/')) GROUP BY path""",
        "prf_code_tokens": f"WITH {ROWS} SELECT id, {sql_code_tokens(chr(39) + chr(39) + ' || coalesce(content, ' + chr(39) + chr(39) + ')')} AS tokens FROM rows",
        "prf_term_statistics": f"WITH {_stats_sql()} SELECT query_id, term, round(score, 6) AS score, frequency, document_count, first_doc, first_pos FROM stats",
        "prf_expansion_terms": f"WITH {_stats_sql()} SELECT query_id, term, round(score, 6) AS score, frequency, document_count, rank FROM best",
        "prf_expanded_query": f"WITH {_stats_sql()} SELECT query_id, CASE WHEN len(terms) > 0 THEN concat(text, ' ', array_to_string(terms, ' ')) ELSE text END AS expanded, array_to_string(terms, ',') AS terms, documents FROM expanded",
        "prf_reasoning": f"""WITH {_stats_sql()} SELECT query_id, coalesce(refused, concat('Analyzed ', documents, ' pseudo-relevant documents; ', CASE WHEN len(terms) > 0 THEN concat('Extracted ', len(terms), ' expansion terms using TF-IDF analysis; Top terms: ', array_to_string(list_slice(terms, 1, 3), ', '),
  '; Average TF-IDF score: ', printf('%.3f', list_avg(list_transform(found, lambda x: x.score))), '; ') ELSE '' END, 'Applied code-aware tokenization')) AS reasoning FROM expanded""",
        "tfidf_rank": f"""WITH {ROWS}, dt AS (SELECT id, string_split({sql_code_tokens("coalesce(content, '')")}, ' ') AS t FROM rows), dc AS (SELECT id, term, count(*) AS c, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY id, term),
qt AS (SELECT query_id, string_split(lower(trim(regexp_replace(text, '[\\r\\n]', ' ', 'g'))), ' ') AS t FROM queries WHERE text IS NOT NULL), qc AS (SELECT query_id, term, count(*) AS qc, any_value(len) AS qlen FROM (SELECT query_id, len(t) AS len, unnest(t) AS term FROM qt) GROUP BY query_id, term),
n AS (SELECT count(*) AS n FROM rows), df AS (SELECT term, ln(any_value(n) / (count(*) + 1)) + 1 AS idf FROM dc, n GROUP BY term),
qn AS (SELECT query_id, sqrt(sum((qc / (qlen + 1) * coalesce(idf, ln(n) + 1)) ** 2)) AS qn FROM qc LEFT JOIN df USING (term), n GROUP BY query_id),
x AS (SELECT query_id, id, sum(qc / (qlen + 1) * idf * (c / (len + 1)) * idf) AS dot, sqrt(sum((c / (len + 1) * idf) ** 2)) AS dn FROM qc JOIN dc USING (term) JOIN df USING (term) GROUP BY query_id, id)
SELECT query_id, id, round(CASE WHEN qn * dn = 0 THEN 0 ELSE dot / (qn * dn) END, 6) AS similarity FROM x JOIN qn USING (query_id)""",
        "query_variants": f"WITH {_prep_sql()} SELECT query_id, coalesce(array_to_string(v, '|'), '') AS variants, len(v) AS n FROM prep",
        "query_patterns": f"WITH {_prep_sql()} SELECT query_id, array_to_string(pats, '|') AS patterns, multi FROM prep",
        "query_reasoning": f"WITH {_prep_sql()} SELECT query_id, normalized, reasoning FROM prep",
        "query_best": f"WITH {_prep_sql()} SELECT query_id, best FROM best",
        "query_top": f"WITH {_prep_sql()} SELECT query_id, coalesce(array_to_string(top, '|'), '') AS top FROM tops",
    }
