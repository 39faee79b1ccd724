"""Operators on small tables: invariants and edge cases that the SQL comparison does not reach."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import staging
from quern.operators import bm25, catalog, chunking, dense, embedding, evaluation, fusion, prf, reading, sync
from quern.operators.distributed_rank import rank_values
from quern.sources import files as sources


def test_rank_values_against_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if rng.random() < 0.6 else "hot", rng.choice([None, 1, 2, 3, 4, 5]), "x") for _ in range(500)]
    got = {(r.g, r.k): (r.n_before, r.n_equal) for r in rank_values(spark.createDataFrame(rows, "g string, k int, n_before string"), ["g"], "k").collect()}
    key = lambda k: -1 if k is None else k
    for (g, k), (before, equal) in got.items():
        own = [key(x[1]) for x in rows if x[0] == g]
        assert before == sum(x < key(k) for x in own) and equal == own.count(key(k))
    assert len(got) == len({x[:2] for x in rows})


def test_rank_values_over_many_groups_and_batches(spark):
    """Groups that go on over batches and ranges, null groups, keys that are structures."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, *range(3, 400)]) if rng.random() < 0.6 else 7, rng.choice("ab"), rng.randrange(3000)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "g int, h string, k int").withColumn("key", F.struct((F.col("k") / 10).cast("int").alias("a"), "k"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.g, r.h, r.key.k): (r.n_before, r.n_equal) for r in rank_values(df, ["g", "h"], "key").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {}
    for g, h, k in rows:
        by.setdefault((g, h), []).append(k)
    assert len(got) == len(set(rows))
    for (g, h), own in by.items():
        own.sort()
        assert all(got[g, h, k] == (own.index(k), own.count(k)) for k in set(own))


def test_dense_passes_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))] + [("null", None), ("zero", [0.0] * 4), ("short", [1.0]), ("nan", [float("nan")] * 4), ("part", [None, 1.0, 1.0, 1.0])]
    r = spark.createDataFrame(rows, "id string, vector array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))] + [(99, None)], "query_id long, vector array<float>")
    one = sorted(map(tuple, dense.top_k(r, q, 5, 4).collect()))
    assert len(one) == 45 and {x[0] for x in one} == set(range(9))
    monkeypatch.setattr(dense, "BYTES_A_PASS", 16 * 2)
    assert sorted(map(tuple, dense.top_k(r, q, 5, 4).collect())) == one
    assert dense.top_k(r, q.limit(0), 5, 4).count() == 0 and dense.top_k(r.limit(0), q, 5, 4).count() == 0


def test_dense_keeps_all_ties_in_reach(spark):
    rows = spark.createDataFrame([(f"r{i:03d}", [1.0, 0.0]) for i in range(50)], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in dense.top_k(rows, q, 3, 2).orderBy("rank").collect()] == ["r000", "r001", "r002"]


def test_dense_is_exact_over_blocks_and_shuffles_once(spark, monkeypatch):
    """Bounds from groups of rows and from the blocks before lose nothing, ties at the edge and tiny values included; only k a query and task are shuffled."""
    r = np.random.default_rng(5)
    x = r.integers(-2, 3, (3000, 4)).astype(float)  # many equal directions
    x[:10] = 1e-200, 2e-200, 0, 0
    q = r.normal(size=(30, 4))
    monkeypatch.setattr(dense, "ROWS_AT_ONCE", 700)
    monkeypatch.setattr(dense, "SCORES_AT_ONCE", 9000)
    rows = spark.createDataFrame([(f"r{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, vector array<double>").repartition(3)
    found = dense.top_k(rows, spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "query_id long, vector array<double>"), 7, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    unit = lambda y: y / np.abs(y).max(1, keepdims=True) / np.linalg.norm(y / np.abs(y).max(1, keepdims=True), axis=1, keepdims=True)
    ids = np.flatnonzero(x.any(1))
    s = np.round(unit(q) @ unit(x[ids]).T, 6)
    want = [(i, f"r{ids[j]:04d}") for i in range(30) for j in np.lexsort((ids, -s[i]))[:7]]
    assert [(f.query_id, f.id) for f in found.orderBy("query_id", "rank").collect()] == want


def test_bm25_edges(spark):
    rows = spark.createDataFrame([("a", "Red fox"), ("b", "red red hen"), ("c", None), ("d", "")], "id string, content string")
    q = spark.createDataFrame([(1, "RED"), (2, None), (3, "!!"), (4, "fox red red")], "query_id long, text string")
    got = [(r.query_id, r.id) for r in bm25.top_k(rows, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b"), (1, "a"), (4, "a"), (4, "b")]
    assert bm25.top_k(rows.limit(0), q, 5).count() == 0
    other = spark.createDataFrame([("a", "Сборка индекса"), ("b", "größere Menge"), ("c", "日本 語")], "id string, content string")
    q = spark.createDataFrame([(1, "индекса?"), (2, "GRÖSSERE größere"), (3, "語")], "query_id long, text string")
    assert [(r.query_id, r.id) for r in bm25.top_k(other, q, 5).orderBy("query_id").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_bm25_scores_where_the_documents_lie(spark):
    """No pair of a query and a document is a row, whatever the number of both; words that a task's documents lack add nothing."""
    words = ["fox", "hen", "owl", "cat", "elk", "bee"]
    docs = {f"d{i:03d}": [words[j] for j in range(6) if i % (j + 2) == 0] + ["the"] * (i % 5) for i in range(300)}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id string, content string")
    asks = {q: ["the", words[q % 6], "yak" if q % 2 else words[(q + 1) % 6], f"d{q}"] for q in range(40)}
    found = bm25.top_k(rows, spark.createDataFrame([(q, " ".join(t)) for q, t in asks.items()], "query_id long, text string"), 4)
    avgdl = sum(map(len, docs.values())) / 300
    df = {w: sum(w in t for t in docs.values()) for w in ["the", *words]}

    def score(q, t):
        return round(sum(math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) for w in set(asks[q]) if w in t), 6)

    want = [(q, i, score(q, docs[i])) for q in asks for i in sorted((i for i in docs if set(asks[q]) & set(docs[i])), key=lambda i: (-score(q, docs[i]), i))[:4]]
    assert [(r.query_id, r.id, r.score) for r in found.orderBy("query_id", "rank").collect()] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" in plan and "sum(" not in plan  # the pairs' sums were rows before


def test_rerank_neutral_on_failure(spark):
    df = spark.createDataFrame([(1, "a", "q", "doc a", 1), (1, "b", "q", "boom", 2), (1, "c", "q", None, 3)], "query_id long, id string, text string, doc string, rank int")

    def scorer(q, d):
        if d == "boom":
            raise ValueError
        return 0.9 if d else 0.1

    assert [(r.id, r.rerank_score) for r in fusion.rerank(df, 3, scorer).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.5), ("c", 0.1)]

    class Batches(fusion.Reranker):
        def score(self, queries, documents):
            if len(documents) > 16 or "d39" in documents:
                raise ValueError
            return [0.001 * int(d[1:]) for d in documents]

    many = spark.createDataFrame([(1, f"i{n:02d}", "q", f"d{n}", n) for n in range(40)], "query_id long, id string, text string, doc string, rank int").coalesce(1)
    got = {r.id: r.rerank_score for r in fusion.rerank(many, 40, Batches()).collect()}
    assert got == {f"i{n:02d}": 0.5 if n >= 32 else round(0.001 * n, 6) for n in range(40)}  # 16, 16 and a batch that fails
    assert fusion.candidates(20, True, True) == 50 and fusion.candidates(5, False, True) == 10 and fusion.candidates(5, True, False) == 5


def test_feedback_limits(spark):
    docs = [(q, d, t) for q, n in ((1, 7), (2, 2), (3, 3)) for d, t in enumerate(["getUserName loads the user record from storage"] * n, 1)]
    d = spark.createDataFrame(docs, "query_id long, doc int, content string")
    q = spark.createDataFrame([(1, "user"), (2, "user"), (3, "user"), (4, "user"), (5, " ")], "query_id long, text string")
    got = {r.query_id: r for r in prf.expand(q, d).collect()}
    assert got[1].terms and not {"the", "user"} & set(got[1].terms) and got[1].expanded.startswith("user ")
    assert got[2].expanded == "user" and "Insufficient" in got[2].reasoning and got[3].terms and "No search results" in got[4].reasoning and got[5].reasoning == "Empty query"
    few = {r.query_id: r for r in prf.expand(q, d, original_weight=0.3, most=2, least=5).collect()}
    assert len(few[1].terms) == 2 and few[1].expanded.endswith(" user") and all(len(t) >= 5 for t in few[1].terms)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab c\n\t{}", max_size=300), st.integers(5, 60))
def test_lines_and_windows_lose_nothing(text, size):
    bare = lambda s: "".join(s.split())
    assert bare("".join(p.content for p in chunking.by_lines(chunking.Piece(text, 1, 1), size))) == bare(text)
    pieces = chunking.by_window(text, size, 0)
    assert bare("".join(p.content for p in pieces)) == bare(text)
    lines = text.split("\n")
    assert all(p.content == "\n".join(lines[p.start_line - 1 : p.end_line]) for p in chunking.by_window(text, size, 10))
    assert all(len(x) <= max(size, 1) for x in chunking.by_separators(text, "python", size, 0))


PYTHON = "import os\nimport sys\n\nX = 1\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        return 2\n"
SCRIPT = "import a from 'a';\nimport b from 'b';\n\nexport class A {\n  run(x) {\n    return '}' + x;\n  }\n}\n\nconst f = (x) => {\n  return x;\n};\n"


def test_declarations():
    ranges = [(p.start_line, p.end_line) for p in chunking.units(PYTHON, "python")]
    assert ranges == [(1, 2), (4, 4), (6, 8), (10, 12), (11, 12)]
    script = [(p.start_line, p.end_line) for p in chunking.units(SCRIPT, "js")]
    assert script[0] == (1, 2) and (4, 8) in script and (5, 7) in script and (10, 12) in script
    assert [(p.start_line, p.end_line) for p in chunking.units("broken (", "python")] == [(1, 1)] and chunking.units(" \n", "go") == []
    assert [p.start_line for p in chunking.units("def a\n  1\nend\n\nclass B\n  def c\n  end\nend\n", "rb")] == [1, 5, 6]
    for code, language in ((PYTHON, "python"), (SCRIPT, "ts")):
        whole = "\n".join(p.content for p in chunking.with_gaps(code, language))
        assert [x for x in whole.split("\n") if x.strip()] == [x for x in code.split("\n") if x.strip()]
    s = chunking.Splitter(size=40, overlap=5)
    assert s.strategy("python") == "ast" and s.strategy("cobol") == "text" and not s.supports(None)
    assert len({(p.start_line, p.end_line) for p in s.split(PYTHON, "python")}) == len(s.split(PYTHON, "python"))


def test_embedding_cache_round_trip(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", " x y\n"), ("c", "z"), ("d", None)], "id string, content string")
    cache = spark.createDataFrame([], "content_hash string, embedding array<float>, dimension int, created_at timestamp")
    got, after = embedding.embed_cached(rows, cache, embedding.HashingEmbedder(8))
    v = {r.id: r.vector for r in got.collect()}
    assert v["a"] == v["b"] and len(v["a"]) == 8 and v["d"] is not None and after.count() == 3
    again, _ = embedding.embed_cached(rows, after, embedding.HashingEmbedder(8))
    assert {r.id: r.vector for r in again.collect()} == v
    assert embedding.misses(rows.select(embedding.content_hash(F.col("content")).alias("content_hash")).where("content_hash is not null"), after).count() == 0


def test_sync_agrees_with_fresh_index(spark):
    one = spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("c.py", "3")], "relative_path string, content string")
    two = spark.createDataFrame([("d.py", "4"), ("c.py", "9"), ("a.py", "1")], "relative_path string, content string")
    a, b = sync.snapshot(one), sync.snapshot(two)
    assert {tuple(r) for r in sync.compare(a, b).collect()} == {("b.py", "removed"), ("c.py", "modified"), ("d.py", "added")}
    assert sync.changed(a, b) and not sync.changed(a, a.orderBy(F.desc("relative_path")))
    assert {tuple(r) for r in sync.after_change(one, sync.compare(a, b), two).collect()} == {tuple(r) for r in two.collect()}
    kept = sync.after_change(one, sync.compare(a, b), two, F.col("relative_path") == "c.py")
    assert {tuple(r) for r in kept.collect()} == {("a.py", "1"), ("b.py", "2"), ("c.py", "9")}
    hidden = spark.createDataFrame([("a/.git/x",), ("a/log/x",), ("log",), ("z.min.js",), ("ok.js",), (None,)], "p string")
    assert [r[0] for r in hidden.select(sync.sync_ignored(F.col("p"), ["log/", "*.min.js", "/"])).collect()] == [True, True, False, True, False, False]


def test_store(spark, tmp_path):
    s = catalog.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert not s.has("x") and s.names() == []
    s.insert("x", rows)
    s.insert("x", spark.createDataFrame([("c", 3)], "id string, n int"))
    s.delete("x", spark.createDataFrame([("a",)], "id string"))
    assert s.names() == ["x"] and sorted(r.id for r in s.read("x").collect()) == ["b", "c"]
    s.drop("x")
    assert not s.has("x")


def test_catalog_states(spark):
    rows = [("/a", "indexed", 1), ("/a", "indexing", 2), ("/b", "indexed", 1), (None, "indexed", 1), ("/b/c", "indexed", None)]
    c = spark.createDataFrame(rows, "codebase_path string, status string, last_updated int")
    assert {tuple(r)[:2] for r in catalog.latest_state(c).collect()} == {("/a", "indexing"), ("/b", "indexed"), ("/b/c", "indexed")}
    p = spark.createDataFrame([("/b/c/d",), ("/b/x",), ("/bx",), ("/a",)], "path string")
    assert {tuple(r) for r in catalog.parent_index(p, c).collect()} == {("/b/c/d", "/b/c"), ("/b/x", "/b"), ("/bx", None), ("/a", None)}


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(["/a", "a", "b"], ["a", "/c"]), ([], ["a"]), (None, None)], "hits array<string>, oracles array<string>")
    assert [(r.precision, r.recall, r.f1) for r in evaluation.with_metrics(df).collect()] == [(0.5, 0.5, 0.5), (0, 0, 0), (0, 0, 0)]
    assert evaluation.edit_line("a\nb\nc", "b\n") == 2 and evaluation.edit_line("a", "") is None
    assert "-a" in evaluation.unified_diff("a\n", "b\n", "x") and evaluation.unified_diff("a", "a", "x") == ""


def test_reading(spark):
    f = spark.createDataFrame([("src/a/b.py", "x = 1\ny = 22\n"), ("src/c.py", "z"), ("top.md", None), (".hid/x", "z")], "relative_path string, content string")
    assert [tuple(r) for r in reading.grep(f, r"\d+", include=r"\.py$").collect()] == [("src/a/b.py", 1, "x = 1", "1"), ("src/a/b.py", 2, "y = 22", "22")]
    assert {tuple(r) for r in reading.list_directory(f, "src/").collect()} == {("a", "directory"), ("c.py", "file")}
    assert {tuple(r) for r in reading.directory_tree(f, 1).collect()} == {("src", 1, 2)}
    assert spark.range(1).select(reading.read_slice(F.lit("a\nb\nc"), 1, 1), reading.read_slice(F.lit("a"), None, 1)).first()[0].endswith("\nb")


def test_folder_scan(spark, tmp_path):
    for name, text in {"a b/x+y%.py": "1", "node_modules/z.js": "2", "n.txt": "3", ".myignore": "secret/\n# no\n", "secret/q.py": "4", "m.ts": "é"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(text)
    files = sources.read_folder(spark, str(tmp_path))
    got = {r.relative_path: r.content for r in files.collect()}
    assert got["a b/x+y%.py"] == "1" and got["m.ts"] == "é"
    assert sources.read_ignore_files(spark, str(tmp_path)) == ["secret/"]
    code = sources.code_files(files, patterns=[*sources.IGNORE, "secret/"])
    assert {r.relative_path: r.language for r in code.collect()} == {"a b/x+y%.py": "python", "m.ts": "typescript"}
    assert sources.read_ignore_files(spark, str(tmp_path / "secret")) == []
    (tmp_path / "node_modules" / "z.js").chmod(0)
    some = sources.read_folder(spark, str(tmp_path), sources.EXTENSIONS, [*sources.IGNORE, "secret/"])
    assert {r.relative_path: r.content for r in some.collect()} == {"a b/x+y%.py": "1", "m.ts": "é"}
    assert "content:binary" not in some._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "bytes.py").write_bytes(b"x\xff")
    assert sources.read_folder(spark, f"file://{tmp_path}", [".py"], []).where("relative_path = 'bytes.py'").first().content == "x\ufffd"


def test_grep_takes_each_line_by_itself(spark):
    df = spark.createDataFrame([("a", "import x\ndef foo():\n  return\n"), ("b", "no def foo"), ("c", None), ("d", "")], "relative_path string, content string")
    assert [(r.relative_path, r.line_number, r.match) for r in reading.grep(df, "^def foo").collect()] == [("a", 2, "def foo")]
    assert [(r.relative_path, r.line_number) for r in reading.grep(df, "return$").collect()] == [("a", 3)]
    assert {r.relative_path for r in reading.grep(df, "foo", include="^b").collect()} == {"b"}


def test_directories_come_first(spark):
    df = spark.createDataFrame([("b.py",), ("A.py",), ("zeta/x.py",), ("Beta/y/z.py",), ("zeta/y.py",)], "relative_path string")
    assert [(r.name, r.kind) for r in reading.list_directory(df).collect()] == [("Beta", "directory"), ("zeta", "directory"), ("A.py", "file"), ("b.py", "file")]


LOG = """Tool Call: 'edit'
   Arguments: {'file_path': '/repo/src/a.py', 'old_string': "def a():\\n    pass", 'new_string': 'def a(x):\\n    return "x"'}
   Arguments: {'path': '/repo'}
   Arguments: {'file_path': '/repo/b.py', 'old_string': 'it\\'s',
     'new_string': 'that'}
   Arguments: {'file_path': '/repo/c.py'}
"""


def test_edits_of_a_log(spark):
    logs = spark.createDataFrame([(1, LOG), (2, None), (3, "nothing")], "doc_id long, text string")
    calls = evaluation.edit_calls(logs)
    got = [tuple(r) for r in calls.orderBy("call_no").collect()]
    assert got == [(1, 1, "/repo/src/a.py", "def a():\n    pass", 'def a(x):\n    return "x"'), (1, 2, "/repo/b.py", "it's", "that")]
    files = spark.createDataFrame([("/repo/src/a.py", "import os\n\ndef a():\n    pass\n")], "relative_path string, content string")
    diffs = {r.file_path: r for r in evaluation.edit_diffs(calls, files).collect()}
    assert diffs["/repo/src/a.py"].line == 3 and diffs["/repo/src/a.py"].diff.startswith("# Edit starting at line 3\n--- a/") and diffs["/repo/b.py"].line is None and diffs["/repo/b.py"].diff.startswith("--- a/")


def test_paths_that_a_transcript_tells(spark):
    text = 'x\n Successfully modified file: /repo/a.py \nedit {"file_path": "/repo/b.py"} Successfully modified file: c.py\nSuccessfully modified file: /repo2/a.py\nSuccessfully modified file: /repo/a.py'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.path, r.place) for r in evaluation.edited_paths(df, "/repo/").orderBy("place").collect()] == [("a.py", 1), ("c.py", 2), ("b.py", 3), ("/repo2/a.py", 4)]


def test_tokens_and_tools(spark):
    m = spark.createDataFrame([("a", 5, 2, None), ("a", 1, 1, 9), ("b", 0, 0, None), ("c", None, None, None)], "instance_id string, input_tokens long, output_tokens long, total_tokens long")
    assert {tuple(r) for r in evaluation.token_totals(m).collect()} == {("a", 6, 3, 16, 9), ("b", 0, 0, 0, 0), ("c", 0, 0, 0, 0)}
    calls = spark.createDataFrame([("a", "grep"), ("a", "read"), ("a", "grep"), ("b", None)], "instance_id string, tool string")
    assert {(r.instance_id, tuple(sorted(r.tool_call_counts.items())), r.total_tool_calls) for r in evaluation.tool_stats(calls).collect()} == {("a", (("grep", 2), ("read", 1)), 3), ("b", (("unknown", 1),), 1)}
    assert evaluation.subset_share(spark.createDataFrame([], "difficulty string, patch string"), "x", 2).first().percent == 0


def test_instances_and_what_is_done(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"instance_id": "a", "patch": "x"}\n{"instance_id": "b", "patch": null}\n')
    (tmp_path / "whole.json").write_text('{\n "metadata": {"n": 2},\n "instances": [\n  {"instance_id": "a"},\n  {"instance_id": "c"}\n ]\n}\n')
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "result.json").write_text("{}")
    (tmp_path / "runs" / "b").mkdir()
    (tmp_path / "runs" / "b" / "log.txt").write_text("broken off")
    done = sources.done_instances(spark, str(tmp_path / "runs"))
    left = lambda name: [r.instance_id for r in sources.not_done(sources.read_instances(spark, str(tmp_path / name)), done).orderBy("instance_id").collect()]
    assert left("lines.jsonl") == ["b"] and left("whole.json") == ["c"]


def test_nodes_of_a_tree(spark):
    nodes = sync.merkle_nodes(sync.snapshot(spark.createDataFrame([("a", "x"), ("b", None)], "relative_path string, content string")))
    assert sync.roots(nodes).count() == 1 and {r.data.split(":")[0] for r in sync.leaves(nodes).collect()} == {"a", "b"}
    again = sync.from_lines(sync.to_lines(nodes).unionByName(spark.createDataFrame([("{",), (None,)], "value string")))
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.select("id", "data", "parents", "children").collect()))


def test_trees_and_recent_ones(spark):
    names = ["src/a/x.py", "src/a/deep/y.py", "src/b.py", "node_modules/z/q.js", ".git/x", ".env", "top.md", "zz/.hidden", "zz/venv/x.py", "zz/a.py", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "relative_path string")
    assert [r.line for r in reading.tree(df).collect()] == ["├── .env", "├── src/", "│   ├── a/", "│   │   ├── deep/", "│   │   └── x.py", "│   └── b.py", "├── top.md", "└── zz/", "    ├── a.py"]
    assert reading.tree(df.limit(0)).count() == 0 and [r.line for r in reading.tree(df, 1).collect()] == ["├── .env", "├── src/", "├── top.md", "└── zz/"]
    repos = spark.createDataFrame([("r", "2025-01-01"), ("r", "2025-03-01"), ("s", "2025-02-01")], "id string, indexed_at string").withColumn("indexed_at", F.to_timestamp("indexed_at"))
    assert [r.id for r in catalog.recent(repos).collect()] == ["r", "s"] and [r.id for r in catalog.recent(repos, since=F.to_timestamp(F.lit("2025-02-15"))).collect()] == ["r"]


def test_once_keeps_one_row_of_a_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), ("b", 5, None), (None, 9, "n"), ("c", None, None), ("c", None, None)], "id string, n int, t string")
    got = {tuple(r) for r in staging.once(rows, "id", lambda rest: F.max(F.struct(*rest))).collect()}
    assert got == {("a", 2, "w"), ("b", 5, None), ("c", None, None)}
    assert staging.once(rows.where("n = 5"), "id", lambda rest: F.max(F.struct(*rest))).count() == 1 and staging.once(rows.limit(0), "id", lambda rest: F.max(F.struct(*rest))).count() == 0


def test_feedback_counts_words_where_the_documents_lie(spark):
    docs = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "red hen hen"), (2, 1, "red")], "query_id long, doc int, content string")
    found = prf.term_statistics(docs)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.split("\n") if "Exchange" in x and "term" in x]  # words are not shuffled
    assert sorted((r.query_id, r.term, r.frequency, r.document_count, r.first_doc, r.first_pos) for r in found.collect()) == [
        (1, "fox", 1, 1, 1, 1), (1, "hen", 2, 1, 2, 1), (1, "red", 2, 2, 1, 0), (2, "red", 1, 1, 1, 0)
    ]


def test_tfidf_pairs_are_not_shuffled(spark):
    docs = {"a": "red fox", "b": "red red hen", "c": "", "d": None, "e": "owl"}
    asks = {1: "Red fox", 2: "hen yak hen", 3: "", 4: "yak", 5: "owl red"}
    found = prf.tfidf_rank(spark.createDataFrame(list(docs.items()), "id string, content string"), spark.createDataFrame(list(asks.items()), "query_id long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    words = {i: (t or "").split(" ") for i, t in docs.items()}
    idf = lambda w: math.log(5 / (sum(w in t for t in words.values()) + 1)) + 1
    want = {}
    for q, text in asks.items():
        t = text.lower().split(" ")
        own = {w: t.count(w) / (len(t) + 1) * idf(w) for w in t}
        for i, d in words.items():
            if both := [w for w in own if w in d]:
                there = {w: d.count(w) / (len(d) + 1) * idf(w) for w in both}
                want[q, i] = round(sum(own[w] * there[w] for w in both) / math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in there.values())), 6)
    assert {(r.query_id, r.id): r.similarity for r in found.collect()} == want and (3, "d") in want
    assert prf.tfidf_rank(found.selectExpr("id", "id as content").limit(0), spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0
