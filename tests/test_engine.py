"""From a folder to results, and in step with its changes; the stream; the driver's contract."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.operators import bm25, prf
from quern.operators.catalog import Store
from quern.operators.chunking import Splitter
from quern.operators.embedding import HashingEmbedder
from quern.plans.engine import Engine, Settings
from quern.streaming import sync_stream

ONE = {"src/auth.py": "def login(user):\n    return check_password(user)\n", "src/io.py": "def read_file(path):\n    return open(path).read()\n", "README.md": "How to read files and log in\n"}


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "relative_path string, content string")


def test_index_search_and_sync(spark, tmp_path):
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"))
    q = spark.createDataFrame([(1, "read_file path")], "query_id long, text string")
    assert e.search("/repo", q).count() == 0 and not e.has_index("/repo")
    done = e.index("/repo", files(spark, ONE))
    assert (done.files, done.status) == (3, "completed") and e.index("/repo").chunks == done.chunks
    assert e.search("/repo", q, 2).orderBy("rank").first().relative_path == "src/io.py"
    assert {r.relative_path for r in e.search("/repo", q, 5, filter_expression="fileExtension in ['.md']").collect()} <= {"README.md"}
    two = {k: v for k, v in ONE.items() if k != "README.md"} | {"src/io.py": "def write_file(path):\n    pass\n", "src/new.py": "def read_file_again(path):\n    pass\n"}
    assert e.reindex("/repo", files(spark, two), only=["src/new.py"]) == {"added": 1, "modified": 0, "removed": 0}
    assert e.reindex("/repo", files(spark, two)) == {"added": 0, "modified": 1, "removed": 1}
    assert e.reindex("/repo", files(spark, two)) == {"added": 0, "modified": 0, "removed": 0}
    fresh = Engine(spark, Store(spark, f"file://{tmp_path}/t"))
    fresh.index("/repo", files(spark, two))
    rows = lambda x: {tuple(r) for r in x.store.read(x.collection("/repo")).select("id", "relative_path", "content").collect()}
    assert rows(e) == rows(fresh)
    postings = lambda x: {tuple(r) for r in x.store.read(x.collection("/repo") + "_postings").collect()}
    assert postings(e) == postings(fresh)
    q2 = spark.createDataFrame([(1, "write_file"), (2, "nothing of it")], "query_id long, text string")
    found = lambda x: {(r.query_id, r.relative_path, r["rank"]) for r in x.search("/repo", q2).collect()}
    assert found(e) == found(fresh)
    assert e.status("/repo") == "indexed: 3 files, 3 chunks" and e.catalog().count() == 1
    e.clear("/repo")
    assert not e.has_index("/repo") and e.status("/repo") == "not indexed"


def test_nothing_is_embedded_twice(spark, tmp_path):
    class Counting(HashingEmbedder):
        """Writes down how many texts it is asked for."""

        def __init__(self, folder):
            super().__init__(8)
            self.folder = folder

        def embed(self, texts):
            import uuid

            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            return HashingEmbedder.embed(self, texts)

    (tmp_path / "n").mkdir()
    asked = lambda: sum(int(p.read_text()) for p in (tmp_path / "n").iterdir())
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Settings(embedder=Counting(str(tmp_path / "n"))))
    e.index("/a", files(spark, ONE))
    assert asked() == 3
    e.index("/b", files(spark, ONE))  # the same texts in another codebase
    e.index("/a", files(spark, ONE), force=True)
    assert asked() == 3 and e.store.read(e.collection("/b")).where("vector is null").count() == 0
    assert e.reindex("/a", files(spark, ONE | {"src/new.py": "x = 1\n"})) == {"added": 1, "modified": 0, "removed": 0}
    assert asked() == 4 and e.store.read("embedding_cache").count() == 4


def test_a_limit_leaves_files_for_later(spark, tmp_path):
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Settings(chunk_limit=2))
    done = e.index("/a", files(spark, ONE))
    assert (done.chunks, done.status) == (2, "limit_reached") and e.status("/a").endswith("(limit reached)")
    e.use(chunk_limit=None)
    assert e.reindex("/a", files(spark, ONE)) == {"added": 1, "modified": 0, "removed": 0}
    assert e.store.read(e.collection("/a")).count() == 3


def test_a_failure_is_told(spark, tmp_path):
    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("no provider")

    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Settings(embedder=Broken(8)))
    with pytest.raises(Exception, match="no provider"):
        e.index("/a", files(spark, ONE))
    assert e.status("/a").startswith("failed: ") and not e.has_index("/a")
    e.use(embedder=HashingEmbedder(8))
    assert e.index("/a", files(spark, ONE)).chunks == 3 and e.status("/a").startswith("indexed")


def test_store_survives_failed_and_rival_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i, i * 2) for i in ids], "id long, x long")
    store.write("c", rows(1, 2))
    fails = F.udf(lambda x: 1 / 0, "long")
    for _ in range(2):
        with pytest.raises(Exception, match="division"):
            store.write("c", rows(3).withColumn("x", fails("x")))
    assert {r.id for r in store.read("c").collect()} == {1, 2}
    store.insert("c", rows(3, 4))
    store.delete("c", rows(1, 9))
    assert {r.id for r in store.read("c").collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="exist"):
        store._publish("c", max(store._versions("c")), [])  # another writer has this number
    for i in range(10, 24):  # parts are put together after some changes
        store.change("c", rows(i - 1), "id", rows(i))
    assert {r.id for r in store.read("c").collect()} == {2, 3, 4, 23}
    assert all(len(parts) <= store.MOST_PARTS for parts in store._versions("c").values()) and len(store._versions("c")) == 2
    store.insert("d", rows(5))
    assert store.names() == ["c", "d"]
    store.drop("d")
    assert store.names() == ["c"]


def test_search_reads_no_contents_to_rank(spark, tmp_path):
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"))
    e.index("/a", files(spark, ONE))
    name = e.collection("/a")
    q = spark.createDataFrame([(1, "read_file path")], "query_id long, text string")
    ranked = bm25.top_k_of(e.store.read(name + "_postings"), bm25.statistics(e.store.read(name).select(F.col("n_terms").alias("dl"))), q)
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert "content:string" not in text and "In(term, [" in text and ranked.count() == 1
    assert e.search("/a", q).where("relative_path = 'src/io.py'").first().content == ONE["src/io.py"].strip()


def test_settings_take_effect(spark, tmp_path):
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"))
    e.add_extensions("txt")
    e.add_ignore(["src/"])
    e.use(splitter=Splitter("window", 50, 10), hybrid=False, feedback=True, reranking=True)
    e.index("/r", files(spark, ONE | {"a.txt": "alpha beta\n" * 20, "b.md": "alpha gamma\n", "c.md": "alpha delta beta\n"}))
    paths = {r.relative_path for r in e.store.read(e.collection("/r")).collect()}
    assert paths == {"README.md", "a.txt", "b.md", "c.md"}
    got = e.search("/r", spark.createDataFrame([(1, "alpha")], "query_id long, text string"), 3, 0.0).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3]
    e.reset_ignore()
    assert "src/" not in e.settings.ignore


def test_one_query_as_a_reader_sees_it(spark, tmp_path, monkeypatch):
    e = Engine(spark, Store(spark, f"file://{tmp_path}/s"))
    (tmp_path / "env").write_text("CUSTOM_EXTENSIONS=txt, .cfg\nOTHER=1\n")
    (tmp_path / "ignore").write_text("# mine\nold/\n")
    monkeypatch.setenv("CUSTOM_IGNORE_PATTERNS", "tmp/,*.log")
    e.from_environment(str(tmp_path / "env"), str(tmp_path / "ignore"))
    assert {".txt", ".cfg"} <= set(e.settings.extensions) and {"tmp/", "*.log", "old/"} <= set(e.settings.ignore)
    e.index("/repo", files(spark, ONE | {"a.txt": "read_file of a path\n", "old/b.py": "read_file\n"}))
    got = e.search_code("/repo", "read_file path", 1).collect()
    assert len(got) == 1 and got[0].text.startswith("1. Code snippet (")
    only = e.search_code("/repo/src", "read_file path", 99, [" .txt "]).collect()  # a folder of an indexed codebase
    assert len(only) == 1 and "a.txt:1-" in only[0].text
    with pytest.raises(ValueError, match="txt"):
        e.search_code("/repo", "x", extensions=["txt"])
    e.search_code("/repo", "read_file path", feedback=True).collect()
    assert not e.settings.feedback and e.feedback.stats()["total_queries"] == 1
    seen = e.browse("/repo", spark.createDataFrame([(1, "read_file of a path")], "query_id long, text string")).orderBy("rank").collect()
    assert seen[0].relative_path == "a.txt" and (seen[0]["class"], seen[0].score) == ("high", 1.0) and all(r.score >= 0.3 for r in seen)
    monkeypatch.setattr(prf, "expand", lambda *a, **k: 1 / 0)
    with pytest.warns(UserWarning, match="without feedback"):
        assert e.search_code("/repo", "read_file path", 1, feedback=True).count() == 1


def test_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2025, 1, 1, 0, m)
    store = Store(spark, f"file://{tmp_path}/store")

    def put(rows, n):
        spark.createDataFrame(rows, sync_stream.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def chunk(df):
        return df.select(F.md5("content").alias("id"), "relative_path", "content")

    def run():
        q = sync_stream.start(sync_stream.changes(spark, f"{tmp_path}/in"), store, "c", chunk, f"{tmp_path}/ck", every=None)
        q.awaitTermination()

    put([("a", "1", False, at(1)), ("b", "2", None, at(1)), ("a", "3", False, at(2))], 1)
    run()
    assert {(r.relative_path, r.content) for r in store.read("c").collect()} == {("a", "3"), ("b", "2")}
    put([("b", None, True, at(3)), ("c", "4", False, at(3))], 2)
    run()
    assert {(r.relative_path, r.content) for r in store.read("c").collect()} == {("a", "3"), ("c", "4")}


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert __spark_entry__.entry(spark).count() > 0
