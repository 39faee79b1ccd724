"""Query rewriting, paths and filters on literals."""

import pytest
from pyspark.sql import functions as F

from quern.functions import paths, query_prep
from quern.functions.text import code_tokens, trim_all
from quern.operators import filters


def prepared(spark, *texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return [r for r in query_prep.top(query_prep.best(query_prep.preprocess(df, **how))).orderBy("query_id").collect()]


def test_variants(spark):
    blank, padded, camel, snake, dunder, none, js = prepared(spark, "", "  js code  ", "getUserData", "user_name here user_name", "__init__", None, "javascript js")
    assert blank.variants == [""] and none.variants == [None]
    assert padded.variants[:2] == ["js code", "javascript code"] and padded.normalized == "js code"
    assert "get User Data" in camel.variants and "user name here user_name" in snake.variants
    assert not any(v.startswith("  init") for v in dunder.variants) and dunder.patterns == ["language:python"]
    assert "javascript javascript" in js.variants and not any("avascriptavascript" in v for v in js.variants)


def test_variants_are_each_once_and_bounded(spark):
    (r,) = prepared(spark, "database connection error handling authentication testing security", most=15)
    assert len(r.variants) == 15 == len(set(r.variants))
    (off,) = prepared(spark, "js getUserData how to", flags=())
    assert off.variants == ["js getUserData how to"]
    (long,) = prepared(spark, "word " * 3000)
    assert len(long.variants) >= 1


def test_selection(spark):
    file, tech, plain, impl = prepared(spark, "see src/app/main.py now", "auth flow", "quick fox", "how to parse")
    assert file.patterns[:2] == ["filename:src/app/main.py", "filename:app/main.py"] or file.patterns[0] == "filename:src/app/main.py"
    assert file.top[0] == "see src/app/main.py now" and file.multi
    assert tech.best == "authentication flow" and plain.best == "quick fox" and plain.top == ["quick fox"]
    assert impl.best == "how to parse function class method implementation"


def test_text(spark):
    row = spark.createDataFrame([("\ufeff \n x y\t ", "getHTTPServer my_var-name abc123def x²")], "a string, b string").select(trim_all(F.col("a")), code_tokens(F.col("b"))).first()
    assert row[0] == "x y" and row[1] == "get httpserver my var name abc 123 def x"


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("build/**", "build/x/y", True), ("build/**", "a/build/x", False), ("build", "a/build/x", True),
        ("/build", "a/build", False), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/b/d/c", True), ("a/**/c", "a/c", True), ("dir/", "x/dir/y", True),
        ("dir/", "x/dir", False), ("a?.py", "ab.py", True), ("a?.py", "a/.py", False), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), (".env.*", ".env.local", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert spark.range(1).select(paths.ignored(F.lit(path), [pattern])).first()[0] is hit


def test_ignore_order_and_lists(spark):
    rules = paths.ignore_patterns(["*.log"], "# comment\n\n  keep/ \n!keep/x.log\n", ["*.log"])
    assert rules == ["*.log", "keep/", "!keep/x.log"]
    rows = spark.createDataFrame([("a.log",), ("keep/x.log",), ("b.py",), (None,)], "p string").select(paths.ignored(F.col("p"), rules)).collect()
    assert [r[0] for r in rows] == [True, False, False, False]
    assert paths.with_extensions([".a"], "b, .a,.c,") == [".a", ".b", ".c"]
    assert paths.checked_extensions([" .ts ", "", ".py"]) == [".ts", ".py"]
    with pytest.raises(ValueError):
        paths.checked_extensions(["ts"])


def test_weights(spark):
    cases = [("test_x.py", ".py", 1.0), ("a/test_x.py", ".py", 0.8), ("a/x.test.ts", ".ts", 0.8), ("a/x.test.ts", ".py", 1.0), ("a/Mocks/x.go", ".go", 0.8), ("a/XTest.java", ".java", 0.8), (None, None, 1.0)]
    df = spark.createDataFrame(cases, "p string, e string, w double")
    assert df.where(paths.file_weight(F.col("p"), F.col("e")) != F.col("w")).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a", 'x/"q".py', 1, ".py"), ("b", "y.ts", 50, ".ts"), ("c", "it's.go", 9, ".go")], "id string, relative_path string, start_line int, file_extension string")
    ids = lambda e: sorted(r.id for r in df.where(filters.parse(e)).collect())
    assert ids(filters.of_extensions([".py", ".ts"])) == ["a", "b"] and ids(filters.of_path('x/"q".py')) == ["a"]
    assert ids("startLine > 5 and not (fileExtension == '.go' or id == 'x')") == ["b"]
    assert ids("id not in ['a'] && relativePath like '%.ts' || startLine <= 1") == ["a", "b"]
    assert ids("id in []") == [] and filters.parse("  ") is None
    for bad in ("id = 'a'", "nothing == 1", "id ==", "(id == 'a'", "id == 'a' 'b'", "id; drop"):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)
