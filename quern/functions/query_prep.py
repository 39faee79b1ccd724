"""Query rewriting: a query text to its variants, detected patterns and chosen searches, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import trim_all

# Fixed values, in the order in which they apply.
ABBREVIATIONS = {
    "js": "javascript", "ts": "typescript", "py": "python", "fn": "function", "var": "variable", "api": "API", "db": "database",
    "auth": "authentication", "async": "asynchronous", "config": "configuration", "util": "utility", "req": "request",
    "res": "response", "err": "error", "ctx": "context",
}
CONCEPTS = {
    "error handling": ["try except finally", "raise Exception", "error log", "catch error"],
    "database connection": [
        "db.connect", "create_engine", "connection pool", "sessionmaker", "db.session", "db.engine", "db.query", "db.execute",
        "db.commit", "db.rollback", "db.close",
    ],
    "configuration": ["load_config", "settings.toml", "os.environ.get", "app.config"],
    "authentication": ["auth token", "jwt", "oauth", "login_required", "password"],
    "async processing": ["async def", "await", "asyncio", "celery task", "message queue"],
    "file system": ["os.path.join", "os.path.exists", "os.makedirs", "os.listdir"],
    "logging": ["logging.info", "logging.error", "logging.warning", "logging.debug"],
    "data processing": ["pandas", "numpy", "scipy", "scikit-learn", "scikit-image"],
    "web development": ["flask", "django", "fastapi", "react", "vue", "angular"],
    "machine learning": ["tensorflow", "pytorch", "scikit-learn", "keras", "torchvision"],
    "data visualization": ["matplotlib", "seaborn", "plotly", "bokeh", "altair"],
    "data analysis": ["pandas", "numpy", "scipy", "scikit-learn", "scikit-image"],
    "testing": ["pytest", "unittest", "mock", "coverage", "test_case"],
    "security": ["encryption", "hashing", "authentication", "authorization", "access control"],
    "performance optimization": ["profiling", "caching", "batch processing", "parallel processing"],
    "database optimization": ["indexing", "query optimization", "database schema design", "database tuning"],
}
LANGUAGES = {
    "python": ["python", r"\bpy\b", r"\.py\b", r"\bdef\s+", r"\bimport\s+", r"\bfrom\s+", r"\bclass\s+", "__init__"],
    "javascript": ["javascript", r"\bjs\b", r"\.js\b", r"\bfunction\b", r"\bconst\s+", r"\blet\s+", r"\bvar\s+", "=>"],
    "typescript": ["typescript", r"\bts\b", r"\.ts\b", r"\binterface\b", r"\btype\s+", r"\benum\b", r"\bnamespace\b"],
    "java": [r"\bjava\b", r"\.java\b", "public class", r"\bprivate\s+", r"\bpublic\s+", r"\bstatic\s+"],
    "cpp": [r"c\+\+", r"\bcpp\b", r"\.cpp\b", r"\.h\b", "#include", "std::", r"\bclass\s+", r"\bnamespace\b"],
    "go": ["golang", r"\bgo\b", r"\.go\b", r"\bfunc\s+", r"\bpackage\s+", r"\bimport\s+", r"\bstruct\b"],
    "rust": [r"\brust\b", r"\brs\b", r"\.rs\b", r"\bfn\s+", r"\bpub\s+", r"\bstruct\b", r"\bimpl\b", r"\buse\s+"],
    "php": [r"\bphp\b", r"\.php\b", r"<\?php", r"\bfunction\b", r"\bclass\b", r"\$\w+"],
    "ruby": [r"\bruby\b", r"\brb\b", r"\.rb\b", r"\bdef\s+", r"\bclass\s+", r"\bmodule\b", r"\brequire\b"],
    "swift": [r"\bswift\b", r"\.swift\b", r"\bfunc\s+", r"\bclass\s+", r"\bstruct\b", r"\bvar\s+", r"\blet\s+"],
    "kotlin": [r"\bkotlin\b", r"\bkt\b", r"\.kt\b", r"\bfun\s+", r"\bclass\s+", r"\bval\s+", r"\bvar\s+"],
    "scala": [r"\bscala\b", r"\.scala\b", r"\bdef\s+", r"\bclass\s+", r"\bobject\b", r"\btrait\b"],
    "csharp": ["c#", "csharp", r"\.cs\b", "public class", r"\bprivate\s+", r"\bpublic\s+", r"\busing\s+"],
}
FILE_EXTENSIONS = "py js ts tsx jsx java cpp c h cs rb go php swift kt rs scala sh bash yaml yml json md txt".split()
_E = "|".join(FILE_EXTENSIONS)
FILENAMES = [rf"([\w-]+(?:/[\w.-]+)+\.(?:{_E}))\b", rf"\b([\w-]+/[\w.-]+\.(?:{_E}))\b", rf"\b([\w.-]+\.(?:{_E}))\b"]
BUILDING = ["how to", "implement", "create", "build", "write"]
CODE_WORDS = r"\b(async|def|class|function)\s+\w+"
TECHNICAL = ["javascript", "python", "typescript", "authentication", "configuration", "database"]
IMPLEMENTATION = ["function", "class", "method", "implementation", "definition"]
FLAGS = ("abbreviations", "concepts", "cases", "languages", "filenames", "implementation")
MAX_VARIANTS = 20


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w).replace(r"\ ", " ") for w in words))


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def languages(query: Column) -> Column:
    """The languages a query speaks of, in table order."""
    return _present(*[F.when(query.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in LANGUAGES.items()])


def filenames(query: Column) -> Column:
    """The file names and paths in a query: all of the first pattern, then of the next, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in FILENAMES]))


def _split_cases(q: Column) -> Column:
    """A variant per term that is camel case, and per one that is snake case: its first occurrence in the query, parted."""

    def put(term: Column, to: Column) -> Column:
        at = F.locate(term, q) if isinstance(term, str) else F.instr(q, term)
        return F.concat(F.substring(q, F.lit(1), at - 1), to, F.substring(q, at + F.length(term), F.length(q)))

    def of(term: Column) -> Column:
        camel = F.when(term.rlike("[a-z][A-Z]"), put(term, F.regexp_replace(term, "([a-z])([A-Z])", "$1 $2")))
        snake = F.when(term.contains("_") & ~term.startswith("_"), put(term, F.replace(term, F.lit("_"), F.lit(" "))))
        return F.array(camel, snake)

    return F.filter(F.flatten(F.transform(F.split(q, r"\s+"), of)), lambda x: x.isNotNull())


def variants(query: Column, most: int = MAX_VARIANTS, flags: tuple[str, ...] = FLAGS) -> Column:
    """All rewritten queries in order, each once, at most `most`; the first is the trimmed query. A null or blank query is alone."""
    q = trim_all(query)
    low = F.lower(q)
    parts = [F.array(q)]
    if "abbreviations" in flags:
        expanded = [F.when(low.contains(a), F.regexp_replace(q, rf"(?i)\b{a}\b", full)) for a, full in ABBREVIATIONS.items()]
        parts.append(F.filter(F.array(*expanded), lambda x: x.isNotNull() & (x != q)))
    if "concepts" in flags:
        parts.append(F.flatten(_present(*[F.when(low.contains(c), F.array(*map(F.lit, [*terms, c]))) for c, terms in CONCEPTS.items()])))
    if "cases" in flags:
        parts.append(_split_cases(q))
    if "languages" in flags:
        parts.append(F.transform(languages(q), lambda x: F.concat(q, F.lit(" "), x)))
    if "filenames" in flags:
        parts.append(F.transform(filenames(q), lambda x: F.concat(q, F.lit(" "), F.regexp_replace(x, r"\.[^.]*$", ""))))
    if "implementation" in flags:
        parts.append(
            _present(
                F.when(_any(low, BUILDING), F.concat(q, F.lit(" function class method implementation"))),
                F.when(q.rlike(CODE_WORDS), F.concat(q, F.lit(" implementation definition"))),
            )
        )
    return F.when(query.isNull() | (q == ""), F.array(query)).otherwise(F.slice(F.array_distinct(F.concat(*parts)), 1, most))


def patterns(query: Column) -> Column:
    """filename:... and language:... of the query as it was given."""
    blank = query.isNull() | (trim_all(query) == "")
    none = F.array().cast("array<string>")
    named = F.concat(F.transform(filenames(query), lambda x: F.concat(F.lit("filename:"), x)), F.transform(languages(query), lambda x: F.concat(F.lit("language:"), x)))
    return F.when(blank, none).otherwise(named)


def reasoning(query: Column, found: Column, detected: Column) -> Column:
    """What was done, in words."""
    low = F.lower(query)
    concepts = _present(*[F.when(low.contains(c), F.lit(c)) for c in CONCEPTS])
    text = F.concat_ws(
        "; ",
        F.when(F.size(found) > 1, F.concat(F.lit("Generated "), (F.size(found) - 1).cast("string"), F.lit(" query variants"))),
        F.when(F.size(detected) > 0, F.concat(F.lit("Detected patterns: "), F.array_join(detected, ", "))),
        F.when(_any(low, list(ABBREVIATIONS)), F.lit("Expanded programming abbreviations")),
        F.when(F.size(concepts) > 0, F.concat(F.lit("Mapped concepts: "), F.array_join(concepts, ", "))),
    )
    return F.when(query.isNull() | (trim_all(query) == ""), F.lit("Empty query requires no preprocessing")).when(text == "", F.lit("Basic query preprocessing applied")).otherwise(text)


def preprocess(queries: DataFrame, most: int = MAX_VARIANTS, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """queries (query_id, text) with normalized, variants, patterns, reasoning, and whether several searches are called for."""
    text = F.col("text")
    return (
        queries.select("query_id", "text")
        .withColumn("normalized", F.when(trim_all(text) == "", text).otherwise(trim_all(text)))
        .withColumn("variants", variants(text, most, flags))
        .withColumn("patterns", patterns(text))
        .withColumn("reasoning", reasoning(text, F.col("variants"), F.col("patterns")))
        .withColumn("multi", (F.size("variants") > 2) & (F.size("patterns") > 0))
    )


def _named(kind: str) -> Column:
    return F.transform(F.filter("patterns", lambda p: p.startswith(kind)), lambda p: F.substring(p, F.lit(len(kind) + 1), F.length(p)))


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _length(x: Column) -> Column:
    return F.length(x)


def best(prepared: DataFrame) -> DataFrame:
    """`best`: the one variant to search with. By file name, language, words of implementation, technical words, length; else the normalized query."""
    text, v = F.col("text"), F.col("variants")
    by_file = _first(F.filter(v, lambda x: F.exists(_named("filename:"), lambda n: x.contains(n))))
    by_language = _first(F.filter(v, lambda x: (x != text) & F.exists(_named("language:"), lambda n: F.lower(x).contains(n))))
    implementing = _first(F.filter(v, lambda x: (x != text) & _any(F.lower(x), IMPLEMENTATION)))
    technical = _first(F.filter(v, lambda x: (x != text) & _any(x, TECHNICAL)))
    longest = F.aggregate(v, F.get(v, F.lit(0)), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    chosen = F.coalesce(F.when(by_file != text, by_file), by_language, implementing, technical, F.when((F.size(v) > 1) & (longest != text), longest), F.col("normalized"))
    return prepared.withColumn("best", chosen)


def top(prepared: DataFrame, n: int = 3) -> DataFrame:
    """`top`: up to n variants. One by file name, a technical one, an implementing one, then the longest (equal ones in their order)."""
    v, text = F.col("variants"), F.col("text")
    prepared = prepared.withColumn("_1", _first(F.filter(v, lambda x: F.exists(_named("filename:"), lambda k: x.contains(k)))))
    prepared = prepared.withColumn("_2", _first(F.filter(v, lambda x: (x != text) & ~x.eqNullSafe(F.col("_1")) & _any(x, TECHNICAL))))
    prepared = prepared.withColumn("_3", _first(F.filter(v, lambda x: (x != text) & ~x.eqNullSafe(F.col("_1")) & ~x.eqNullSafe(F.col("_2")) & _any(F.lower(x), IMPLEMENTATION[:4]))))
    used = F.filter(F.array("_1", "_2", "_3"), lambda x: x.isNotNull())
    rest = F.filter(v, lambda x: (x != text) & ~F.array_contains(used, x))
    ordered = F.transform(F.array_sort(F.transform(rest, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    chosen = F.slice(F.concat(used, ordered), 1, n)
    return prepared.withColumn("top", F.when(F.size(chosen) == 0, F.array("normalized")).otherwise(chosen)).drop("_1", "_2", "_3")
