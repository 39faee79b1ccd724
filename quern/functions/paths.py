"""Paths: extensions, languages, ignore patterns, weights of test files; fixed values and the expressions over them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = ".ts .tsx .js .jsx .py .java .cpp .c .h .hpp .cs .go .rs .php .rb .swift .kt .scala .m .mm .md .markdown .ipynb".split()
IGNORE = """
node_modules/** dist/** build/** out/** target/** coverage/** .nyc_output/** .vscode/** .idea/** *.swp *.swo .git/** .svn/** .hg/**
.cache/** __pycache__/** .pytest_cache/** logs/** tmp/** temp/** *.log .env .env.* *.local
*.min.js *.min.css *.min.map *.bundle.js *.bundle.css *.chunk.js *.vendor.js *.polyfills.js *.runtime.js *.map
node_modules .git .svn .hg build dist out target .vscode .idea __pycache__ .pytest_cache coverage .nyc_output logs tmp temp
""".split()
LANGUAGE_OF = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".m": "objective-c", ".mm": "objective-c", ".ipynb": "jupyter",
}
REMOTE = r"\.(ts|tsx|js|jsx|py|java|cpp|c|h|hpp|cs|go|rs|php|rb|swift|kt|scala|m|mm|md)$"
GRAMMARS = {
    "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "tsx": "tsx", "python": "python",
    "py": "python", "java": "java", "cpp": "cpp", "c++": "cpp", "c": "cpp", "go": "go", "rust": "rust", "rs": "rust", "cs": "csharp",
    "csharp": "csharp", "ruby": "ruby", "rb": "ruby", "scala": "scala",
}
TESTS = {
    ".py": [r"/test_", r"_test\.py$", "/tests/", r"/conftest\.py$"],
    ".js": [r"\.test\.js$", r"\.spec\.js$", "/__tests__/", "/test/"],
    ".ts": [r"\.test\.ts$", r"\.spec\.ts$", "/__tests__/", "/test/"],
    ".tsx": [r"\.test\.tsx$", r"\.spec\.tsx$", "/__tests__/", "/test/"],
    ".java": [r"Test\.java$", r"Tests\.java$", "/src/test/"],
    ".go": [r"_test\.go$"],
    ".rb": [r"_spec\.rb$", r"_test\.rb$", "/spec/", "/test/"],
    ".cs": [r"Test\.cs$", r"Tests\.cs$", r"\.Tests\."],
    ".rs": [r"_test\.rs$", "/tests/"],
    ".php": [r"Test\.php$", "/tests/"],
}
MOCKS = "(?i)/mock|/mocks|/stubs|/fixtures|mock-utils"
TEST_WEIGHT = 0.8


def extension(path: Column) -> Column:
    """From the last dot of the name on; '' for names without a dot or with only a leading one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def language_of(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]), ext), F.lit("text"))


def grammar_of(language: Column) -> Column:
    """The grammar a language name is split with; 'fallback' for others and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GRAMMARS.items() for x in kv]), F.lower(language)), F.lit("fallback"))


def file_weight(path: Column, ext: Column) -> Column:
    """0.8 for files of tests and mocks, else 1. A leading slash is asked for: test_x.py at the root is no test."""
    test = F.lit(False)
    for e, ps in TESTS.items():
        test = test | ((ext == e) & path.rlike("|".join(ps)))
    return F.when(F.coalesce(test | path.rlike(MOCKS), F.lit(False)), F.lit(TEST_WEIGHT)).otherwise(F.lit(1.0))


def sql_file_weight(path: str, ext: str) -> str:
    tests = " OR ".join(f"({ext} = '{e}' AND regexp_matches({path}, '{'|'.join(ps)}'))" for e, ps in TESTS.items())
    return f"CASE WHEN coalesce({tests} OR regexp_matches({path}, '{MOCKS}'), FALSE) THEN 0.8 ELSE 1.0 END"


def with_extensions(base: list[str], more: str | list[str]) -> list[str]:
    """Supported extensions with further ones (also as comma-separated text): a dot is put before, each counts once, in order."""
    given = more.split(",") if isinstance(more, str) else more
    return list(dict.fromkeys([*base, *[e if e.startswith(".") else f".{e}" for e in map(str.strip, given) if e]]))


def ignore_patterns(base: list[str], *more: str | list[str]) -> list[str]:
    """Patterns merged in order, each once; texts are lines of an ignore file: trimmed, blank ones and comments dropped."""
    out = list(base)
    for m in more:
        lines = m.splitlines() if isinstance(m, str) else m
        out += [x for x in map(str.strip, lines) if x and not x.startswith("#")]
    return list(dict.fromkeys(out))


def checked_extensions(given: list[str]) -> list[str]:
    """An extension filter, trimmed and without empty entries. Raises ValueError for one that is no extension."""
    out = [e.strip() for e in given if e and e.strip()]
    if bad := [e for e in out if not re.fullmatch(r"\.\S+", e)]:
        raise ValueError(f"Invalid file extensions: {', '.join(bad)}")
    return out


def glob_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression over a whole relative path, negated) of a gitignore pattern.

    * and ? stay within a name, ** crosses names; a slash inside or in front binds the pattern to the root, else it holds
    at any depth; a trailing slash asks for a directory. What matches a directory matches all below it.
    """
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    p = re.sub(r"^\\([!#])", r"\1", p)
    directory = p.endswith("/")
    p = p.rstrip("/")
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 1)) > 0:
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + (re.escape(p[i]) if p[i] not in "-_/" else p[i]), i + 1
    start = "^" if rooted else "^(?:.*/)?"
    return f"{start}{out}{'/.+' if directory else '(?:/.*)?'}$", negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a gitignore list takes the path out; the last pattern that matches decides."""
    out = F.lit(False)
    run: list[str] = []
    kind = False

    def close(out: Column) -> Column:
        return F.when(path.rlike("|".join(f"(?:{r})" for r in run)), F.lit(not kind)).otherwise(out) if run else out

    for p in patterns:
        regex, negated = glob_regex(p)
        if negated != kind:
            out, run, kind = close(out), [], negated
        run.append(regex)
    return F.coalesce(close(out), F.lit(False))


def first_pattern(path: Column, patterns: list[str]) -> Column:
    """The first pattern that alone matches; 'unknown-pattern' where none does."""
    hits = [F.when(path.rlike(glob_regex(p)[0]), F.lit(p)) for p in patterns if not p.startswith("!")]
    return F.coalesce(*hits, F.lit("unknown-pattern"))


def hidden(path: Column) -> Column:
    """Whether any name of the path begins with a dot."""
    return path.rlike(r"(^|/)\.")
