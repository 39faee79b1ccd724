"""Files cut into chunks: by declarations, by lines, by separators; with the passes that refine what comes out."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.paths import GRAMMARS, grammar_of
from quern.functions.text import trim_all

CHUNK_SIZE, WINDOW_SIZE, WINDOW_OVERLAP, CHUNK_CAP = 2500, 1000, 200, 450_000


@dataclass(frozen=True)
class Piece:
    content: str
    start_line: int
    end_line: int


def by_lines(piece: Piece, size: int = CHUNK_SIZE) -> list[Piece]:
    """Lines gathered until the next would make it longer than `size`; a single longer line stays whole. Contents are trimmed."""
    lines = piece.content.split("\n")
    out: list[Piece] = []
    held, start, count = "", piece.start_line, 0
    for i, line in enumerate(lines):
        text = line if i == len(lines) - 1 else line + "\n"
        if held and len(held) + len(text) > size:
            out.append(Piece(held.strip(), start, start + count - 1))
            held, start, count = text, piece.start_line + i, 1
        else:
            held, count = held + text, count + 1
    if held.strip():
        out.append(Piece(held.strip(), start, start + count - 1))
    return out


def by_window(content: str, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> list[Piece]:
    """Lines gathered up to `size`, each piece beginning with as many lines of the one before as the overlap is worth. Blank pieces are dropped."""
    out: list[Piece] = []
    held: list[str] = []
    cost, start = 0, 1
    for line in content.split("\n"):
        if held and cost + len(line) + 1 > size:
            text = "\n".join(held)
            out.append(Piece(text, start, start + len(held) - 1))
            keep = min(overlap * len(held) // max(1, len(text)), len(held))
            start += len(held) - keep
            held = held[len(held) - keep :]
            cost = len("\n".join(held))
        held.append(line)
        cost += len(line) + 1
    if held:
        out.append(Piece("\n".join(held), start, start + len(held) - 1))
    return [p for p in out if p.content.strip()]


#: Where a text of a language may be cut, the strongest first.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "javascript": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\n\n", "\n", " ", ""],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", "\n\n", "\n", " ", ""],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase ", "\n\n", "\n", " ", ""],
    "markdown": ["\n## ", "\n### ", "\n#### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n", "\n", " ", ""],
    "": ["\n\n", "\n", " ", ""],
}
SEPARATORS |= {"typescript": SEPARATORS["javascript"], "tsx": SEPARATORS["javascript"], "c": SEPARATORS["cpp"], "csharp": SEPARATORS["java"], "php": SEPARATORS["javascript"], "kotlin": SEPARATORS["java"], "swift": SEPARATORS["go"]}


def by_separators(text: str, language: str | None = None, size: int = 1000, overlap: int = 200) -> list[str]:
    """The text cut at the strongest separator that it has, parts joined up to `size`, longer ones cut at the next; consecutive pieces share up to `overlap`."""

    def cut(text: str, separators: list[str]) -> list[str]:
        found = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
        mark, rest = separators[found], separators[found + 1 :]
        parts = list(text) if mark == "" else [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
        out: list[str] = []
        fitting: list[str] = []
        for p in parts:
            if len(p) < size:
                fitting.append(p)
                continue
            out += joined(fitting)
            fitting = []
            out += cut(p, rest) if rest else [p]
        return out + joined(fitting)

    def joined(parts: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        total = 0
        for p in parts:
            if held and total + len(p) > size:
                out.append("".join(held))
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        return [x.strip() for x in [*out, "".join(held)] if x.strip()]

    return cut(text, SEPARATORS.get((language or "").lower(), SEPARATORS[""])) if text else []


def first_line(code: str, chunk: str) -> tuple[int, int]:
    """Where a chunk stands, by its first occurrence; of one that is not found, from line 1."""
    at = code.find(chunk)
    start = 1 if at < 0 else code.count("\n", 0, at) + 1
    return start, start + chunk.count("\n")


def line_estimate(code: Column, chunk: Column) -> Column:
    """first_line's first number, as an expression."""
    at = F.instr(code, chunk)
    return F.when(at > 0, F.size(F.split(F.substring(code, F.lit(1), at - 1), "\n"))).otherwise(F.lit(1))


# --- declarations -----------------------------------------------------------------------------------------------------

#: Lines that begin a unit, for languages whose units are closed by braces, and for those closed by `end`.
BRACED = {
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|class\b|const\b|let\b|var\b)|import\b|(?:async\s+)?[\w$]+\s*\([^;]*\)\s*\{|constructor\b",
    "java": r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+.*[({;]|(?:class|interface|enum|record)\b|package\b|import\b",
    "go": r"func\b|type\b|var\b|const\b|import\b",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|impl|struct|enum|trait|mod|use|static|const)\b",
    "csharp": r"(?:(?:public|private|protected|internal|static|sealed|abstract|async|override|partial)\s+)+.*|(?:class|interface|struct|enum)\b",
    "cpp": r"(?:class|struct|namespace|template|static|inline|std::|[\w:<>]+[\s*&]+[\w:~]+\s*\()",
    "scala": r"(?:(?:final|case|sealed|abstract|private|override)\s+)*(?:class|trait|object|def)\b",
}
BRACED["typescript"] = BRACED["javascript"] + r"|(?:export\s+)?(?:interface|type|enum|namespace)\b"
BRACED["tsx"] = BRACED["typescript"]
RUBY = r"\s*(?:class|module|def)\b"


def _braced(lines: list[str], pattern: str) -> list[tuple[int, int]]:
    """(first, last) line, from 1, of each unit: from a declaring line to where its brackets close. Strings and comments are passed over."""
    opens = re.compile(r"^\s*(?:" + pattern + ")")
    depth, stack, out = 0, [], []
    for i, line in enumerate(lines, 1):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*$|/\*.*?\*/", "", line)
        if opens.match(line) and not re.match(r"^\s*(?://|\*|/\*|#)", line):
            stack.append((depth, i))
        for c in bare:
            depth += (c in "{(") - (c in "})")
        while stack and depth <= stack[-1][0] and (stack[-1][1] < i or bare.rstrip().endswith((";", "}", ")", ",")) or not re.search(r"[{(]", bare)):
            if stack[-1][1] == i and i < len(lines) and re.match(r"^\s*\{\s*$", lines[i]):
                break  # the bracket stands on a line of its own
            out.append((stack.pop()[1], i))
    out += [(first, len(lines)) for _, first in stack]
    return sorted(out, key=lambda x: (x[0], -x[1]))


def _ended(lines: list[str]) -> list[tuple[int, int]]:
    out = []
    for i, line in enumerate(lines):
        if re.match(RUBY, line):
            indent = len(line) - len(line.lstrip())
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^\s{{{indent}}}end\b", lines[j])), i)
            out.append((i + 1, end + 1))
    return out


def _python(code: str) -> list[tuple[int, int]]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Assign)
    found = [(min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]), n.end_lineno) for n in ast.walk(tree) if isinstance(n, kinds)]
    return sorted(found, key=lambda x: (x[0], -x[1]))


def units(code: str, language: str | None) -> list[Piece]:
    """The declarations of a file in the order of their first line, nested ones too; two or more imports at the start are one piece.

    Python is parsed; other languages are scanned for declaring lines and their closing brackets, which approximates a
    grammar. A file without any, and an unknown language, is one piece.
    """
    grammar = GRAMMARS.get((language or "").lower())
    lines = code.split("\n")
    found = [] if grammar is None else _python(code) if grammar == "python" else _ended(lines) if grammar == "ruby" else _braced(lines, BRACED[grammar])
    imports: list[tuple[int, int]] = []
    at = 0
    for first, last in found:
        between = [x for x in lines[at : first - 1] if x.strip() and not re.match(r"^\s*(?://|#|/?\*)", x)]
        if grammar in ("python", "javascript", "typescript", "tsx") and re.match(r"^import\b", lines[first - 1]) and not between:
            imports.append((first, last))
            at = last
        else:
            break
    out = []
    if len(imports) > 1:
        found = found[len(imports) :]
        out.append((imports[0][0], imports[-1][1]))
    pieces = [Piece("\n".join(lines[a - 1 : b]), a, b) for a, b in [*out, *found]]
    return [p for p in pieces if p.content.strip()] or ([Piece(code, 1, len(lines))] if code.strip() else [])


def with_gaps(code: str, language: str | None) -> list[Piece]:
    """Top-level declarations and, as pieces of their own, the lines between them: together the whole file."""
    lines = code.split("\n")
    out: list[Piece] = []
    at = 1
    for p in units(code, language):
        if p.start_line < at:
            continue
        if any(x.strip() for x in lines[at - 1 : p.start_line - 1]):
            out.append(Piece("\n".join(lines[at - 1 : p.start_line - 1]), at, p.start_line - 1))
        out.append(p)
        at = p.end_line + 1
    if any(x.strip() for x in lines[at - 1 :]):
        out.append(Piece("\n".join(lines[at - 1 :]), at, len(lines)))
    return out


# --- over tables --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Splitter:
    """How a file is cut: 'ast' by declarations, then lines; 'gaps' also what lies between; 'window' and 'recursive' by size alone."""

    kind: str = "ast"
    size: int = CHUNK_SIZE
    overlap: int = 0
    languages: frozenset[str] = field(default=frozenset(GRAMMARS))

    def supports(self, language: str | None) -> bool:
        return (language or "").lower() in self.languages

    def strategy(self, language: str | None) -> str:
        return "ast" if self.kind in ("ast", "gaps") and self.supports(language) else "text"

    def split(self, code: str, language: str | None) -> list[Piece]:
        if self.kind == "window":
            return by_window(code, self.size, self.overlap)
        if self.kind == "recursive" or not self.supports(language):
            return [Piece(x, *first_line(code, x)) for x in by_separators(code, language, min(self.size, 1000), 200)]
        pieces = (with_gaps if self.kind == "gaps" else units)(code, language)
        pieces = [y for x in pieces for y in (by_lines(x, self.size) if len(x.content) > self.size else [x])]
        seen: dict[tuple[int, int], Piece] = {}
        for p in pieces:
            seen.setdefault((p.start_line, p.end_line), p)
        pieces = list(seen.values())
        if self.overlap > 0:
            before = [None, *pieces[:-1]]
            pieces = [
                p if b is None else Piece(b.content[-self.overlap :] + "\n" + p.content, max(1, p.start_line - b.content[-self.overlap :].count("\n") - 1), p.end_line)
                for p, b in zip(pieces, before, strict=True)
            ]
        return pieces


CHUNK = "relative_path string, language string, chunk_index int, content string, start_line int, end_line int"


def split_files(files: DataFrame, splitter: Splitter = Splitter()) -> DataFrame:  # noqa: B008
    """files (relative_path, language, content) as chunks; null contents have none. A narrow pass in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [
                (path, language, i, x.content, x.start_line, x.end_line)
                for path, language, code in zip(p.relative_path, p.language, p.content, strict=True)
                if code
                for i, x in enumerate(splitter.split(code, language))
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return files.select("relative_path", "language", "content").mapInPandas(run, CHUNK)


def split_pieces(rows: DataFrame, key: str, size: int, how: str = "lines", overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """rows (key, content, start_line) cut by lines or by window: (key, piece, content, start_line, end_line)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, text, start in zip(p[key], p.content, p.start_line, strict=True):
                base = int(start) if pd.notna(start) else 1
                for i, x in enumerate(by_lines(Piece(text, base, base), size) if how == "lines" else by_window(text, size, overlap)):
                    out.append((k, i, x.content, x.start_line, x.end_line))
            yield pd.DataFrame(out, columns=[key, "piece", "content", "start_line", "end_line"])

    return rows.where("content is not null").select(key, "content", "start_line").mapInPandas(run, f"`{key}` {kind}, piece int, content string, start_line long, end_line long")


def dedupe_ranges(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """The first chunk of each (relative_path, start_line, end_line)."""
    w = W.partitionBy("relative_path", "start_line", "end_line").orderBy(order)
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def add_overlap(chunks: DataFrame, overlap: int, order: str = "seq") -> DataFrame:
    """Each chunk with the last characters of the one before in its file put in front, and its first line moved up. 0 changes nothing."""
    if overlap <= 0:
        return chunks
    tail = F.lag(F.expr(f"right(content, {overlap})")).over(W.partitionBy("relative_path").orderBy(order))
    lines = F.size(F.split("_tail", "\n"))
    return (
        chunks.withColumn("_tail", tail)
        .withColumn("start_line", F.when(F.col("_tail").isNull(), F.col("start_line")).otherwise(F.greatest(F.lit(1), F.col("start_line") - lines)))
        .withColumn("content", F.when(F.col("_tail").isNull(), F.col("content")).otherwise(F.concat("_tail", F.lit("\n"), "content")))
        .drop("_tail")
    )


def long_enough(content: Column, least: int = 10) -> Column:
    return F.length(trim_all(content)) > least


def capped(chunks: DataFrame, cap: int = CHUNK_CAP) -> tuple[DataFrame, str]:
    """At most `cap` chunks in order of path and place, and 'limit_reached' if there were more, else 'completed'."""
    first = chunks.orderBy("relative_path", "chunk_index").limit(cap)
    more = chunks.limit(cap + 1).count() > cap
    return (first if more else chunks), ("limit_reached" if more else "completed")


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    text = F.concat_ws(":", path, start.cast("string"), end.cast("string"), content)
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(text, 256), 1, 16))


def collection_name(path: Column, hybrid: bool = True) -> Column:
    return F.concat(F.lit("hybrid_code_chunks_" if hybrid else "code_chunks_"), F.substring(F.md5(path), 1, 8))


def rows_to_store(chunks: DataFrame, codebase: str) -> DataFrame:
    """Chunks as rows of a collection, without their vectors."""
    path = F.col("relative_path")
    meta = F.struct(F.lit(codebase).alias("codebasePath"), F.coalesce("language", F.lit("unknown")).alias("language"), F.col("chunk_index").alias("chunkIndex"))
    return chunks.select(
        chunk_id(path, F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"),
        "content",
        "relative_path",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        F.regexp_extract(path, r"[^/](\.[^./]*)$", 1).alias("file_extension"),
        F.to_json(meta).alias("metadata"),
    )


__all__ = ["Splitter", "grammar_of", "split_files"]
