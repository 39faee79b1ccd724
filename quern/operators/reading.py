"""Plain reading of a corpus: line search, slices, directories, and formatted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.staging import staged


def grep(files: DataFrame, pattern: str, key: str = "relative_path", include: str | None = None) -> DataFrame:
    """(key, line_number from 1, line_content, match) of every line that matches, each line by itself (so ^ and $ are its ends);
    `include` is a regular expression over the key."""
    used = files if include is None else files.where(F.col(key).rlike(include))
    lines = used.select(key, F.posexplode(F.split("content", "\n")).alias("n", "line_content"))
    return lines.where(F.col("line_content").rlike(pattern)).select(key, (F.col("n") + 1).alias("line_number"), "line_content", F.regexp_extract("line_content", f"({pattern})", 1).alias("match"))


def read_slice(content: Column, offset: int | None, limit: int | None) -> Column:
    """Lines from `offset` (from 0) on, `limit` of them, with a notice if there are more; the whole text unless both are given."""
    if offset is None or limit is None:
        return content
    lines = F.split(content, "\n")
    text = F.array_join(F.slice(lines, offset + 1, limit), "\n")
    note = F.concat(F.lit(f"[File content truncated: showing lines {offset + 1}-"), F.least(F.lit(offset + limit), F.size(lines)).cast("string"), F.lit(" of "), F.size(lines).cast("string"), F.lit(" total lines]\n"))
    return F.when(F.size(lines) > offset + limit, F.concat(note, text)).otherwise(text)


def list_directory(files: DataFrame, directory: str = "") -> DataFrame:
    """(name, kind): entries of a directory; those with further paths below are directories. Directories first, then by name without case."""
    base = directory.strip("/")
    rest = F.col("relative_path") if not base else F.substring("relative_path", len(base) + 2, 1 << 30)
    inside = files if not base else files.where(F.col("relative_path").startswith(base + "/"))
    kind = F.when(F.instr(rest, "/") > 0, "directory").otherwise("file")
    return inside.select(F.regexp_extract(rest, "^[^/]+", 0).alias("name"), kind.alias("kind")).distinct().orderBy("kind", F.lower("name"), "name")


def directory_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(path, level, files): each directory down to a depth, and how many files lie below it. Hidden ones are left out."""
    parts = F.split("relative_path", "/")
    levels = F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))
    prefixes = F.when(F.size(parts) > 1, F.transform(levels, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("level"))))
    return (
        files.where(~F.col("relative_path").rlike(r"(^|/)\."))
        .select("relative_path").distinct()
        .select(F.explode(prefixes).alias("p"))
        .groupBy("p.path", "p.level").agg(F.count("*").alias("files"))
    )


#: Names that a tree does not show, and hidden ones that it does.
SKIPPED = ["node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", "env"]
SHOWN = [".env", ".gitignore", ".gitattributes"]


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(path, line) of directories and files down to a depth, as a reader sees them, in order: each with its branch before its name.

    The last entry of a directory has the closing branch; entries that are not shown count in that, as they do in the directory. What lies below
    one that is not shown is not shown either.
    """
    parts = F.split("relative_path", "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts))),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.element_at(parts, i.cast("int")).alias("name"), i.alias("level"), (i < F.size(parts)).alias("is_directory")),
    )
    entries = files.where("relative_path is not null and relative_path <> ''").select(F.explode(steps).alias("e")).select("e.*")
    entries = entries.groupBy("path", "parent", "name", "level").agg(F.max("is_directory").alias("is_directory"))
    last = entries.groupBy("parent").agg(F.max("name").alias("last"))
    shown = ~F.col("name").isin(*SKIPPED) & (~F.col("name").startswith(".") | F.col("name").isin(*SHOWN))
    entries = staged(entries.join(last, "parent").where(shown).withColumn("is_last", F.col("name") == F.col("last")))
    found = entries.where("level = 1").withColumn("before", F.lit(""))
    above = found
    for level in range(2, depth + 1):
        inside = above.where("is_directory").select(F.col("path").alias("parent"), F.concat("before", F.when(F.col("is_last"), "    ").otherwise("│   ")).alias("before"))
        above = entries.where(F.col("level") == level).join(inside, "parent").select(*entries.columns, "before")
        found = found.unionByName(above)
    line = F.concat("before", F.when(F.col("is_last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_directory"), "/").otherwise(""))
    return found.select("path", line.alias("line")).orderBy(F.split("path", "/"))


def formatted(results: DataFrame, most: int = 5000) -> DataFrame:
    """results (query_id, rank, content, relative_path, start_line, end_line, language, codebase) with `text` as a reader sees it."""
    body = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    place = F.concat("relative_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    head = F.concat(F.col("rank").cast("string"), F.lit(". Code snippet ("), "language", F.lit(") ["), "codebase", F.lit("]\n   Location: "), place, F.lit("\n   Rank: "), F.col("rank").cast("string"))
    return results.withColumn("text", F.concat(head, F.lit("\n   Context: \n```"), "language", F.lit("\n"), body, F.lit("\n```\n")))


def preview(content: Column, most: int = 150) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
