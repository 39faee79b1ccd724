"""How good a retrieval is, and what it costs: set metrics, run aggregates, patches and transcripts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bare(paths: Column) -> Column:
    """Paths, each once, without one leading slash."""
    return F.array_distinct(F.transform(paths, lambda p: F.regexp_replace(p, "^/", "")))


def with_metrics(runs: DataFrame) -> DataFrame:
    """runs with hits and oracles (arrays of paths) and precision, recall and f1; zeros where a side is empty."""
    hits, oracles = bare(F.coalesce("hits", F.array())), bare(F.coalesce("oracles", F.array()))
    common = F.size(F.array_intersect(hits, oracles))
    p, r = F.coalesce(F.try_divide(common, F.size(hits)), F.lit(0.0)), F.coalesce(F.try_divide(common, F.size(oracles)), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return runs.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})


def run_aggregates(runs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean and population deviation of each measure, and the number of distinct instances."""
    cells = [x for m in measures for x in (F.round(F.avg(m), 6).alias(f"avg_{m}"), F.round(F.stddev_pop(m), 6).alias(f"std_{m}"))]
    return runs.groupBy(*by).agg(*cells, F.count("*").alias("runs"), F.count_distinct("instance_id").alias("instances"))


def change_percent(new: Column, old: Column) -> Column:
    return F.coalesce(F.try_divide(new - old, old) * 100, F.lit(0.0))


def patched_files(patch: Column) -> Column:
    """The files that a patch changes, by their old names, each once."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"--- a/(.+)"), F.lit(1)))


def patch_file_count(patch: Column) -> Column:
    return F.size(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(.*?) b/(.*?)$"), F.lit(1)))


def is_test(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "[ _/.]"), F.array(F.lit("test"), F.lit("tests"), F.lit("testing")))


def first_lines(text: Column, most: int = 30) -> Column:
    lines = F.split(text, "\n")
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... "), (F.size(lines) - most).cast("string"), F.lit(" more lines"))
    return F.when(F.size(lines) > most, cut).otherwise(text)


#: What a transcript says of an edit that was made, and of one that is asked for.
EDITED = (r"Successfully modified file:\s*(.+?)(?:\s|$)", r"(?i)edit.*?file_path[\"']?\s*:\s*[\"']([^\"']+)[\"']")


def relative_to(path: Column, codebase: str) -> Column:
    """A path below the codebase as relative to it; any other as it is."""
    base = codebase.rstrip("/")
    return F.when(path == base, F.lit(".")).when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30)).otherwise(path)


def edited_paths(transcripts: DataFrame, codebase: str = "/") -> DataFrame:
    """(doc_id, path, place): paths that a text (doc_id, text) says were edited, each once, numbered from 1 as they come; relative to the codebase.

    A line may say so in either way, or in both.
    """
    lines = transcripts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    told = F.array(*[F.nullif(F.trim(F.regexp_extract(F.trim("line"), p, 1)), F.lit("")) for p in EDITED])
    found = lines.select("doc_id", "line_no", F.posexplode(told).alias("way", "path")).where("path is not null")
    found = found.withColumn("path", relative_to(F.col("path"), codebase)).groupBy("doc_id", "path").agg(F.min(F.struct("line_no", "way")).alias("at"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).drop("at")


def subset(instances: DataFrame, difficulty: str, files: int) -> DataFrame:
    """Instances (difficulty, patch, ...) of this difficulty whose patch changes so many files."""
    return instances.where((F.col("difficulty") == difficulty) & (F.coalesce(patch_file_count(F.col("patch")), F.lit(0)) == files))


def subset_share(instances: DataFrame, difficulty: str, files: int) -> DataFrame:
    """One row (total, chosen, percent) of what subset leaves."""
    chosen = (F.col("difficulty") == difficulty) & (F.coalesce(patch_file_count(F.col("patch")), F.lit(0)) == files)
    sums = instances.agg(F.count("*").alias("total"), F.count(F.when(chosen, 1)).alias("chosen"))
    return sums.withColumn("percent", F.round(100 * F.coalesce(F.try_divide("chosen", "total"), F.lit(0.0)), 1))


def token_totals(messages: DataFrame) -> DataFrame:
    """(instance_id, input_tokens, output_tokens, total_tokens, max_single_turn_tokens) of messages (instance_id, input_tokens, output_tokens,
    total_tokens). A message that does not tell its total counts what went in and out; so does an instance whose totals are 0."""
    given, made = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    turn = F.coalesce(F.col("total_tokens"), given + made)
    sums = messages.groupBy("instance_id").agg(F.sum(given).alias("input_tokens"), F.sum(made).alias("output_tokens"), F.sum(turn).alias("t"), F.greatest(F.max(turn), F.lit(0)).alias("max_single_turn_tokens"))
    total = F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    return sums.select("instance_id", "input_tokens", "output_tokens", total.alias("total_tokens"), "max_single_turn_tokens")


def tool_stats(calls: DataFrame) -> DataFrame:
    """(instance_id, tool_call_counts, total_tool_calls) of calls (instance_id, tool); a call that names no tool is of tool 'unknown'.

    Calls are counted by tool before those of an instance come together.
    """
    each = calls.groupBy("instance_id", F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("n"))
    return each.groupBy("instance_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("tool_call_counts"), F.sum("n").alias("total_tool_calls"))


#: How a log writes the arguments of an edit.
ARGUMENTS = re.compile(r"^.*Arguments:.*$", re.M)
FIELDS = (re.compile(r"'file_path':\s*'([^']*)'"), re.compile(r"'old_string':\s*[\"'](.*?)[\"'](?=,\s*'new_string')", re.S), re.compile(r"'new_string':\s*[\"'](.*?)[\"'](?=\s*})", re.S))


def edits_of(log: str) -> Iterator[tuple[str, str, str]]:
    """(file, old, new) of each edit in a log: the arguments run from their line to the next one that closes a bracket."""
    for m in ARGUMENTS.finditer(log):
        if "'file_path'" not in m[0]:
            continue
        close = log.find("}", m.start())
        end = log.find("\n", close) if close >= 0 else -1
        found = [f.search(log, m.start(), end if end >= 0 else len(log)) for f in FIELDS]
        if all(found):
            path, *texts = (x[1] for x in found)
            yield path, *(t.replace("\\n", "\n").replace("\\'", "'") for t in texts)


def edit_calls(logs: DataFrame) -> DataFrame:
    """(doc_id, call_no, file_path, old, new) of the edits in logs (doc_id, text), numbered from 1; a null text has none."""
    kind = logs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, n, *x) for i, t in zip(p.doc_id, p.text, strict=True) if t for n, x in enumerate(edits_of(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "call_no", "file_path", "old", "new"])

    return logs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, call_no int, file_path string, old string, new string")


def edit_diffs(calls: DataFrame, files: DataFrame) -> DataFrame:
    """calls (file_path, old, new, ...) with `line`, on which the edit begins in files (relative_path, content), and `diff`, headed by it where it is known."""
    found = calls.join(files.select(F.col("relative_path").alias("file_path"), F.col("content").alias("_content")), "file_path", "left")
    at = F.when(F.col("old") != "", F.nullif(F.instr("_content", F.col("old")), F.lit(0)))
    line = F.size(F.split(F.substring("_content", F.lit(1), at - 1), "\n"))
    placed = found.withColumn("line", F.when(at.isNotNull(), line)).drop("_content").withColumn("name", F.col("file_path"))
    head = F.when(F.col("line").isNotNull(), F.concat(F.lit("# Edit starting at line "), F.col("line").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    return unified_diffs(placed).withColumn("diff", F.concat(head, "diff")).drop("name")


def unified_diff(old: str, new: str, name: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{name}", f"b/{name}"))


def edit_line(content: str, old: str) -> int | None:
    """The line, from 1, on which an edited passage begins; None if it is not there."""
    at = content.find(old) if old else -1
    return None if at < 0 else content.count("\n", 0, at) + 1


def unified_diffs(edits: DataFrame) -> DataFrame:
    """edits (id, name, old, new) with `diff`."""
    @F.pandas_udf("string")
    def make(old: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(o or "", n or "", p or "") for o, n, p in zip(old, new, name, strict=True)], dtype=object)

    return edits.withColumn("diff", make("old", "new", "name"))
