"""Files of a folder as a table, and which of them are indexed and why the others are not."""

from __future__ import annotations

import base64
import json
import os
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.paths import EXTENSIONS, IGNORE, REMOTE, extension, first_pattern, ignore_patterns, ignored, language_of


def read_folder(spark: SparkSession, folder: str, extensions: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(relative_path, content) of all files below a folder but hidden ones; bytes that are no UTF-8 become replacement signs.

    With rules only files that are indexed are read: names are listed without their contents, and of a folder that Python can open (a
    local or mounted one) the contents of what is left are read where the names lie. Of other file systems contents are read with the names.
    """
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    relative = F.substring(plain, len("/" + base.split(":", 1)[-1].lstrip("/")) + 2, 1 << 30)
    ruled = extensions is not None or patterns is not None
    kept = (lambda df: code_files(df, extensions or EXTENSIONS, patterns if patterns is not None else IGNORE)) if ruled else (lambda df: df)
    if ruled and (":" not in base.split("/", 1)[0] or base.startswith("file:")):
        names = kept(files.select(relative.alias("relative_path"), "path")).select("relative_path", "path")

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for name, path in zip(p.relative_path, p.path, strict=True):
                    with open("/" + path.split(":", 1)[-1].lstrip("/"), "rb") as f:
                        yield pd.DataFrame({"relative_path": [name], "content": [f.read().decode("utf-8", "replace")]})

        return names.mapInPandas(read, "relative_path string, content string")
    return kept(files.select(relative.alias("relative_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))).select("relative_path", "content")


def read_ignore_files(spark: SparkSession, folder: str) -> list[str]:
    """The patterns of all files .*ignore at a folder's top: a few lines of configuration, read on the driver (Spark's readers pass hidden files over)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.*ignore")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: list[str] = []
    for status in sorted(fs.globStatus(p) or [], key=lambda s: s.getPath().getName()):
        stream = fs.open(status.getPath())
        try:
            out += ignore_patterns([], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    return list(dict.fromkeys(out))


def classified(files: DataFrame, extensions: list[str] = EXTENSIONS, patterns: list[str] = IGNORE) -> DataFrame:
    """files (relative_path, ...) with `reason` (ignored, unsupported, included) and, of ignored ones, the first `pattern` that takes them out."""
    path = F.col("relative_path")
    reason = F.when(ignored(path, patterns), "ignored").when(~extension(path).isin(*extensions), "unsupported").otherwise("included")
    return files.withColumn("reason", reason).withColumn("pattern", F.when(F.col("reason") == "ignored", first_pattern(path, patterns)))


def code_files(files: DataFrame, extensions: list[str] = EXTENSIONS, patterns: list[str] = IGNORE) -> DataFrame:
    """The files that are indexed, with their language."""
    path = F.col("relative_path")
    return files.where(~ignored(path, patterns) & extension(path).isin(*extensions)).withColumn("language", language_of(extension(path)))


def scan_counters(files: DataFrame, **how) -> DataFrame:
    return classified(files, **how).groupBy("reason", "pattern").agg(F.count("*").alias("files"))


def remote_files(tree: DataFrame) -> DataFrame:
    """Entries (path, type) of a remote tree that are fetched."""
    return tree.where((F.col("type") == "blob") & F.col("path").rlike(REMOTE))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances of an evaluation: a JSON file that holds them under `instances`, or lines of JSON, one each."""
    lines = spark.read.json(path)
    if "_corrupt_record" not in lines.columns and "instances" not in lines.columns:
        return lines
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("instances").alias("i")).select("i.*") if "instances" in whole.columns else whole


def done_instances(spark: SparkSession, folder: str, result: str = "result.json") -> DataFrame:
    """(instance_id) of those that have a result: the names of the folders in which it lies. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", result).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("instance_id")).distinct()


def not_done(instances: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Instances that are still to be run; with a limit, `most` in all, those done counted."""
    left = instances.join(done.select("instance_id").distinct(), "instance_id", "left_anti")
    return left if most is None else left.orderBy("instance_id").limit(max(0, most - done.select("instance_id").distinct().count()))


def env_value(name: str, file: str | None = None) -> str | None:
    """A setting of the process, else of a file of NAME=value lines."""
    if os.environ.get(name):
        return os.environ[name]
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            return next((x.split("=", 1)[1].strip() for x in f if x.startswith(f"{name}=")), None)
    return None


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _get(self, path: str) -> dict:
        import urllib.request

        request = urllib.request.Request(self.options["api"].rstrip("/") + path)
        if token := self.options.get("token"):
            request.add_header("Authorization", f"Bearer {token}")
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)

    def partitions(self) -> list[InputPartition]:
        import re

        repo = self.options["repo"]
        branch = self._get(f"/repos/{repo}").get("default_branch", "main")
        tree = self._get(f"/repos/{repo}/git/trees/{branch}?recursive=1")["tree"]
        paths = [x["path"] for x in tree if x["type"] == "blob" and re.search(REMOTE, x["path"])]
        return [_Slice(paths[i : i + 200]) for i in range(0, len(paths), 200)] or [_Slice([])]

    def read(self, partition: _Slice):
        for p in partition.paths:
            body = self._get(f"/repos/{self.options['repo']}/contents/{urllib.parse.quote(p)}")
            yield p, base64.b64decode(body["content"]).decode("utf-8", "replace")


class RemoteTree(DataSource):
    """spark.read.format('remote_tree'): files of a hosted repository, over its HTTP interface (options api, repo, token)."""

    @classmethod
    def name(cls) -> str:
        return "remote_tree"

    def schema(self) -> str:
        return "relative_path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))
