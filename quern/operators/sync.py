"""Incremental sync: snapshots of file hashes, Merkle trees, differences, and what they change in a collection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.paths import hidden


def snapshot(files: DataFrame) -> DataFrame:
    """(relative_path, hash) of files (relative_path, content)."""
    return files.select("relative_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def _glob(pattern: str) -> str:
    return re.escape(pattern).replace(r"\*", ".*").replace(r"\-", "-").replace(r"\ ", " ")


def sync_ignored(path: Column, patterns: list[str]) -> Column:
    """The sync's own rule: hidden names, then patterns in which * crosses slashes. `x/` takes directories of that name or path, a pattern with a
    slash a path or one above it, any other a name at any depth."""
    out = hidden(path)
    rules = []
    for p in patterns:
        bare = p.strip("/")
        if not bare:
            continue
        if p.endswith("/"):
            rules.append(rf"^(?:{_glob(bare)})/|(?:^|/){_glob(bare).replace('.*', '[^/]*')}/")
        elif "/" in bare:
            rules.append(rf"^(?:{_glob(bare)})(?:/|$)")
        else:
            rules.append(rf"(?:^|/){_glob(bare).replace('.*', '[^/]*')}(?:/|$)")
    return F.coalesce(out | path.rlike("|".join(rules)) if rules else out, F.lit(False))


def leaf_hash(path: Column, hash_: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), hash_), 256)


def merkle_nodes(files: DataFrame) -> DataFrame:
    """(id, data, parents, children): a root over all files and a node for each, of a snapshot (relative_path, hash).

    The root's id is a digest of the sorted node ids by ranges: each of 4096 buckets of the ids is digested, then the buckets in order; so a
    large snapshot is never gathered, and the order of the scan does not matter. Children of the root are all nodes without another parent.
    """
    leaves = files.select(leaf_hash(F.col("relative_path"), F.col("hash")).alias("id"), F.concat("relative_path", F.lit(":"), "hash").alias("data"))
    root = merkle_root(files)
    none = F.array().cast("array<string>")
    return leaves.crossJoin(F.broadcast(root)).select("id", "data", F.array("root").alias("parents"), none.alias("children")).unionByName(  # root: one row
        root.select(F.col("root").alias("id"), F.lit("root").alias("data"), none.alias("parents"), none.alias("children"))
    )


def merkle_root(files: DataFrame) -> DataFrame:
    """One row: `root` of a snapshot. Equal snapshots, and only they, have equal roots."""
    leaves = files.select(leaf_hash(F.col("relative_path"), F.col("hash")).alias("id"))
    buckets = leaves.groupBy(F.substring("id", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ""), 256).alias("h"))
    top = buckets.agg(F.array_sort(F.collect_list(F.struct("b", "h"))).alias("all"))  # 4096 buckets
    return top.select(F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform("all", lambda x: x["h"]), "")), 256).alias("root"))


NODE = "id string, data string, parents array<string>, children array<string>"


def roots(nodes: DataFrame) -> DataFrame:
    """The nodes without a parent."""
    return nodes.where(F.size("parents") == 0)


def leaves(nodes: DataFrame) -> DataFrame:
    """The nodes that have a parent and no child: the files."""
    return nodes.where((F.size("parents") > 0) & (F.size("children") == 0))


def to_lines(nodes: DataFrame) -> DataFrame:
    """Nodes as lines of JSON (value)."""
    return nodes.select(F.to_json(F.struct("id", "data", "parents", "children")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Nodes of lines (value) as to_lines writes them; a line that is none is passed over."""
    return lines.select(F.from_json("value", NODE).alias("n")).select("n.*").where("id is not null")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, change): added, modified or removed, of two snapshots (relative_path, hash)."""
    a, b = before.select("relative_path", F.col("hash").alias("old")), after.select("relative_path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "relative_path", "full_outer").select("relative_path", change.alias("change")).where("change is not null")


def compare_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, side): nodes of one tree that the other lacks."""
    return after.join(before, "id", "left_anti").select("id", F.lit("added").alias("side")).unionByName(before.join(after, "id", "left_anti").select("id", F.lit("removed").alias("side")))


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots differ, by their roots alone."""
    return merkle_root(before).first()[0] != merkle_root(after).first()[0]


def after_change(collection: DataFrame, changes: DataFrame, new_chunks: DataFrame, only: Column | None = None) -> DataFrame:
    """A collection after a difference: chunks of removed and modified files go, chunks of added and modified ones come.

    `only` restricts the change to some paths (a targeted update).
    """
    used = changes if only is None else changes.where(only)
    gone = used.where(F.col("change").isin("removed", "modified")).select("relative_path")
    come = used.where(F.col("change").isin("added", "modified")).select("relative_path")
    return collection.join(gone, "relative_path", "left_anti").unionByName(new_chunks.join(come, "relative_path", "left_semi"))


def progress(done: Column, of: Column) -> Column:
    """Percent of an indexing run: 10 after the scan, then up to 100 over the files."""
    return F.when(of == 0, F.lit(100)).otherwise(F.round(10 + 90 * done / of)).cast("int")


def progress_percent(done: int, of: int) -> int:
    """progress of two numbers."""
    return 100 if of == 0 else round(10 + 90 * done / of)


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether the roots of two snapshots are equal: then nothing needs to be compared."""
    return not changed(before, after)
