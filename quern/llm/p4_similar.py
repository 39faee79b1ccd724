"""Problem 4: the most similar vectors of every vector, by cross-polytope hashing with several probes and exact reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.staging import once, staged

DIM = 64


# --- hashing -----------------------------------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d).astype(np.float32)


def rotated(x: np.ndarray, table: int, digit: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform. Rows are filled up to a power of two."""
    if more := (1 << (x.shape[1] - 1).bit_length()) - x.shape[1]:
        x = np.pad(x, ((0, 0), (0, more)))
    rng = np.random.default_rng([71, table, digit])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), x.shape[1]))
    return x


def axes(x: np.ndarray, table: int, digit: int) -> np.ndarray:
    """How well each of the 2d signed axes fits each rotated row: axis a < d is +e_a, a >= d is -e_(a-d)."""
    y = rotated(x, table, digit)
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, table: int, digits: int, probes: int) -> np.ndarray:
    """The `probes` best buckets of each row, the own one first: the signed axes of `digits` rotations, written as one number.

    A probe takes lesser axes; those whose fit falls short of the best by least come first.
    """
    scores = [axes(x, table, j) for j in range(digits)]
    if probes == 1:
        out = np.zeros((len(x), 1), np.int64)
        for s in scores:
            out = out * s.shape[1] + np.argmax(s, axis=1)[:, None]
        return out
    loss, code = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
    for s in scores:
        m = min(probes, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        fit = np.take_along_axis(s, top, 1)
        gap = (fit.max(axis=1, keepdims=True) - fit) ** 2
        loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * s.shape[1] + top[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(loss, keep, 1), np.take_along_axis(code, keep, 1)
    return code


def digits_for(n: int, aim: int, dim: int = DIM) -> int:
    """Rotations per table so that a bucket of evenly spread vectors holds about `aim`."""
    d = 1
    while n / (2 * dim) ** d > aim:
        d += 1
    return d


# --- vectors, classes of equal ones, and their short codes -----------------------------------------------------------


def unit_classes(vectors: DataFrame, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(classes, members): each distinct direction once as (rep, unit), and (id, rep) for every id with a usable vector.

    Vectors that are null, all zero, not finite or not of `dim` values are left out. An id that comes twice counts once;
    of vectors that disagree the one whose bytes sort first holds. Copies, also scaled ones (equal to 2^-20 in
    each coordinate), form a class named by its smallest id; they are found by grouping, before any bucket is built, so that
    however many there are they are one row in the index. Only vectors whose id or direction comes again are shuffled.
    """

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ok = [i for i, v in enumerate(p.vector) if v is not None and len(v) == dim]
            if not ok:
                continue
            x = np.stack([np.asarray(p.vector.iloc[i], np.float64) for i in ok])
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good][:, None]
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            key = np.round(x * (1 << 20)).astype(np.int32)
            yield pd.DataFrame({"id": p.id.iloc[ok].to_numpy()[good], "unit": [r.tobytes() for r in x], "key": [r.tobytes() for r in key]})

    units = staged(
        vectors.where("id is not null and vector is not null")
        .select("id", F.col("vector").cast("array<double>"))
        .mapInPandas(clean, "id string, unit binary, key binary")
        .select("id", "unit", F.concat(F.hex(F.xxhash64("key")), F.substring(F.md5("key"), 1, 16)).alias("k"))
    )
    units = once(units, "id", lambda rest: F.min(F.struct(*rest)))
    classes = staged(once(units.select("k", "id", "unit"), "k", lambda rest: F.min(F.struct(*rest))).withColumnRenamed("id", "rep"))
    members = units.select("id", "k").join(classes.select("k", "rep"), "k").select("id", "rep")
    return classes.select("rep", "unit"), members


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as 8-bit codes, a scale each, and the length of what the code misses."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.round(x / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(x - code * scale[:, None], axis=1)


class Rows(NamedTuple):
    """Rows of one group: decoded codes, the length of what each misses, numbers, and what else a group's rows bring."""

    x: np.ndarray
    miss: np.ndarray
    no: np.ndarray
    more: np.ndarray


def decoded(p: pd.DataFrame, more: str | None) -> Rows:
    x = np.frombuffer(b"".join(p.code), np.int8).reshape(len(p), -1).astype(np.float32)
    return Rows(x * p.scale.to_numpy(np.float32)[:, None], p.miss.to_numpy(np.float32), p.no.to_numpy(np.int64), p[more].to_numpy() if more else np.zeros(len(p)))


ENTRY = "g long, stored boolean, no long, code binary, scale float, miss float"


def numbered(classes: DataFrame) -> DataFrame:
    return classes.select(F.xxhash64("rep").alias("no"), "rep", "unit")


def entries(classes: DataFrame, tables: int, digits: int, probes: int, dim: int = DIM) -> DataFrame:
    """One row per vector, table and bucket in which it asks; in its own one (stored) it is also what is asked for. g: table and bucket.

    Only short codes and numbers (a hash of the name) travel; exact vectors and names are fetched for the candidates that remain.
    Classes whose names hash alike are both fetched and both measured, so that none is lost.
    """

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), 2000):
                q = p.iloc[lo : lo + 2000]
                x = np.frombuffer(b"".join(q.unit), np.float32).reshape(len(q), dim)
                code, scale, miss = coded(x)
                codes = np.array([c.tobytes() for c in code], object)
                for t in range(tables):
                    b = buckets(x, t, digits, probes)
                    for k in range(probes):
                        yield pd.DataFrame({"g": (t << PLACE) | (b[:, k] << PART), "stored": k == 0, "no": q.no.to_numpy(), "code": codes, "scale": scale, "miss": miss})

    return numbered(classes).mapInPandas(spread, ENTRY)


#: Bits of g: the part of a bucket, and below the table the bucket (of at most five rotations of 128 axes).
PART, PLACE = 20, 56


def full_buckets(classes: DataFrame, tables: int, digits: int, block: int, dim: int = DIM) -> DataFrame:
    """(g, parts) of the buckets that hold more than `block` vectors. Counted by batch before the shuffle."""
    return bucket_sizes(classes, tables, digits, dim).where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("parts"))


def bucket_sizes(classes: DataFrame, tables: int, digits: int, dim: int = DIM) -> DataFrame:
    """(g, n): how many vectors lie in each bucket. Counted by batch before the shuffle."""

    def sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.frombuffer(b"".join(p.unit), np.float32).reshape(len(p), dim)
                for t in range(tables):
                    b, n = np.unique(buckets(x, t, digits, 1), return_counts=True)
                    yield pd.DataFrame({"g": (t << PLACE) | (b << PART), "n": n})

    return classes.select("unit").mapInPandas(sizes, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


#: Full buckets up to this number (16 bytes each) are sent to all tasks; more of them are joined by shuffle.
BROADCAST_BUCKETS = 100_000


def blocked(classes: DataFrame, tables: int, digits: int, probes: int, block: int, dim: int = DIM) -> DataFrame:
    """Entries such that every asking row meets every stored row of its bucket in exactly one group g (table, bucket, part), and
    no group holds more than about `block` stored rows.

    A bucket's stored rows are spread over as many parts as its size asks for; its asking rows go to each. Nothing
    is dropped from a full bucket.
    """
    rows = entries(classes, tables, digits, probes, dim)
    full = staged(full_buckets(classes, tables, digits, block, dim))
    if not (n := full.count()):
        return rows
    if n <= BROADCAST_BUCKETS:
        full = F.broadcast(full)
    own = F.coalesce("parts", F.lit(1))
    return (
        rows.join(full, "g", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), own - 1)))
        .withColumn("stored", F.col("stored") & (F.col("part") == F.pmod("no", own)))
        .withColumn("g", F.col("g") + F.col("part"))
        .select(*[c.split()[0] for c in ENTRY.split(", ")])
    )


def grouped(rows: DataFrame, handle: Callable[[Rows, Rows, bool], tuple[np.ndarray, ...] | None], schema: str, more: str | None = None, prepare: Callable[[Rows], Rows] | None = None) -> DataFrame:
    """handle(stored, asking, same) for each group g; groups stream through a task one after another, the stored rows first.

    Stored rows ask too (same: the asking rows are a piece of the stored ones). A batch is decoded at once and its groups are slices of it, so
    that many small groups cost little. The asking rows of a group are handled in pieces: only the stored ones (bounded by the block)
    are held. `more` names a further column that handle sees; prepare is done once with a group's stored rows.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stored, base, found = None, [], None, []

        def ask(asking: Rows, same: bool) -> None:
            for k in range(0, len(asking.no), 1024):
                out = handle(base, Rows(*(c[k : k + 1024] for c in asking)), same)
                if out is not None and len(out[0]):
                    found.append(out)

        def close() -> None:
            nonlocal base
            if stored and base is None:
                base = stored[0] if len(stored) == 1 else Rows(*map(np.concatenate, zip(*stored, strict=True)))
                base = prepare(base) if prepare else base
                ask(base, True)

        def flush() -> Iterator[pd.DataFrame]:
            if found:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))
                found.clear()

        for p in parts:
            if not len(p):
                continue
            key, is_stored, all_ = p.g.to_numpy(np.int64), p.stored.to_numpy(bool), decoded(p, more)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (is_stored[1:] != is_stored[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(p)], strict=True):
                if key[lo] != at:
                    close()
                    at, stored, base = key[lo], [], None
                piece = Rows(*(c[lo:hi] for c in all_))
                if is_stored[lo]:
                    stored.append(piece)
                elif stored:
                    close()
                    ask(piece, False)
            yield from flush()
        close()
        yield from flush()

    return rows.repartition("g").sortWithinPartitions("g", F.desc("stored")).mapInPandas(run, schema)


def exact_cosine(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, cosine): pairs of numbers (a, b) as names, with the exact cosine of their vectors, in double precision."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.float32).reshape(len(p), -1).astype(np.float64) for c in ("ua", "ub"))
                c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pd.DataFrame({"a": p.ra, "b": p.rb, "cosine": np.clip(c, -1, 1)})

    known = numbered(classes)
    named = pairs.select("a", "b").join(known.select(F.col("no").alias("b"), F.col("rep").alias("rb"), F.col("unit").alias("ub")), "b").join(
        known.select(F.col("no").alias("a"), F.col("rep").alias("ra"), F.col("unit").alias("ua")), "a"
    )
    return named.where("ra <> rb").select("ra", "rb", "ua", "ub").mapInPandas(measure, "a string, b string, cosine double")


# --- what is asked for -------------------------------------------------------------------------------------------------


def similar_classes(
    classes: DataFrame, least: float, n: int, tables: int = 10, probes: int = 2, aim: int = 256, block: int = 4096, dim: int = DIM
) -> DataFrame:
    """(a, b, cosine) with a < b: pairs of classes with at least this cosine. n: about how many classes there are.

    At cosine 0.95 one table finds a pair with a chance of about two thirds or more; over ten tables a miss is rare.
    Codes only screen, with their measured error as slack, so that they lose nothing; the cosine is then exact.
    """

    def near(base: Rows, asking: Rows, same: bool) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(asking.x @ base.x.T >= (least - 1e-5) - 1.1 * (asking.miss[:, None] + base.miss[None, :]))
        a, b = asking.no[i], base.no[j]
        keep = a < b if same else a != b
        return np.minimum(a, b)[keep], np.maximum(a, b)[keep]

    rows = blocked(classes, tables, digits_for(n, aim, dim), probes, block, dim)
    found = grouped(rows, near, "a long, b long").distinct()
    return exact_cosine(found, classes).where(F.col("cosine") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


#: Members of one class, and rows of a pair of classes, that one task unfolds; larger classes are cut into parts.
MEMBERS = 2000


def similar_pairs(vectors: DataFrame, least: float = 0.95, members_block: int = MEMBERS, **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose vectors have at least this cosine, copies included.

    The pairs of classes are unfolded at last. A class of very many members is cut into parts, so that no task holds all its pairs.
    """
    classes, members = unit_classes(vectors)
    pairs = similar_classes(classes, least, classes.count(), **how).select("a", "b")
    members = staged(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / members_block).cast("int"))
    many = staged(sizes.where("n > 1").select("rep", "parts"))
    same = many.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "parts")
    across = pairs.join(many.select(F.col("rep").alias("a"), "parts"), "a", "left").select("a", "b", F.coalesce("parts", F.lit(1)).alias("parts"))
    rows = same.unionByName(across).select("a", "b", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    split = members.join(many, "rep", "left").select(F.col("rep").alias("a"), F.col("id").alias("ia"), F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return (
        rows.join(split, ["a", "part"])
        .join(members.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
        .where("a <> b or ia < ib")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    )


def similar_groups(vectors: DataFrame, least: float = 0.95, **how) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, cosine) of class representatives with at least this cosine, and (id, rep) of every usable id."""
    classes, members = unit_classes(vectors)
    return similar_classes(classes, least, classes.count(), **how), members


def similar_degree(vectors: DataFrame, least: float = 0.95, **how) -> DataFrame:
    """(id, rep, copies, alike): for each usable id its class, how many ids the class has, and to how many other classes it is similar."""
    pairs, members = similar_groups(vectors, least, **how)
    pairs = staged(pairs.select("a", "b"))
    members = staged(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("alike"))
    return members.join(sizes, "rep").join(ends, "rep", "left").select("id", "rep", "copies", F.coalesce("alike", F.lit(0)).alias("alike"))


# --- the k nearest ------------------------------------------------------------------------------------------------------

#: Buckets of a table lie side by side in shards; a row asks a shard once, for all the buckets it probes there.
SHARDED = "g long, stored boolean, no long, code binary, scale float, miss float, own binary"


class Layout(NamedTuple):
    """For each bucket of a table the shard where it begins and in how many it lies."""

    first: np.ndarray
    parts: np.ndarray


def layout(sizes: np.ndarray, block: int) -> Layout:
    """Neighbouring buckets together while they hold no more than `block` rows; a larger bucket in several shards of its own."""
    first, parts, shard, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for b, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            shard, held = shard + 1, 0
        first[b], parts[b] = shard, max(1, -(-n // block))
        if n > block:
            shard, held = shard + int(parts[b]), 0
        else:
            held += n
    return Layout(first, parts)


def sharded(classes: DataFrame, tables: int, probes: int, block: int, dim: int = DIM) -> DataFrame:
    """One row per vector, table and shard that holds a bucket it probes; `own` is its bucket (as two bytes) and the set of its probes as bits.

    A shard holds about `block` stored rows at most; what probes a bucket of several shards goes to each of them.
    """
    axes_ = 2 << (dim - 1).bit_length()
    counted = {r.g: r.n for r in bucket_sizes(classes, tables, 1, dim).collect()}  # tables x 2 dim rows
    plans = [layout(np.array([counted.get((t << PLACE) | (b << PART), 0) for b in range(axes_)]), block) for t in range(tables)]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for lo in range(0, len(p), 2000):
                q = p.iloc[lo : lo + 2000]
                no = q.no.to_numpy(np.int64)
                x = np.frombuffer(b"".join(q.unit), np.float32).reshape(len(q), dim)
                code, scale, miss = coded(x)
                codes = np.array([c.tobytes() for c in code], object)
                for t, plan in enumerate(plans):
                    b = buckets(x, t, 1, min(probes, axes_))
                    probed = np.zeros((len(q), axes_), bool)
                    np.put_along_axis(probed, b, True, 1)
                    asks = np.concatenate([b[:, :1].astype(np.uint16).view(np.uint8).reshape(len(q), -1), np.packbits(probed, axis=1)], axis=1)
                    asks = np.array([r.tobytes() for r in asks], object)
                    home = plan.first[b[:, 0]] + no % plan.parts[b[:, 0]]
                    row = np.repeat(np.arange(len(q)), b.shape[1])
                    start, n = plan.first[b].ravel(), plan.parts[b].ravel()
                    again = np.repeat(np.arange(len(row)), n)
                    shard = start[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    both = np.unique((row[again] << 32) | shard)
                    row, shard = both >> 32, both & 0xFFFFFFFF
                    yield pd.DataFrame({"g": (t << PLACE) | shard, "stored": shard == home[row], "no": no[row], "code": codes[row], "scale": scale[row], "miss": miss[row], "own": asks[row]})

    return numbered(classes).mapInPandas(spread, SHARDED)


NEAREST = "no long, other long, cosine float, slack float"


def _within(of: np.ndarray, value: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Which rows may be among the k best of their asker (of, ascending not needed): no further below the k-th best than twice the slack."""
    order = np.lexsort((-value, of))
    sorted_of = of[order]
    start = np.flatnonzero(np.append(True, sorted_of[1:] != sorted_of[:-1]))
    count = np.diff(np.append(start, len(of)))
    kth = np.where(count >= k, value[order[np.minimum(start + k - 1, len(of) - 1)]], -np.inf)
    keep = np.empty(len(of), bool)
    keep[order] = value[order] >= np.repeat(kth, count) - 2 * slack[order]
    return keep


def nearest_classes(classes: DataFrame, k: int = 5, tables: int = 3, probes: int = 40, block: int = 32_768, dim: int = DIM) -> DataFrame:
    """(a, b, cosine, rank): the k most similar classes of each class among its candidates, ties by name.

    The candidates are all classes in the `probes` nearest of the 2 dim axes in each of `tables` tables. Codes only screen: with each
    candidate goes what its cosine by code may be wrong by, and all that may be among the k best are measured exactly.

    One rotation and the same probes serve collections of any size: by another rotation a bucket shrinks to a 128th, and evenly spread vectors
    are then missed. Large buckets lie in several shards, all of which an asker meets, so that the work for an asker grows with the
    collection: for vectors spread evenly, which is the worst case, it meets about half of all.
    """

    def prepare(base: Rows) -> Rows:
        own = np.frombuffer(b"".join(x[:2] for x in base.more), np.uint16)
        return Rows(*(c[np.argsort(own, kind="stable")] for c in base))

    def best(base: Rows, asking: Rows, same: bool) -> tuple[np.ndarray, ...] | None:
        own = np.frombuffer(b"".join(x[:2] for x in base.more), np.uint16)
        probed = np.unpackbits(np.frombuffer(b"".join(x[2:] for x in asking.more), np.uint8).reshape(len(asking.no), -1), axis=1).astype(bool)
        slack = 1.1 * (asking.miss + base.miss.max()) + 1e-6
        edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        found = []
        for lo, hi in zip(edges, np.append(edges[1:], len(own)), strict=True):
            rows = np.flatnonzero(probed[:, own[lo]])
            if not len(rows):
                continue
            s = asking.x[rows] @ base.x[lo:hi].T
            s[asking.no[rows][:, None] == base.no[None, lo:hi]] = -np.inf  # itself
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1] if hi - lo > k else np.full(len(rows), -2, np.float32)
            i, j = np.nonzero(s >= np.maximum(kth - 2 * slack[rows], -2)[:, None])
            found.append((rows[i], base.no[lo + j], s[i, j]))
        if not found:
            return None
        of, other, value = map(np.concatenate, zip(*found, strict=True))
        keep = _within(of, value, slack[of], k)
        return asking.no[of[keep]], other[keep], value[keep], slack[of[keep]].astype(np.float32)

    rows = sharded(classes, tables, probes, block, dim)
    found = grouped(rows, best, NEAREST, "own", prepare).repartition("no").groupBy("no", "other").agg(F.max("cosine").alias("c"), F.max("slack").alias("slack"))
    all_ = W.partitionBy("no").orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    few = found.withColumn("kth", F.nth_value("c", k).over(all_)).withColumn("most", F.max("slack").over(all_))
    few = few.where("kth is null or c >= kth - 2 * most").select(F.col("no").alias("a"), F.col("other").alias("b"))
    w = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return exact_cosine(few, classes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 5, **how) -> DataFrame:
    """(id, rep, rank, neighbour, cosine): for each usable id the k most similar other classes; ids with one rep are copies."""
    classes, members = unit_classes(vectors)
    found = nearest_classes(classes, k, **how)
    return members.join(found.select(F.col("a").alias("rep"), "rank", F.col("b").alias("neighbour"), F.round("cosine", 6).alias("cosine")), "rep").select(
        "id", "rep", "rank", "neighbour", "cosine"
    )


def exact_nearest(classes: DataFrame, asking: DataFrame, k: int, groups: int, dim: int = DIM) -> DataFrame:
    """(a, b, cosine, rank) by brute force for a stated set of askers against all rows, in blocks, in double precision: for measuring the recall.

    The rows are cut into `groups` blocks, each of which meets all askers once; a task holds one block.
    """
    stored = classes.select(F.pmod(F.xxhash64("rep"), F.lit(groups).cast("long")).alias("g"), F.lit(False).alias("asks"), "rep", "unit")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")
    asked = asking.select(every, F.lit(True).alias("asks"), "rep", "unit")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, base, names = None, [], None, None
        for p in parts:
            edges = np.flatnonzero((p.g.to_numpy()[1:] != p.g.to_numpy()[:-1]) | (p.asks.to_numpy()[1:] != p.asks.to_numpy()[:-1])) + 1
            for piece in np.split(np.arange(len(p)), edges):
                if not len(piece):
                    continue
                q = p.iloc[piece]
                if q.g.iloc[0] != at:
                    at, held, base = q.g.iloc[0], [], None
                if not q.asks.iloc[0]:
                    held.append(q)
                    continue
                if not held:
                    continue
                if base is None:
                    rows = pd.concat(held)
                    base, names = np.frombuffer(b"".join(rows.unit), np.float32).reshape(len(rows), dim).astype(np.float64), rows.rep.to_numpy()
                    base /= np.linalg.norm(base, axis=1, keepdims=True)
                for lo in range(0, len(q), 512):
                    a = q.iloc[lo : lo + 512]
                    x = np.frombuffer(b"".join(a.unit), np.float32).reshape(len(a), dim).astype(np.float64)
                    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ base.T
                    s[a.rep.to_numpy()[:, None] == names[None, :]] = -2
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(a), -1.5)
                    i, j = np.nonzero(s >= np.maximum(kth, -1.5)[:, None])
                    yield pd.DataFrame({"a": a.rep.to_numpy()[i], "b": names[j], "cosine": s[i, j]})

    found = stored.union(asked).repartition("g").sortWithinPartitions("g", "asks").mapInPandas(run, "a string, b string, cosine double")
    w = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_report(vectors: DataFrame, k: int = 5, every: int = 50, block: int = 8192, **how) -> DataFrame:
    """One row: askers, neighbours found, and the share of the true k nearest that the index found.

    Askers are the classes whose name's hexadecimal number is divisible by `every`, against all rows.
    """
    classes, _ = unit_classes(vectors)
    n = classes.count()
    number = F.conv(F.regexp_extract("rep", "([0-9a-f]{1,15})$", 1), 16, 10).cast("long")
    asking = classes.where(F.pmod(F.coalesce(number, F.xxhash64("rep")), F.lit(every)) == 0)
    true = exact_nearest(classes, asking, k, max(1, -(-n // block))).select("a", "b")
    said = nearest_classes(classes, k, **how).select("a", "b", F.lit(1).alias("hit"))
    return true.join(said, ["a", "b"], "left").agg(
        F.count_distinct("a").alias("askers"),
        F.count("*").alias("true_neighbours"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
