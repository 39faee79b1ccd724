"""Problem 8: containers of fixed capacity filled with neighbouring documents along a Hilbert curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import RANKS, encoded
from quern.staging import staged

DIMS, BITS = 4, 15


def sketch(tokens: list[int], dims: int = DIMS) -> np.ndarray:
    """A document as a few numbers of about normal distribution: its token numbers, hashed to random signs and summed."""
    x = np.asarray(tokens, np.uint64)
    if not len(x):
        return np.zeros(dims)
    x, n = np.unique(x, return_counts=True)
    h = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    weight = np.sqrt(n)
    signs = ((h[:, None] >> np.arange(dims, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.int8) * 2 - 1
    return signs.T @ weight / np.sqrt((weight * weight).sum())


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of whole numbers (below 2^bits) on the Hilbert curve through its cube."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's turns from the largest cube down
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, place): the size of each distinct doc_id and its place on the curve. Whole texts are tokenized, once.

    The sums are spread evenly over the cube by the normal distribution's logistic approximation. A doc_id that comes twice counts
    once (that with more tokens holds); rows without doc_id are none; null and empty texts have 0 tokens. Texts stay where they
    are read; only sizes and places are shuffled.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                sizes, rows = [], []
                for t in encoded(p.text, ranks):
                    sizes.append(len(t))
                    rows.append(sketch(t))
                cell = np.clip(1 / (1 + np.exp(-1.702 * np.stack(rows))), 0, 1 - 1e-9) * (1 << BITS)
                yield pd.DataFrame({"doc_id": p.doc_id, "n_tokens": sizes, "place": hilbert(cell.astype(np.int64))})

    sized = documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, place long")
    return sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "place")).alias("r")).select("doc_id", "r.n_tokens", "r.place")


class Packer:
    """Lays pieces into containers, the larger of a window first, each where the least room is left over.

    Containers stay open for the next window of the curve until they are full or too many are open; then those with
    the least room are closed. So a container holds documents from nearby on the curve.
    """

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list[tuple]] = {}
        self.n = 0

    def _whole(self, number: int, room: int) -> list[tuple]:
        rows, at = [], 0
        for doc_id, piece, start, size in self.held.pop(number):
            rows.append((number, doc_id, piece, start, size, at, self.capacity - room, room))
            at += size
        return rows

    def add(self, window: list[tuple[int, int]]) -> list[tuple]:
        """window: (doc_id, n_tokens). Gives the rows of the containers that it closes."""
        done: list[tuple] = []
        rest = []
        for doc_id, n in window:
            piece = 0
            while n - piece * self.capacity > self.capacity:  # longer than a container: parts that fill one, and what remains
                self.n += 1
                done.append((self.n, doc_id, piece, piece * self.capacity, self.capacity, 0, self.capacity, 0))
                piece += 1
            rest.append((n - piece * self.capacity, doc_id, piece, piece * self.capacity))
        rest.sort(reverse=True)
        for size, doc_id, piece, start in rest:
            i = bisect_left(self.open, (size, -1))
            if i < len(self.open):
                room, number = self.open.pop(i)
            else:
                self.n += 1
                room, number = self.capacity, self.n
                self.held[number] = []
            self.held[number].append((doc_id, piece, start, size))
            if room == size:
                done += self._whole(number, 0)
            else:
                insort(self.open, (room - size, number))
        extra = len(self.open) - self.most_open
        if extra > 0:
            for room, number in self.open[:extra]:
                done += self._whole(number, room)
            del self.open[:extra]
        return done

    def close(self) -> list[tuple]:
        done = [row for room, number in self.open for row in self._whole(number, room)]
        self.open = []
        return done


PACKED = "pack_name string, capacity_tokens long, container_id string, doc_id long, piece_no int, piece_start long, n_tokens long, place_in_container long, used long, room long, cell int"
#: Of the place on the curve so many leading bits are the cell of the cube that a document is told by: 4 parts a dimension.
CELL_BITS = 2 * DIMS


def pack(documents: DataFrame, limits: DataFrame, ranks: str = RANKS, window: int = 32, most_open: int = 64, task_rows: int = 50_000) -> DataFrame:
    """One row per piece laid into a container, for each pack_name; containers are named by task and number.

    A document is whole unless it is longer than the capacity; then it is cut into parts that fill containers and a rest. used and
    room are those of the container; cell is where in the cube the document lies. A document without tokens takes no room: its container_id
    is null. The documents are sorted by range of (place on the curve, doc_id), about `task_rows` a task, so that equal texts, however many,
    are spread over tasks; a task holds one window of the curve, of `window` containers' tokens, and at most `most_open` open containers
    for each limit: a container is filled from this stretch of the curve. Limits without a name or a positive capacity are none; a pack_name
    that comes twice counts once (the smaller capacity holds).
    """
    rows = limits.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").alias("c"))
    packs = [(r.pack_name, int(r.c)) for r in rows.orderBy("pack_name").collect()]  # a configuration table: one row per kind of container
    keys = staged(curve_keys(documents, ranks))
    columns = [c.split()[0] for c in PACKED.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = [Packer(c, most_open) for _, c in packs]

        def frame(k: int, done: list[tuple]) -> pd.DataFrame:
            name, capacity = packs[k]
            return pd.DataFrame([(name, capacity, f"{name}-{task}-{d[0]}", *d[1:], cell_of[d[1]]) for d in done], columns=columns)

        cell_of: dict[int, int] = {}  # of the documents that wait or stand open
        waiting: list[list[tuple[int, int]]] = [[] for _ in packs]
        tokens = [0] * len(packs)

        for p in parts:
            cells = (p.place.to_numpy() >> (DIMS * BITS - CELL_BITS)).tolist()
            ids, sizes = p.doc_id.tolist(), p.n_tokens.tolist()
            empty = [(i, c) for i, n, c in zip(ids, sizes, cells, strict=True) if n == 0]
            for name, capacity in packs if empty else ():
                yield pd.DataFrame([(name, capacity, None, i, 0, 0, 0, None, None, None, c) for i, c in empty], columns=columns).astype(
                    {"place_in_container": "Int64", "used": "Int64", "room": "Int64"}
                )
            live = {i for w in waiting for i, _ in w} | {r[0] for x in packers for h in x.held.values() for r in h}
            cell_of = {i: c for i, c in cell_of.items() if i in live}
            cell_of.update(zip(ids, cells, strict=True))
            for k, packer in enumerate(packers):
                done: list[tuple] = []
                for i, n in zip(ids, sizes, strict=True):
                    if n:
                        waiting[k].append((i, n))
                        tokens[k] += n
                        if tokens[k] >= window * packer.capacity:
                            done += packer.add(waiting[k])
                            waiting[k], tokens[k] = [], 0
                if done:
                    yield frame(k, done)
        for k, packer in enumerate(packers):
            if done := packer.add(waiting[k]) + packer.close():
                yield frame(k, done)

    tasks = max(1, -(-keys.count() // task_rows))
    return keys.repartitionByRange(tasks, "place", "doc_id").sortWithinPartitions("place", "doc_id").mapInPandas(run, PACKED)


def room_left(packed: DataFrame) -> DataFrame:
    """One row per pack_name: documents, containers, tokens, room, the share of the room, and how near the documents of a container lie.

    same_cell is the share of pairs of documents of one container that lie in one cell of the cube, by_chance that of all pairs.
    """
    own = packed.where("container_id is not null and piece_no = 0").groupBy("pack_name", "container_id", "cell").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1))
    total = F.sum("n")
    inside = own.groupBy("pack_name", "container_id").agg(pairs(F.col("n")).alias("same"), (total * (total - 1)).alias("pairs"))
    near = inside.groupBy("pack_name").agg(F.round(F.try_divide(F.sum("same"), F.sum("pairs")), 6).alias("same_cell"))
    cells = own.groupBy("pack_name", "cell").agg(F.sum("n").cast("double").alias("n"))
    chance = cells.groupBy("pack_name").agg(F.round(F.try_divide(pairs(F.col("n")), total * (total - 1)), 6).alias("by_chance"))
    return (
        packed.groupBy("pack_name", "capacity_tokens")
        .agg(
            F.count(F.expr("case when piece_no = 0 then 1 end")).alias("documents"),
            F.count(F.expr("case when place_in_container = 0 then 1 end")).alias("containers"),
            F.sum("n_tokens").alias("tokens"),
            F.coalesce(F.sum(F.expr("case when place_in_container = 0 then room end")), F.lit(0)).alias("room"),
        )
        .withColumn("room_share", F.expr("round(room / nullif(room + tokens, 0), 6)"))
        .join(near, "pack_name", "left")
        .join(chance, "pack_name", "left")
    )
