"""Problem 2: has this key been seen before? Quotient filters over ordered blocks of the stream, merged with those of like size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 64
#: The block of the keys that were there before the stream.
EARLIEST = -(1 << 63)


def clean_hash(c: Column) -> Column:
    """The 64 hex digits of a hash, lower case, however it is written; null where there are not exactly 64.

    A name of the algorithm or 0x before it, and anything between the digits that is no hex digit, is dropped.
    """
    bare = F.regexp_replace(F.lower(c), r"^[^0-9a-z]*(sha-?_?256|sha2|0x)[^0-9a-z]*", "")
    bare = F.regexp_replace(bare, r"[\s:_.\-{}\"'<>\[\]()]", "")
    return F.when(bare.rlike(f"^[0-9a-f]{{{HEX_DIGITS}}}$"), bare)


def fingerprint(c: Column) -> Column:
    """63 bits of all digits of a clean hash; -1 for none. Mixed again, so that hashes that share digits are apart."""
    return F.when(c.isNull(), F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(c), 1))


class QuotientFilter:
    """A static quotient filter: a fingerprint is split into quotient (its home slot) and remainder (what is stored).

    Three bits a slot mark occupied homes, continuations of a run, and shifted entries; from these the quotient
    of each stored remainder follows, so that a filter can be read out in order and merged with another.
    The table has no wrap-around: it is longer than 2^q by what the last run needs.
    """

    def __init__(self, ordered: np.ndarray, q: int, r: int):
        """ordered: distinct fingerprints of q + r bits, ascending."""
        self.q, self.r = q, r
        n = len(ordered)
        quotient = (ordered >> np.uint64(r)).astype(np.int64)
        i = np.arange(n)
        slot = np.maximum.accumulate(quotient - i) + i if n else i
        size = max(1 << q, int(slot[-1]) + 1 if n else 0)
        self.remainders = np.zeros(size, np.uint32 if r <= 32 else np.uint64)
        self.remainders[slot] = ordered & np.uint64((1 << r) - 1)
        occupied, continuation, shifted = (np.zeros(size, bool) for _ in range(3))
        occupied[quotient] = True
        continuation[slot[1:]] = quotient[1:] == quotient[:-1]
        shifted[slot] = slot != quotient
        self.bits = [np.packbits(x) for x in (occupied, continuation, shifted)]
        self.size, self.n = size, n
        self._index: tuple[np.ndarray, ...] | None = None

    def nbytes(self) -> int:
        return self.remainders.nbytes + sum(b.nbytes for b in self.bits)

    def _layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        occupied, continuation, shifted = (np.unpackbits(b, count=self.size).astype(bool) for b in self.bits)
        start = ~continuation & (shifted | occupied)  # a slot that holds a run's first entry
        full = start | continuation
        # a home that is occupied but whose own slot is empty cannot be: its run would stand there
        return occupied, start, full, np.flatnonzero(start)

    def index(self) -> tuple[np.ndarray, ...]:
        """For asking: occupied homes, each home's run (how many occupied ones up to it), where runs start, and filled slots up to each. Made once."""
        if self._index is None:
            occupied, _, full, starts = self._layout()
            self._index = occupied, np.cumsum(occupied, dtype=np.int32), np.append(starts, self.size).astype(np.int32), np.cumsum(full, dtype=np.int32)
        return self._index

    def read(self) -> np.ndarray:
        """All fingerprints, ascending."""
        occupied, start, full, _ = self._layout()
        homes = np.flatnonzero(occupied)
        run = np.cumsum(start)[full] - 1
        return (homes[run].astype(np.uint64) << np.uint64(self.r)) | self.remainders[full].astype(np.uint64)

    def contains(self, asked: np.ndarray) -> np.ndarray:
        """Whether each fingerprint (q + r bits) is stored."""
        if not self.n or not len(asked):
            return np.zeros(len(asked), bool)
        occupied, runs, starts, filled = self.index()
        quotient = (asked >> np.uint64(self.r)).astype(np.int64)
        remainder = asked & np.uint64((1 << self.r) - 1)
        out = occupied[quotient]
        run = np.maximum(runs[quotient] - 1, 0)
        at, following = starts[run], starts[run + 1]
        length = filled[following - 1] - filled[at] + 1  # entries up to the next run, empty slots not counted
        found = np.zeros(len(asked), bool)
        live = np.flatnonzero(out)
        step = 0
        while len(live):
            live = live[length[live] > step]
            found[live] |= self.remainders[at[live] + step] == remainder[live]
            live = live[~found[live]]
            step += 1
        return found

    def merged(self, ordered: np.ndarray, q: int) -> QuotientFilter:
        """With further ascending fingerprints, as a filter of 2^q homes and the same number of bits in all."""
        both = np.concatenate([self.read(), ordered])
        both.sort(kind="stable")  # two ascending runs: one merging pass
        if len(both):
            both = both[np.append(True, both[1:] != both[:-1])]
        return QuotientFilter(both, q, self.q + self.r - q)


class Levels:
    """All keys of a segment so far, as quotient filters of growing size; filters of like size are merged, so that each key is moved a few times only."""

    def __init__(self, bits: int):
        self.bits = bits
        self.filters: list[QuotientFilter] = []
        self.moved = 0  # keys written into filters

    def _filter(self, ordered: np.ndarray) -> QuotientFilter:
        q = quotient_bits(len(ordered), self.bits)
        return QuotientFilter(ordered, q, self.bits - q)

    def ask(self, keys: np.ndarray) -> np.ndarray:
        """For keys in the order of their arrival: whether each came earlier, among these or before. Afterwards all are held."""
        distinct, first = np.unique(keys, return_index=True)
        new = ~np.logical_or.reduce([f.contains(distinct) for f in self.filters]) if self.filters else np.ones(len(distinct), bool)
        seen = np.ones(len(keys), bool)
        seen[first[new]] = False
        if new.any():
            self._add(distinct[new])
        return seen

    def _add(self, ordered: np.ndarray) -> None:
        held = self._filter(ordered)
        self.moved += held.n
        while self.filters and self.filters[-1].n <= 2 * held.n:
            last = self.filters.pop()
            held = last.merged(held.read(), quotient_bits(last.n + held.n, self.bits))
            self.moved += held.n
        self.filters.append(held)


def quotient_bits(n: int, bits: int) -> int:
    """So that at most 3 of 4 homes are taken; the remainder keeps at least 1 bit."""
    return int(min(max(4, np.ceil(np.log2(max(1, n) / 0.75))), bits - 1))


def plan_sizes(n_rows: int, block_rows: int, segment_rows: int) -> tuple[int, int]:
    """(blocks, segment bits): blocks of the stream and segments of the key space that one task can hold."""
    return max(1, -(-n_rows // block_rows)), int(max(0, np.ceil(np.log2(max(1, n_rows / segment_rows)))))


def seen_before(
    earlier: DataFrame,
    stream: DataFrame,
    bits: int = 56,
    block_rows: int = 250_000,
    segment_rows: int = 250_000,
) -> DataFrame:
    """(lookup_id, seen): for every key of the stream whether it was in `earlier` or under a smaller lookup_id.

    earlier has `content_hash`; stream has `lookup_id` and `content_hash`. A null or cut hash is no key: its `seen`
    is null, and it makes no later one seen. A record delivered twice counts once (where copies disagree, the
    smallest clean hash holds); records without lookup_id are none.

    Keys are held as `bits`-bit fingerprints. The stream is cut by range of lookup_id into blocks. Within a block a
    key that the block's own filter has already seen is settled there; only the first in its block goes on, so that
    a key with a third of all rows sends one row a block. The key space is cut by leading fingerprint bits into
    segments; each segment takes the blocks in order, asks the filter of all earlier blocks, and merges the
    block's sorted fingerprints into it. A task holds one block (16 bytes a row) or one segment's filter,
    never all keys.
    """
    n_rows = earlier.count() + stream.count()
    blocks, segment_bits = plan_sizes(n_rows, block_rows, segment_rows)
    bits = max(bits, segment_bits + 8)
    cut = 63 - bits
    keys = (
        stream.where(F.col("lookup_id").isNotNull())
        .select(F.col("lookup_id").cast("long").alias("lookup_id"), clean_hash(F.col("content_hash")).alias("h"))
        .select("lookup_id", F.shiftright(fingerprint(F.col("h")), cut).alias("fp"))
    )
    blocked = keys.repartitionByRange(blocks, "lookup_id")
    shift = bits - segment_bits

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(p.lookup_id.to_numpy(np.int64), p.fp.to_numpy(np.int64)) for p in parts if len(p)]
        if not own:
            return
        ids, fps = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((np.where(fps < 0, np.iinfo(np.int64).max, fps), ids))
        ids, fps = ids[order], fps[order]
        once = np.append(True, ids[1:] != ids[:-1])
        ids, fps = ids[once], fps[once]
        real, block = fps >= 0, ids[0]  # blocks are in the order of their first lookup
        yield pd.DataFrame({"lookup_id": ids[~real], "fp": -1, "block": block, "segment": ids[~real] & 1023, "seen": None})
        ids, fps = ids[real], fps[real]
        if not len(ids):
            return
        _, first = np.unique(fps, return_index=True)
        again = np.ones(len(fps), bool)
        again[first] = False
        # the block's filter, asked by the later rows: what it answers is what is settled
        own_filter = QuotientFilter(np.unique(fps.astype(np.uint64)), q := quotient_bits(len(first), bits), bits - q)
        settled = again & own_filter.contains(fps.astype(np.uint64))
        yield pd.DataFrame({"lookup_id": ids[settled], "fp": -1, "block": block, "segment": ids[settled] & 1023, "seen": True})
        yield pd.DataFrame(
            {"lookup_id": ids[~settled], "fp": fps[~settled], "block": block, "segment": fps[~settled] >> shift, "seen": None}
        )

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty(0, np.int64)
        for p in parts:
            kept = np.union1d(kept, p.fp.to_numpy(np.int64))
            if len(kept) >= block_rows:
                yield pd.DataFrame({"lookup_id": -1, "fp": kept, "block": EARLIEST, "segment": kept >> shift, "seen": None})
                kept = np.empty(0, np.int64)
        yield pd.DataFrame({"lookup_id": -1, "fp": kept, "block": EARLIEST, "segment": kept >> shift, "seen": None})

    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments one after another, each with its blocks in order; the filters of one are held."""
        segment, held = None, None
        for p in parts:
            done = p.fp < 0
            yield p.loc[done, ["lookup_id", "seen"]]
            p = p[~done]
            if not len(p):
                continue
            of, fps, ids, asks = p.segment.to_numpy(), p.fp.to_numpy(np.uint64) & np.uint64((1 << shift) - 1), p.lookup_id.to_numpy(), p.block.to_numpy() != EARLIEST
            edges = np.flatnonzero(of[1:] != of[:-1]) + 1
            for lo, hi in zip([0, *edges], [*edges, len(p)], strict=True):
                if of[lo] != segment:
                    segment, held = of[lo], Levels(shift)
                seen = held.ask(fps[lo:hi])
                asking = asks[lo:hi]
                if asking.any():
                    yield pd.DataFrame({"lookup_id": ids[lo:hi][asking], "seen": seen[asking]})

    schema = "lookup_id long, fp long, block long, segment long, seen boolean"
    before = (
        earlier.select(F.shiftright(fingerprint(clean_hash(F.col("content_hash"))), cut).alias("fp"))
        .where("fp >= 0")
        .mapInPandas(gather, schema)
    )
    return (
        blocked.mapInPandas(settle, schema)
        .union(before)
        .withColumn("side", (F.col("fp") < 0).cast("int"))
        .repartition("side", "segment")
        .sortWithinPartitions("segment", "block")
        .drop("side")
        .mapInPandas(answer, "lookup_id long, seen boolean")
    )


def error_report(earlier: DataFrame, stream: DataFrame, bits: int) -> DataFrame:
    """One row: lookups, those new, wrong answers expected and measured, and their rates.

    Of a key that is new when m keys are stored, the filter says seen if one of m fingerprints of `bits` bits
    is equal: 1 - (1 - 2^-bits)^m. The measured number comes from whole hashes, counted exactly.
    """
    said = seen_before(earlier, stream, bits)
    exact = stream.where("lookup_id is not null").groupBy("lookup_id").agg(F.min(clean_hash(F.col("content_hash"))).alias("h")).where("h is not null")
    old = earlier.select(clean_hash(F.col("content_hash")).alias("h")).where("h is not null").distinct()
    first = exact.groupBy("h").agg(F.min("lookup_id").alias("lookup_id"))
    new = first.join(old, "h", "left_anti").select("lookup_id", F.lit(True).alias("is_new"))
    sizes = old.agg(F.count("*").alias("n_old"))
    return (
        said.where("seen is not null")
        .join(new, "lookup_id", "left")
        .agg(
            F.count("*").alias("lookups"),
            F.count("is_new").alias("new_keys"),
            F.count(F.expr("case when is_new and seen then 1 end")).alias("false_seen"),
            F.count(F.expr("case when is_new is null and not seen then 1 end")).alias("false_new"),
        )
        .crossJoin(sizes)  # one row each
        .select(
            F.lit(bits).alias("fingerprint_bits"),
            "lookups",
            "new_keys",
            "false_seen",
            "false_new",
            (F.col("new_keys") * (F.col("n_old") + F.col("new_keys") / 2) / F.pow(F.lit(2.0), F.lit(bits))).alias("expected_false_seen"),
            ((F.col("false_seen") + F.col("false_new")) / F.col("lookups")).alias("measured_rate"),
            (F.col("new_keys") * (F.col("n_old") + F.col("new_keys") / 2) / F.pow(F.lit(2.0), F.lit(bits)) / F.col("lookups")).alias("derived_rate"),
        )
    )
