"""Problem 9: sources mixed to target weights, by nested thresholds on a hash found with histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import RANKS, with_tokens
from quern.staging import staged

#: Bits of the hash that one round of histograms resolves; five rounds resolve all 60.
STEP, LEVELS = 12, 5


def targets(mix: DataFrame) -> DataFrame:
    """(source, weight, max_repeats): one row per source; weights are scaled to sum 1; sources without a positive weight are none.

    A source that comes twice counts once (the larger weight and repeats hold). A null max_repeats is 1, one below 0 is 0.
    """
    rows = mix.where("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(
        F.max("weight").alias("w"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats")
    )
    return rows.crossJoin(rows.agg(F.sum("w").alias("all"))).select("source", (F.col("w") / F.col("all")).alias("weight"), "max_repeats")


def mixture(documents: DataFrame, mix: DataFrame, total: int | None = None, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): how often each document is used, and what each source reaches.

    Of source s with T tokens and weight w, w * total tokens are wanted: each document floor(w * total / T) times, and once more those
    whose hash lies below the source's threshold. Without `total` the largest is taken that all sources can fill within their
    max_repeats. A source that cannot fill its share gives all it may, and the shares say so. The threshold comes
    within half a document (the last one is taken if that is nearer). doc_ids that come twice count once (that with more tokens holds);
    documents without doc_id, without source or of a source without a target are not used.

    The token sums by source and the first hash bits (4096 buckets a source, summed before the shuffle) show in which bucket each
    threshold lies; only that bucket is summed again by the next bits. Nothing is sorted, and a hot source is spread over all tasks.
    The documents are tokenized once, where they are read; the driver sees a few numbers per source of the target table.
    """
    goal = targets(mix)
    sizes = with_tokens(
        documents.where("doc_id is not null and source is not null").join(F.broadcast(goal.select("source")), "source", "left_semi"),  # one row per source of the target table
        ["doc_id", "source"],
        ranks=ranks,
    )
    sized = staged(
        sizes.groupBy("doc_id")
        .agg(F.max(F.struct("n_tokens", "source")).alias("r"))
        .select("doc_id", "r.source", "r.n_tokens", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(29)), 4).alias("h"))
    )
    wanted = {r.source: (r.weight, r.max_repeats) for r in goal.collect()}
    have = {r.source: int(r.t) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r.t}
    if total is None:
        # a source without any text or any use cannot be in a mixture; it must not make the rest empty
        total = int(min((r * have[s] / w for s, (w, r) in wanted.items() if have.get(s) and r), default=0))
    plan = {}
    for s, (w, r) in wanted.items():
        t = have.get(s, 0)
        if not t or not r:
            plan[s] = [0, 0, 0]
            continue
        need = min(w * total, r * t)
        times = min(int(need // t), r)
        plan[s] = [times, need - times * t if times < r else 0, 0]  # times, tokens still wanted, threshold on the hash (60 bits)
    spark = documents.sparkSession
    open_ = {s: 0 for s, p in plan.items() if p[1] > 0}  # source: the leading hash bits of its boundary bucket
    for level in range(LEVELS):
        if not open_:
            break
        width = 60 - STEP * (level + 1)
        known = spark.createDataFrame([(s, b) for s, b in open_.items()], "source string, boundary long")
        inside = sized.join(F.broadcast(known), "source").where(F.shiftrightunsigned("h", width + STEP) == F.col("boundary") if level else F.lit(True))
        sums: dict[str, list[tuple[int, int, int]]] = {}
        # at most 4096 rows per source of the target table
        for r in inside.groupBy("source", F.shiftrightunsigned("h", width).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect():
            sums.setdefault(r.source, []).append((r.b, r.t, r.n))
        for s in list(open_):
            plan[s][2] = open_[s] << (width + STEP)
            boundary = None
            for b, t, n in sorted(sums.get(s, [])):
                if t <= plan[s][1]:
                    plan[s][1] -= t
                    plan[s][2] = (b + 1) << width
                elif n > 1 and level < LEVELS - 1:
                    boundary = b
                    break
                else:
                    if t - plan[s][1] < plan[s][1]:
                        plan[s][2] = (b + 1) << width
                    break
            if boundary is None:
                del open_[s]
            else:
                open_[s] = boundary
    thresholds = spark.createDataFrame([(s, p[0], p[2]) for s, p in plan.items()], "source string, times int, threshold long")
    uses = (
        sized.join(F.broadcast(thresholds), "source")
        .select("doc_id", "source", "n_tokens", (F.col("times") + (F.col("h") < F.col("threshold")).cast("int")).alias("uses"))
        .where("uses > 0")
    )
    reached = uses.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    everything = reached.agg(F.sum("tokens").alias("all"))
    shares = (
        goal.join(reached, "source", "left")
        .crossJoin(everything)  # one row
        .select(
            "source",
            F.round("weight", 6).alias("target_share"),
            F.round(F.coalesce(F.col("tokens") / F.expr("nullif(`all`, 0)"), F.lit(0.0)), 6).alias("share"),
            F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
            F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
            F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"),
            F.col("max_repeats").cast("int").alias("max_repeats"),
        )
    )
    return uses, shares
