"""Problem 3: how distinctive a term is of a record, by probabilistic relevance weighting (BM25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import code_tokens
from quern.staging import staged

K1, B = 1.2, 0.75


#: Rows of copies, and ids of candidates, up to this number (some 50 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to all tasks if it has no more than `most` rows. It must be staged."""
    return F.broadcast(df) if df.count() <= most else df


def tokenized(chunks: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, t): the code tokens of each distinct chunk id, staged. The contents are tokenized once, where they lie, and are not shuffled.

    Null content has no tokens; rows without id are none. An id that comes twice counts once (of copies that disagree the longest content
    holds, of equally long ones that with the larger hash): only ids, lengths and hashes are grouped to tell which rows are left out.
    """
    content = F.coalesce("content", F.lit(""))
    rows = staged(
        chunks.where("id is not null")
        .select("id", F.length(content).alias("n"), F.xxhash64(content).alias("h"), F.split(code_tokens(content), " ").alias("t"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "n", "h", F.expr("filter(t, x -> x <> '')").alias("t"))
    )
    held = rows.groupBy("id").agg(F.max(F.struct("n", "h", "row")).alias("r"), F.count("*").alias("copies")).where("copies > 1").select("id", F.col("r.row").alias("held"))
    copies = staged(rows.select("id", "row").join(held, "id").where("row <> held").select("row"))
    return rows.join(small(copies, broadcast_rows), "row", "left_anti").select("id", "t")


def distinctive_terms(chunks: DataFrame, candidates: DataFrame, k1: float = K1, b: float = B, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, term, score, frequency, document_count) for each distinct candidate (id, term).

    frequency counts the term among the code tokens of the chunk, document_count the distinct chunks that have it;
    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)).
    N, df and the average length are those of all distinct chunk ids; a chunk with null content has no tokens. A term
    that the chunk lacks, or a chunk that is unknown, scores 0. Candidates without id or term are none. Rows that come
    twice count once (see tokenized).
    """
    wanted = staged(candidates.where("id is not null and term is not null").select("id", "term").distinct())
    tokens = tokenized(chunks, broadcast_rows)
    collection = tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avg_len"))
    terms, ids = (small(staged(wanted.select(c).distinct()), broadcast_rows) for c in ("term", "id"))
    # each chunk's terms once; counted in each task before they are shuffled
    df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = tokens.join(ids, "id", "left_semi").select("id", F.size("t").alias("len"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
    counts = asked.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return (
        wanted.join(counts, ["id", "term"], "left")
        .join(df, "term", "left")
        .crossJoin(F.broadcast(collection))  # one row
        .select(
            "id",
            "term",
            F.expr(f"""coalesce(ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * ({k1}D + 1)
                / (tf + {k1}D * (1 - {b}D + {b}D * len / avg_len)), 0D)""").alias("score"),
            F.coalesce("tf", F.lit(0)).cast("long").alias("frequency"),
            F.coalesce("df", F.lit(0)).cast("long").alias("document_count"),
        )
    )


def most_distinctive(scored: DataFrame) -> DataFrame:
    """(id, term): the best term of each id, of equal ones the first by code point. Combined before the shuffle."""
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best")).select("id", "best.term")
