"""Problem 1: one order out of several differently scaled scores, by weighted median rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.distributed_rank import rank_values
from quern.staging import staged

#: Metrics of which a smaller score is better; of all others a larger one is.
SMALLER_IS_BETTER = ("L2",)


def list_weights(queries: DataFrame) -> DataFrame:
    """(query_id, weights) as HybridSearchOptions.rerank asks; null, broken or other strategies weigh all lists alike.

    A query that comes twice counts once, with the largest text of its option.
    """
    return (
        queries.groupBy("query_id")
        .agg(F.max("rerank").alias("rerank"))
        .select("query_id", F.from_json("rerank", "strategy string, params struct<weights: array<double>>").alias("o"))
        .where("o.strategy = 'weighted' and o.params.weights is not null")
        .select("query_id", F.col("o.params.weights").alias("weights"))
    )


def median_ranks(ranked: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, id, median_rank, mean_rank, n_lists): where each item stands over all lists of its query.

    An item's rank in a list comes from its score alone, in the direction of the list's metric; equal scores share
    the mean of their places. In a list without the item (or where its score is null, NaN or infinite, which counts
    as absent) it stands one place behind the last. The weighted median is the middle between the lower and the upper
    one. Weights go by list_no; a list without a weight, or with one below or equal to 0 or not finite, weighs 1
    and 0 respectively; if all are 0, all weigh alike. Rows without query_id, list_no or id are no entries;
    an entry that comes twice counts once, with its better score.
    """
    score = F.col("score").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    entries = staged(
        ranked.where(finite & F.col("query_id").isNotNull() & F.col("id").isNotNull() & F.col("list_no").isNotNull())
        .select(
            "query_id",
            "list_no",
            "id",
            F.when(F.upper(F.trim("metric")).isin(*SMALLER_IS_BETTER), score).otherwise(-score).alias("key"),
        )
        .groupBy("query_id", "list_no", "id")
        .agg((F.min("key") + F.lit(0.0)).alias("key"))
    )
    places = rank_values(entries, ["query_id", "list_no"], "key")
    placed = entries.join(places, ["query_id", "list_no", "key"]).select(
        "query_id", "id", "list_no", (F.col("n_before") + (F.col("n_equal") + 1) / 2).alias("rank")
    )
    lists = (
        places.groupBy("query_id", "list_no")
        .agg(F.sum("n_equal").alias("n"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("list_no", "n"))).alias("lists"))
    )
    if weights is None:
        lists = lists.withColumn("weights", F.lit(None).cast("array<double>"))
    else:
        lists = lists.join(weights.select("query_id", "weights"), "query_id", "left")
    lists = lists.withColumn(
        "lists",
        F.expr("""transform(lists, (l, i) -> struct(l.list_no as list_no, l.n as n,
            case when weights is null or get(weights, i) is null then 1D
                 when isnan(get(weights, i)) or get(weights, i) <= 0 or get(weights, i) = double('Infinity') then 0D
                 else get(weights, i) end as w))"""),
    ).withColumn("alike", F.expr("aggregate(lists, 0D, (s, l) -> s + l.w) <= 0D"))
    items = placed.groupBy("query_id", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("list_no", "rank"))).alias("own")
    )
    return (
        items.join(lists, "query_id")
        .withColumn(
            "r",
            F.expr("""array_sort(transform(lists, l -> struct(coalesce(try_element_at(own, l.list_no), double(l.n + 1)) as rank,
                if(alike, 1D, l.w) as w)))"""),
        )
        .withColumn("half", F.expr("aggregate(r, 0D, (s, x) -> s + x.w) / 2D"))
        .withColumn(
            "r",
            F.expr("""transform(r, (x, i) -> struct(x.rank as rank, x.w as w,
                aggregate(slice(r, 1, i + 1), 0D, (s, y) -> s + y.w) as upto))"""),
        )
        .select(
            "query_id",
            "id",
            F.expr("""(filter(r, x -> x.upto >= half)[0].rank
                + coalesce(get(filter(r, x -> x.upto > half), 0).rank, r[size(r) - 1].rank)) / 2D""").alias("median_rank"),
            F.expr("aggregate(r, 0D, (s, x) -> s + x.w * x.rank) / (2D * half)").alias("mean_rank"),
            F.expr("size(own)").alias("n_lists"),
        )
    )


def first_items(order: DataFrame, n: int) -> DataFrame:
    """The first n items of each query; each task keeps at most n of a query before anything is shuffled."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("median_rank", "mean_rank", "id")
    return order.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def full_order(order: DataFrame) -> DataFrame:
    """Every item with its `place` in its query: by median rank, then mean rank, then identifier."""
    key = order.withColumn("key", F.struct("median_rank", "mean_rank", "id"))
    return rank_values(key, ["query_id"], "key").select(
        "query_id",
        "key.id",
        (F.col("n_before") + 1).alias("place"),
        F.round("key.median_rank", 6).alias("median_rank"),
        F.round("key.mean_rank", 6).alias("mean_rank"),
    )
