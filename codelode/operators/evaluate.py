"""Retrieval evaluation: recall, reciprocal rank and discounted gain of ranked answers, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank): best rank of a hit (query_id, item, rank) that is relevant (query_id, item); null for a miss."""
    found = hits.join(relevant.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left")


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: recall at each k, mean reciprocal rank, binary nDCG at 10, queries and the 95th percentile of the rank."""
    r = F.col("rank")
    p95 = F.sort_array(F.collect_list(r))
    return ranks.agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(r <= 10, 1.0 / F.log2(r + 1)).otherwise(0.0)), 6).alias("ndcg_10"),
        F.get(p95, (F.ceil(0.95 * F.size(p95)) - 1).cast("int")).alias("p95_rank"),
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, rank_a, rank_b, outcome): win, loss or tie of b against a; a miss is worse than any rank."""
    both = a.select("query_id", F.col("rank").alias("rank_a")).join(b.select("query_id", F.col("rank").alias("rank_b")), "query_id", "full")
    ra, rb = F.coalesce("rank_a", F.lit(1 << 30)), F.coalesce("rank_b", F.lit(1 << 30))
    return both.withColumn("outcome", F.when(rb < ra, "win").when(rb > ra, "loss").otherwise("tie"))
