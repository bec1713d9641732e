"""Scoring and shaping of search hits, as one declarative pipeline over a bounded pool.

A hit is (query_id, project, file, score, symbol, symbol_type, lang, start_line, end_line, snippet). All windows are
partitioned by query, so many queries are shaped in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import class_weight, is_data
from ..functions.text import query_tokens, subtokens

# Magnitudes of the adjustments, and the words by which queries ask for tests or data.
DEFINITION_BOOST, LEXICAL_WEIGHT, DATA_PENALTY, DATA_SHARE = 0.02, 0.25, 0.03, 0.4
SYMBOL_BOOST, FUZZY_BOOST, PATH_BOOST, REPEAT_PENALTY, RERANK_POOL = 0.04, 0.02, 0.02, 0.03, 30
RRF_K, MERGE_GAP = 60, 2
TEST_WORDS = ("fixture", "fixtures", "spec", "specs", "test", "tests", "testing", "unittest", "unittests")
DATA_WORDS = ("json", "yaml", "yml", "toml")


def identity() -> list[Column]:
    """Total tie-break of hits."""
    return [F.coalesce("project", F.lit("")), F.coalesce("file", F.lit("")), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)), F.coalesce("symbol", F.lit(""))]


def score_order() -> list[Column]:
    return [F.desc("score"), *identity()]


def positions(hits: DataFrame, *order: Column) -> DataFrame:
    """``pos`` from 1 per query."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or score_order()))))


def lexical_overlap(query: Column, symbol: Column, file: Column, snippet: Column) -> Column:
    """Share of the query's distinct tokens found, and 0.5 if one is part of the symbol's name."""
    wanted = F.array_distinct(query_tokens(query))
    have = query_tokens(F.concat_ws(" ", symbol, file, snippet))
    bonus = F.when(F.exists(wanted, lambda t: F.lower(F.coalesce(symbol, F.lit(""))).contains(t)), 0.5).otherwise(0.0)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, have)) / F.size(wanted) + bonus)


def boost_definitions(hits: DataFrame) -> DataFrame:
    delta = F.when(F.coalesce("symbol", F.lit("")) != "", DEFINITION_BOOST).otherwise(0.0)
    return hits.withColumn("score", F.round(F.col("score") + delta, 4))


def fuse_lexical(hits: DataFrame, query: Column, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    lex = F.round(lexical_overlap(query, F.col("symbol"), F.col("file"), F.col("snippet")), 4)
    return hits.withColumn("lexical_score", lex).withColumn("score", F.round(F.col("score") + weight * F.col("lexical_score"), 4))


def _asks(query: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(query_tokens(query), F.array(*[F.lit(w) for w in words]))


def penalise_data(hits: DataFrame, query: Column) -> DataFrame:
    hit = is_data(F.col("file"), F.col("lang")) & ~_asks(query, DATA_WORDS)
    return hits.withColumn("score", F.round(F.col("score") - F.when(hit, DATA_PENALTY).otherwise(0.0), 4))


def cap_data(hits: DataFrame, query: Column, limit: int) -> DataFrame:
    """Data hits beyond the share of the window go behind all others; order among each stays."""
    data = is_data(F.col("file"), F.col("lang")) & ~_asks(query, DATA_WORDS)
    w = Window.partitionBy("query_id", "data").orderBy("pos")
    flagged = hits.withColumn("data", data).withColumn("over", (F.col("data") & (F.row_number().over(w) > max(1, int(limit * DATA_SHARE)))).cast("int"))
    return positions(flagged, F.col("over"), F.col("pos")).drop("data", "over")


def rerank(hits: DataFrame, query: Column, pool: int = RERANK_POOL) -> DataFrame:
    """Token-overlap reranking of the first ``pool`` hits; the rest keep their places behind."""
    tokens = F.array_distinct(query_tokens(query))
    parts = F.array_distinct(F.flatten(F.transform(tokens, subtokens)))
    symbol = F.coalesce("symbol", F.lit(""))
    boost = F.when(F.arrays_overlap(query_tokens(symbol), tokens), SYMBOL_BOOST).when(F.arrays_overlap(subtokens(symbol), parts), FUZZY_BOOST).otherwise(0.0)
    boost = boost + F.when(F.arrays_overlap(query_tokens(F.lower(F.coalesce("file", F.lit("")))), tokens), PATH_BOOST).otherwise(0.0)
    nth = F.row_number().over(Window.partitionBy("query_id", "project", "file").orderBy("pos"))
    first = hits.where(F.col("pos") <= pool).withColumn("nth", nth)
    delta = F.round(boost - F.when(F.col("nth") >= 3, REPEAT_PENALTY).otherwise(0.0), 4)
    first = first.withColumn("score", F.round(F.col("score") + F.when(F.size(tokens) > 0, delta).otherwise(0.0), 4)).drop("nth")
    again = first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("file", F.lit("")), F.coalesce("start_line", F.lit(0)), "pos")))
    return again.unionByName(hits.where(F.col("pos") > pool))


def class_order(hits: DataFrame, query: Column) -> DataFrame:
    """Stable order by file class; tests count as source for queries about tests."""
    w = class_weight(F.col("file"))
    return positions(hits.withColumn("rung", F.when((w == 2) & _asks(query, TEST_WORDS), 0).otherwise(w)), F.col("rung"), F.col("pos"))


def reciprocal_rank(lists: DataFrame, limit: int) -> DataFrame:
    """Fusion of ranked lists (query_id, list, project, file, start_line, pos): score is the sum of 1 / (60 + rank)."""
    fused = lists.groupBy("query_id", "project", "file", "start_line").agg(F.round(F.sum(1.0 / (RRF_K + F.col("pos"))), 6).alias("score"), F.sort_array(F.collect_list("pos")).alias("rank_positions"))
    ranked = fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "project", "file", "start_line")))
    return ranked.where(F.col("pos") <= max(1, limit))


def islands(hits: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """``island``: hits of one file whose line ranges touch or lie within ``gap`` lines; hits without a range are alone."""
    ranged = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    first, last = F.when(ranged, F.col("start_line")), F.when(ranged, F.col("end_line"))
    w = Window.partitionBy("query_id", "project", "file").orderBy(first, last, "pos")
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = hits.withColumn("new", F.when(ranged, F.coalesce((first > before + gap + 1).cast("int"), F.lit(1))).otherwise(1))
    return flagged.withColumn("island", F.sum("new").over(w)).drop("new")


def merge_overlapping(hits: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """One hit per island: united range, the best member's score and snippet, distinct symbols, number of members."""
    grouped = islands(hits, gap).groupBy("query_id", "project", "file", "island")
    best = F.struct((-F.col("score")).alias("s"), "pos")
    merged = grouped.agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.count(F.lit(1)).alias("merged_count"), F.min("pos").alias("first_pos"),
        F.min_by("snippet", best).alias("snippet"), F.min_by("lang", best).alias("lang"),
        F.array_join(F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "pos", "symbol"))), lambda x: F.coalesce(x["symbol"], F.lit("")) != ""), lambda x: x["symbol"])), ", ").alias("symbol"),
        *([F.first("query").alias("query")] if "query" in hits.columns else []),
    )
    return positions(merged.drop("island"), F.desc("score"), F.col("project"), F.col("file"), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)), F.col("first_pos"))


def cap_per_file(hits: DataFrame, most: int) -> DataFrame:
    if most <= 0:
        return hits
    nth = F.row_number().over(Window.partitionBy("query_id", "project", "file").orderBy("pos"))
    return positions(hits.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), F.col("pos"))


def demote_repeats(hits: DataFrame) -> DataFrame:
    """Within a class, a hit that overlaps an already shown distinct range of its file goes behind the distinct ones.

    Order-dependent, so a fold over each (query, class, file)'s hits in order; the array is bounded by the pool.
    """
    rows = hits.withColumn("rung", class_weight(F.col("file")))
    hit = F.struct("pos", *[c for c in rows.columns if c not in ("pos", "query_id", "rung", "project", "file")])
    ordered = rows.groupBy("query_id", "rung", "project", "file").agg(F.array_sort(F.collect_list(hit), lambda a, b: a["pos"] - b["pos"]).alias("h"))
    empty = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("shown"), F.array().cast("array<int>").alias("repeats"))

    def step(acc: Column, x: Column) -> Column:
        ranged = x["start_line"].isNotNull() & x["end_line"].isNotNull()
        again = ranged & F.exists(acc["shown"], lambda o: (x["start_line"] <= o["e"]) & (x["end_line"] >= o["s"]))
        shown = F.when(ranged & ~again, F.concat(acc["shown"], F.array(F.struct(x["start_line"].cast("int").alias("s"), x["end_line"].cast("int").alias("e"))))).otherwise(acc["shown"])
        return F.struct(shown.alias("shown"), F.when(again, F.concat(acc["repeats"], F.array(x["pos"].cast("int")))).otherwise(acc["repeats"]).alias("repeats"))

    flagged = ordered.withColumn("r", F.aggregate("h", empty, step)["repeats"]).select("query_id", "rung", "project", "file", "r", F.explode("h").alias("x")).select("query_id", "rung", "project", "file", "r", "x.*")
    flagged = flagged.withColumn("again", F.array_contains("r", F.col("pos")).cast("int"))
    return positions(flagged, F.col("rung"), F.col("again"), F.col("pos")).select(*hits.columns)


def truncate_snippets(hits: DataFrame, budget: int, n: int) -> DataFrame:
    return hits.withColumn("snippet", F.left(F.col("snippet"), F.lit(max(100, budget // max(1, n) - 80))))


def trim_to_budget(hits: DataFrame, tokens: int) -> DataFrame:
    """Hits in order whose cost (80 and the snippet's length, 500 at most) still fits; the first always stays."""
    cost = F.lit(80) + F.least(F.length(F.coalesce("snippet", F.lit(""))), F.lit(500))
    hit = F.struct("pos", "cost", *[c for c in hits.columns if c not in ("pos", "query_id")])
    lists = hits.withColumn("cost", cost).groupBy("query_id").agg(F.array_sort(F.collect_list(hit), lambda a, b: a["pos"] - b["pos"]).alias("h"))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["cost"] <= tokens * 4)
        return F.struct((acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["pos"].cast("int")))).otherwise(acc["kept"]).alias("kept"))

    kept = lists.withColumn("k", F.aggregate("h", empty, step)["kept"]).select("query_id", "k", F.explode("h").alias("x")).select("query_id", "k", "x.*").where(F.array_contains("k", F.col("pos")))
    return positions(kept, F.col("pos")).select(*hits.columns)


def shape(hits: DataFrame, query: Column, limit: int, merge: str = "merged", per_file: int = 0, budget: int = 0) -> DataFrame:
    """The whole order: score, data cap, merge, class, repeats, per-file cap, snippets, budget, limit.

    A query's pool is sent to one place first: every window and group below is one query's, so none is sent again.
    """
    out = cap_data(positions(hits.repartition("query_id")), query, limit)
    if merge == "merged":
        out = merge_overlapping(out)
    out = demote_repeats(class_order(out, query).drop("rung"))
    out = cap_per_file(out, per_file)
    if budget:
        out = trim_to_budget(truncate_snippets(out, budget * 4, limit), budget)
    return out.where(F.col("pos") <= limit)
