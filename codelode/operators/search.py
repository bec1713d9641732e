"""Lexical, vector and fused retrieval.

Query sets are relations, so many queries run in one pass over the corpus. BM25 streams over the text with two small
aggregates and a top-k; where the same corpus is searched often, ``postings`` gives the stored inverted index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from ..functions.text import terms
from .shaping import reciprocal_rank

#: BM25 constants, column weights of content, symbol and path, and terms of a query that are used.
K1, B, WEIGHTS, MOST_TERMS = 1.2, 0.75, (1.0, 8.0, 4.0), 12
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 20_000
#: Similarities that a matrix product gives at once.
CELLS = 1 << 21
#: Least number of candidates fetched per answer.
LEAST_FETCH = 24


def match_phrases(query: str) -> list[str]:
    """The last twelve tokens of a query, each as the phrase of its underscore parts; its last part is a prefix."""
    import re

    tokens = re.findall(r"[A-Za-z0-9_]+", query)[-MOST_TERMS:]
    return [" ".join(p for p in t.lower().split("_") if p) for t in tokens if t.strip("_")]


def term_string(column: Column) -> Column:
    """The column's index terms with blanks around each, so that phrases and prefixes are substrings."""
    return F.concat(F.lit(" "), F.array_join(terms(F.coalesce(column, F.lit(""))), " "), F.lit(" "))


def _count(haystack: Column, phrase: str) -> Column:
    needle = f" {phrase}"
    return (F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)


def bm25(docs: DataFrame, query: str, limit: int, key: tuple[str, ...]) -> DataFrame:
    """Top documents (content, symbol, path and ``key`` columns) by weighted BM25; the score is positive, larger better.

    Ties go by ``key``. Documents without any term of the query aren't answers.
    """
    phrases = match_phrases(query)
    if not phrases:
        return docs.select(*key).withColumn("score", F.lit(0.0)).limit(0)
    strings = docs.select(*key, *[term_string(F.col(c)).alias(f"t_{c}") for c in ("content", "symbol", "path")])
    # Only lengths and counts go on: they are stored, so that the texts are read and tokenized once.
    counted = strings.select(
        *key,
        sum((F.greatest(F.length(f"t_{c}") - F.length(F.replace(F.col(f"t_{c}"), F.lit(" "), F.lit(""))) - 1, F.lit(0)) * (F.trim(f"t_{c}") != "").cast("int") for c in ("content", "symbol", "path")), F.lit(0)).alias("len"),
        *[sum((_count(F.col(f"t_{c}"), p) * w for c, w in zip(("content", "symbol", "path"), WEIGHTS)), F.lit(0.0)).alias(f"f{k}") for k, p in enumerate(phrases)],
    )
    counted = durable(counted)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"f{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(phrases))])
    scored = counted.where(sum((F.col(f"f{k}") for k in range(len(phrases))), F.lit(0.0)) > 0)
    row = stats.first()

    def part(k: int) -> Column:
        df = row[f"df{k}"] or 0
        idf = max(math.log((row["n"] - df + 0.5) / (df + 0.5)), 1e-6)
        tf = F.col(f"f{k}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (row["avgdl"] or 1.0)))

    return scored.select(*key, F.round(sum((part(k) for k in range(len(phrases))), F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), *key).limit(limit)


def postings(docs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(term, key..., tf): the inverted index of a ``content`` column, combined before it is shuffled."""
    return docs.select(*key, F.explode(terms(F.coalesce("content", F.lit("")))).alias("term")).groupBy("term", *key).agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(terms(F.coalesce("content", F.lit(""))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexical_hits(ranked: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """Answers with the score that fusion uses: 1 / (60 + rank)."""
    w = Window.orderBy(*order)  # over at most the limit's rows
    return ranked.withColumn("pos", F.row_number().over(w)).withColumn("hit_score", F.round(1.0 / (60 + F.col("pos")), 6))


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine top-k of a stated query set against all rows, in blocks.

    Queries (query_id, embedding) are sent to the tasks in blocks of bounded size, each block of rows is multiplied with
    all of a block's queries, and only the best ``limit`` of each go on.
    """
    n = queries.count()
    if n > QUERY_BLOCK:
        blocks = -(-n // (QUERY_BLOCK // 2))  # hash blocks differ in size
        part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        parts = [nearest(vectors, queries.where(part == k), limit) for k in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    rows = queries.select("query_id", "embedding").collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    ids = np.array([r["query_id"] for r in rows])
    q = np.array([r["embedding"] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            k = min(limit, len(v))
            for block in np.array_split(np.arange(len(q)), -(-len(q) * len(v) // CELLS)):
                s = np.round(q[block] @ v.T, 6)
                # ties at the last place are all kept here; the final order decides by id
                floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero(s >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[block][i]), b.column(0).take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    usable = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size("embedding") == len(rows[0]["embedding"])).where("exists(embedding, x -> x != 0)")
    return _top(usable.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id bigint, vec_id bigint, score double"), limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fetch_size(limit: int) -> int:
    return max(limit * 3, LEAST_FETCH)


def hybrid(dense: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Fusion of two ranked lists (query_id, project, file, start_line, pos)."""
    lists = dense.withColumn("list", F.lit("dense")).unionByName(lexical.withColumn("list", F.lit("lexical")))
    return reciprocal_rank(lists, limit * 3)


def pin_exact(fused: DataFrame, exact: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` exact symbol hits before all others, with score 2."""
    w = Window.partitionBy("query_id").orderBy("project", "file", "start_line")
    pinned = exact.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "project", "file", "start_line", F.lit(2.0).alias("score"))
    rest = fused.select("query_id", "project", "file", "start_line", "score").join(pinned, ["query_id", "project", "file", "start_line"], "left_anti")
    both = pinned.unionByName(rest)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "project", "file", "start_line")))
