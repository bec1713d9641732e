"""Search from text to shaped answers: BM25 and vectors in every project, fused, exact symbols first, shaped.

Every project is searched on its own (ranks and statistics are its own), so a search over all projects is the same plan with
more rows. Pools are bounded by their fetch size before they are joined to anything wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from .embed import Embed, embedded
from .lexical import LexicalIndex, bm25
from .search import CELLS, QUERY_BLOCK, fetch_size
from .shaping import RRF_K, boost_definitions, cap_data, penalise_data, positions, shape

#: Exact symbol hits that go first, and their score.
PINNED, PIN_SCORE = 3, 2.0


def anchored(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Lexical hits (query_id, project, file, symbol, pos) at the range of the symbol they name, else at the file's head.

    A hit names a symbol of its file if the first of its comma-separated names is part of the symbol's name; the first in
    the file's order counts. Without one the range is line 1 to the end of the file's last symbol, with no symbol.
    """
    rows = symbols.select("project", "file", "id", "name", "symbol_type", "start_line", "end_line")
    met = hits.select("query_id", "project", "file", "pos", F.substring_index("symbol", ", ", 1).alias("wanted")).join(rows, ["project", "file"], "left")
    named = (F.col("wanted") != "") & F.col("name").contains(F.col("wanted"))
    first = F.min(F.when(named, F.struct("start_line", "id", "end_line", "name", "symbol_type"))).alias("s")
    one = met.groupBy("query_id", "project", "file", "pos").agg(first, F.greatest(F.max("end_line"), F.lit(1)).alias("last"))
    return one.select(
        "query_id", "project", "file", "pos", F.col("s.name").alias("symbol"), "s.symbol_type", F.coalesce("s.start_line", F.lit(1)).cast("int").alias("start_line"),
        F.when(F.col("s").isNotNull(), F.col("s.end_line")).otherwise(F.coalesce("last", F.lit(1))).cast("int").alias("end_line"),
    )


def nearest_in_scopes(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, scope, doc, score, pos): exact cosine top-k of (scope, doc, vec) in every scope for (query_id, vec).

    ``vec`` holds float16 bytes. At most ``QUERY_BLOCK`` queries are sent to the tasks; more are asked in turn.
    """
    rows = queries.where("vec IS NOT NULL").select("query_id", "vec").limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries at once")
    out = "query_id bigint, scope string, doc bigint, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], out + ", pos int")
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    asked = np.stack([np.frombuffer(bytes(r["vec"]), dtype="<f2").astype(np.float64) for r in rows])
    norm = np.linalg.norm(asked, axis=1, keepdims=True)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, asked / np.where(norm == 0, 1, norm)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            scopes = np.array(b.column(0).to_pylist(), dtype=object)
            doc, m = b.column(1).to_numpy(), np.stack([np.frombuffer(x, dtype="<f2").astype(np.float64) for x in b.column(2).to_pylist()]) if b.num_rows else None
            if m is None:
                continue
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norms == 0, 1, norms)
            for scope in set(scopes):
                at = np.flatnonzero(scopes == scope)
                for block in np.array_split(np.arange(len(q)), -(-len(q) * len(at) // CELLS)):
                    s = np.round(q[block] @ m[at].T, 4)
                    k = min(limit, len(at))
                    floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(s >= floor[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[block][i]), pa.array([scope] * len(i), pa.string()), pa.array(doc[at][j]), pa.array(s[i, j])], names=["query_id", "scope", "doc", "score"])

    scored = vectors.where("vec IS NOT NULL").select("scope", "doc", "vec").mapInArrow(run, out)
    best = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "doc")
    return scored.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= limit)


def fused(dense: DataFrame, lexical: DataFrame, most: int) -> DataFrame:
    """(query_id, project, file, start_line, score, details): reciprocal ranks of two ranked lists within each project.

    A place found by both lists keeps the details of the dense one.
    """
    key = ["query_id", "project", "file", "start_line"]
    details = F.struct("symbol", "symbol_type", "lang", "end_line", "snippet")
    both = dense.select(*key, "pos", F.lit(0).alias("list"), details.alias("details")).unionByName(lexical.select(*key, "pos", F.lit(1).alias("list"), details.alias("details")))
    one = both.groupBy(*key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("pos"))), 6).alias("score"), F.min_by("details", F.struct("list", "pos")).alias("details"))
    order = Window.partitionBy("query_id", "project").orderBy(F.desc("score"), "file", "start_line")
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def exact_symbols(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Up to three symbols of each project that an identifier-shaped query names, case of ASCII letters aside."""
    asked = queries.select("query_id", F.trim("query").alias("q")).where(F.col("q").rlike(r"^[A-Za-z_][\w:.]*$")).select("query_id", F.lower("q").alias("folded"))
    met = symbols.where("name IS NOT NULL").withColumn("folded", F.lower("name")).join(F.broadcast(asked), "folded")  # one short row for each query of a checked block
    order = Window.partitionBy("query_id", "project").orderBy(F.when(F.col("source") == "ast", 0).otherwise(1), "file", "start_line", "id")
    first = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PINNED)
    return first.select(
        "query_id", "project", "file", F.col("start_line").cast("int").alias("start_line"), F.lit(PIN_SCORE).alias("score"),
        F.struct(F.col("name").alias("symbol"), "symbol_type", F.col("language").alias("lang"), F.col("end_line").cast("int").alias("end_line"), F.concat(F.lit("exact symbol match: "), "name").alias("snippet")).alias("details"),
    )


def search(chunks: DataFrame, symbols: DataFrame, files: DataFrame, index: LexicalIndex, vectors: DataFrame, queries: DataFrame, embed: Embed, limit: int = 10, per_file: int = 3, budget: int = 2000) -> DataFrame:
    """Shaped answers of every (query_id, query) over all projects of ``index`` and ``vectors`` (scope = project).

    Modes are parts of it: ``bm25`` alone is the lexical one, ``nearest_in_scopes`` the dense one, this the hybrid one.
    """
    fetch = fetch_size(limit)
    queries = durable(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query"))
    if queries.count() > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries at once")
    rows = chunks.select(F.col("chunk_id").alias("doc"), "project", "file", "start_line", "end_line", "symbol", "symbol_type", F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("snippet"))
    language = files.select("project", F.col("path").alias("file"), F.col("language").alias("lang"))
    near = nearest_in_scopes(vectors, embedded(queries.select("query_id", F.col("query").alias("text")), "query_id", embed), fetch)
    dense = near.drop("pos").join(rows, "doc").where("scope = project").join(language, ["project", "file"], "left").join(F.broadcast(queries), "query_id")  # at most QUERY_BLOCK rows
    dense = penalise_data(boost_definitions(dense), F.col("query")).withColumn("query_id", F.struct("query_id", "project"))
    dense = cap_data(positions(dense), F.col("query"), limit).withColumn("query_id", F.col("query_id.query_id"))
    words = bm25(index, queries, fetch).join(rows.select("doc", "project", "file", "symbol"), "doc").where("scope = project")
    lexical = anchored(words, symbols).join(language, ["project", "file"], "left").withColumn("snippet", F.concat_ws("", F.lit("lexical match: "), "file"))
    pool = fused(dense, lexical, limit * 3).unionByName(exact_symbols(queries, symbols))
    hits = pool.groupBy("query_id", "project", "file", "start_line").agg(F.max_by(F.struct("score", "details"), "score").alias("h"))
    hits = hits.select("query_id", "project", "file", "start_line", "h.score", "h.details.*").join(F.broadcast(queries), "query_id")  # at most QUERY_BLOCK rows
    return shape(hits, F.col("query"), limit, per_file=per_file, budget=budget)
