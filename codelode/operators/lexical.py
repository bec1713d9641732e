"""An inverted index over content, symbol and path, and BM25 for many queries at once.

The index is two tables: documents with their term strings, and postings. It is built once, added to and purged by file,
and a query reads only the postings of its terms and the documents these name. Documents belong to a scope (a project, or
all of them to one): counts, lengths and document frequencies are those of the scope.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch, durable, maybe_broadcast
from ..functions.text import SUBTOKEN
from .search import K1, MOST_TERMS, WEIGHTS, B

COLUMNS = ("content", "symbol", "path")


class LexicalIndex(NamedTuple):
    documents: DataFrame
    """(scope, doc, path, len, t_content, t_symbol, t_path): term strings have a blank around each term."""
    postings: DataFrame
    """(term, scope, doc)."""


_RAW, _PART, _PLAIN = re.compile(r"[A-Za-z0-9_]+"), re.compile(SUBTOKEN), re.compile(r"[a-z]+|[0-9]+")


@lru_cache(maxsize=1 << 17)
def _expanded(token: str) -> tuple[str, ...]:
    """A token and its parts, as ``index_tokens`` has them; tokens repeat so much that most are found in the cache."""
    if _PLAIN.fullmatch(token):
        return (token,)
    out = [token]
    for piece in filter(None, token.split("_")):
        parts = _PART.findall(piece)
        out += [p.lower() for p in parts] if len(parts) > 1 else parts if piece != token else []
    return tuple(out)


def term_list(text: str | None) -> list[str]:
    """``functions.text.terms`` of one text."""
    found = dict.fromkeys(e for t in dict.fromkeys(_RAW.findall(text or "")) for e in _expanded(t))
    return [p for e in found for p in e.lower().split("_") if p]


def indexed(rows: DataFrame) -> LexicalIndex:
    """Of (scope, doc, content, symbol, path) rows, one per (scope, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[term_list(t) for t in b.column(k).to_pylist()] for k in (2, 3, 4)]
            strings = [pa.array([f" {' '.join(x)} " for x in column], pa.string()) for column in lists]
            size = pa.array([sum(map(len, x)) for x in zip(*lists)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), size, *strings], names=names)

    names = ["scope", "doc", "path", "len", *[f"t_{c}" for c in COLUMNS]]
    documents = rows.select("scope", "doc", *COLUMNS).mapInArrow(run, "scope string, doc bigint, path string, len int, t_content string, t_symbol string, t_path string")
    stored = Scratch(rows.sparkSession).write(documents, "documents")
    return LexicalIndex(stored, postings_of(stored))


def postings_of(documents: DataFrame) -> DataFrame:
    """Postings of documents, stored by ranges of terms so that a query reads few files."""
    words = F.array_distinct(F.split(F.trim(F.concat(*[f"t_{c}" for c in COLUMNS])), " +"))
    pairs = documents.select(F.explode(words).alias("term"), "scope", "doc").where("term != ''")
    return Scratch(documents.sparkSession).write(pairs.sortWithinPartitions("term"), "postings")


def purged(index: LexicalIndex, files: DataFrame) -> LexicalIndex:
    """Without the documents of the (scope, path) rows."""
    gone = index.documents.join(files.select("scope", "path").distinct(), ["scope", "path"], "left_semi").select("scope", "doc")
    return LexicalIndex(index.documents.join(files.select("scope", "path").distinct(), ["scope", "path"], "left_anti"), index.postings.join(gone, ["scope", "doc"], "left_anti").select("term", "scope", "doc"))


def added(index: LexicalIndex, rows: DataFrame) -> LexicalIndex:
    """With new rows; documents of the same files are replaced, so that none stands twice."""
    kept, new = purged(index, rows), indexed(rows)
    return LexicalIndex(kept.documents.unionByName(new.documents), kept.postings.unionByName(new.postings))


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, n, phrase): the last terms of each query, each as the phrase of its underscore parts, the last a prefix."""
    tokens = F.regexp_extract_all("query", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    last = F.slice(tokens, F.greatest(F.size(tokens) - MOST_TERMS + 1, F.lit(1)), MOST_TERMS)
    phrase = F.array_join(F.filter(F.split(F.lower("t"), "_"), lambda p: p != ""), " ")
    return queries.where("query IS NOT NULL").select("query_id", F.posexplode(last).alias("n", "t")).select("query_id", "n", phrase.alias("phrase")).where("phrase != ''")


def bm25(index: LexicalIndex, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, scope, doc, score, pos): the best documents of every scope for each (query_id, query).

    Ties go to the smaller ``doc``; documents without any term of a query aren't answers.
    """
    asked = durable(phrases(queries))
    wanted = asked.select("phrase").distinct().withColumn("head", F.substring_index("phrase", " ", 1)).withColumn("alone", ~F.col("phrase").contains(" "))
    n = asked.count()
    # The distinct terms are few beside the postings; each is met by its prefixes.
    lexicon = index.postings.select("term").distinct().select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.left(F.col("term"), k))).alias("head"))
    reached = durable(lexicon.join(maybe_broadcast(wanted, n, 200), "head").where("alone OR term = head").select("term", "phrase"))
    candidates = index.postings.join(maybe_broadcast(reached, reached.count(), 100), "term").select("scope", "doc", "phrase").distinct()
    found = candidates.join(index.documents, ["scope", "doc"])

    def times(c: str):
        needle = F.concat(F.lit(" "), F.col("phrase"))
        return (F.length(f"t_{c}") - F.length(F.replace(F.col(f"t_{c}"), needle, F.lit("")))) / F.length(needle)

    weighed = durable(found.select("scope", "doc", "phrase", "len", sum((times(c) * w for c, w in zip(COLUMNS, WEIGHTS)), F.lit(0.0)).alias("f")).where("f > 0"))
    scopes = index.documents.groupBy("scope").agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("avgdl"))
    df = weighed.groupBy("scope", "phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    facts = df.join(scopes, "scope").select("scope", "phrase", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.greatest("avgdl", F.lit(1e-9))))
    parts = weighed.join(facts, ["scope", "phrase"]).select("scope", "doc", "phrase", part.alias("part"))
    scored = parts.join(maybe_broadcast(asked, n, 200), "phrase").groupBy("query_id", "scope", "doc").agg(F.round(F.sum("part"), 6).alias("score"))
    best = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "doc")
    return scored.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= limit)

