"""The inverted index against the plain scan, upkeep by file, and search from text to answers."""

import random

import numpy as np
import pytest
from codelode.operators import embed, lexical, retrieve, search
from pyspark.sql import functions as F

ROWS = "scope string, doc long, content string, symbol string, path string"


def _rows(n=120, seed=3):
    rng = random.Random(seed)
    words = ["loadToken", "load_token", "reader", "cacheEntry", "HTTPServer", "parse", "x1", "token", "tokens", "écrit"]
    return [(["a", "b"][k % 2], k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice([None, "", "loadToken", "parse_all"]), f"src/{rng.choice(words)}/f{k % 40}.py") for k in range(n)]


@pytest.mark.parametrize("query", ["load token", "load_token", "HTTPServer parse", "tok", "loadtoken x1 x1", "nothing_here", "!!", "a_b_ __ reader"])
def test_index_equals_a_scan_of_the_corpus(spark, query):
    df = spark.createDataFrame(_rows(), ROWS)
    index = lexical.indexed(df.withColumn("scope", F.lit("")))
    got = [(r.doc, r.score) for r in lexical.bm25(index, spark.createDataFrame([(7, query)], "query_id long, query string"), 15).orderBy("pos").collect()]
    want = [(r.doc, r.score) for r in search.bm25(df, query, 15, ("doc",)).collect()]
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


def test_terms_equal_those_of_the_columns(spark):
    from codelode.functions.text import terms

    texts = ["", "fooBar_baz HTTPServer2x a__b _x_ 12ab AB foo FOO foo", "éclair naïveTest x", "A1b2C3 __init__ snake_case_Name x.y->z()", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in rows.select("t", terms(F.coalesce("t", F.lit(""))).alias("w")).collect():
        assert lexical.term_list(r.t) == r.w, r.t


def test_scopes_have_their_own_statistics_and_many_queries_run_at_once(spark):
    df = spark.createDataFrame(_rows(), ROWS)
    queries = spark.createDataFrame([(1, "load token"), (2, "parse"), (3, None), (4, "")], "query_id long, query string")
    got = {(r.query_id, r.scope, r.doc): r.score for r in lexical.bm25(lexical.indexed(df), queries, 10).collect()}
    for query_id, query in ((1, "load token"), (2, "parse")):
        for scope in "ab":
            want = {(query_id, scope, r.doc): r.score for r in search.bm25(df.where(F.col("scope") == scope), query, 10, ("doc",)).collect()}
            mine = {k: v for k, v in got.items() if k[:2] == (query_id, scope)}
            assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 2e-6 for k in want)
    assert {k[0] for k in got} == {1, 2}
    empty = lexical.indexed(spark.createDataFrame([], ROWS))
    assert lexical.bm25(empty, queries, 10).count() == 0


def test_added_files_are_replaced_and_purged_ones_gone(spark):
    df = spark.createDataFrame(_rows(), ROWS)
    index = lexical.indexed(df)
    files = df.where("path LIKE '%f1.py'").select("scope", "path")
    q = spark.createDataFrame([(1, "load token parse reader")], "query_id long, query string")
    rest = lexical.purged(index, files)
    want = lexical.indexed(df.join(files.distinct(), ["scope", "path"], "left_anti").select(*ROWS.replace(" string", "").replace(" long", "").split(", ")))
    rows = lambda x: sorted((r.doc, r.score) for r in lexical.bm25(x, q, 200).collect())
    assert rows(rest) == rows(want)
    again = lexical.added(rest, df.where("path LIKE '%f1.py'"))
    assert rows(lexical.added(again, df.where("path LIKE '%f1.py'"))) == rows(index)


def test_nearest_in_scopes_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8)).astype("<f2")
    rows = [("pq"[k % 2], k, bytearray(m[k].tobytes())) for k in range(200)]
    got = {}
    for r in retrieve.nearest_in_scopes(spark.createDataFrame(rows, "scope string, doc long, vec binary"), spark.createDataFrame([(5, bytearray(m[5].tobytes())), (6, None)], "query_id long, vec binary"), 7).orderBy("pos").collect():
        got.setdefault(r.scope, []).append(r.doc)
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u[5], 4)
    for k, scope in enumerate("pq"):
        assert got[scope] == sorted(range(k, 200, 2), key=lambda x: (-s[x], x))[:7]


def test_search_from_text_to_answers(spark):
    chunk = "chunk_id long, project string, file string, chunk_index int, start_line int, end_line int, symbol string, symbol_type string, text string"
    chunks, symbols = [], []
    for p in ("p1", "p2"):
        for k in range(12):
            name = f"handle_{['order', 'cache', 'token'][k % 3]}_{k}"
            base = 0 if p == "p1" else 100
            chunks.append((base + k, p, f"src/m{k}.py", 0, 1, 9, name, "function", f"def {name}(request):\n    return {['order', 'cache', 'token'][k % 3]}.read(request)"))
            symbols.append((base + k, p, f"src/m{k}.py", name, "function", "python", 1, 9, "ast"))
        chunks.append((base + 50, p, "data/words.json", 0, 1, 2, None, None, '{"token": "token token token"}'))
    chunks_df = spark.createDataFrame(chunks, chunk)
    symbols_df = spark.createDataFrame(symbols, "id long, project string, file string, name string, symbol_type string, language string, start_line int, end_line int, source string")
    files = chunks_df.select("project", F.col("file").alias("path"), F.when(F.col("file").endswith("json"), "json").otherwise("python").alias("language"))
    hashed = embed.hash_embedder(32)
    vectors = embed.embedded(chunks_df.select("chunk_id", "text"), "chunk_id", hashed).join(chunks_df.select("chunk_id", "project"), "chunk_id").select(F.col("project").alias("scope"), F.col("chunk_id").alias("doc"), "vec")
    index = lexical.indexed(chunks_df.select(F.col("project").alias("scope"), F.col("chunk_id").alias("doc"), F.col("text").alias("content"), "symbol", F.col("file").alias("path")))
    queries = spark.createDataFrame([(1, "handle_token_5"), (2, "where is the cache read"), (3, "zzzz")], "query_id long, query string")
    got: dict[int, list] = {}
    for r in retrieve.search(chunks_df, symbols_df, files, index, vectors, queries, hashed, 6).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r)
    assert [r.symbol for r in got[1][:2]] == ["handle_token_5"] * 2 and {r.project for r in got[1][:2]} == {"p1", "p2"} and got[1][0].score == 2.0
    assert all("cache" in (r.symbol or "") for r in got[2][:4]) and {r.project for r in got[2]} == {"p1", "p2"}
    assert all(len(v) <= 6 and [r.pos for r in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_lexical_hits_stand_at_the_symbol_they_name(spark):
    hits = spark.createDataFrame([(1, "p", "a.py", "run, other", 1), (1, "p", "a.py", "nothing", 2), (1, "p", "b.py", None, 3), (1, "p", "c.py", "x", 4)], "query_id long, project string, file string, symbol string, pos int")
    symbols = spark.createDataFrame([(3, "p", "a.py", "A.run", "method", 8, 9), (2, "p", "a.py", "rerun", "function", 20, 30), (1, "p", "b.py", "z", "class", 2, 40)], "id long, project string, file string, name string, symbol_type string, start_line int, end_line int")
    got = {r.pos: (r.symbol, r.symbol_type, r.start_line, r.end_line) for r in retrieve.anchored(hits, symbols).collect()}
    assert got == {1: ("A.run", "method", 8, 9), 2: (None, None, 1, 30), 3: (None, None, 1, 40), 4: (None, None, 1, 1)}
