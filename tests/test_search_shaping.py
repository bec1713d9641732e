"""Search and shaping against plain Python models."""

import math
import random

from pyspark.sql import functions as F

from codelode.operators import evaluate, search, shaping

HIT = "query_id int, project string, file string, score double, symbol string, symbol_type string, lang string, start_line int, end_line int, snippet string, pos int"


def _pool(rng, n=40):
    rows = []
    for k in range(n):
        a = rng.randint(1, 60) if rng.random() > 0.1 else None
        rows.append((k % 2, "p", rng.choice(["src/a.py", "tests/t.py", "d.json", "docs/x.md"]), round(rng.random(), 4), rng.choice([None, "load", "tokenTest"]), "function", rng.choice(["python", "json"]), a, a and a + rng.randint(0, 8), "x" * rng.randint(0, 600)))
    return rows


def _hits(spark, rows):
    return shaping.positions(spark.createDataFrame([(*r, 0) for r in rows], HIT).drop("pos"))


def test_repeat_demotion_and_budget_equal_plain_folds(spark):
    for seed in range(2):
        hits = _hits(spark, _pool(random.Random(seed)))
        rows = sorted((r.asDict() for r in hits.collect()), key=lambda r: (r["query_id"], r["pos"]))
        weight = {"src/a.py": 0, "tests/t.py": 2, "d.json": 0, "docs/x.md": 3}
        expected = []
        for q in (0, 1):
            mine = [r for r in rows if r["query_id"] == q]
            seen, keyed = {}, []
            for r in sorted(mine, key=lambda r: (weight[r["file"]], r["pos"])):
                ranges = seen.setdefault((weight[r["file"]], r["file"]), [])
                again = r["start_line"] is not None and any(r["start_line"] <= e and r["end_line"] >= s for s, e in ranges)
                if r["start_line"] is not None and not again:
                    ranges.append((r["start_line"], r["end_line"]))
                keyed.append((weight[r["file"]], again, r["pos"]))
            expected += [(q, k[2], n) for n, k in enumerate(sorted(keyed), 1)]
        marked = hits.withColumn("old", F.col("pos"))
        got = sorted((r.query_id, r.old, r.pos) for r in shaping.demote_repeats(marked).collect())
        assert got == sorted(expected)
        budget, kept = 300, []
        for q in (0, 1):
            used, n = 0, 0
            for r in [r for r in rows if r["query_id"] == q]:
                cost = 80 + min(len(r["snippet"]), 500)
                if n == 0 or used + cost <= budget * 4:
                    used, n = used + cost, n + 1
                    kept.append((q, r["pos"]))
        assert sorted((r.query_id, r.old) for r in shaping.trim_to_budget(marked, budget).collect()) == sorted(kept)


def test_merge_adjacent_ranges(spark):
    rows = [(0, "p", "a", 0.5, "x", "f", "python", 1, 5, "one"), (0, "p", "a", 0.9, "y", "f", "python", 8, 10, "two"), (0, "p", "a", 0.4, None, "f", "python", 14, 15, "three"), (0, "p", "a", 0.3, "z", "f", "python", None, None, "four")]
    got = sorted((r.start_line or 0, r.end_line, r.score, r.symbol, r.snippet, r.merged_count) for r in shaping.merge_overlapping(_hits(spark, rows)).collect())
    assert got == [(0, None, 0.3, "z", "four", 1), (1, 10, 0.9, "x, y", "two", 2), (14, 15, 0.4, "", "three", 1)]


def test_data_share_and_waivers(spark):
    rows = [(0, "p", "telemetry/run%d.json" % k, 0.536, None, None, "json", 1, 2, "") for k in range(5)] + [(0, "p", "src/m%d.py" % k, 0.5 - k / 100, "f", "function", "python", 1, 2, "") for k in range(4)]
    hits = _hits(spark, rows)
    top = [r.lang for r in shaping.cap_data(hits, F.lit("summarise metrics"), 5).where("pos <= 5").orderBy("pos").collect()]
    assert top.count("json") == 2
    assert [r.lang for r in shaping.cap_data(hits, F.lit("the json files"), 5).where("pos <= 5").collect()].count("json") == 5


def test_bm25_equals_plain_formula(spark):
    rng = random.Random(4)
    words = ["load", "token", "cache", "tokens", "loader", "x", "index_map"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["loadCache", None]), f"src/{rng.choice(words)}.py") for k in range(40)]
    df = spark.createDataFrame(docs, "id int, content string, symbol string, path string")
    strings = {r.id: [r.c, r.s, r.p] for r in df.select("id", *[search.term_string(F.col(a)).alias(b) for a, b in (("content", "c"), ("symbol", "s"), ("path", "p"))]).collect()}
    phrases = search.match_phrases("load index_map zzz")
    assert phrases == ["load", "index map", "zzz"]
    length = {k: sum(len(x.split()) for x in v) for k, v in strings.items()}
    avg = sum(length.values()) / len(docs)
    tf = {k: [sum(x.count(" " + p) * w for x, w in zip(v, search.WEIGHTS)) for p in phrases] for k, v in strings.items()}
    score = {}
    for k in tf:
        if any(tf[k]):
            score[k] = 0.0
            for n, f in enumerate(tf[k]):
                df_n = sum(t[n] > 0 for t in tf.values())
                idf = max(1e-6, math.log((len(docs) - df_n + 0.5) / (df_n + 0.5)))
                score[k] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[k] / avg))
    got = [(r.id, r.score) for r in search.bm25(df, "load index_map zzz", 100, ("id",)).collect()]
    assert dict(got) == {k: round(v, 6) for k, v in score.items()}
    assert search.bm25(df, "!!", 5, ("id",)).count() == 0


def test_nearest_ties_and_search_metrics(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0] if k < 4 else [0.0, 1.0], "") for k in range(6)] + [(9, [0.0, 0.0], ""), (None, [1.0, 1.0], "")], "vec_id long, embedding array<float>, rank string").drop("rank")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in search.nearest(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, rank int")
    m = evaluate.metrics(ranks).first()
    assert (m.queries, m.recall_1, m.recall_5, m.mrr) == (3, 0.333333, 0.666667, 0.416667)
    out = {r.query_id: r.outcome for r in evaluate.compare(ranks, spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "query_id string, rank int")).collect()}
    assert out == {"a": "loss", "b": "win", "c": "tie"}


def test_rerank_pool(spark):
    rows = [(0, "p", "src/token.py", 0.5, "loadToken", "f", "python", k, k, "") for k in range(1, 5)] + [(0, "p", "b.py", 0.51, "other", "f", "python", 1, 1, "")]
    got = shaping.rerank(_hits(spark, rows), F.lit("token")).orderBy("pos").collect()
    assert [(r.file, r.start_line, r.score) for r in got][:3] == [("src/token.py", 1, 0.54), ("src/token.py", 2, 0.54), ("b.py", 1, 0.51)]
