"""Splitting, packing, mixing, truncation and neighbours against plain models and edge tables."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import mixing, neighbours, packing, splitting, tokens, truncation

CHUNKS = "chunk_id long, project string, file string, chunk_index int, start_line int, symbol string, symbol_type string, text string, piece_no string"
DOCS = "doc_id long, text string, lang string, source string, n_tokens string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400) | st.just(1500), min_size=1, max_size=80), st.randoms())
def test_cut_properties(lengths, rng):
    lines = ["".join(rng.choice("ab é\t(") for _ in range(n)) for n in lengths]
    text = "\n".join(lines)
    got = splitting.cut(text)
    assert got[0][0] == 0 and got[-1][1] == len(lines) - 1
    for a, b in got:
        assert a == b or len("\n".join(lines[a : b + 1])) <= 1000
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b + 1 and d > b and b - c + 1 <= 10
        if b - c + 1 < 10 and c - 1 > a:  # as many as fit beside a new line
            assert len("\n".join(lines[c - 1 : b + 2])) > 1000


def test_edits_move_near_cuts_only():
    rng = random.Random(2)
    lines = ["    " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    other = lines[:200] + ["    inserted = 1"] + lines[200:]
    pieces = lambda x: {"\n".join(x[a : b + 1]) for a, b in splitting.cut("\n".join(x))}
    a, b = pieces(lines), pieces(other)
    assert len(a & b) >= 0.7 * len(a)


def test_pieces_over_dirty_chunks(spark):
    long = "\n".join(f"line {k} " + "x" * 30 for k in range(60))
    rows = [(1, "p", "a.py", 0, 11, "f", "function", long, "clash"), (2, "p", "b", 0, None, None, None, "y" * 1500, None), (3, "p", "c", 0, 1, "g", None, "z" * 1000, None), (4, None, None, None, None, None, None, None, None), (5, "p", "d", 0, 1, None, None, "é" * 1001 + "\n", None)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = splitting.pieces(df).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {1, 2, 5}
    mine = [r for r in got if r.chunk_id == 1]
    assert [r.symbol for r in mine] == ["f"] + [None] * (len(mine) - 1) and mine[0].start_line == 11 and mine[-1].end_line == 70
    for r in mine:
        assert r.text == "\n".join(long.split("\n")[r.start_line - 11 : r.end_line - 10])
    assert [len(r.text) for r in got if r.chunk_id == 2] == [1500]
    assert splitting.pieces(spark.createDataFrame([], CHUNKS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_packing_patterns(histogram):
    plan = packing.shortest_pack_first(histogram, 64)
    placed: dict[int, int] = {}
    for pattern, packs in plan:
        assert packs > 0 and sum(n * m for n, m in pattern) <= 64
        for n, m in pattern:
            placed[n] = placed.get(n, 0) + m * packs
    assert placed == histogram


def test_packing_over_dirty_documents(spark):
    rng = random.Random(1)
    docs = [(k, "word " * rng.randint(1, 40) if k % 9 else None, rng.choice(["en", "EN", "en-GB", "de", None]), "s", "clash") for k in range(200)] + [(1000 + k, "same text", "en", "s", None) for k in range(120)] + [(5000, "w " * 900, "en", "s", None), (5001, "", "en", "s", None)]
    specs = spark.createDataFrame([(1, 64, None), (2, 256, "en"), (3, None, "en"), (4, 0, None)], "spec_id int, capacity_tokens int, lang string")
    df = spark.createDataFrame(docs, DOCS)
    packing_rows, packing.RANK_ROWS = packing.RANK_ROWS, 50  # many salted parts
    try:
        got = packing.pack(df, specs).collect()
    finally:
        packing.RANK_ROWS = packing_rows
    n = {d[0]: tokens.count(d[1]) for d in docs if d[1]}
    for spec, capacity, langs in ((1, 64, None), (2, 256, ("en", "EN", "en-GB"))):
        mine = [r for r in got if r.spec_id == spec]
        fill: dict[int, int] = {}
        whole: dict[int, int] = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        assert whole == {d[0]: n[d[0]] for d in docs if d[1] and (langs is None or d[2] in langs)}
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert sum(fill.values()) > 0.9 * capacity * (len(fill) - 1)
        assert all(r.part == 0 for r in mine if n[r.doc_id] <= capacity)
    assert {r.spec_id for r in got} == {1, 2}
    assert packing.pack(spark.createDataFrame([], DOCS), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0
    assert {r.spec_id for r in packing.fill(packing.pack(df, specs)).collect()} == {1, 2}


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(k, "word " * rng.randint(1, 30), "en", ["big", "Big ", "small"][0 if k < 700 else 1 if k < 900 else 2], None) for k in range(1000)] + [(2000, None, "en", "big", None), (2001, "x", "en", None, None)]
    targets = spark.createDataFrame([(1, "big", 0.6, 1, 8000), (1, "small", 0.3, 2, 8000), (1, "absent", 0.1, 3, 8000), (2, "BIG", 1.0, 1, 4000), (3, "small", 1.0, 4, 10**9), (4, None, 1.0, 1, 100), (5, "big", None, 1, 100)], "mix_id int, source string, target_share double, max_repeats int, budget_tokens long")
    df = spark.createDataFrame(docs, DOCS)
    chosen, shares = mixing.mix(df, targets)
    rows, share = chosen.collect(), {(r.mix_id, r.source): r for r in shares.collect()}
    assert abs(share[(1, "big")].share_of_budget - 0.6) < 0.01 and abs(share[(1, "small")].share_of_budget - 0.3) < 0.01
    assert share[(1, "absent")].tokens == 0
    assert {r.copies for r in rows if r.mix_id == 3} == {4} and sum(r.mix_id == 3 for r in rows) == 100
    big = lambda m: {r.doc_id for r in rows if r.mix_id == m and r.source == "big"}
    assert big(2) < big(1)  # smaller budgets are nested in larger ones
    assert all(r.copies <= 2 for r in rows if r.mix_id == 1) and not any(r.mix_id in (4, 5) for r in rows)
    assert mixing.mix(spark.createDataFrame([], DOCS), targets)[0].count() == 0
    assert mixing.mix(df, targets.limit(0))[1].count() == 0


def test_token_counts_of_long_texts():
    text = ("Some words, and 12 numbers. " * 9000)[:-1]
    assert tokens.count(text) == len(tokens.encoder(tokens.RANKS).encode_ordinary(text))


def _sentences(rng):
    nouns, verbs = ["table", "index", "reader", "writer", "cache", "loader"], ["keeps", "drops", "moves", "finds"]
    return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} of every {rng.choice(nouns)}." for _ in range(rng.randint(2, 8)))


def test_truncation_on_held_out_cuts(spark):
    rng = random.Random(7)
    docs, cut = [], set()
    for k in range(900):
        text = _sentences(rng) if k % 4 else _sentences(rng) + "\n\n- small table\n- late cache\n- old reader"
        if k % 15 == 3:
            cut.add(k)
            text = text[: rng.randint(30, len(text) - 8)].rstrip(". ") + rng.choice(["", "", " [truncated]", "\ufffd"])
        docs.append((k, text, "en", ["wiki", "Wiki ", "issue"][k % 3], None))
    docs += [(9001, None, "en", "wiki", None), (9002, "", "en", "wiki", None), (9003, "  ", "en", None, None)]
    got = {r.doc_id for r in truncation.scored(spark.createDataFrame(docs, DOCS)).where("truncated").collect()}
    right = len(got & cut)
    assert right >= 0.9 * len(cut) and right >= 0.85 * len(got)
    assert not got & {9001, 9002, 9003}
    assert truncation.scored(spark.createDataFrame([], DOCS)).count() == 0


EMBED = "vec_id long, dim int, vec binary, id string, s string"


def test_neighbours_equal_brute_force_and_copies(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows, unit = [], {}
    for k in range(900):
        v = (centres[k % 30] + 0.3 * rng.normal(size=16)) * rng.uniform(0.2, 3)
        blob = v.astype("<f2").tobytes()
        rows.append((k, 16, bytearray(blob), "clash", None))
        u = np.frombuffer(blob, "<f2").astype(np.float32)
        unit[k] = u / np.linalg.norm(u)
    rows.append(rows[0])
    copy = rng.normal(size=8).astype("<f2").tobytes()
    rows += [(2000 + k, 8, bytearray(copy), None, None) for k in range(40)]
    rows += [(3000, 16, bytearray(b"\0" * 32), None, None), (3001, 16, bytearray(b"ab"), None, None), (3002, 16, None, None, None), (3003, None, bytearray(b"ab"), None, None), (3004, 16, bytearray(np.full(16, np.inf, "<f2").tobytes()), None, None), (None, 16, bytearray(copy), None, None)]
    df = spark.createDataFrame(rows, EMBED)
    found = neighbours.neighbours(df).collect()
    by: dict[int, set[int]] = {}
    for r in found:
        by.setdefault(r.vec_id, set()).add(r.neighbour)
    m = np.stack([unit[k] for k in range(900)])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert sum(len(by[k] & set(map(int, truth[k]))) for k in range(900)) >= 0.97 * 4500
    assert all(len(by[2000 + k]) == 5 for k in range(40)) and by[2020] == {2000, 2001, 2002, 2003, 2004} and by[2000] == {2001, 2002, 2003, 2004, 2005}
    assert set(by) == set(range(900)) | set(range(2000, 2040))
    pairs = [tuple(r) for r in neighbours.neighbour_pairs(neighbours.neighbours(df)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert neighbours.neighbours(spark.createDataFrame([], EMBED)).count() == 0


def test_graph_search_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    blobs = [(centres[k % 20] + 0.4 * rng.normal(size=16)).astype("<f2").tobytes() for k in range(600)]
    df = spark.createDataFrame([(k, 16, bytearray(b), None, None) for k, b in enumerate(blobs)], EMBED)
    graph = neighbours.graph_of(df)
    q = spark.createDataFrame([(k, 16, bytearray(blobs[k])) for k in range(0, 600, 50)], "query_id long, dim int, vec binary")
    got: dict[int, set[int]] = {}
    for r in neighbours.search(q, graph).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    m = np.stack([np.frombuffer(b, "<f2").astype(np.float32) for b in blobs])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = sum(len(got[k] & set(map(int, np.argsort(-(m @ m[k]))[:5]))) for k in got)
    assert len(got) == 12 and hits >= 0.9 * 60


def test_graph_search_answers_with_copies_without_the_query(spark):
    rng = np.random.default_rng(8)
    blobs = [rng.normal(size=16).astype("<f2").tobytes() for _ in range(60)]
    base = rng.normal(size=16)
    near = (base + 0.05 * rng.normal(size=16)).astype("<f2").tobytes()
    rows = [(k, 16, bytearray(b), None, None) for k, b in enumerate(blobs)] + [(k, 16, bytearray(near), None, None) for k in range(100, 109)] + [(200, 16, bytearray(base.astype("<f2").tobytes()), None, None)]
    graph = neighbours.graph_of(spark.createDataFrame(rows, EMBED))
    q = spark.createDataFrame([(k, 16, rows[-1][2] if k == 200 else bytearray(near)) for k in (100, 108, 200)], "query_id long, dim int, vec binary")
    got: dict[int, list[int]] = {}
    for r in sorted(neighbours.search(q, graph, copies=True).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {100: [101, 102, 103, 104, 105], 108: [100, 101, 102, 103, 104], 200: [100, 101, 102, 103, 104]}


def test_length_limits_are_spikes_of_open_texts(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n // 4 + 2))[:n].rstrip() or "w"
    docs = [(k, (words(2000)[:777] + "x" * 777)[:777], "en", "wiki", None) for k in range(30)]  # a field of 777 characters
    docs += [(100 + k, words(rng.randrange(300, 1500)) + "x", "en", "wiki", None) for k in range(300)]
    docs += [(500 + k, "the same open text " * 30, "en", "issue", None) for k in range(200)]  # copies make no limit
    docs += [(800 + k, words(399)[:398] + ".", "en", "chat", None) for k in range(200)]  # nor do complete texts
    docs += [(1100 + k, (words(90) + "z" * 30)[: 20 + min(rng.randrange(12), rng.randrange(12))], "en", "commit", None) for k in range(600)]  # nor a common length among others
    df = spark.createDataFrame(docs, DOCS)
    assert truncation.length_limits(df) == {("wiki", 777), ("wiki", -777)}
    assert truncation.length_limits(df.limit(0)) == set()


def test_known_words_have_no_length_limit(spark):
    long = "x" * 60
    df = spark.createDataFrame([(k, f"some {long} here now", "en", "wiki", None) for k in range(3)], DOCS)
    bits = truncation.known_words(df)
    assert truncation._known(bits, long.upper()) and truncation._known(bits, "some") and not truncation._known(bits, "now")
