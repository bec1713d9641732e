"""Versioned store, embedder, watcher, declarations of brace languages, callees and dependency walks."""

import datetime

import numpy as np
import pytest

from codelode.operators import embed, extract, graph, maintain
from codelode.plans.governance import Busy
from codelode.sources.store import VersionedStore
from codelode.streaming import debounce, watch


def test_store_flips_versions_and_locks(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.version == 0 and store.meta() == {}
    store.commit({"files": spark.range(3)}, model="m")
    first = store.read("files")
    store.commit({"files": spark.range(5)})
    assert (store.version, store.meta()["revision"], store.meta()["model"]) == (2, 2, "m")
    assert store.read("files").count() == 5 and first.count() == 3
    with store.writing(), pytest.raises(Busy), store.writing():
        pass
    with store.writing():
        pass


def test_embedder_retries_and_bisects(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0, 0.5]] * len(texts)

    assert embed.with_retries(flaky, ["a", "bad", "b"], pause=0) == [[1.0, 0.5], None, [1.0, 0.5]]
    with pytest.raises(embed.FatalEmbedding):
        embed.with_retries(lambda t: (_ for _ in ()).throw(embed.FatalEmbedding("key")), ["a"])
    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "")], "id long, text string")
    got = {r.id: bytes(r.vec) for r in embed.embedded(df, "id", embed.hash_embedder(16), pause=0).collect()}
    assert set(got) == {1, 2, 4} and got[1] == got[2] and len(got[1]) == 32
    assert abs(float(np.linalg.norm(np.frombuffer(got[1], "<f2").astype(float))) - 1) < 0.01
    assert embed.half_precision([0.1]) != [0.1]


def test_watcher_runs_passes_once_and_reports_busy(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    ddl = "key string, ts timestamp, path string, kind string, is_dir boolean"
    rows = [("a", at(0), "x.py", "modified", False), ("a", at(1), "y.py", "created", False), ("b", at(1), "z.py", "deleted", True), ("c", at(1), ".git/x", "modified", False), ("d", at(1), "q.py~", "modified", False), ("e", at(1), "dir", "modified", True)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(src)
    spark.createDataFrame([("z", at(9000), "x.py", "modified", False)], ddl).coalesce(1).write.mode("append").parquet(src)
    ran, busy = [], []

    def run(key):
        if key == "b":
            raise Busy("writer")
        ran.append(key)

    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    query = watch.watch(stream, run, str(tmp_path / "cp"), 3, available_now=True, on_busy=busy.append)
    query.awaitTermination(120)
    assert ran == ["a"] and busy == ["b"] and watch.stop(query, 5)
    fired = spark.createDataFrame([("a", 100.0), ("b", None)], "key string, fired_at double")
    assert sorted(r.key for r in watch.due_for_sweep(fired, 350.0).collect()) == ["b"]
    roots = spark.createDataFrame([("/w", "outer"), ("/w/p", "inner")], "root string, slug string")
    ev = spark.createDataFrame([("/w/p/x.py",), ("/w/q.py",), ("/other",)], "path string")
    assert {r.path: r.slug for r in debounce.route(ev, roots).collect()} == {"/w/p/x.py": "inner", "/w/q.py": "outer"}


def test_brace_declarations():
    text = 'export class A extends B {\n    async go(x) {\n        if (x) { y("}"); }\n    }\n}\n\n// function no() {\nfunction f(a) {\n}\n'
    assert extract.brace_declarations(text) == [("A", "class", None, 1, 5), ("A.go", "method", "A", 2, 4), ("f", "function", None, 8, 9)]
    c = "static int g(struct x *y)\n{\n    while (y) { z(); }\n    return 0;\n}\nint h(void);\n"
    assert [(n, s, e) for n, _, _, s, e in extract.brace_declarations(c)] == [("g", 1, 5)]
    assert extract.brace_declarations("") == []


def test_python_references_and_whole_texts(spark):
    text = "import os\nfrom a.b import c\n\nclass D(Base, m.Other):\n    def e(self):\n        return self.f(g(1))\n"
    got = set(extract.python_references(text))
    assert {(1, None, "os", "includes", None), (2, None, "a.b", "includes", None), (4, "D", "Base", "base_class", None), (4, "D", "Other", "base_class", "m"), (6, "D.e", "f", "call", "self"), (6, "D.e", "g", "call", None)} == got
    assert extract.python_references("def (") == []
    chunks = spark.createDataFrame([("p", "a", 1, "two"), ("p", "a", 0, "one"), ("p", "a", 0, "one"), ("p", None, 0, "x"), ("p", "b", 0, None)], "project string, file string, chunk_index int, text string")
    assert [tuple(r) for r in extract.whole_texts(chunks).collect()] == [("p", "a", "one\ntwo")]


def test_callees_and_dependencies(spark):
    symbols = spark.createDataFrame([("p", "a.py", "f"), ("p", "b.py", "g"), ("p", "c.py", "g"), ("p", "c.py", "h")], "project string, file string, name string")
    refs = spark.createDataFrame([("p", "a.py", "f", "g", "call"), ("p", "a.py", "f", "h", "call"), ("p", "a.py", "f", "h", "call"), ("p", "a.py", "f", "h", "type")], "project string, file string, from_symbol string, to_name string, relationship string")
    assert sorted((r.to_name, r.target_file, r.calls) for r in graph.callees(refs, symbols).collect()) == [("g", None, 1), ("h", "c.py", 2)]
    imports = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "d", "a"), ("p", "a", None), ("p", "a", "a")], "project string, file string, resolved_file string")
    walk = lambda direction, **k: sorted((r.level, r.file) for r in graph.dependencies(imports, "p", "a", direction, **k).collect())
    assert walk("out") == [(0, "a"), (1, "b"), (2, "c")] and walk("in") == [(0, "a"), (1, "c"), (1, "d"), (2, "b")] and walk("both", depth=1) == [(0, "a"), (1, "b"), (1, "c"), (1, "d")]
    capped = graph.dependencies(imports, "p", "a", "in", depth=1, cap=2).where("level = 1").collect()
    assert [(r.file, r.refused) for r in capped] == [("c", 1)]
    assert graph.render([(0, "a"), (1, "b")]) == "a\n  b"


def test_eviction_and_orphans(spark):
    cache = spark.createDataFrame([(k, f"k{k}", float(k)) for k in range(9)], "vec_id long, key string, last_used double")
    assert maintain.evict(cache, 9).count() == 9
    assert sorted(r.vec_id for r in maintain.evict(cache, 8).collect()) == [3, 4, 5, 6, 7, 8]
    # Many equal times, nulls, several ranges.
    rows = [(k, f"k{k % 7}", None if k % 11 == 0 else float(k % 3)) for k in range(500)]
    order = lambda r: ((r[2] is not None, r[2] or 0.0), r[1], r[0])
    want = sorted(r[0] for r in sorted(rows, key=order)[500 // 4 + 1 :])
    for size in (40, 100_000):
        maintain.RANGE_ROWS, before = size, maintain.RANGE_ROWS
        try:
            assert sorted(r.vec_id for r in maintain.evict(spark.createDataFrame(rows, "vec_id long, key string, last_used double"), 10).collect()) == want
        finally:
            maintain.RANGE_ROWS = before
    files = spark.createDataFrame([("p", "a")], "project string, path string")
    child = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b"), ("q", "a")], "project string, file string")
    assert sorted((r.project, r.file, r.rows) for r in maintain.orphans({"x": child}, files).collect()) == [("p", "b", 2), ("q", "a", 1)]


def test_brace_references():
    ts = 'import { a } from "./a";\nexport class A extends B.C<D> implements E, F {\n  run(x: number) {\n    if (x) { this.go(x); }\n    return make<string>(x) + "no(1)"; // not(this)\n  }\n}\nfunction f() {\n  return new G(run());\n}\n'
    got = extract.brace_references(ts, "ts")
    assert {(n, o) for _, o, n, r, _ in got if r == "base_class"} == {("C", "A"), ("E", "A"), ("F", "A")}
    assert [(line, o, n, v) for line, o, n, r, v in got if r == "call"] == [(4, "A.run", "go", "this"), (5, "A.run", "make", None), (9, "f", "G", None), (9, "f", "run", None)]
    cs = "public class A : Base<int>, IThing\n{\n    int Run(int n)\n    {\n        foreach (var x in Get(n)) _log.Write(x);\n        return nameof(n).Length;\n    }\n}\n"
    got = extract.brace_references(cs, "cs")
    assert [n for _, _, n, r, _ in got if r == "base_class"] == ["Base", "IThing"]
    assert [(n, v, o) for _, o, n, r, v in got if r == "call"] == [("Get", None, "A.Run"), ("Write", "_log", "A.Run")]
    rs = "impl fmt::Display for P {\n    fn fmt(&self) -> R { helper::<u8>(self.x()); Ok(()) }\n}\n"
    got = extract.brace_references(rs, "rs")
    assert ("Display", "base_class") in {(n, r) for _, _, n, r, _ in got} and {n for _, _, n, r, _ in got if r == "call"} == {"helper", "x", "Ok"}
    go = "package a\n\nfunc Run(t *T) {\n\tfmt.Println(t.Name())\n}\n"
    assert [(n, v) for _, _, n, r, v in extract.brace_references(go, "go") if r == "call"] == [("Println", "fmt"), ("Name", "t")]
    assert extract.brace_references("", "c") == []
