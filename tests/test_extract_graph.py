"""Extraction, resolution, walks, maintenance, streams, sources and plans on small fixtures."""

import datetime
import random

import pytest

from codelode.operators import extract, graph, lookup, maintain, resolve
from codelode.plans import core_queries, edits, governance
from codelode.sources import readers, tree
from codelode.streaming import debounce

SYM = "id long, project string, file string, qualified_name string, symbol_type string, decl_hash string, name string, container string, language string, start_line int, end_line int, source string, signature string, visibility string"
REF = "project string, file string, line int, from_symbol string, to_name string, relationship string, confidence string, receiver string"


def _sym(k, file, name, kind="function", start=1):
    return (k, "p", file, name, kind, "h", name, None, "python", start, start + 2, "ast", None, None)


def _ref(file, line, frm, to, rel="call"):
    return ("p", file, line, frm, to, rel, "ast", None)


def test_resolution_precedence(spark):
    symbols = spark.createDataFrame([_sym(1, "a.py", "f"), _sym(2, "b.py", "f"), _sym(3, "src/g.py", "g"), _sym(4, "tests/g.py", "g"), _sym(5, "c.py", "t", "class"), _sym(6, "x.py", "f")], SYM)
    refs = spark.createDataFrame([_ref("a.py", 1, None, "f"), _ref("c.py", 1, None, "f"), _ref("c.py", 2, None, "g"), _ref("c.py", 3, None, "zz"), _ref("d.py", 1, None, "t", "type_use"), _ref("d.py", 2, None, "g", "type_use")], REF)
    got = {(r.file, r.line): (r.target_id, r.how) for r in resolve.resolved(refs, symbols).collect()}
    assert got[("a.py", 1)] == (1, "same_file") and got[("c.py", 1)] == (None, "none") and got[("c.py", 2)] == (3, "same_project") and got[("c.py", 3)] == (None, "none")
    kept = {(r.file, r.line, r.relationship) for r in resolve.type_uses(refs, symbols).where("file = 'd.py'").collect()}
    assert kept == {("d.py", 1, "type")}


def test_callers_levels_caps_and_cycles(spark):
    symbols = spark.createDataFrame([_sym(1, "a.py", "f"), _sym(2, "b.py", "g"), _sym(3, "c.py", "h")], SYM)
    refs = spark.createDataFrame([_ref("b.py", 2, "g", "f"), _ref("b.py", 3, "g", "f"), _ref("c.py", 2, "h", "g"), _ref("a.py", 2, "f", "h")], REF)
    rows = graph.callers(refs, symbols, "p", "f", depth=5).collect()
    assert sorted((r.level, r.file, r.line) for r in rows) == [(0, "a.py", 1), (1, "b.py", 2), (1, "b.py", 3), (2, "c.py", 2), (3, "a.py", 2)]
    capped = graph.callers(refs, symbols, "p", "f", depth=1, cap=2).where("level = 1").collect()
    assert [(r.line, r.refused) for r in capped] == [(2, 1)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert sorted(map(tuple, graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 2).collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_walks_count_what_a_used_up_cap_refuses(spark):
    symbols = spark.createDataFrame([_sym(k, f"d{k}.py", "f") for k in range(5)], SYM)
    refs = spark.createDataFrame([_ref("b.py", 2, "g", "f"), _ref("c.py", 2, "h", "f"), _ref("e.py", 2, "z", "g")], REF)
    rows = graph.callers(refs, symbols, "p", "f", cap=3).collect()
    assert sorted((r.level, r.file or "", r.position or 0, r.refused) for r in rows) == [(0, "d0.py", 1, 2), (0, "d1.py", 2, 2), (0, "d2.py", 3, 2), (1, "", 0, 2)]
    rows = graph.callers(refs, symbols, "p", "f", cap=7).collect()
    assert [(r.level, r.file, r.refused) for r in rows if r.level] == [(1, "b.py", 0), (1, "c.py", 0), (2, None, 1)]
    imports = spark.createDataFrame([("p", "b", "a"), ("p", "c", "a"), ("p", "d", "b")], "project string, file string, resolved_file string")
    walk = lambda cap: sorted((r.level, r.file or "", r.refused) for r in graph.dependencies(imports, "p", "a", "in", cap=cap).collect())
    assert walk(1) == [(0, "a", 0), (1, "", 2)]
    assert walk(2) == [(0, "a", 0), (1, "b", 1), (2, "", 1)]
    assert walk(3) == [(0, "a", 0), (1, "b", 0), (1, "c", 0), (2, "", 1)]


def test_symbol_filters(spark):
    symbols = spark.createDataFrame([_sym(1, "a.py", "LoadIt"), _sym(2, "tests/b.py", "loadit"), _sym(3, "c.py", "x_load", "method"), _sym(4, "d.py", None)], SYM)
    refs = spark.createDataFrame([_ref("c.py", 2, "x_load", "Go"), _ref("a.py", 2, None, "Go")], REF)
    find = lambda **k: [r.id for r in lookup.find_symbols(symbols, refs, lookup.SymbolFilter(**k), 10).collect()]
    assert find(name="loadIT") == [1, 2]
    assert find(name="load", match="substring") == [1, 3, 2]
    assert find(name="%oad_", match="substring") == [1, 2]  # wildcards are not escaped; a position follows "oad"
    assert find(name="*load", match="glob") == [3]
    assert find(has_call="go") == [3] and find(visibility="private") == [] and len(find(visibility="public")) == 4
    assert [r.id for r in lookup.find_symbols_tiered(symbols, refs, "load").collect()] == [1, 3, 2]


def test_window_chunks_lose_nothing(spark):
    rng = random.Random(5)
    for _ in range(40):
        text = "\n".join("x" * rng.choice([0, 5, 40, 300, 1200]) for _ in range(rng.randint(1, 200)))
        rows, spans = extract.split_lines(text), extract.window_spans(text)
        assert {n for s, e in spans for n in range(s, e + 1)} == set(range(1, len(rows) + 1))
        assert all(s == e or sum(map(len, rows[s - 1 : e])) + e - s <= 1000 for s, e in spans)
    df = spark.createDataFrame([("a", "x\r\ny"), ("b", None), ("c", "")], "id string, text string")
    assert [(r.id, r.start_line, r.end_line, r.text) for r in extract.window_chunks(df, "id").collect()] == [("a", 1, 2, "x\ny")]


def test_textual_references_and_imports(spark):
    text = "from a.b import c\n# call(me)\nvalue = compute(other)\n"
    chunks = spark.createDataFrame([("p", "src/m.py", 10, text), ("p", "src/m.py", 10, text), ("p", "ui/x.ts", 1, 'import { a } from "./lib/y";')], "project string, file string, start_line int, text string")
    got = {(r.file, r.line, r.to_name, r.relationship) for r in extract.textual_references(chunks).collect()}
    assert ("src/m.py", 10, "a.b", "includes") in got and ("src/m.py", 12, "compute", "call") in got and ("src/m.py", 12, "other", "identifier") in got and not any(x[2] == "call" for x in got)
    files = spark.createDataFrame([("p", "a/b.py"), ("p", "src/a/b.py"), ("p", "ui/lib/y/index.ts")], "project string, path string")
    resolved = {(r.file, r.resolved_file) for r in extract.resolve_imports(extract.imports_of(chunks), files).collect()}
    assert resolved == {("src/m.py", "a/b.py"), ("ui/x.ts", "ui/lib/y/index.ts")}


def test_textual_references_of_every_language_without_parser(spark, tmp_path):
    texts = {"a.ts": 'export const kind = make("word");\nexport { x } from "./lib/y";', "b.go": "func Run() {\n\tload(item)\n}", "c.md": "from the list(s)\nusing tokens", "d.json": '{"name": 1}', "e.js": "run(it);", "f.yaml": "key: val", "g.py": "call(me)", "h.rs": "use a::b;"}
    spark.createDataFrame([("p", f, 1, t) for f, t in texts.items()], "project string, file string, start_line int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(r.file, r.relationship): r.refs for r in core_queries.x12_x13_textual_references(spark, str(tmp_path)).collect()}
    assert {f for f, _ in got} == set(texts) - {"g.py"}
    assert got[("a.ts", "includes")] == got[("a.ts", "call")] == 1 and got[("a.ts", "identifier")] == 4  # export, const, kind, word
    assert got[("b.go", "call")] == 2 and got[("c.md", "call")] == 1 and got[("c.md", "identifier")] == 4 and got[("h.rs", "includes")] == 1


def test_relative_and_go_imports_resolve(spark, tmp_path):
    texts = [
        ("pkg/sub/a.py", 0, 1, "from .m import x\nfrom ..n import y\nfrom . import z\nfrom ....far import w"), ("ui/app/x.ts", 0, 1, 'import { a } from "../lib/y";\nimport b from "./../../top";'),
        ("src/u.c", 0, 1, '#include "../inc/h.h"'), ("go.mod", 0, 1, "module example.org/m\n"), ("cmd/main.go", 0, 1, 'package main\n\nimport (\n\t"fmt" // "no"'), ("cmd/main.go", 1, 5, '\tq "example.org/m/pkg/q"\n\t`lone`\n)\nvar s = "after"'),
    ]
    spark.createDataFrame([("p", *t) for t in texts], "project string, file string, chunk_index int, start_line int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    paths = ["pkg/sub/m.py", "pkg/n.py", "pkg/sub/__init__.py", "far.py", "ui/lib/y/index.ts", "top.js", "inc/h.h", "pkg/q/a_test.go", "pkg/q/c.go", "pkg/q/b.go", "lone.go"]
    spark.createDataFrame([("p", f, k) for k, f in enumerate(paths)], "project string, path string, file_id int").write.parquet(str(tmp_path / "files.parquet"))
    got = {(r.file, r.line, r.raw_target): r.resolved_file for r in core_queries.x14_resolved_imports(spark, str(tmp_path)).collect()}
    assert got == {
        ("pkg/sub/a.py", 1, ".m"): "pkg/sub/m.py", ("pkg/sub/a.py", 2, "..n"): "pkg/n.py", ("pkg/sub/a.py", 3, "."): "pkg/sub/__init__.py", ("pkg/sub/a.py", 4, "....far"): None,
        ("ui/app/x.ts", 1, "../lib/y"): "ui/lib/y/index.ts", ("ui/app/x.ts", 2, "./../../top"): "top.js", ("src/u.c", 1, "../inc/h.h"): "inc/h.h",
        ("cmd/main.go", 4, "fmt"): None, ("cmd/main.go", 5, "example.org/m/pkg/q"): "pkg/q/b.go", ("cmd/main.go", 6, "lone"): "lone.go",
    }


def test_python_declarations(spark):
    text = "@d\nclass A:\n    def m(self):\n        def inner(): pass\n\ndef f():\n    return 1\n"
    assert extract.python_declarations(text) == [("A", "class", None, 1, 4), ("A.m", "method", "A", 3, 4), ("A.m.inner", "function", "A.m", 4, 4), ("f", "function", None, 6, 7)]
    df = spark.createDataFrame([("p", "a.py", "def f(:\n"), ("p", "b.py", ""), ("p", "c.py", None)], "project string, file string, text string")
    assert sorted((r.file, r.verdict) for r in extract.declarations(df).collect()) == [("a.py", "parse_error"), ("b.py", "parsed")]


def test_declarations_of_every_language(spark, tmp_path):
    texts = {
        "a.py": "def f(): pass", "b.md": "# f(x) {", "c.json": "{}",
        "a.go": "package p\n\nimport (\n\t\"x/y\"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Go(v interface{}) error {\n\tdefer done(v)\n\tif v {\n\t}\n}",
        "a.rs": "impl Show for T {\n    fn go<'a>(x: &'a str) -> u8 {\n        match look(x) {\n        }\n        for y in all(x) {\n        }\n    }\n}",
        "a.cs": "public sealed class C\n{\n    public C(int x) : base(x)\n    {\n        foreach (var y in Read(x))\n        {\n        }\n    }\n}",
        "a.c": "struct s {\n};\nstruct s *make(int x)\n{\n}\nstruct s one = { 1 };",
        "a.js": "class A {\n  run({ a, b }) {\n    if (a) { say('}'); }\n  }\n}",
        "a.ts": "export interface I {\n}\nexport function f(x: { y: number }): number {\n}",
    }
    spark.createDataFrame([("p", f, 0, t) for f, t in texts.items()], "project string, file string, chunk_index int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    rows = core_queries.x5_x7_declarations(spark, str(tmp_path)).collect()
    assert {r.file: r.verdict for r in rows} == {f: "parsed" if f == "a.py" else "parse_unavailable" for f in texts}
    assert {r.source for r in rows if r.file != "a.py" and r.qualified_name} == {"regex"}
    got = {f: sorted((r.start_line, r.end_line, r.qualified_name, r.symbol_type) for r in rows if r.file == f and r.source) for f in texts}
    assert got == {
        "a.py": [(1, 1, "f", "function")], "b.md": [], "c.json": [],
        "a.go": [(7, 8, "T", "struct"), (10, 14, "Go", "function")],
        "a.rs": [(1, 8, "T", "class"), (2, 7, "T.go", "method")],
        "a.cs": [(1, 9, "C", "class"), (3, 8, "C.C", "method")],
        "a.c": [(1, 2, "s", "struct"), (3, 5, "make", "function")],
        "a.js": [(1, 5, "A", "class"), (2, 4, "A.run", "method")],
        "a.ts": [(1, 2, "I", "interface"), (3, 4, "f", "function")],
    }


def test_tree_changes_and_reuse(spark):
    f = "project string, path string, content_hash string, status string"
    old = spark.createDataFrame([("p", "a", "1", "ok"), ("p", "b", "1", "ok"), ("p", "c", "1", "ok"), ("p", "d", "1", "ok")], f)
    new = spark.createDataFrame([("p", "a", "1", "ok"), ("p", "b", "2", "ok"), ("p", "d", None, "unreadable"), ("p", "e", "1", "ok")], f)
    kinds = {r.path: r.kind for r in maintain.tree_changes(old, new).collect()}
    assert kinds == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "unreadable", "e": "added"}
    row = maintain.staleness(maintain.tree_changes(old, new)).first()
    assert row.state == "stale" and [x.path for x in row.reasons] == ["b", "c", "d", "e"]
    p = "id string, chunk_hash string, symbol string"
    stored = spark.createDataFrame([("1", "h", None), ("2", "h", None), ("3", "g", "s")], p)
    wanted = spark.createDataFrame([("2", "h", None), ("7", "h", None), ("8", "h", None), ("9", "g", "s")], p)
    assert {r.id: r.donor for r in maintain.reuse_vectors(stored, wanted).collect()} == {"2": "2", "7": "1", "8": None, "9": "3"}


def test_debounce_batch_and_stream(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(2)), ("a", at(5)), ("b", at(1)), ("a", at(8)), (None, at(1)), ("c", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = sorted((r.k, r.events, r.fires_at) for r in debounce.firings(df, "k", "ts", 3).collect())
    assert got == [("a", 1, at(8)), ("a", 1, at(11)), ("a", 2, at(5)), ("b", 1, at(4))]
    src = str(tmp_path / "events")
    df.where("k IS NOT NULL AND ts IS NOT NULL").coalesce(1).write.parquet(src)
    spark.createDataFrame([("z", at(10_000))], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = debounce.stream_firings(stream, "k", "ts", 3, "1 second").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    fired = sorted((r.key, r.events) for r in spark.table("fired").collect() if r.key != "z")
    assert fired == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_tree_source(spark, tmp_path):
    put = lambda p, b: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    for p, b in [("pkg/__init__.py", b""), ("pkg/a.py", b"x = 1\n"), ("pkg/.gitignore", b"*.log\n!keep.log\n"), ("pkg/x.log", b"1"), ("pkg/keep.log", b"1"), ("pkg/b.bin", b"1"), ("pkg/n.txt", b"a\0b"), ("pkg/l.txt", b"\xff\xfe"), ("big.txt", b"x" * 2000), ("node_modules/a.js", b"1"), (".env", b"1"), ("poetry.lock", b"1")]:
        put(p, b)
    put("pkg/k.py", ("k = '" + "AKIA" + "ABCDEFGHIJKLMNOP'\n").encode())
    df = tree.read_tree(spark, str(tmp_path), maxFileBytes=1000)
    got = {r.path: r.skipped for r in df.collect()}
    assert got == {"pkg/__init__.py": None, "pkg/a.py": None, "pkg/.gitignore": None, "pkg/x.log": "ignored", "pkg/keep.log": None, "pkg/b.bin": "binary", "pkg/n.txt": "binary", "pkg/l.txt": "non-utf8", "pkg/k.py": "sensitive", "big.txt": "oversized", ".env": "sensitive", "poetry.lock": "ignored"}
    assert sum(r.files for r in tree.accounting(df).collect()) == len(got)
    with pytest.raises(Exception, match="ScanBudgetExceeded"):
        tree.read_tree(spark, str(tmp_path), maxEntries=2).collect()


def test_small_sources(spark, tmp_path):
    diff = ["+++ b/a.py", "@@ -1,0 +2,3 @@ def f", "@@ -9 +12 @@", "+++ b/b.py", "@@ -4,2 +3,0 @@"]
    rows = spark.createDataFrame(list(enumerate(diff)), "n int, line string")
    assert [tuple(r) for r in readers.diff_hunks(rows).orderBy("file", "from_line").collect()] == [("a.py", 2, 4), ("a.py", 12, 12), ("b.py", 3, 3)]
    names = spark.createDataFrame([("M\ta",), ("R090\told\tnew",), ("noise",)], "line string")
    assert sorted((r.status, r.path, r.old_path) for r in readers.name_status(names).collect()) == [("M", "a", None), ("R", "new", "old")]
    f = tmp_path / "q.jsonl"
    f.write_text('# c\n\n{"id": "1", "query": "x", "relevant": [{"file": "a"}]}\n')
    assert readers.read_labelled_queries(spark, str(f)).first().relevant[0].file == "a"
    f.write_text('{"query": "x"}\n')
    with pytest.raises(readers.QueryFileError):
        readers.read_labelled_queries(spark, str(f))
    assert readers.class_ladder('[tool.codelode.ordering]\ndocs = ["KB/"]\ntests = "x"')["docs"] == ("kb",)
    assert readers.class_ladder("= broken") == {"docs": (), "examples": (), "tests": ()}
    assert readers.load_config({"CODELODE_QUIET_SECONDS": "9", "CODELODE_SEARCH_LIMIT": "no"}, search_limit=3) == readers.Config(quiet_seconds=9, search_limit=3)
    reg = spark.createDataFrame([("/a", "a", 1.0, "A")], "path string, slug string, created_at double, name string")
    assert readers.add_project(reg, "/b", "B", 2.0).count() == 2
    with pytest.raises(readers.RegistryError):
        readers.add_project(reg, "/b", "a", 2.0)
    with pytest.raises(readers.RegistryError):
        readers.remove_project(reg, "zz")


def test_edit_plans():
    texts = {"a.py": "import x\n# note\ndef f():\n    pass\n\ndef g():\n    pass"}
    lines = texts["a.py"].split("\n")
    plan = edits.build([edits.replace_body("a.py", (3, 4), "def f():\n    return 1"), edits.insert_symbol("a.py", lines, (6, 7), "before", "def h(): ...\n"), edits.delete_declaration("a.py", (1, 1))], texts)
    after = edits.apply(plan, texts)["a.py"]
    assert after == "# note\ndef f():\n    return 1\n\ndef h(): ...\n\ndef g():\n    pass"
    assert edits.insert_symbol("a.py", lines, (3, 4), "before", "x").start == 2
    assert "+    return 1" in edits.preview(plan, texts)
    for change, rung in (({"schema": 2}, "id"), ({}, "hash")):
        with pytest.raises(edits.PlanError) as e:
            edits.apply(plan | change, texts if change else {"a.py": "y"})
        assert e.value.rung == rung
    with pytest.raises(edits.PlanError):
        edits.build([edits.Edit("a.py", 1, 3, ""), edits.Edit("a.py", 2, 4, "")], texts)


def test_governance(spark):
    a = governance.Fingerprint("7", "c1", "m", 64)
    governance.gate(a, a, True)
    with pytest.raises(governance.NeedsReindex):
        governance.gate(governance.Fingerprint("6", "c1"), a)
    assert governance.vector_mode("auto", None) and not governance.vector_mode("auto", False) and governance.is_write("add-project")
    assert governance.NeedsReindex("x").exit_code == 4
    assert governance.empty_reason({"files": 0}) == "index-empty"
    assert governance.health(spark, {"a": (True, ""), "b": (False, "x")}).where("status = 'fail'").count() == 1




def test_exclusions_of_the_repository_and_character_classes(tmp_path):
    from codelode.sources import tree

    top = tmp_path / "top"
    (top / ".git" / "info").mkdir(parents=True)
    (top / "sub" / "in").mkdir(parents=True)
    (top / ".git" / "info" / "exclude").write_text("# local\n/sub/secret.txt\n*.tmp\nbuild/\n")
    rules = tree.local_rules(str(top / "sub"))
    hit = lambda p, d=False: tree.ignored(p, d, rules)
    assert hit("secret.txt") and hit("in/a.tmp") and hit("build", True) and not hit("build") and not hit("in/secret.txt")
    assert tree.ignored("sub/secret.txt", False, tree.local_rules(str(top)))
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: ../top/.git/worktrees/w\n")
    (top / ".git" / "worktrees" / "w").mkdir(parents=True)
    (top / ".git" / "worktrees" / "w" / "commondir").write_text("../..\n")
    assert tree.ignored("x.tmp", False, tree.local_rules(str(tmp_path / "tree")))
    assert tree.local_rules("/") == []
    rules = [tree.compile_rule(x) for x in ("a[0-9].py", "b[!xy].c", "c[d", "\\#e", "f[]].g")]
    for path, want in {"a1.py": True, "ab.py": False, "bz.c": True, "bx.c": False, "c[d": True, "#e": True, "f].g": True}.items():
        assert tree.ignored(path, False, rules) is want, path


def test_callees_walk_caps_and_counts(spark):
    refs = spark.createDataFrame([("p", "a.py", 1, "A.run", n, "call", "ast", None) for n in ("f", "g", "g", "h")] + [("p", "b.py", 2, "f", "k", "call", "ast", None), ("p", "b.py", 3, "g", "run", "call", "ast", None), ("q", "b.py", 3, "run", "z", "call", "ast", None)], "project string, file string, line int, from_symbol string, to_name string, relationship string, confidence string, receiver string")
    symbols = spark.createDataFrame([("p", "b.py", "f"), ("p", "x.py", "g"), ("p", "y.py", "g")], "project string, file string, name string")
    walk = lambda **k: [(r.level, r.name, r.calls, r.target_file, r.position, r.refused) for r in graph.callees_walk(refs, symbols, "p", "run", **k).orderBy("level", "position").collect()]
    assert walk() == [(0, "run", None, None, 1, 0), (1, "g", 2, None, 2, 0), (1, "f", 1, "b.py", 3, 0), (1, "h", 1, None, 4, 0), (2, "k", 1, None, 5, 0)]
    assert walk(cap=3) == [(0, "run", None, None, 1, 0), (1, "g", 2, None, 2, 1), (1, "f", 1, "b.py", 3, 1), (2, None, None, None, None, 1)]
