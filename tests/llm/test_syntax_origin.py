"""Syntax faults and origins: cases per language and rule, exactness against the compiler, dirty tables."""

import random

import pytest

from codelode.llm import origin, syntax
from codelode.llm.assemble import File
from codelode.llm.lexers import language_of, scan

FILES = "file_id long, project string, path string, content_hash string, size long, status string, loc int, language string, parse_verdict string, text string"
CHUNKS = "chunk_id long, project string, file string, chunk_index int, start_line int, text string, path string, language string"

GOOD = {
    "python": 'import os\n\n@x\ndef f(a, *, b: int = 1) -> None:\n    """like foo( or {"""\n    if a:\n        return {"k": [1, 2]}  # it\'s (\n    x = (1,\n         2)\n    match a:\n        case 1:\n            pass\n    return a; b = 2\n',
    "javascript": 'import { a } from "./x";\n\nasync function f(t) {\n    // don\'t {\n    const r = /[({\\[]+"/.test(`a ${t["x"]} }`);\n    return r ? t / 2 : { a: [1] };\n}\n',
    "typescript": "export class A<T> implements B {\n    private x: number = 1;\n    async f(s: string): Promise<void> {\n        const y = s as unknown;\n    }\n}\n",
    "go": 'package a\n\nimport (\n    "x"\n)\n\nfunc F(a *B) ([]string, error) {\n    c := `raw "`\n    r := \'"\'\n    return nil, err\n}\n',
    "rust": "use a::b;\n\nfn f<'a>(x: &'a str) -> Result<u32, E> {\n    let c = '{';\n    let r = r#\"a \" {\"#;\n    /* outer /* inner */ { */\n    Ok(vec![1])\n}\n",
    "c": '#include <stdio.h>\n// it\'s\nstatic int f(struct x *y)\n{\n    char c = \'"\';\n    fprintf(stderr, "a (\\n", c);\n    return 0;\n}\n',
    "csharp": 'using A.B;\n\nnamespace C;\n\npublic class D\n{\n    string s = @"a ""q"" {";\n    string t = $"x {y["k"]} }}";\n}\n',
    "json": '{"a": [1, true, null, "x"]}',
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid_and_damaged_texts(language):
    text = GOOD[language]
    assert syntax.syntax_error(text, language) is None
    cut = text.index("(1,") + 2 if language == "python" else int(len(text) * 0.6)
    assert syntax.syntax_error(text[:cut], language) is not None
    marker = "<<<<<<< HEAD"
    assert syntax.syntax_error(text.replace("\n", f"\n{marker}\n", 1) if "\n" in text else marker + text, language) == "conflict_marker"
    assert syntax.syntax_error("<!DOCTYPE html>\n<html><body>x</body></html>", language)
    for other, foreign in GOOD.items():
        if other != language and (language, other) not in (("typescript", "javascript"), ("python", "json")):
            assert syntax.syntax_error(foreign, language), other


def test_python_agrees_with_the_compiler_on_random_damage():
    rng = random.Random(3)
    text = GOOD["python"]
    for _ in range(300):
        k = rng.randrange(len(text))
        broken = rng.choice([text[:k], text[:k] + rng.choice("()[]{}:") + text[k:], text[:k] + text[k + 1 :]])
        try:
            compile(broken, "x", "exec")
        except (SyntaxError, ValueError):
            continue
        assert syntax.syntax_error(broken, "python") is None, broken


def test_markers_inside_literals_are_no_conflict():
    assert syntax.syntax_error('x = """\n<<<<<<< HEAD\n=======\n"""\n', "python") is None
    assert syntax.syntax_error("", "python") is None and syntax.syntax_error("", "c") is None and syntax.syntax_error("", "json")
    assert language_of(None, "a/b.PY") == "python" and language_of("Go", "x") == "go" and language_of(None, "a.md") is None and language_of(None, None) is None


def test_faults_over_dirty_tables(spark):
    files = [(1, "p", "a.py", None, 3, "ok", 1, None, None, "clash"), (1, "p", "a.py", None, 3, "ok", 1, None, None, "clash"), (2, "p", "b.go", None, None, None, None, "go", "parsed", None), (3, None, "c.py", None, 1, "ok", 1, "python", None, None), (4, "p", None, None, 1, "ok", 1, "python", None, None), (5, "p", "n.py", None, 1, "ok", 1, "python", None, None), (6, "p", "r.md", None, 1, "ok", 1, "markdown", None, None)]
    chunks = [(2, "p", "a.py", 1, 2, "    return (1", None, "x"), (1, "p", "a.py", 0, 1, "def f():", None, "x"), (1, "p", "a.py", 0, 1, "def f():", None, "x"), (3, "p", "b.go", 0, None, "package a\n", None, None), (4, "p", "r.md", 0, 1, "((", None, None), (5, "p", None, 0, 1, "x", None, None), (6, "p", "b.go", None, 1, "((", None, None)]
    got = syntax.parse_verdicts(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS))
    assert sorted((r.file_id, r.fault) for r in got.collect()) == [(1, "premature_end"), (2, None)]
    rates = {(r.project, r.language): (r.files, r.faulty, r.rate) for r in syntax.fault_rates(got).collect()}
    assert rates == {("p", "python"): (1, 1, 1.0), ("p", "go"): (1, 0, 0.0)}
    assert syntax.parse_verdicts(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)).count() == 0


def _kind(path, text, language=None, digest="", texts=(), hashes=()):
    emit = origin._judge(frozenset(["lumenkit"]), frozenset(hashes), [origin.shingles(t) for t in texts])
    return emit(File("p", path, [(1, language, None, None, None, digest)], text))[0][4]


HAND = 'import os\n\ndef f(a):\n    """Doc."""\n    return os.path.join(a, "x")\n'


def test_origin_rules():
    assert _kind("src/a.py", HAND) is None
    for path in ("vendor/x/a.py", "a/node_modules/b.js", "deps/lumenkit/a.c", "lib/site-packages/q/a.py"):
        assert _kind(path, HAND) == "vendored", path
    for path in ("src/vendors/a.py", "app/vendor_portal/a.py", "deps/own/a.c", "src/third_party_billing/a.py", "src/generator/a.py", "tools/generated_docs_check.py"):
        assert _kind(path, HAND) is None, path
    assert _kind("x/poetry.lock", "a") == "lock" and _kind("src/a_pb2.py", HAND) == "generated" and _kind("web/a.min.js", "x") == "minified"
    for head in ("# Code generated by x. DO NOT EDIT.", "# @generated by x", "# AUTO-GENERATED FILE", "# Licence: x\n#\n# This file was automatically generated by y 1.2", "# Diese Datei wurde von y erzeugt, bitte nicht von Hand ändern."):
        assert _kind("src/a.py", head + "\n" + HAND) == "generated", head
    for head in ("# Please edit freely, nothing regenerates this module.", "# Replaces the client we used to generate; written by hand since then.", "# Writes the header that marks output of y.", "# Wrapper around lumenkit, ours."):
        assert _kind("src/a.py", head + "\n" + HAND) is None, head
    for head in ("# Taken unchanged from x (upstream tag v1.2)", "# Copyright (c) the x contributors. Bundled copy, report bugs upstream.", "# x 5.1.0 - https://x.example - released by the x authors"):
        assert _kind("src/a.py", head + "\n" + HAND) == "vendored", head
    assert _kind("src/a.py", HAND + 'M = "DO NOT EDIT"\n') is None
    assert _kind("docs/a.md", "Code generated by x. DO NOT EDIT.") is None
    assert _kind("src/a.py", HAND, digest="ABC", hashes=["abc"]) == "vendored"


def test_origin_by_layout_literals_and_similarity():
    minified = "".join(f"function f{k}(a){{var b=a[{k}];return b?f(b):a}}" for k in range(30))
    assert _kind("src/a.js", minified) == "minified"
    assert _kind("src/a.c", "static const char x[] = {\n" + "    0x12, 0x34,\n" * 100 + "};\n") == "data"
    assert _kind("src/a.py", HAND + 'LONG = "' + "word " * 400 + '"\n') is None
    known = "\n".join(f"def function_number_{k}(argument, other):\n    return argument + {k} * other" for k in range(30))
    assert _kind("src/a.py", known + "\n# a note added here\n", texts=[known]) == "vendored"
    assert _kind("src/a.py", HAND * 40, texts=[known]) is None
    assert _kind("src/e.py", "") is None and _kind("src/e.py", None) is None


def test_canonical_lines():
    original, emitted = origin.canonical("if (a; b) {\n  x = [1,\n  2];\n} else { y(); }\nz", "javascript")
    assert original == ["if @ {", "  x = @;", "} else { y@; }", "z"]
    assert [x.strip() for x in emitted] == ["if @ {", "x = @;", "}else {", "y@;", "}", "z"]
    allman, knr = "int f(int a)\n{\n    g(a);\n    return 1;\n}\n", "int f(int a) {\n    g(a);\n    return 1;\n}\n"
    for text in (allman, knr):
        m = origin.layout(text, "c")
        assert m["uniform"] == 1.0 and 0.7 <= m["expansion"] <= 1.0
    assert origin.layout(knr.replace("\n", " "), "c")["expansion"] >= 4
    assert origin.layout(knr.replace("    g(a);\n    return", "  g(a); return"), "c")["uniform"] < 0.9


def test_a_generated_header_over_an_irregular_layout_is_not_believed():
    head = "// Code generated by x. DO NOT EDIT.\n"
    tidy = "".join(f"function f{k}(a) {{\n    g(a, {k});\n    return a;\n}}\n" for k in range(5))
    assert _kind("src/a.js", head + tidy) == "generated"
    assert _kind("src/a.js", head + tidy.replace(";\n    return", "; return").replace("    g", "   g  ")) is None


def test_rewrapped_and_indented_copies_are_similar():
    known = "\n".join(f"def function_number_{k}(argument, other):\n    return argument + {k} * other" for k in range(30))
    changed = "\r\n".join("\t\t" + x for x in known.replace("(argument, other)", "(\n argument,\n other)").split("\n"))
    assert _kind("src/a.py", changed, texts=["unlike " * 9, known]) == "vendored"
    assert _kind("src/a.py", known[: len(known) // 2], texts=[known]) is None


def test_origins_over_tables(spark):
    cat = spark.createDataFrame([(1, "lumenkit", "lumenkit/a.py", "h1", 10), (2, None, None, None, None)], "item_id int, library string, path string, content_hash string, size long")
    files = [(1, "p", "x/a.py", "h1", 3, "ok", 1, "python", None, None), (2, "p", "y/b.py", "h2", 3, "ok", 1, "python", None, None), (3, "p", "z/c.py", None, None, None, None, None, None, None)]
    body = "\n".join(f"def function_number_{k}(argument, other):\n    return argument + {k}" for k in range(20))
    chunks = [(1, "p", "x/a.py", 0, 1, body, None, None), (2, "p", "y/b.py", 0, 1, body + "\n# patched", None, None)]
    got = {r.file_id: (r.kind, r.evidence) for r in origin.origins(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS), cat).collect()}
    assert got == {1: ("vendored", "catalogue"), 2: ("vendored", "similar"), 3: (None, None)}
    assert origin.origins(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS), cat.limit(0)).count() == 0


def test_scan_counts():
    s = scan('x = "a(b" # c(\n', "python")
    assert s.code == 'x = ""   \n'.replace("   ", "  ") and s.literals == ['"a(b"'] and not s.open_quote
    assert scan("x = 'a\n", "python").open_quote
