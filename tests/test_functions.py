"""Path and text functions, one case per rule."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import paths, text

CASES = [
    ("src/app.py", "source"), ("weird", "source"), ("build/readme.md", "generated"), ("a/node_modules/x.js", "generated"), ("poetry.lock", "generated"), ("x/api_pb2.py", "generated"), ("x/y_generated.go", "generated"), ("app.min.js", "generated"),
    ("docs/a.py", "docs"), ("README", "docs"), ("README.weird", "source"), ("tests/notes.md", "docs"), ("tests/a.py", "tests"), ("examples/tests/a.py", "tests"), ("Foo.Tests/A.cs", "tests"), ("src/FooTests.cs", "tests"), ("src/Contest.cs", "source"),
    ("conftest.py", "tests"), ("test_a.py", "tests"), ("a.spec.ts", "tests"), ("examples/a.py", "examples"), ("Samples/a.py", "examples"), ("a\\tests\\b.py", "tests"), ("", "source"), ("build", "source"),
]


def test_file_class(spark):
    df = spark.createDataFrame(CASES, "path string, expected string").withColumns({"got": paths.file_class(F.col("path")), "w": paths.class_weight(F.col("path"))})
    rows = df.collect()
    assert [(r.path, r.got) for r in rows] == CASES
    assert all(paths.CLASSES[r.w] == r.got for r in rows)
    assert spark.createDataFrame([("kb/x.py",)], "p string").select(paths.file_class(F.col("p"), docs=("kb",))).first()[0] == "docs"


def test_native_plan(spark):
    plan = spark.createDataFrame(CASES, "path string, expected string").where(paths.file_class(F.col("path")) == "tests")._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.py", "a/b.py", "a.pyc"), ("a?c", "abc", "ac"), ("[a-c]x", "bx", "dx"), ("[!a]x", "bx", "ax"), ("x.y", "x.y", "xzy")])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "p string").select(F.col("p").rlike(paths.glob_regex(glob)).alias("m"))
    assert [r.m for r in df.collect()] == [True, False]


def test_lines_and_tokens(spark):
    texts = ["a\r\nb\rc\n", "", "one", "x\x0cy\n\n", "a\u2028b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.lines(F.col("t")).alias("l")).collect()
    assert [list(r.l) for r in got] == [["a", "b", "c"], [], ["one"], ["x\x0cy", ""], ["a\u2028b"]]
    toks = spark.createDataFrame([("refreshToken foo_bar X HTTPServer2",)], "t string").select(text.index_tokens(F.col("t")).alias("i"), text.terms(F.col("t")).alias("s")).first()
    assert toks.i == ["refreshToken", "refresh", "token", "foo_bar", "foo", "bar", "X", "HTTPServer2", "http", "server", "2"]
    assert "foo" in toks.s and "refreshtoken" in toks.s


def test_symbol_guess(spark):
    lines = ["  async def go(x):", "class A:", "export function f() {", "function g$1() {", "pub fn h() -> u32 {", "static int verify_link(struct x *y)", "x = 1", "    public Foo Bar(int a)"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(text.guess_symbol(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == ["go", "A", "f", "g$1", "h", "verify_link", None, "Bar"]


def test_sniffs_and_sensitivity(spark):
    rows = [(b"abc\0d",), ("é".encode() * 3000,), (b"\xff\xfe",), (b"",)]
    got = spark.createDataFrame(rows, "b binary").select(text.is_binary(F.col("b")).alias("n"), text.is_utf8_sample(F.col("b")).alias("u")).collect()
    assert [(r.n, r.u) for r in got] == [(True, True), (False, True), (False, False), (False, True)]
    names = spark.createDataFrame([("a/.env.local",), ("k.pem",), ("secrets_x.yaml",), ("src/key.py",)], "p string").select(paths.is_sensitive_name(F.col("p")).alias("s")).collect()
    assert [r.s for r in names] == [True, True, True, False]
    value = "AKIA" + "ABCDEFGHIJKLMNOP"
    assert spark.createDataFrame([(f"x = {value}",), ("x",)], "t string").where(paths.is_sensitive_text(F.col("t"))).count() == 1
