"""Statement checks per language: valid texts that look odd, damaged ones, and texts of another language."""

import sysconfig
import warnings
from pathlib import Path

import pytest
from codelode.llm.syntax import syntax_error

PY = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\nclass A:\n    x = 1\n"
JS = 'import { a } from "./a";\n\nexport async function load(path, n = 2) {\n  for await (const x of a(path)) {\n    if (x?.of in n) { continue; }\n  }\n  return n ? (b) : { c: n };\n}\n'
TS = 'import type { A } from "./a";\n\nexport abstract class B<T extends A> implements C {\n  private readonly x: T | undefined;\n  constructor(public name: string, y?: number) { super(); }\n  is(v: unknown): v is T { return v as unknown as boolean; }\n}\ntype D = keyof typeof x;\n'
GO = 'package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tn int\n}\n\nvar x = 1 +\n\t2\n\nfunc (t *T) Run(a int, b string) (int, error) {\n\tif err := f(a); err != nil {\n\t\treturn 0, err\n\t}\n\tfmt.Println(b)\n\treturn a, nil\n}\n'
RUST = 'use std::io;\n\n#[derive(Debug)]\npub struct A<\'a> {\n    s: &\'a str,\n}\n\nimpl<\'a> A<\'a> {\n    pub fn f(&self, n: u32) -> Result<u32, ()> {\n        let x = if n == 1 { r#"a " b"# } else { "\\r" };\n        println!("{x}");\n        Ok(n)\n    }\n}\n\nmacro_rules! m { ($a:expr) => { $a }; }\nm!(3);\n'
C = '#include <a.h>\n#define TWICE(x) ((x) + (x))\n\nstatic const char *names[] = { "a", "b" };\nstruct p { int x : 3; };\n\n#ifdef WIDE\nint f(long n) {\n#else\nint f(int n) {\n#endif\n    switch (n) {\n    case (1): return n ? 1 : 2;\n    default: return 0;\n    }\n}\n\nMODULE_END(f)\n'
CS = 'using System;\n\nnamespace A;\n\npublic sealed record B(int X) : C(X)\n{\n    public string Name { get; set; } = "";\n    public async Task<int> Run(int n, string s = null) => await F(n: 1);\n#if WIDE\n    int a() {\n#else\n    int a(int b) {\n#endif\n        var q = from x in y where x.A > 1 select x;\n        return q switch { null => 0, _ => 1 };\n    }\n}\n'
VALID = {"python": PY, "javascript": JS, "typescript": TS, "go": GO, "rust": RUST, "c": C, "csharp": CS}
ALSO_VALID = [
    ("python", 'impl = 1\nfn = 2\nvar = 3\nnamespace = {}\nx = f"{impl["a"]}"\nmatch impl:\n    case 1: pass\n'), ("python", "\ufeffx = 1\n"), ("python", ""), ("javascript", "#!/usr/bin/env node\nconst a = `x ${b ? `y ${c}` : `{`} z`;\n"), ("javascript", "outer: for (;;) { continue outer; }\nlet re =\n  /[\"'`]/;\n"), ("javascript", "const v = <p>Some words here</p>;\n"),
    ("typescript", "declare module 'x';\nexport as namespace y;\n"), ("go", "// c\npackage a\n"), ("rust", "#![allow(x)]\n"), ("c", "#if 0\n} this isn't code {\n#else\nint x;\n#endif\n"), ("csharp", 'Console.WriteLine("x");\n'),
]


@pytest.mark.parametrize(("language", "text"), [*VALID.items(), *ALSO_VALID])
def test_valid(language, text):
    assert syntax_error(text, language) is None


@pytest.mark.parametrize("language", VALID)
@pytest.mark.parametrize("other", VALID)
def test_text_of_another_language(language, other):
    if other == language or (language, other) == ("typescript", "javascript"):
        return
    assert syntax_error(VALID[other], language) is not None


DAMAGED = [
    ("python", "x = = 1\ny = 2\n"), ("python", "def f(a b):\n    pass\n\n\nz = 1\n"), ("python", "class 1A:\n    pass\n\n\nz = 1\n"), ("python", "def f(x, 1):\n    pass\nz = 1\n"), ("python", "if x = 3:\n    pass\nz = 1\n"), ("python", "def f():\n    return return y\nz = 1\n"), ("python", "x = 'abc\ny = 1\n"),
    ("javascript", "const x: number = 1;\n"), ("javascript", "function f(a: T) { return a; }\n"), ("javascript", "let x = ;\n"), ("javascript", "def f(x) { }\n"), ("javascript", "if x { y(); }\n"), ("javascript", "class A extends B implements C { }\n"), ("javascript", "let x = `a ${b\n"),
    ("typescript", "internal class A { }\n"), ("typescript", "let x = = 1;\n"), ("typescript", "func main() { }\n"), ("go", "x := 1\n"), ("go", "package a\n\nx := 1\n"), ("go", "package a\n\nfunc f() {\n"), ("go", "package a\n\nvar x = ;\n"), ("rust", "let x = 1;\n"), ("rust", "fn f() { (1 }\n"), ("rust", "class A { }\n"), ("rust", "fn f() -> u8\n"),
    ("c", "int f() { return 1; \n"), ("c", "class A { int x; };\n"), ("c", "int x = ;\n"), ("c", "#ifdef A\nint x;\n"), ("c", "use a::b;\n"), ("c", "int f(int a)"), ("csharp", "using A;\nclass B { int x = ; }\n"), ("csharp", "import { a } from \"b\";\n"), ("csharp", "class A { void F() { } \n"), ("json", '{"a": 1,}'), ("json", ""), ("c", "int x;\n<<<<<<< a\nint y;\n=======\nint z;\n>>>>>>> b\n"),
]


@pytest.mark.parametrize(("language", "text"), DAMAGED)
def test_damaged(language, text):
    assert syntax_error(text, language) is not None


@pytest.mark.parametrize("language", VALID)
def test_every_lost_bracket_is_seen(language):
    text = "\n".join(x for x in VALID[language].split("\n") if not x.startswith("#define"))
    if "#else" in text:  # only one arm of a condition is read
        text = text[: text.index("#if")] + text[text.index("#else") + 6 :].replace("#endif\n", "")
    lost = [text[:k] + text[k + 1 :] for k, c in enumerate(text) if c in "()[]{}"]
    seen = sum(syntax_error(t, language) is not None for t in lost)
    assert seen >= 0.9 * len(lost), (seen, len(lost))


def test_no_file_of_the_standard_library_is_flagged():
    import ast

    root = Path(sysconfig.get_paths()["stdlib"])
    flagged = []
    for path in sorted(root.glob("*.py")) + sorted(root.glob("*/*.py"))[:400]:
        text = path.read_text(encoding="utf8", errors="replace")
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        if syntax_error(text, "python"):
            flagged.append(path)
    assert not flagged
