"""Path functions as native Column expressions: file class, language, data payload, ignore and sensitivity rules.

Every function is a plain expression tree, so filters built from it stay inside whole-stage codegen.
"""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file classes and the names by which they are told apart.
CLASSES = ("source", "examples", "tests", "docs", "generated")
GENERATED_DIRS = (".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "coverage", "dist", "htmlcov", "node_modules", "out", "site-packages", "target", "venv")
GENERATED_SUFFIXES = (".designer.cs", ".freezed.dart", ".g.cs", ".g.dart", ".map", ".min.css", ".min.js", ".pb.go", "_pb2.py", "_pb2_grpc.py")
GENERATED_MARKERS = ("_generated.", ".generated.")
LOCK_NAMES = ("cargo.lock", "composer.lock", "gemfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock")
DOC_DIRS = ("doc", "docs", "documentation")
DOC_SUFFIXES = (".adoc", ".asciidoc", ".markdown", ".md", ".rst", ".txt")
DOC_NAMES = ("authors", "changelog", "contributing", "copying", "licence", "license", "notice", "readme")
EXAMPLE_DIRS = ("demo", "demos", "example", "examples", "sample", "samples")
TEST_DIRS = ("__tests__", "spec", "specs", "test", "tests")
TEST_NAMES = ("conftest.py",)
TEST_PREFIXES = ("test_", "test-")
TEST_SUFFIXES = (".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", "_test.c", "_test.cc", "_test.cpp", "_test.cxx", "_test.go", "_test.py", "_test.rs")
TEST_CAMEL_SUFFIXES = ("Test.cs", "Tests.cs", "Test.java", "Tests.java", "Test.kt", "Tests.kt")
SKIP_DIRS = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", ".idea", ".pytest_cache", ".mypy_cache", ".ruff_cache", "site-packages", ".tox", "coverage", "htmlcov")
IGNORED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock", "uv.lock", "*.lock", "*.min.js", "*.min.css", "*.map", "*.pb.go", "*_pb2.py", "*_generated.*")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".webp", ".pdf", ".zip", ".gz", ".tar", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".class", ".so", ".o", ".a", ".dll", ".exe", ".bin", ".wasm", ".pyc", ".pyo", ".db", ".sqlite", ".sqlite3", ".mp3", ".mp4", ".avi", ".mov", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".svgz", ".DS_Store", ".lockb")
SENSITIVE_NAMES = (".env*", "*.pem", "*.key", "id_rsa*", "*.p12", "*.kdbx", "credentials*", "secrets*.json", "secrets*.yaml", "secrets*.yml", "secrets*.toml", "*.tfstate")
SENSITIVE_CONTENT = (r"AKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"gh[pousr]_[A-Za-z0-9]{36,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"xox[baprs]-[A-Za-z0-9-]{10,}")
SENSITIVE_CHARS = 262_144
DATA_LANGUAGES = ("json", "yaml", "toml")
DATA_EXTENSIONS = (".json", ".yaml", ".yml", ".toml")
# Language names by extension; an unknown extension names itself, and a path without one is text.
LANGUAGES = {"py": "python", "md": "markdown", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "h": "cpp", "cs": "csharp", "sh": "shell", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "txt": "text"}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def parts(path: Column) -> Column:
    """Path segments without empty ones and single dots; backslashes count as slashes."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def base(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def top_directory(path: Column) -> Column:
    """First segment of a path with directories, else a dot."""
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise(".")


def _either(names: tuple[str, ...]) -> str:
    """A group of literal alternatives."""
    return "(?:" + "|".join("".join("\\" + c if c in r"\.^$|+(){}[]*?" else c for c in n) for n in names) + ")"


def in_dirs(path: Column, names: tuple[str, ...]) -> Column:
    """Whether any directory of the path, in lower case, is one of ``names``: one compiled pattern, no splitting."""
    return F.lower(F.translate(path, "\\", "/")).rlike(f"(?:^|/){_either(names)}/")


def ends_with(column: Column, suffixes: tuple[str, ...]) -> Column:
    return any_of([column.endswith(s) for s in suffixes])


def _class_rules(path: Column, docs: tuple[str, ...], examples: tuple[str, ...], tests: tuple[str, ...]) -> list[tuple[Column, str]]:
    """(condition, class) in the order they are tried; source where none holds."""
    # One pattern per rule and spelling: conditional branches share no subexpressions, so each must be cheap by itself.
    plain = F.translate(path, "\\", "/")
    low = F.lower(plain)
    generated = low.rlike(f"(?:^|/){_either(GENERATED_DIRS)}/|(?:^|/){_either(LOCK_NAMES)}$|{_either(GENERATED_SUFFIXES)}$|{_either(GENERATED_MARKERS)}[^/]*$")
    document = low.rlike(f"(?:^|/){_either(DOC_DIRS + docs)}/|{_either(DOC_SUFFIXES)}$|(?:^|/){_either(DOC_NAMES)}$")
    test = low.rlike(f"(?:^|/){_either(TEST_DIRS + tests)}/|\\.tests?/") | plain.rlike(f"(?:^|/)(?:{_either(TEST_NAMES)}$|{_either(TEST_PREFIXES)}[^/]*$)|{_either(TEST_SUFFIXES + TEST_CAMEL_SUFFIXES)}$")
    return [(generated, "generated"), (document, "docs"), (test, "tests"), (in_dirs(path, EXAMPLE_DIRS + examples), "examples")]


def file_class(path: Column, docs: tuple[str, ...] = (), examples: tuple[str, ...] = (), tests: tuple[str, ...] = ()) -> Column:
    """source, examples, tests, docs or generated, by ordered rules; the arguments add directory names to a class."""
    out = F
    for condition, name in _class_rules(path, docs, examples, tests):
        out = out.when(condition, name)
    return out.otherwise("source")


def class_weight(path: Column) -> Column:
    """Sort position of the file class: 0 source, 1 examples, 2 tests, 3 docs, 4 generated; each rule is tried once."""
    out = F
    for condition, name in _class_rules(path, (), (), ()):
        out = out.when(condition, CLASSES.index(name))
    return out.otherwise(0)


def language(path: Column) -> Column:
    """Language by what stands after the last dot; the extension itself where it is unknown, ``text`` where there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.when(ext != "", ext).otherwise("?"))
    return F.coalesce(known, F.nullif(ext, F.lit("")), F.lit("text"))


def is_data(path: Column, lang: Column) -> Column:
    """Pure data files: by language or extension."""
    return F.coalesce(lang.isin(*DATA_LANGUAGES), F.lit(False)) | ends_with(F.lower(path), DATA_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """A Java regular expression equal to a shell pattern."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            k = end
        else:
            out.append("\\" + c if c in r"\.^$|+(){}[]" else c)
        k += 1
    return f"(?s)^(?:{''.join(out)})$"


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a shell pattern matches the whole path or its last segment."""
    regex = "|".join(glob_regex(g).removeprefix("(?s)") for g in globs)
    return path.rlike(f"(?s){regex}") | base(path).rlike(f"(?s){regex}")


def is_skipped(path: Column) -> Column:
    return in_dirs(path, SKIP_DIRS)


def is_ignored(path: Column) -> Column:
    return matches_any(path, IGNORED_NAMES)


def is_sensitive_name(path: Column) -> Column:
    return matches_any(path, SENSITIVE_NAMES)


def is_sensitive_text(text: Column) -> Column:
    """Whether the first ``SENSITIVE_CHARS`` characters hold a credential of a known shape."""
    return F.left(text, F.lit(SENSITIVE_CHARS)).rlike("|".join(f"(?:{p})" for p in SENSITIVE_CONTENT))


def python_matches(path: str, globs: tuple[str, ...]) -> bool:
    """The same as ``matches_any``, for one path on the driver or in a source."""
    return any(fnmatch.fnmatchcase(path, g) or fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], g) for g in globs)
