"""Table functions from text to chunks, symbols, references and imports."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, guess_symbol, lines

#: Characters of a text that stay one chunk, lines of a window and lines shared by windows.
CHUNK_CHARS, WINDOW_LINES, OVERLAP_LINES = 1000, 80, 10
_BREAK = re.compile(r"\r\n|\n|\r")


def split_lines(text: str) -> list[str]:
    got = _BREAK.split(text) if text else []
    return got[:-1] if got and got[-1] == "" else got


def window_spans(text: str) -> list[tuple[int, int]]:
    """First and last line (1-based) of each window chunk: no line is cut, none left out."""
    rows = split_lines(text)
    if not rows:
        return []
    if len(text) <= CHUNK_CHARS:
        return [(1, len(rows))]
    spans, at = [], 0
    while True:
        window = rows[at : at + WINDOW_LINES]
        if sum(map(len, window)) + len(window) - 1 <= CHUNK_CHARS:
            spans.append((at + 1, at + len(window)))
        else:  # near the limit, at line ends; a longer line stands alone
            first, size = at, -1
            for k, line in enumerate(window, at):
                if k > first and size + 1 + len(line) > CHUNK_CHARS:
                    spans.append((first + 1, k))
                    first, size = k, -1
                size += 1 + len(line)
            spans.append((first + 1, at + len(window)))
        if at + WINDOW_LINES >= len(rows):
            return spans
        at += WINDOW_LINES - OVERLAP_LINES


def window_chunks(texts: DataFrame, key: str) -> DataFrame:
    """(key, chunk_index, start_line, end_line, chunk_hash, text) of (key, text) rows."""
    out = "k string, chunk_index int, start_line int, end_line int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = split_lines(text)
                got += [(k, n, s, e, "\n".join(rows[s - 1 : e])) for n, (s, e) in enumerate(window_spans(text))]
            if got:
                cols = list(zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string())], names=["k", "chunk_index", "start_line", "end_line", "text"])

    rows = texts.where("text IS NOT NULL").select(F.col(key).cast("string").alias("k"), "text").mapInArrow(run, out)
    return rows.select(F.col("k").alias(key), "chunk_index", "start_line", "end_line", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("chunk_hash"), "text")


def first_symbol(text: Column) -> Column:
    """The first name that a line of the text declares."""
    return F.get(F.filter(F.transform(lines(text), guess_symbol), lambda s: s.isNotNull()), F.lit(0))


def textual_references(chunks: DataFrame) -> DataFrame:
    """(project, file, line, to_name, relationship): identifiers of at least three characters, calls where ``(`` follows.

    Comment lines are skipped and import lines give one ``includes`` reference to what they import. Rows are the first
    per (line, name, relationship).
    """
    numbered = chunks.select("project", "file", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("project", "file", (F.col("start_line") + F.col("i")).alias("line"), F.trim(F.translate("text", "\t", " ")).alias("t"))
    code = numbered.where("t != ''").where(~F.col("t").rlike(r"^(#(?!include)|//|\*|--)"))
    # A declaration that is exported, and prose that starts with "from" or "using", import nothing.
    other = F.col("t").rlike(r"^export\b(?!.*\bfrom\s*[\"'])|^from\b(?!\s+[\w.]+\s+import\b)|^using\b(?!.*;)")
    target = F.when(~other, import_target(F.col("t")))
    imports = code.where(target.isNotNull()).select("project", "file", "line", target.alias("to_name"), F.lit("includes").alias("relationship"))
    words = code.where(target.isNull()).select("project", "file", "line", F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}\(?"), F.lit(0))).alias("w"))
    names = words.select("project", "file", "line", F.rtrim(F.translate("w", "(", " ")).alias("to_name"), F.when(F.col("w").endswith("("), "call").otherwise("identifier").alias("relationship"))
    return imports.unionByName(names).distinct()


def import_target(line: Column) -> Column:
    """What an import line imports, else null: module of ``from``/``import``/``use``/``using``, or the quoted path."""
    quoted = F.regexp_extract(line, r"^(?:import|export|require|#include)\b.*[\"'<]([^\"'<>]+)[\"'>]", 1)
    module = F.regexp_extract(line, r"^(?:from|import|use|using)\s+([A-Za-z_.][\w.:]*)", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(module, F.lit("")))


def imports_of(chunks: DataFrame) -> DataFrame:
    """(project, file, line, raw_target): import lines of the corpus; only such lines are shuffled."""
    numbered = chunks.select("project", "file", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    got = numbered.where(F.col("t").rlike(r"^(from|import|use|using|export|require|#include)\b")).withColumn("raw_target", import_target(F.col("t")))
    return got.where("raw_target IS NOT NULL").select("project", "file", (F.col("start_line") + F.col("i")).alias("line"), "raw_target").distinct()


_GO_GROUP = re.compile(r"^import\s*\(", re.M)
_GO_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"([^\"\n]*)\"|`([^`]*)`|(\))", re.S)


def go_group_targets(chunks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(line, path) inside the ``import ( … )`` groups of a Go file's (start line, text) chunks, which may overlap."""
    rows: dict[int, str] = {}
    for start, text in chunks:
        for line, row in enumerate(text.split("\n"), start):
            rows.setdefault(line, row)
    numbers = sorted(rows)
    text = "\n".join(rows[k] for k in numbers)
    out: list[tuple[int, str]] = []
    for group in _GO_GROUP.finditer(text):
        for m in _GO_TOKEN.finditer(text, group.end()):
            if m.group(3):
                break
            if path := m.group(1) or m.group(2):
                out.append((numbers[text.count("\n", 0, m.start())], path))
    return out


def grouped_imports(chunks: DataFrame) -> DataFrame:
    """(project, file, line, raw_target): the paths inside Go import groups, read per file as a group may span chunks."""
    ddl = "project string, file string, line int, raw_target string"
    mine = chunks.where("file LIKE '%.go' AND project IS NOT NULL AND start_line IS NOT NULL AND text IS NOT NULL")
    files = mine.groupBy("project", "file").agg(F.array_sort(F.collect_set(F.struct("start_line", "text"))).alias("c")).where(F.exists("c", lambda x: x["text"].rlike(r"(?m)^import\s*\(")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, f, *r) for p, f, c in zip(*[x.to_pylist() for x in b.columns]) for r in go_group_targets([(x["start_line"], x["text"]) for x in c])]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [pa.string(), pa.string(), pa.int32(), pa.string()])], names=[x.split()[0] for x in ddl.split(", ")])

    return files.select("project", "file", "c").mapInArrow(run, ddl)


def go_modules(chunks: DataFrame) -> DataFrame:
    """(project, module) by the ``go.mod`` in a project's root."""
    rows = chunks.where("file = 'go.mod'").select("project", F.explode(F.split("text", "\n")).alias("t"))
    module = F.regexp_extract("t", r"^module\s+\"?([^\s\"]+)", 1)
    return rows.where(module != "").groupBy("project").agg(F.min(module).alias("module"))


def _parts(path: Column) -> Column:
    """The parts of a path without ``.`` and ``..``; null if it leaves the root."""
    none = F.lit(None).cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(none)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def resolve_imports(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Imports with ``resolved_file``: the first candidate path that the project has, or null.

    Candidates go by language: package paths with and without ``src/``, ``__init__``, leading dots counted from the
    file's package; relative modules with extensions and index files; quoted headers beside the file and from the root;
    the first file, tests aside, of a Go package's directory, its path taken without the project's module (project,
    module) in ``modules``.
    """
    here = F.regexp_replace("file", r"[^/]*$", "")
    target = F.col("raw_target")
    path = lambda p: F.array_join(_parts(p), "/")
    dotted = F.regexp_replace("raw_target", r"\.", "/")
    dots = F.length(F.regexp_extract("raw_target", r"^\.*", 0))
    module = _parts(F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.regexp_replace(F.regexp_replace("raw_target", r"^\.+", ""), r"\.", "/")))
    inner = F.array(F.concat(F.array_join(module, "/"), F.lit(".py")), F.array_join(F.concat(module, F.array(F.lit("__init__.py"))), "/"))
    python = F.when(dots > 0, inner).otherwise(F.array(*[F.concat(p, dotted, s) for p in (F.lit(""), F.lit("src/"), here) for s in (F.lit(".py"), F.lit("/__init__.py"))]))
    relative = path(F.concat(here, target))
    script = F.array(*[F.concat(relative, F.lit(s)) for s in ("", ".ts", ".tsx", ".js", ".jsx")], *[path(F.concat(here, target, F.lit(s))) for s in ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")])
    header = F.array(relative, path(target))
    package = F.when(target == F.col("module"), "").when(target.startswith(F.concat("module", F.lit("/"))), F.expr("substring(raw_target, length(module) + 2)")).otherwise(target)
    go = F.array(F.concat(path(package), F.lit("/")), F.concat(path(package), F.lit(".go")))
    ext = F.regexp_extract("file", r"\.([^./]+)$", 1)
    paths = F.when(ext == "py", python).when(ext.isin("js", "ts", "jsx", "tsx"), script).when(ext.isin("c", "h", "cpp"), header).when(ext == "go", go).otherwise(F.array().cast("array<string>"))
    known = imports.join(modules, "project", "left") if modules is not None else imports.withColumn("module", F.lit(None).cast("string"))
    # A directory ends with a slash and stands for its first Go file.
    packages = files.where(r"path LIKE '%.go' AND path NOT LIKE '%\_test.go'").groupBy("project", F.concat(F.regexp_replace("path", r"/?[^/]*$", ""), F.lit("/")).alias("path")).agg(F.min("path").alias("found"))
    homes = files.select("project", "path", F.col("path").alias("found")).unionByName(packages)
    tried = known.select("*", F.posexplode(paths).alias("priority", "path")).join(homes, ["project", "path"])
    best = tried.groupBy("project", "file", "line", "raw_target").agg(F.min_by("found", "priority").alias("resolved_file"))
    return imports.join(best, ["project", "file", "line", "raw_target"], "left")


def symbol_table(rows: DataFrame) -> DataFrame:
    """Declarations, one per (file, qualified name, kind, declaration hash): the first range wins."""
    w = Window.partitionBy("project", "file", "qualified_name", "symbol_type", "decl_hash").orderBy("start_line", "end_line", "id")
    return rows.where("source = 'ast'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def signature(line: Column) -> Column:
    """Declaration head: up to the body, white space collapsed, 120 characters at most."""
    return F.left(collapse(F.regexp_replace(line, r"[:{]\s*$", "")), F.lit(120))


def visibility(name: Column, head: Column, lang: Column) -> Column:
    return F.when(lang == "python", F.when(name.startswith("_"), "private").otherwise("public")).when(lang == "rust", F.when(head.rlike(r"^\s*pub\b"), "public").otherwise("private"))


def python_declarations(text: str) -> list[tuple[str, str, str | None, int, int]] | None:
    """(qualified name, kind, container, first line, last line) of a Python text; None if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[tuple[str, str, str | None, int, int]] = []
    todo: list[tuple[ast.AST, str | None, bool]] = [(n, None, False) for n in reversed(tree.body)]
    while todo:
        node, owner, in_class = todo.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            name = f"{owner}.{node.name}" if owner else node.name
            is_class = isinstance(node, ast.ClassDef)
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((name, "class" if is_class else "method" if in_class else "function", owner, first, node.end_lineno or node.lineno))
            todo += [(n, name, is_class) for n in reversed(node.body)]
    return out


def declarations(texts: DataFrame) -> DataFrame:
    """Declarations of texts (project, file, text), with a verdict per file, also where nothing is declared.

    Python is parsed (source ``ast``, verdict parsed or parse_error). No other language has a parser here: the verdict is
    parse_unavailable, and declarations of brace languages come from a scanner (source ``regex``).
    """
    ddl = "project string, file string, verdict string, source string, qualified_name string, symbol_type string, container string, start_line int, end_line int"
    kinds = [pa.string()] * 7 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for project, file, text in zip(*[c.to_pylist() for c in b.columns]):
                ext = file.rpartition(".")[2].lower()
                python = ext == "py"
                found = python_declarations(text) if python else brace_declarations(text, ext) if ext in BRACED else []
                verdict = "parse_unavailable" if not python else "parse_error" if found is None else "parsed"
                got += [(project, file, verdict, "ast" if python else "regex", *row) for row in found or []] or [(project, file, verdict, *[None] * 6)]
            if got:
                names = [x.split()[0] for x in ddl.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=names)

    return texts.where("text IS NOT NULL").select("project", "file", "text").mapInArrow(run, ddl)


def whole_texts(chunks: DataFrame) -> DataFrame:
    """(project, file, text): each file's chunks in order, repeated rows once, joined by line feeds."""
    once = chunks.where("project IS NOT NULL AND file IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL").select("project", "file", F.struct("chunk_index", "text").alias("c"))
    return once.groupBy("project", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_set("c")), lambda x: x["text"]), "\n").alias("text"))


def python_references(text: str) -> list[tuple[int, str | None, str, str, str | None]]:
    """(line, enclosing declaration, name, relationship, receiver) of calls, base classes and imports of a Python text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[int, str | None, str, str, str | None]] = []
    todo: list[tuple[ast.AST, str | None]] = [(n, None) for n in reversed(tree.body)]
    while todo:
        node, owner = todo.pop()
        inner = owner
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            inner = f"{owner}.{node.name}" if owner else node.name
            if isinstance(node, ast.ClassDef):
                out += [(b.lineno, inner, *_named(b)[:1], "base_class", _named(b)[1]) for b in node.bases if _named(b)]
        elif isinstance(node, ast.Call) and (n := _named(node.func)):
            out.append((node.lineno, owner, n[0], "call", n[1]))
        elif isinstance(node, ast.Import):
            out += [(node.lineno, owner, a.name, "includes", None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((node.lineno, owner, "." * node.level + (node.module or ""), "includes", None))
        todo += [(n, inner) for n in reversed(list(ast.iter_child_nodes(node)))]
    return list(dict.fromkeys(out))


def _named(node: ast.AST) -> tuple[str, str | None] | None:
    if isinstance(node, ast.Name):
        return node.id, None
    if isinstance(node, ast.Attribute):
        return node.attr, node.value.id if isinstance(node.value, ast.Name) else None
    return None


def references_of(text: str, ext: str) -> list[tuple[int, str | None, str, str, str | None]]:
    return python_references(text) if ext == "py" else brace_references(text, ext) if ext in BRACED else []


def parsed_references(texts: DataFrame) -> DataFrame:
    """References of texts (project, file, text): Python's from its syntax tree, those of brace languages from their code."""
    ddl = "project string, file string, line int, from_symbol string, to_name string, relationship string, receiver string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, f, *r) for p, f, t in zip(*[c.to_pylist() for c in b.columns]) for r in references_of(t, f.rpartition(".")[2].lower())]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=[x.split()[0] for x in ddl.split(", ")])

    return texts.where("text IS NOT NULL").select("project", "file", "text").mapInArrow(run, ddl)


#: Extensions of the languages whose declarations end with a brace; single quotes hold texts in some of them.
BRACED = frozenset("c cc cpp cs cts go h hpp java js jsx mjs mts rs ts tsx".split())
_SCRIPT = frozenset("cts js jsx mjs mts ts tsx".split())
_MODIFIERS = r"[ \t]*(?:(?:export|default|declare|async|pub(?:\([\w: ]+\))?|static|public|private|internal|protected|abstract|override|sealed|partial|readonly|virtual|inline|final|const|unsafe|extern|typedef)[ \t]+)*"
_TYPE_HEAD = re.compile(_MODIFIERS + r"(?:(class|struct|enum|interface|namespace|trait)\s+(?:class\s+)?(\w+)|impl(?:<[^{};]*?>)?\s+(?:[^{};\n]*?\sfor\s+)?(?:\w+::)*(\w+)|type\s+(\w+)(?:\[[^\]\n]*\])?\s+(struct|interface)\b)")
_NAMED_HEAD = re.compile(_MODIFIERS + r"(?:function\s*\*?|func|fn)\s+(?:\([^)]*\)\s*)?(\w+)[^;{}()]*\(")
_TYPED_HEAD = re.compile(r"([\w<>\[\],.*&? \t]+?)(?:(?<=[ \t*&])|\n)(\w+)[ \t]*(?:<[\w, \t]*>)?\s*\(")
_AFTER_ARGUMENTS = re.compile(r"\s*(?:(?::|where\b|const\b|noexcept\b|override\b|throws\b)[^;{}]*)?")
_NO_NAME = frozenset("if for foreach while switch catch return else elif do new await throw sizeof using lock fixed synchronized".split())
_NO_TYPE = _NO_NAME | frozenset("assert case def defer go import in match package with yield".split())
_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`", re.S)
_BLANKED_SCRIPT = re.compile(_BLANKED.pattern.replace(r"\\.)'", r"\\.)*'"), re.S)


def _pairs(code: str) -> dict[int, int]:
    """Where each opening brace or parenthesis is closed: by its own kind, at the end of the text if nowhere."""
    closed: dict[int, int] = {}
    open_: dict[str, list[int]] = {"{": [], "(": []}
    for m in re.finditer(r"[{}()]", code):
        if m.group() in open_:
            open_[m.group()].append(m.start())
        elif stack := open_["{" if m.group() == "}" else "("]:
            closed[stack.pop()] = m.start()
    return closed


def _head(code: str, at: int, pairs: dict[int, int], ext: str) -> tuple[str, str, int] | None:
    """(kind, name, opening brace) of the declaration whose head begins on the line at ``at``."""
    if m := _TYPE_HEAD.match(code, at):
        kind, name = (m.group(5) or m.group(1) or "class").replace("trait", "class"), m.group(2) or m.group(3) or m.group(4)
        brace = code.find("{", m.end())
        if brace >= 0 and not re.search(r"[;=()]" if kind in ("struct", "enum") else ";", code[m.end() : brace]):
            return kind, name, brace
    m, named = _NAMED_HEAD.match(code, at), True
    if not m and ext not in ("go", "rs"):
        m, named = _TYPED_HEAD.match(code, at), False
        words = re.findall(r"\w+", m.group(1)) if m else []
        if m and (m.group(2) in _NO_NAME or (words and (words[0] in _NO_TYPE or words[-1] in _NO_TYPE)) or (not words and "\n" in m.group())):
            m = None
    if not m or (end := pairs.get(m.end() - 1)) is None:
        return None
    brace = code.find("{", end)
    between = code[end + 1 : brace]
    if brace < 0 or ";" in between or (not named and not _AFTER_ARGUMENTS.fullmatch(between)):
        return None
    return "function", m.group(1 if named else 2), brace


def brace_declarations(text: str, ext: str = "") -> list[tuple[str, str, str | None, int, int]]:
    """Declarations of a brace language by heads and matching braces: a scanner, not a parser, so rows are ``regex`` ones."""
    code = (_BLANKED_SCRIPT if ext in _SCRIPT else _BLANKED).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    pairs = _pairs(code)
    out: list[tuple[str, str, str | None, int, int]] = []
    open_: list[tuple[int, str]] = []
    at, line, after = 0, 1, -1
    for row in code.split("\n"):
        found = _head(code, at, pairs, ext) if at > after and row.strip() else None
        if found:
            kind, name, after = found
            end = pairs.get(after, len(code))
            while open_ and open_[-1][0] < at:
                open_.pop()
            owner = open_[-1][1] if open_ else None
            full = f"{owner}.{name}" if owner else name
            out.append((full, "method" if owner and kind == "function" else kind, owner, line, line + code.count("\n", at, end)))
            open_.append((end, full))
        at, line = at + len(row) + 1, line + 1
    return out


_CALL_SITE = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\??\.|->|::)\s*)?([A-Za-z_$][\w$]*)(?:\s*(?:::)?<[\w:, &<>\[\]]*>)?\s*(!?)\(")
_BASES = re.compile(r"\b(?:class|interface|struct|record|enum)\s+\w+(?:<[^{};()]*?>)?(?:\([^()]*\))?\s*((?:(?:extends|implements)\b|:(?!:))[^{};]*)\{")
_IMPL_FOR = re.compile(r"\bimpl(?:<[^{};]*?>)?\s+([\w:]+)(?:<[^{};]*?>)?\s+for\s+(?:\w+::)*(\w+)")
_BASE_NAME = re.compile(r"(?:[A-Za-z_$][\w$]*\s*(?:\.|::)\s*)*([A-Za-z_$][\w$]*)")
_IMPORT_LINE = re.compile(r"^[ \t]*(?:import|export|require|use|using|#[ \t]*include)\b[^\n]*", re.M)
_NO_CALL = _NO_TYPE | frozenset("function func fn typeof instanceof in of delete void super this self loop move unsafe async await impl pub struct class enum sizeof alignof defined nameof checked unchecked base".split())


def brace_references(text: str, ext: str = "") -> list[tuple[int, str | None, str, str, str | None]]:
    """(line, enclosing declaration, name, relationship, receiver) of a brace language, from its code without literals.

    Calls are names before a parenthesis that aren't words of the language or the heads of declarations; bases stand behind
    a type's head. A member rule of C# goes with its name: ``a.B(…)`` is a call of ``B`` with receiver ``a``. Imports keep the
    target that ``import_target`` reads from the line.
    """
    code = (_BLANKED_SCRIPT if ext in _SCRIPT else _BLANKED).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    found = brace_declarations(text, ext)
    heads = {(first, full.rpartition(".")[2]) for full, _, _, first, _ in found}
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    owners: dict[int, str] = {}
    for full, _, _, first, last in found:  # outer ones come first, so the innermost stays
        owners.update(dict.fromkeys(range(first, last + 1), full))
    line_of = lambda at: bisect_right(starts, at)
    out = []
    for m in _BASES.finditer(code):
        line = line_of(m.start())
        for base in re.split(r",|\bextends\b|\bimplements\b|^:", re.sub(r"<[^<>]*>|\([^()]*\)|\bwhere\b.*", " ", m.group(1), flags=re.S)):
            if b := _BASE_NAME.match(base.strip()):
                out.append((line, owners.get(line), b.group(1), "base_class", None))
    if ext == "rs":
        for m in _IMPL_FOR.finditer(code):
            out.append((line_of(m.start()), owners.get(line_of(m.start())), m.group(1).rpartition("::")[2], "base_class", None))
    skipped = {line_of(m.start()) for m in _IMPORT_LINE.finditer(code)}
    for m in _CALL_SITE.finditer(code):
        line, name = line_of(m.start(2)), m.group(2)
        if line in skipped or m.group(1) is None and (name in _NO_CALL or (line, name) in heads):
            continue
        out.append((line, owners.get(line), name, "call", m.group(1)))
    return list(dict.fromkeys(sorted(out, key=lambda r: r[0])))


def enclosing(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with the innermost declaration whose lines hold theirs: equality on the file, then containment."""
    spans = symbols.select("project", "file", "id", "start_line", "end_line")
    hit = refs.join(spans, ["project", "file"]).where((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    key = [c for c in ("project", "file", "line", "to_name", "relationship")]
    return hit.groupBy(*key).agg(F.max_by("id", F.struct("start_line", -F.col("end_line"), F.col("id"))).alias("enclosing_id"))
