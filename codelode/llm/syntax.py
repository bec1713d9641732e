"""Source files that do not parse (problem 3): lexers, a pushdown stack over brackets, and statement checks.

A file is damaged if a literal or comment isn't closed, brackets don't match, a conflict marker stands in code, the text
ends before its last statement does, or it holds what the grammar of its language has nowhere: names side by side, an item
that no item of the language begins like, a token or a place of a colon that it doesn't know. Text of another language is
found by these rules too. Python is compiled (to a syntax tree only) and JSON parsed as a whole, as exact checks. Names,
types and imports are not looked at; of the arms of a preprocessor condition the first that can hold is read.

Defined results: files of other languages, without text rows or with a null path are never flagged; an empty text is
valid except in JSON and Go; a language that is null is taken from the path's extension; a byte order mark is no fault.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assemble import File, per_file
from .lexers import OPENERS, Scan, language_of, scan, scan_script

_PAIRS = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])", re.M)
_INNERMOST = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_GO_PACKAGE = re.compile(r"\s*package \w+[ \t]*(?:\n|;|$)")

# Words of the languages' grammars.
#: Words that a name may follow on the same line in JavaScript, and words that may follow a name.
_JS_BEFORE = frozenset("async await break continue case class const default delete do else export extends from function get import in instanceof let new of return set static throw typeof using var void yield as accessor".split())
_JS_AFTER = frozenset("in of instanceof extends from as".split())
_TS_BEFORE = _JS_BEFORE | frozenset("abstract asserts declare enum global implements infer interface is keyof module namespace out override private protected public readonly satisfies type unique".split())
_TS_AFTER = _JS_AFTER | frozenset("is implements satisfies".split())
#: What an item of a Rust file, and a line of a Go file outside all brackets, begins with.
_RUST_ITEM = re.compile(r"\s*(?:#[ \t]*!?[ \t]*@\s*)*(?:(?:pub|crate|fn|struct|enum|union|impl|trait|mod|use|const|static|type|extern|unsafe|async|auto|default|macro|safe|macro_rules)\b|(?:::)?[A-Za-z_]\w*(?:[ \t]*::[ \t]*\w+)*[ \t]*!|;|$)")
_GO_LINE = re.compile(r"(?:package|import|func|var|const|type)\b|[@)}\]\"]")
_CS_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?!(?:if|elif|else|endif|define|undef|warning|error|line|region|endregion|pragma|nullable|r|load)\b|!|:)", re.M)
#: Words one of which stands before a brace outside all brackets in C# (a call, an assignment or a lambda apart).
_CS_BLOCK = re.compile(r"[(=@]|\b(?:namespace|class|struct|interface|enum|record|extension|try|do|else|finally|catch|checked|unchecked|unsafe|get|set|init|add|remove|switch|with|where)\b")
_CS_WORDS = frozenset(
    "abstract as async await base bool break by byte case catch char checked class const continue decimal default delegate descending ascending do double dynamic else enum equals event explicit extern false file finally fixed float for foreach from get global goto group if implicit in init int interface internal into is join let lock long managed nameof namespace new nint not notnull nuint null object on operator or and orderby out override params partial private protected public readonly record ref remove add required return sbyte scoped sealed select set short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unmanaged unsafe ushort using value var virtual void volatile when where while with yield alias allows field".split()
)
#: A type's declaration behind a word that is no modifier.
_CS_TYPE = re.compile(r"\b(?!(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|file|new|record)\b)[A-Za-z_]\w*[ \t]+(?:class|interface|enum|struct)[ \t]+\w")
_C_BLOCK = re.compile(r"[(=\]@]|\b(?:struct|union|enum|extern)\b|\b[A-Z][A-Z0-9_]+\b")

_SPACED_NAMES = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)[ \t]+(?=([A-Za-z_$][\w$]*))")
_THREE_NAMES = re.compile(r"(?<![\w.@])([A-Za-z_]\w*)\s+(?=([A-Za-z_]\w*)\s+([A-Za-z_]\w*))")
_NO_VALUE = re.compile(r"(?<![=!<>+\-*/%&|^:?.~])=(?:[ \t]*[;)\]]|[ \t]+=[ \t])|\b(return|if|while|for|else|break|var|let|const)[ \t]+\1\b")
_JSX = re.compile(r"</[A-Za-z>]|/>")
_TYPED_NAME = re.compile(r"(?<![\w$.])(?:const|let|var)[ \t]+[\w$]+[ \t]*:")
_PARENS = re.compile(r"\(([^()\[\]{}]*)\)")
_BRACES = re.compile(r"\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_RETURN_TYPE = re.compile(r"@[ \t]*:[ \t]*[\w$<>|.&, \t]+@?[ \t]*$")
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\.)*)\n?", re.M | re.S)
#: Tokens that the language has nowhere.
_ALIEN = {
    "c": re.compile(r"::|:=|=>|[`@]|\.\w+[ \t]+(?!\w+\.)[A-Za-z_]\w*[ \t]*\n"), "csharp": re.compile(r":=|`|(?<!global)(?<![\w])\b(?!global\b)\w+[ \t]*::"),
    "javascript": re.compile(r"::|:=|(?<![\w$\"])->"), "typescript": re.compile(r"::|:=|(?<![\w$\"])->"), "go": re.compile(r"::|=>|;[ \t]*\n[ \t]*;"), "rust": re.compile(r":=|`|\+\+[;)]"),
}


def bracket_error(code: str) -> str | None:
    """Why the brackets of ``code`` don't match, by a stack; None if they do."""
    stack: list[str] = []
    for b in _BRACKET.findall(code):
        if b in "([{":
            stack.append(b)
        elif not stack:
            return "unbalanced"
        elif stack.pop() != _PAIRS[b]:
            return "unbalanced"
    return "premature_end" if stack else None


def _conditions(code: str) -> tuple[str, bool]:
    """The code without directives and without the arms of conditions that are not read, and whether conditions match."""
    out, at, stack = [], 0, []
    for m in _DIRECTIVE.finditer(code):
        if all(stack):
            out.append(code[at : m.start()])
        out.append("\n")
        at, word = m.end(), m.group(1)
        if word in ("if", "ifdef", "ifndef"):
            stack.append(m.group(2).strip() not in ("0", "false"))
        elif word in ("else", "elif", "elifdef", "elifndef"):
            if not stack:
                return code, False
            # True: this arm is read; None: an arm has been read; False: none yet
            stack[-1] = None if stack[-1] is not False else True
        elif word == "endif":
            if not stack:
                return code, False
            stack.pop()
    if all(stack):
        out.append(code[at:])
    return "".join(out), not stack


def _collapsed(code: str) -> str:
    """The code outside all brackets, each outermost pair as ``@``."""
    while True:
        code, n = _INNERMOST.subn("@", code)
        if not n:
            return code


def _script_error(code: str, typed: bool) -> bool:
    """JavaScript and TypeScript: names side by side; in JavaScript also types after colons."""
    before, after = (_TS_BEFORE, _TS_AFTER) if typed else (_JS_BEFORE, _JS_AFTER)
    if not _JSX.search(code):
        for a, b in _SPACED_NAMES.findall(code):
            if a not in before and b not in after and (a, b) != ("for", "await"):
                return True
    if typed:
        return False
    if _TYPED_NAME.search(code):
        return True
    flat = code
    while True:  # a colon right between round brackets is a conditional's, and so is one behind them
        for inner in _PARENS.findall(flat):
            if ":" in inner and "?" not in inner:
                return True
        flat, n = _INNERMOST.subn(lambda m: "@" if m.group()[0] != "{" else "{}", flat.replace("{}", "\u0001"))
        flat = flat.replace("\u0001", "@{" + "}")
        if not n:
            break
        flat = flat.replace("@{" + "}", "@")
    return False


def _outer_error(code: str, language: str) -> bool:
    """Rust, Go, C and C#: what stands outside all brackets must be items of the language."""
    # A block ends an item; other brackets belong to it.
    marked, depth, at, out = code, 0, 0, []
    for m in _BRACKET.finditer(marked):
        b = m.group()
        if b in "([{":
            if not depth:
                out.append(marked[at : m.start()])
            depth += 1
        else:
            depth -= 1
            if not depth:
                out.append("{" + "}" if b == "}" else "@")
                at = m.end()
    outer = "".join([*out, marked[at:]])
    if language == "go":
        joined = re.sub(r"([,=+\-*/%&|<>.(])[ \t]*\n\s*", r"\1 ", outer.replace("{" + "}", "@"))
        return any(not _GO_LINE.match(x.strip()) for x in joined.split("\n") if x.strip() and x.strip() != ";")
    if language == "rust":
        return any(not _RUST_ITEM.match(x) for x in re.split(r";|\{\}(?!\s*(?:[;,=+|\-]|as\b|else\b|from\b))", outer))
    block = _C_BLOCK if language == "c" else _CS_BLOCK
    for item in re.split(r";", outer):
        *heads, rest = re.split(r"\{\}", item)
        for k, head in enumerate(heads):
            if head.strip() and not block.search(head) and not (k and heads[0].strip()):
                return True
            if head.strip() and k and not block.search(head):
                return True
    if language == "c":
        for item in re.split(r"[;]|\{\}", outer):
            head = item.partition("=")[0]
            if ":" in head and not re.search(r"\benum\b[^:]*:[ \t]*\w", head) or re.search(r"[A-Za-z_]\w*\.[A-Za-z_]", head) or re.search(r'\b(?!extern|asm|__asm__|_Pragma)[a-z]\w*[ \t]+""', head):
                return True
        return False
    return bool(_CS_TYPE.search(code)) or any(not {a, b, c} & _CS_WORDS for a, b, c in _THREE_NAMES.findall(code))


def _compiles(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "text", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


#: First code that no text of the language begins with: markup, or a data document.
_DATA_HEAD = {k: re.compile(r"\s*<" if k == "go" else r'\s*(?:<|\{\s*""\s*:)' if k in ("javascript", "typescript") else r"\s*[<{(]") for k in ("javascript", "typescript", "go", "rust", "c", "csharp")}


def _lexical_error(code: str, lexed: Scan) -> str | None:
    if _CONFLICT.search(code):
        return "conflict_marker"
    if lexed.open_quote:
        return "unterminated"
    return bracket_error(code)


def syntax_error(text: str, language: str) -> str | None:
    """The first fault found: conflict_marker, unterminated, unbalanced, premature_end, foreign, statement; or None."""
    text = text.removeprefix("\ufeff")
    if language == "json":
        try:
            json.loads(text, parse_constant=_refuse)
        except (ValueError, RecursionError):
            if _CONFLICT.search(text):
                return "conflict_marker"
            return bracket_error(scan(text, "json").code) or "statement"
        return None
    if language in ("javascript", "typescript") and text.startswith("#!"):
        text = text[text.find("\n") + 1 :] if "\n" in text else ""
    lexed: Scan = scan(text, language)
    code = lexed.code
    if language == "python":
        # The lexer names the fault; that there is one is for the compiler to say.
        return None if _compiles(text) else _lexical_error(code, lexed) or "statement"
    if language in ("javascript", "typescript") and (lexed.open_quote or "`" in text and bracket_error(code)):
        lexed = scan_script(text)
        code = lexed.code
    if _CONFLICT.search(code):
        return "conflict_marker"
    if language in ("c", "csharp") and "#" in code:
        if language == "csharp" and _CS_DIRECTIVE.search(code):
            return "statement"
        code, matched = _conditions(code)
        if not matched:
            return "premature_end"
        lexed = replace(lexed, open_quote=lexed.open_quote and bool(OPENERS[language].search(code.replace('""', ""))))
    if fault := _lexical_error(code, lexed):
        return fault
    if _DATA_HEAD[language].match(code) or language == "go" and not _GO_PACKAGE.match(code):
        return "foreign"
    if _ALIEN[language].search(code) or _NO_VALUE.search(code) and language != "rust":
        return "statement"
    if _script_error(code, language == "typescript") if language in ("javascript", "typescript") else _outer_error(code, language):
        return "statement"
    return _statement_end(code, language)


#: A last item that is nothing but a name and its arguments is a macro's call.
_MACRO_CALL = re.compile(r"(?:^|[;}@\n])[ \t]*[A-Za-z_]\w*[ \t]*@$")
_UNFINISHED = re.compile(r"(?:[=+\-*/%&|^,.(\[{:<]|\b(?:return|else|const|let|var|new|import|from|func|fn|class))\s*$")


def _statement_end(code: str, language: str) -> str | None:
    """Brace languages: the text must not stop in the middle of a statement."""
    tail = code.rstrip()
    if not tail:
        return None
    if language in ("c", "csharp", "rust") and tail[-1] not in ";}" and not tail.rsplit("\n", 1)[-1].lstrip().startswith("#"):
        macro = language == "rust" and tail[-1] in ")]" or language == "c" and _MACRO_CALL.search(_collapsed(tail))
        return None if macro else "premature_end"
    return "premature_end" if _UNFINISHED.search(tail) and not tail.endswith(("++", "--")) else None


def _refuse(word: str) -> None:
    raise ValueError(word)


SCHEMA = "file_id bigint, project string, path string, language string, recorded_verdict string, fault string"


def _emit(file: File) -> list[tuple]:
    out, known = [], {}
    for row in dict.fromkeys(file.rows):
        language = language_of(row[1], file.path)
        if language is None or file.text is None:
            continue
        if language not in known:
            known[language] = syntax_error(file.text, language)
        out.append((row[0], file.project, file.path, language, row[2], known[language]))
    return out


def parse_verdicts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per distinct ``files`` row in one of the eight languages; ``fault`` is null where the text is valid."""
    return per_file(files, chunks, _emit, SCHEMA)


def fault_rates(verdicts: DataFrame) -> DataFrame:
    """Files, faulty files and their rate per project and language, with the recorded verdicts that were wrong."""
    bad = F.col("fault").isNotNull()
    return verdicts.groupBy("project", "language").agg(
        F.count_distinct("path").alias("files"),
        F.count_distinct(F.when(bad, F.col("path"))).alias("faulty"),
        F.round(F.count_distinct(F.when(bad, F.col("path"))) / F.count_distinct("path"), 6).alias("rate"),
        F.count_distinct(F.when(bad & (F.coalesce("recorded_verdict", F.lit("")) != "parse_error"), F.col("path"))).alias("missed_by_record"),
    )
