"""Lexers for eight languages: one compiled pattern each splits a text into code, literals and comments.

``scan(text, language)`` is the common entry. The pattern has a single capturing group around literals, so that
``re.split`` returns code, literal (or None for a comment), code, ... at the speed of the regex engine; everything else
works on those pieces. What is left of a quote or comment opener in a code piece is an unterminated literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Languages by file extension, where a row names none.
EXTENSIONS = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cs": "csharp", "json": "json",
}
LANGUAGES = frozenset(EXTENSIONS.values())

_DQ = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_LINE = r"//[^\n]*"
_REGEX = r"/(?:(?<=[=(,:;!&|?{}\[\n+]/)|(?<=[=(,:;!&|?{}\[+] /)|(?<=return /)|(?<=^/)|(?<=\n /)|(?<=\n  /)|(?<=\n    /)|(?<=\n      /)|(?<=\n        /)|(?<=\n\t/))(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`[^`\\$]*(?:(?:\\.|\$\{(?:[^`{}]|`[^`]*`|\{[^{}]*\})*\}|\$(?!\{))[^`\\$]*)*`"

_PATTERNS = {
    "python": rf'#[^\n]*|("""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""|\'\'\'[^\'\\]*(?:(?:\\.|\'(?!\'\'))[^\'\\]*)*\'\'\'|{_DQ}|{_SQ})',
    "javascript": rf"{_LINE}|{_BLOCK}|({_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX})",
    "go": rf"{_LINE}|{_BLOCK}|({_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)')",
    "rust": rf"{_LINE}|/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_BLOCK})*\*/|((?<![\w])[bc]?r(?:\"[^\"]*\"|\#\"(?:[^\"]|\"(?!\#))*\"\#|\#\#\"(?:[^\"]|\"(?!\#\#))*\"\#\#)|\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)')|'[A-Za-z_]\w*",
    "c": rf"{_LINE}|{_BLOCK}|\#[ \t]*(?:include|error|warning|pragma|line)\b[^\n]*|({_DQ}|{_SQ})",
    "csharp": rf'{_LINE}|{_BLOCK}|\#[ \t]*(?:region|endregion|error|warning|pragma|nullable|line)\b[^\n]*|("""[^"]*(?:"(?!"")[^"]*)*"""|@"[^"]*(?:""[^"]*)*"|\$@"[^"]*(?:""[^"]*)*"|\$"(?:[^"\\{{\n]|\\.|\{{\{{|\{{[^{{}}"]*(?:"[^"]*"[^{{}}"]*)*\}})*"|{_DQ}|{_SQ})',
    "json": rf"({_DQ})",
    # Formats without a grammar of ours: quoted literals on one line and hash comments.
    "conf": rf"(?:(?<=\s)|^)\#[^\n]*|({_DQ}|{_SQ})",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
LEXERS = {k: re.compile(v, re.S) for k, v in _PATTERNS.items()}


@dataclass(slots=True)
class Scan:
    """A lexed text: ``code`` has every literal as an empty string literal and every comment blanked."""

    code: str
    literals: list[str]
    literal_chars: int
    open_quote: bool


def language_of(language: str | None, path: str | None) -> str | None:
    """The row's language, or by the path's extension where it is null; None if it isn't one of the eight."""
    if language:
        low = language.strip().lower()
        return low if low in LANGUAGES else None
    return EXTENSIONS.get((path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower())


def pieces(text: str, language: str) -> list[str | None]:
    """code, literal or None, code, ...: odd places hold literals (None: a comment)."""
    return LEXERS[language].split(text)


OPENERS = {
    "python": re.compile(r"[\"']"), "javascript": re.compile(r"[\"'`]|/\*"), "typescript": re.compile(r"[\"'`]|/\*"), "go": re.compile(r"[\"'`]|/\*"),
    "rust": re.compile(r"[\"']|/\*"), "c": re.compile(r"[\"']|/\*"), "csharp": re.compile(r"[\"']|/\*"), "json": re.compile('"'), "conf": re.compile(r"(?!)"),
}


#: Comments and blank space before the first code; what it spans is a file's header.
LEADING = re.compile(r"(?:\s+|//[^\n]*|#(?![ \t]*(?:include|define|if|ifdef|ifndef|pragma|undef)\b)[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|<!--.*?-->)*", re.S)


def scan(text: str, language: str) -> Scan:
    parts = pieces(text, language)
    code, marks = parts[::2], parts[1::2]
    joined = [code[0]]
    for mark, piece in zip(marks, code[1:]):
        joined.append('""' if mark is not None else " ")
        joined.append(piece)
    literals = [m for m in marks if m is not None]
    return Scan("".join(joined), literals, sum(map(len, literals)), bool(OPENERS[language].search("".join(code))))


_SCRIPT_TOKEN = re.compile(rf"{_LINE}|{_BLOCK}|({_DQ}|{_SQ}|{_REGEX})|(`)|([{{}}])", re.S)
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:(`)|\$\{)", re.S)


def scan_script(text: str) -> Scan:
    """JavaScript and TypeScript with a stack for templates within templates, for texts that the pattern leaves open."""
    out, literals, at, stack, opened = [], [], 0, [], False
    while m := _SCRIPT_TOKEN.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        in_template = m.group(2) is not None
        if m.group(1) is not None:
            literals.append(m.group(1))
            out.append('""')
        elif brace := m.group(3):
            if brace == "{":
                stack.append("{")
                out.append("{")
            elif stack and stack[-1] == "`":
                stack.pop()
                in_template = True
                out.append(")")
            else:
                if stack:
                    stack.pop()
                out.append("}")
        elif not in_template:
            out.append(" ")
        if in_template:
            part = _TEMPLATE_PART.match(text, at)
            if part is None:
                opened = True
                break
            literals.append(part.group())
            at = part.end()
            out.append('""')
            if part.group(1) is None:
                stack.append("`")
                out.append("+(")
    out.append(text[at:] if not opened else "")
    code = "".join(out)
    return Scan(code, literals, sum(map(len, literals)), opened or bool(OPENERS["javascript"].search(code.replace('""', ""))))
