"""Credentials embedded in source code, configuration, comments and prose (problem 2).

Chunks are sent to the partition of their file and scanned there as one text, one file at a time, so that literals and key
blocks that cross the border of a chunk are seen whole. A cheap pass over the lower-cased text decides whether a file can
hold a credential at all; such files are tokenized lexically, adjacent literals are folded, and literals assigned to,
compared with or listed under credential-named identifiers, or passed to calls named for them or for signing in, are
flagged unless they are placeholders. Values of known shape (cloud keys, signed tokens, URL and header credentials, private
key blocks) are flagged wherever they stand. Redaction overwrites only the value's own characters, keeping delimiters,
escapes, line breaks and length, so that line numbers and syntax stay.

Defined results: null and empty texts hold nothing; a null start_line counts as 1; a null path means unknown language;
repeated rows of a chunk give equal findings; rows without project, path or chunk_index, and rows that rival another of the
same index, are scanned alone; a value counts in the chunk that holds its first character and is masked in all; a key block
without an end is masked as far as its lines hold nothing but key material, one without a beginning from the text's start.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexers import EXTENSIONS, LEXERS

# Fixed value shapes of public credential formats.
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{12,}|xox[abeoprs]-\d[\w-]{8,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|AIza[\w-]{24,}|eyJ[\w-]{6,}\.eyJ[\w-]{6,}\.[\w-]{8,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})"
)
#: The same formats where a literal was split: long enough beginnings, tested on folded literals only.
_SHAPE_MARKS = ("akia", "asia", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "aiza", "eyj", "npm_", "hf_", "sg.")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/@:\"'`<>]*:([^\s@/\"'`]+)@[\w.\[-]")
_CURL = re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?['\"]?[\w.@-]+:([^\s'\"]+)")
_CONNECTION = re.compile(r"(?i)(?:^|[;\"'\s])(?:pwd|password|accountkey|sharedaccesskey|user password)=([^;\"'\s]+)(?=;|[\"']|$)")
_HEADER = re.compile(r"(?i)\b(?:(?:proxy-)?authorization\s*[:=]\s*[\"']?(?:bearer|basic|token)\s+|x-[\w-]*(?:token|key|secret|auth)\s*:\s*)([^\s\"'\\<>,;]+)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[\s\"'`+\\,()]|[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=]{16,}")
#: A line of key material: long pieces of it, a short one at the end, and what joins literals.
_KEY_LINE = re.compile(r"[ \t]*[+\"'`]?[ \t]*[\"'`]?((?:(?:\\[nr])*[A-Za-z0-9+/=]{16,})*)(?:\\[nr])*([A-Za-z0-9+/=]*)(?:\\[nr])*[\"'`]?[ \t]*[,;+)\\]*[ \t]*\r?\n?")
_KEY_FIELD = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash): ")
_BASE64_LINE = re.compile(r"[\sA-Za-z0-9+/=\"',\\]*")

_MAYBE = re.compile(r"(?:pass|pwd|pw|secret|token|key|credential|auth)[\w.\-]*[\"'\])]*\s*(?:\[\w*\]\s*)?(?::[^=\n\"'`]*)?(?:=|:|,|\(|>|\"|')|(?:session|log_?in|log_?on|sign_?in|connect|bind|dial)\w*\(")
_TO_LITERAL = re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'\]]*\s*(?:\[\s*\w*\s*\])?\s*(?::[ \t]*[&\w<>\[\]| ']+?)?\s*(?<![=!<>])(?::=|=>|=|:)\s*\(?\s*[A-Za-z@$&]{0,3}$")
_COMPARED = re.compile(r"([A-Za-z_$][\w$.\-]*)\s*(?:[=!]==?|\.[eE]quals\(|\bis)\s*$")
_LISTED = re.compile(r"([A-Za-z_$][\w$]*?)(?:e?s|_?[lL]ist|_?[sS]et)\s*(?::[^=\n]*)?(?::=|=|:)[^\n=\"']*[\[{(]\s*$")
_DEFINED = re.compile(r"#[ \t]*define[ \t]+(\w+)[ \t]+$")
#: A call's name before its first literal, or before later ones where names stand between.
_CALLED = re.compile(r"([A-Za-z_][\w]*)\((?:[^()\"'`;{}]*,)?\s*$")
_CLOSED = re.compile(r"\s*\)")
_TAGGED = re.compile(r"<([A-Za-z_][\w.:-]*)>[ \t]*([^<>\s]+)[ \t]*</\1>")
_SIGNS_IN = frozenset("session login logon signin connect connection credentials credential authenticate auth authorize bind dial account".split())
#: Values that forms and schemas give to a field named password.
_FIELD_WORDS = frozenset("password passwd required optional hidden string text label input field secret token none empty missing invalid unknown default random".split())
_CALL = re.compile(r"\b((?:set|with|use|login|put|add|auth\w*)[A-Za-z_]*)\(\s*$|\.([A-Za-z_]\w*)\(\s*$")
_SLASHED = re.compile(r"^[ \t]*//[^\n]*", re.M)
_JOIN = re.compile(r"\s*(?:[+.&\\]|\.\.)?\s*[bBuUrRfF@$]{0,2}$")
_CONFIG = re.compile(r"^[ \t]*(?:(?:export|ENV|ARG|set|SET)[ \t]+|-[ \t]+)?[\"']?([A-Za-z_][\w.-]*)[\"']?[ \t]*[:=][ \t]*(?![|>&*!{\[\"'])([^\s#][^\n]*?)[ \t]*(?:[ \t]#[^\n]*)?$", re.M)
_CUE = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|tokens?|secrets?|(?:api[ _-]?)?keys?|login|credentials?)\b")
_REMOVE = re.compile(r"(?i)\b(?:todo|fixme|xxx)\b[: ]+(?:remove|rotate|drop|revoke)\b")
_OPAQUE = re.compile(r"(?<![\w./+=-])(?=[^\s]*\d)(?=[^\s]*[A-Za-z])[A-Za-z0-9_\-+/=!#?@$%^&*.]{8,}")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|api[ _-]?key|token)\b(?: is| was)?\s*[:=]?\s*[`\"']((?=[^`\"'\s]*\d)[^`\"'\s]{8,})[`\"']")
_DIGEST_WORDS = re.compile(r"(?i)sha-?\d|md5|digest|checksum|integrity|\bhash|commit|revision|fingerprint|etag")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_LAST = frozenset("password passwd pwd passphrase passcode passwort secret token credential credentials pw pass".split())
_KEYED = frozenset("api access secret private signing service encryption encrypt auth master shared client webhook account session hmac jwt app admin deploy storage".split())
_PLACEHOLDER = re.compile(
    r"(?:<.*>|\$\{.*\}|\$\w+|\$\(.*\)|\{\{.*\}\}|\{\w*\}|%\(\w+\)s|%\w|%[A-Z_]+%|#\{.*\}|(.)\1{3,}|\*+|(?:env|vault|ssm|kms|secretsmanager|keyring|file|arn|op|ref|var)[:.].*|arn:.*"
    r"|your[-_ ].*|.*[-_]here|example[-_ ].*|.*[-_]example|changeme.*|change[-_]?(?:me|it|this).*|replace[-_ ]?(?:me|this|with).*|not[-_]a[-_]real.*|(?:dummy|fake|mock|sample|test|placeholder)(?:[-_][a-z_-]*)?"
    r"|.*placeholder.*|\W?redacted\W?|\W?masked\W?|none|null|nil|undefined|true|false|todo|fixme|tbd|n/?a|process\.env.*|os\.environ.*|getenv.*|insert.*)\Z",
    re.I | re.S,
)
_PROSE_EXT = frozenset(("md", "rst", "txt", "adoc", ""))
_CONFIG_EXT = frozenset(("yaml", "yml", "ini", "env", "toml", "properties", "conf", "cfg", "sh", "bash", "zsh", "bat", "dockerfile"))
_SET_APART = re.compile(r"^[ \t]*ENV[ \t]+([A-Za-z_]\w*)[ \t]+(?![\"'=])(\S+)[ \t]*$", re.M)


class Span(NamedTuple):
    """A value's place: characters [start, end) of the chunk, and its form."""

    start: int
    end: int
    form: str


def is_placeholder(value: str) -> bool:
    value = value.strip()
    return len(value) < 4 or bool(_PLACEHOLDER.match(value))


def names_credential(identifier: str) -> str | None:
    """``strong`` or ``weak`` (a bare token needs an opaque value) for credential-named identifiers, else None."""
    words = [w.lower() for w in _WORDS.findall(identifier)]
    if not words:
        return None
    last = words[-1]
    if last.isdigit() and len(words) > 1:
        words, last = words[:-1], words[-2]
    if last in _LAST or last in ("apikey", "authtoken", "accesstoken", "secretkey", "dbpass"):
        return "weak" if last in ("token", "pass", "pw") and len(words) == 1 or last == "token" and words[-2] not in _KEYED | {"bearer", "refresh", "csrf", "bot"} else "strong"
    return "strong" if last == "key" and len(words) > 1 and words[-2] in _KEYED else None


def _words(value: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(value)]


def is_secret(value: str, strength: str, name: str = "") -> bool:
    """Whether a literal given to a credential-named identifier is a credential value."""
    if is_placeholder(value):
        return False
    digits = any(c.isdigit() for c in value)
    if any(c.isspace() for c in value):  # a phrase of words, or words with an opaque one among them
        parts = value.split()
        phrase = _words(name)[-1:] == ["passphrase"] and len(parts) >= 4 and value.replace(" ", "").isalpha()
        return strength == "strong" and (phrase or len(parts) <= 8 and not value[-1:] in ".:!?" and any(_looks_random(p) and len(p) >= 8 for p in parts))
    if strength == "weak":
        return digits and len(value) >= 8 and any(c.isalpha() for c in value)
    if not digits and value.replace("-", "_").replace("_", "").isalpha():
        words = _words(value)
        if any(w in _LAST or w == "key" for w in words) or "-" in value or "_" in value or len(value) < 6:
            return False
        return not value.islower() or _words(name)[-1:] in (["password"], ["passwd"], ["pwd"], ["passphrase"], ["passwort"]) and value not in _FIELD_WORDS
    return True


def _opaque(value: str) -> bool:
    """Letters with digits or signs among them, as no name, path, address or sentence has them."""
    if len(value) < 6 or is_placeholder(value) or any(c.isspace() for c in value) or not any(c.isalpha() for c in value):
        return False
    if "://" in value or re.fullmatch(r"[\w-]+(?:[./:][\w-]+)+", value) or re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+)*[_-]?v?\d{0,2}", value):
        return False
    return any(c.isdigit() for c in value) and len(set(value)) >= 5


def _literals(text: str, language: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a literal) of literals and comments; delimiters included."""
    for m in LEXERS[language].finditer(text):
        yield m.start(), m.end(), m.start(1) >= 0


def _inner(text: str, start: int, end: int) -> tuple[int, int]:
    """The literal's contents, without prefix letters and delimiters."""
    while start < end and text[start] in "@$bBrRuUfF":
        start += 1
    quote = text[start : start + 3]
    n = 3 if quote in ('"""', "'''") and end - start >= 6 else 1
    return start + n, end - n


class _Run(NamedTuple):
    """Adjacent literals, folded: the code before them, the literal before that, the call they are passed to, the code behind."""

    left: str
    before: str
    call: str
    place: int
    list_of: str
    parts: list[tuple[int, int]]
    behind: list[int]


def _last_line(left: str) -> str:
    """The end of a piece of code, from its last line that holds anything."""
    bare = left.rstrip()
    return left[bare.rfind("\n") + 1 :]


def _runs(text: str, language: str) -> tuple[list[_Run], list[tuple[int, int]]]:
    last, before, runs, comments = 0, "", [], []
    for start, end, literal in _literals(text, language):
        if not literal:
            comments.append((start, end))
            continue
        a, b = _inner(text, start, end)
        left = text[last:start]
        if runs and _JOIN.fullmatch(left):
            runs[-1].parts.append((a, b))
            runs[-1].behind[0] = end
        else:
            tail = _last_line(left)
            call, place, list_of = "", 0, ""
            if runs and left.strip() in (",", ",\n"):
                call, place, list_of = runs[-1].call, runs[-1].place + 1, runs[-1].list_of
            elif m := _CALLED.search(tail):
                call, place = m.group(1), int("," in m.group()[m.end(1) - m.start() :])
            elif m := _LISTED.search(tail):
                list_of = m.group(1)
            runs.append(_Run(tail, before, call, place, list_of, [(a, b)], [end]))
        before, last = text[a:b], end
    return runs, comments


def _assigned(text: str, language: str) -> Iterator[Span]:
    """Folded literals that a credential-named identifier gets, and folded literals of a known shape."""
    runs, comments = _runs(text, language)
    for run in runs:
        first = next(((a, b) for a, b in run.parts if b > a), None)
        if first is None:
            continue
        value = "".join(text[a:b] for a, b in run.parts)
        span = first[0], run.parts[-1][1]
        m = _TO_LITERAL.search(run.left) or _DEFINED.search(run.left)
        name = m.group(1) if m else run.before if run.left.strip() in (":", ",", "=>", "=") else None
        if m is None and name is None and (call := _CALL.search(run.left)):
            name = call.group(1) or call.group(2)
            if re.match(r"(?i)(?:get|fetch|load|read|check|verify|find|lookup|hash|accept|emit|parse)", name):
                name = None
        if name and (strength := names_credential(name)) and is_secret(value, strength, name):
            yield Span(*span, "assigned")
        elif len(run.parts) > 1 and _SHAPES.search(value):
            yield Span(*span, "shape")
        elif (c := _COMPARED.search(run.left)) and names_credential(c.group(1)) == "strong" and _opaque(value) or run.list_of and names_credential(run.list_of) and _opaque(value):
            yield Span(*span, "assigned")
        elif run.place and _SIGNS_IN & set(_words(run.call)) and _opaque(value) and _CLOSED.match(text, run.behind[0]):
            yield Span(*span, "passed")
    for start, end in comments:
        yield from _commented(text, start, end)
    if language in ("python", "conf"):  # line comments of another language, in a file with the wrong extension
        for m in _SLASHED.finditer(text):
            yield from _commented(text, m.start(), m.end())


def _commented(text: str, start: int, end: int) -> Iterator[Span]:
    """Opaque words of a comment that also speaks of a credential."""
    part = text[start:end]
    if _CUE.search(part) or _REMOVE.search(part):
        for m in _OPAQUE.finditer(part):
            word, ahead = m.group(), part[max(0, m.start() - 24) : m.start()]
            if not is_placeholder(word) and _looks_random(word) and (_CUE.search(ahead) or _REMOVE.search(ahead) or not _DIGEST_WORDS.search(ahead)):
                yield Span(start + m.start(), start + m.end(), "comment")


def _looks_random(word: str) -> bool:
    """Not a path, identifier, version or date: digits stand among the letters, not only after whole words."""
    if "://" in word or re.fullmatch(r"[\w-]+(?:[./][\w-]+)*\.[A-Za-z]{1,5}", word) or re.fullmatch(r"(?:[A-Za-z]+[_/.-])*[A-Za-z]+\d{0,2}", word):
        return False
    return bool(re.search(r"\d[A-Za-z]|[A-Za-z]\d", word)) and len(set(word)) >= 6


def find(text: str, path: str | None) -> list[Span]:
    """The credential values of one chunk, in order, without overlaps."""
    low = text.lower()
    spans: list[Span] = []
    if any(m in low for m in _SHAPE_MARKS):
        spans += [Span(m.start(), m.end(), "shape") for m in _SHAPES.finditer(text) if not is_placeholder(m.group())]
    if "://" in low and "@" in low:
        spans += [Span(m.start(1), m.end(1), "url") for m in _URL.finditer(text) if not is_placeholder(m.group(1))]
    if "curl " in low:
        spans += [Span(m.start(1), m.end(1), "header") for m in _CURL.finditer(text) if not is_placeholder(m.group(1))]
    if "pwd=" in low or "password=" in low or "key=" in low:
        if ";" in low:
            spans += [Span(m.start(1), m.end(1), "connection") for m in _CONNECTION.finditer(text) if not is_placeholder(m.group(1)) and ";" in text[max(0, m.start() - 80) : m.start() + 1]]
    if "authorization" in low or "x-" in low:
        spans += [Span(m.start(1), m.end(1), "header") for m in _HEADER.finditer(text) if not is_placeholder(m.group(1)) and len(m.group(1)) >= 8]
    if "private key" in low:
        spans += _key_blocks(text)
    base = (path or "").rsplit("/", 1)[-1].lower()
    ext = "dockerfile" if base.startswith("dockerfile") else base.rpartition(".")[2] if "." in base else ""
    language = EXTENSIONS.get(ext, "conf")
    if ext in _PROSE_EXT:
        spans += [Span(m.start(1), m.end(1), "prose") for m in _PROSE.finditer(text) if not is_placeholder(m.group(1))]
        if ext != "md" and "login" in low:
            spans += _commented(text, 0, len(text))
    elif ext == "dockerfile" or _MAYBE.search(low) or "login" in low or "todo" in low or _split_shape(low) or _CUE.search(low) and language != "conf":
        spans += _assigned(text, language)
        if ext in _CONFIG_EXT:
            for m in _CONFIG.finditer(text):
                if (strength := names_credential(m.group(1))) and is_secret(m.group(2), strength, m.group(1)):
                    spans.append(Span(m.start(2), m.end(2), "config"))
            for m in _SET_APART.finditer(text):
                if (strength := names_credential(m.group(1))) and is_secret(m.group(2), strength, m.group(1)):
                    spans.append(Span(m.start(2), m.end(2), "config"))
        if language == "conf" and "</" in text:
            for m in _TAGGED.finditer(text):
                if (strength := names_credential(m.group(1))) and is_secret(m.group(2), strength, m.group(1)):
                    spans.append(Span(m.start(2), m.end(2), "config"))
    return _merge(spans)


def _split_shape(low: str) -> bool:
    return any(m in low for m in _SHAPE_MARKS)


def _material(text: str, at: int) -> int:
    """Characters from ``at`` on whose lines hold nothing but key material: the block's end is missing."""
    end = at
    while end < len(text):
        stop = text.find("\n", end) + 1 or len(text)
        line = text[end:stop]
        body = _KEY_LINE.fullmatch(line)
        if not (line.isspace() or _KEY_FIELD.match(line) or body and (body.group(1) or body.group(2)[-1:] == "=" or any(c.isdigit() for c in body.group(2)))):
            break
        end = stop
    return end - at


def _key_blocks(text: str) -> list[Span]:
    out, at = [], 0
    first_end = _PEM_END.search(text)
    begin = _PEM.search(text)
    if first_end and (begin is None or first_end.start() < begin.start()) and _BASE64_LINE.fullmatch(text, 0, first_end.start()):
        out.append(Span(0, first_end.start(), "key_tail"))
    while m := _PEM.search(text, at):
        end = _PEM_END.search(text, m.end())
        at = m.end()
        body = _PEM_BODY.match(text, m.end())
        if body and len(set(body.group()[-16:])) > 1 or not text[m.end() :].strip():
            stop = end.start() if end else m.end() + len(text[m.end() : m.end() + _material(text, m.end())].rstrip(" \t\r\n\"'`,;+)"))
            out.append(Span(m.start(), stop, "key_block"))
            at = stop
    return out


def _merge(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if out and s.start < out[-1].end:
            if s.end > out[-1].end:
                out[-1] = out[-1]._replace(end=s.end)
        else:
            out.append(s)
    return out


_KEEP = re.compile(r"-----[A-Z0-9 ]+-----|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[^\n]|\"\s*\+?\s*\"|'\s*\+?\s*'|[\n\r]+[ \t]*(?:\+[ \t]*)?[\"']?|(.)", re.S)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every value's characters overwritten by ``X``; escapes, line breaks and joints between literals stay."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s.start])
        out.append(_KEEP.sub(lambda m: "X" if m.group(1) is not None else m.group(), text[s.start : s.end]))
        at = s.end
    return "".join([*out, text[at:]])


FOUND = "chunk_id bigint, project string, path string, line_no int, form string"
REDACTED = "chunk_id bigint, project string, path string, values_masked int, text string"


def _scanned(rows: list[tuple]) -> Iterator[tuple[tuple, list[Span]]]:
    """Each row (project, path, index, chunk_id, start_line, text) of one file with the spans of its text.

    A value that crosses a border has a span in each of its chunks; in all but the first its form is ``rest``.
    """
    if rows[0][0] is None or rows[0][1] is None or rows[0][2] is None:
        for row in rows:
            yield row, find(row[5], row[1])
        return
    parts: dict[int, str] = {}
    for row in rows:
        parts.setdefault(row[2], row[5])
    starts, at = {}, 0
    for index, part in parts.items():
        starts[index] = at
        at += len(part) + 1
    spans = find("\n".join(parts.values()), rows[0][1])
    firsts = list(starts.values())
    own: dict[int, list[Span]] = {index: [] for index in parts}
    numbers = list(parts)
    for s in spans:
        k = bisect_right(firsts, s.start) - 1
        form = s.form
        while k < len(numbers) and firsts[k] < s.end:
            a, b = max(0, s.start - firsts[k]), min(len(parts[numbers[k]]), s.end - firsts[k])
            if a < b:
                own[numbers[k]].append(Span(a, b, form))
                form = "rest"
            k += 1
    for row in rows:
        yield row, own[row[2]] if row[5] == parts[row[2]] else find(row[5], row[1])


def _over_files(chunks: DataFrame, emit, schema: pa.Schema, ddl: str) -> DataFrame:
    """``emit`` on every chunk row with its spans; a task holds the rows of one file at a time."""
    rows = chunks.where("text IS NOT NULL").select(
        "project", "file", F.col("chunk_index").cast("int").alias("i"), "chunk_id", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("s"), "text"
    )
    # Rows that belong to no file are spread, not gathered under the null key.
    alone = F.when(F.col("project").isNull() | F.col("file").isNull() | F.col("i").isNull(), F.xxhash64("chunk_id", "text"))
    rows = rows.withColumn("alone", alone).repartition("project", "file", "alone").sortWithinPartitions("project", "file", "alone", "i", "chunk_id").drop("alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    if held and (row[:2] != held[0][:2] or None in row[:3]):
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        out: list[tuple] = []
        for rows in files():
            for row, spans in _scanned(rows):
                out.extend(emit(*row, spans))
            if len(out) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def _lines(project, path, index, chunk_id, start_line, text, spans) -> list[tuple]:
    return [(chunk_id, project, path, start_line + text.count("\n", 0, s.start), s.form) for s in spans if s.form not in ("key_tail", "rest")]


def _masked(project, path, index, chunk_id, start_line, text, spans) -> list[tuple]:
    return [(chunk_id, project, path, len(spans), redact(text, spans) if spans else text)]


def credentials(chunks: DataFrame) -> DataFrame:
    """One row per credential value of each chunk row: where it begins and its form."""
    schema = pa.schema([("chunk_id", pa.int64()), ("project", pa.string()), ("path", pa.string()), ("line_no", pa.int32()), ("form", pa.string())])
    return _over_files(chunks, _lines, schema, FOUND)


def redacted(chunks: DataFrame) -> DataFrame:
    """Every chunk row with its text masked and the number of values masked in it."""
    schema = pa.schema([("chunk_id", pa.int64()), ("project", pa.string()), ("path", pa.string()), ("values_masked", pa.int32()), ("text", pa.string())])
    return _over_files(chunks, _masked, schema, REDACTED)
