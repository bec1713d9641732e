"""Generated, minified, vendored files and data blobs (problem 1), so that only hand-written source remains.

Each whole file is lexed and its code emitted again in canonical form: one statement per line, joined over brackets, at an
indent of its depth. The original lines are compared with it. Extreme expansion marks minified text; literals that dominate
a text without declarations mark bulk data. A layout that agrees with the canonical one throughout is what a generator
leaves, but also what a formatter does: it is required of a file whose header says that it was generated, and an irregular
one says that hands have been at it since. Headers (leading comments only), paths, lock file names, compiler prologues and
catalogue hashes give the rest. Lightly patched copies share at least 0.8 of their five-word shingles with a catalogued
text; the shingles compared are those of ``files`` rows whose hash the catalogue lists, so their number is bounded by the
catalogue, and their size is checked.

Defined results: files without text rows are judged by path and hash alone; a null path takes no part; an empty text is
hand-written unless its path or hash says otherwise; rows standing twice give one row each per distinct row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import BROADCAST_LIMIT, durable, maybe_broadcast
from .assemble import File, per_file
from .lexers import LEADING, language_of, scan

#: Shingle length and similarity for patched copies.
SHINGLE, SIMILAR = 5, 0.8
#: Canonical lines per original line beyond which a text counts as minified.
EXPANSION = 6.0
#: Share of the lines that must agree with canonical layout for a header that says generated to be believed.
UNIFORM = 0.9
#: Share of the code's characters in literals beyond which a file without declarations is bulk data.
LITERAL_SHARE, BLOB_CHARS = 0.75, 600
#: Programming languages and their file extensions, by which prose, configuration and keys are told apart.
#: Lexers near enough for languages without one of their own.
_LEXED_AS = {x: "c" for x in ("cc", "cpp", "hpp", "java", "php", "kt", "swift", "scala", "css")} | {"tsx": "typescript", "jsx": "javascript", "rb": "python"}
CODE = frozenset("py js mjs cjs ts tsx jsx go rs c h cc cpp hpp cs java rb php kt swift scala css".split())

LOCK_FILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock uv.lock cargo.lock go.sum gemfile.lock composer.lock mix.lock flake.lock packages.lock.json podfile.lock pubspec.lock bun.lockb".split())
_VENDOR_DIRS = frozenset("vendor _vendor third_party thirdparty 3rdparty third-party node_modules site-packages bower_components jspm_packages godeps pods web_modules".split())
#: Directory names that hold other people's code only where a catalogued library follows.
_VENDOR_IF_LIBRARY = frozenset("deps external externals bundled lib libs extern contrib packages static".split())
_BUILD_DIRS = frozenset("dist generated __generated__ gen target".split())
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|_pb\.(?:js|d\.ts|ts)|_grpc\.pb\.go|[._](?:generated|gen|g|designer)\.[a-z]+|_generated\.[a-z]+|\.g\.cs)$", re.I)
_MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|chunk)\.(?:js|css|mjs)$", re.I)
_COMPILED = re.compile(r'Object\.defineProperty\(exports, ?["\']__esModule["\']|\bvar (__\w+) = \(this && this\.\1\) \|\||^//[#@] sourceMappingURL=|\b__webpack_require__\b', re.M)
# What a header says. A maker's word (made by, from or with something, or automatically), a warning against edits, or a
# loss of them says generated; it says nothing where the same line denies it or speaks of hands.
_MADE = r"(?:auto-?\s?)?(?:generated|produced|created|written|generiert|erzeugt|généré|generado)"
_GENERATED = re.compile(
    rf"@generated|(?:auto|machine|code)[- ]?\s?{_MADE}|(?:automatically|automatisch|von \S+) {_MADE}|{_MADE} (?:by|from|with|using|automatically|automatiquement|automáticamente|par|por)\b"
    r"|(?:do not|don't|never) (?:edit|modify|change)|nicht von hand|ne pas (?:modifier|éditer)|no (?:editar|modificar)|(?:edits|changes|modifications) .*(?:lost|overwritten|belong)|regenerate (?:with|using|by)",
    re.I,
)
_DENIED = re.compile(r"\b(?:by hand|hand-?\s?(?:written|made)|freely|nothing|not (?:auto|generated|produced)|no longer|used to|mark(?:s|er)?|detects?|checks?|finds?|skips?|header(?! file))\b", re.I)
# A copy says whose: copied or taken from somewhere, a local, bundled or verbatim copy, an upstream to turn to, or a
# library's own banner of name, version and licence or authors.
_COPIED = re.compile(
    r"(?:taken|copied) (?:unchanged |verbatim )?from \S+.*(?:upstream|version|tag|release)|(?:local|verbatim|bundled|vendored|embedded) copy|\bupstream (?:tag|version|release)|bugs upstream"
    r"|^\W*[\w.-]+ v?\d+\.\d+[\w.]*\s*[-|*].*(?:licen[cs]e|authors|https?://)",
    re.I | re.M,
)
_OWN = re.compile(r"wrapper (?:around|for)|\bours\b|not a copy", re.I)
_WORD = re.compile(r"\w+")
_DECLARES = re.compile(r"\b(?:def|class|function|func|fn|impl|struct|interface|namespace|if|for|while|return|switch|match)\b|=>")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLf]*")
_ROUND = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]|\{[^(){};\[\]\n]*\}")
_BREAK = re.compile(r"(?<=[;{}])(?![;,)])|(?=\})")
_JOINED = re.compile(r"\}\s*(else|catch|finally|while|[;,)@.])")
_INNER_BREAK = re.compile(r"(?<![,{};])[ \t]*\n\s*(?![{}])")
_BLANK = re.compile(r"\s+")
_PRE = re.compile(r"^[ \t]*#.*$", re.M)


def _extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def path_kind(path: str, libraries: frozenset[str]) -> str | None:
    """lock, vendored, generated, minified, or None, from the path alone."""
    *dirs, name = path.lower().split("/")
    if name in LOCK_FILES:
        return "lock"
    for here, after in zip(dirs, [*dirs[1:], ""]):
        if here in _VENDOR_DIRS or here in _VENDOR_IF_LIBRARY and after in libraries:
            return "vendored"
    if _MINIFIED_NAME.search(name):
        return "minified"
    if _extension(path) in CODE and (_GENERATED_NAME.search(name) or any(x in _BUILD_DIRS for x in dirs)):
        return "generated"
    return None


def header_kind(header: str) -> str | None:
    """copied, generated or None, from the leading comments."""
    kind = None
    for line in header.split("\n"):
        if _COPIED.search(line) and not _OWN.search(line):
            return "vendored"
        if _GENERATED.search(line) and not _DENIED.search(line):
            kind = "generated"
    return kind


def canonical(code: str, language: str) -> tuple[list[str], list[str]]:
    """(original lines, canonical lines) of lexed code; what stands in brackets, braces of one line included, is one ``@``.

    A canonical line holds one statement, the head of a block or its end. Lines end statements in Python, Go, JavaScript
    and TypeScript; in the other languages only signs do.
    """
    flat = code
    while True:
        flat, n = _ROUND.subn("@", flat)
        if not n:
            break
    original = [x for x in flat.split("\n") if x.strip()]
    if language == "python":
        return original, [x for line in original for x in line.split(";") if x.strip()]
    if language in ("c", "rust", "csharp"):
        directives = _PRE.findall(flat) if language != "rust" else []
        flat = _INNER_BREAK.sub(" ", _PRE.sub("", flat) if directives else flat)
    else:
        directives = []
    flat = _JOINED.sub("\x01\\1", flat)
    lines = [x.replace("\x01", "}") for part in flat.split("\n") for x in _BREAK.split(part) if x.strip()]
    return original, directives + lines


def _agreement(original: list[str], emitted: list[str]) -> float:
    """Share of the original lines that are canonical ones, at a whole indent and without blanks behind.

    A brace that opens a block may stand on the line of its head or alone.
    """
    want = Counter(_BLANK.sub("", x).rstrip("{") for x in emitted)
    unit = min((len(x) - len(x.lstrip()) for x in original if x[0] in " \t"), default=0)
    lines = [x for x in original if x.strip() != "{"]
    good = 0
    for line in lines:
        indent = len(line) - len(line.lstrip())
        good += bool(want[_BLANK.sub("", line).rstrip("{")]) and line[-1] not in " \t" and not (indent % unit if unit else indent)
    return good / max(1, len(lines))


def layout(text: str, language: str) -> dict[str, float]:
    """expansion, literal_share, uniform, declares: the measures of a lexed text against canonical layout."""
    lexed = scan(text, language)
    code = lexed.code
    original, emitted = canonical(code, language)
    numbers = sum(map(len, _NUMBER.findall(code)))
    dense = len(re.sub(r"[\s,]+", "", code)) - 2 * len(lexed.literals)
    return {
        "expansion": len(emitted) / max(1, len(original)),
        "literal_share": (lexed.literal_chars + numbers) / max(1, lexed.literal_chars + dense),
        "literal_chars": lexed.literal_chars + numbers,
        "uniform": _agreement(original, emitted),
        "declares": bool(_DECLARES.search(code)),
    }


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles (of all words together where there are fewer)."""
    words = np.fromiter((zlib.crc32(w.encode()) for w in _WORD.findall(text)), dtype=np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        hashes = (hashes + words[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes)


def _similar(text: str, known: list[np.ndarray], union: np.ndarray) -> bool:
    """Whether the text shares ``SIMILAR`` of its shingles with a catalogued one; ``union`` holds the shingles of all."""
    mine = shingles(text)
    place = np.minimum(np.searchsorted(union, mine), len(union) - 1)
    if (union[place] == mine).sum() < SIMILAR * len(mine):
        return False
    return any(2 * SIMILAR * (len(mine) + len(x)) <= 2 * (1 + SIMILAR) * len(np.intersect1d(mine, x, assume_unique=True)) for x in known)


def _named_like(path: str, size: int, unheld: frozenset[tuple[str, str, int]]) -> bool:
    """Whether name (but for a suffix) and size (within a tenth or 80 bytes) are those of a catalogued file."""
    stem, _, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return any(e == ext and (stem == s or stem.startswith(s + "_")) and abs(size - n) <= max(80, n // 10) for s, e, n in unheld)


SCHEMA = "file_id bigint, project string, path string, language string, kind string, evidence string, expansion double, literal_share double, uniform double"


def _judge(libraries: frozenset[str], hashes: frozenset[str], known: list[np.ndarray], unheld: frozenset[tuple[str, str, int]] = frozenset()):
    """``known``: shingles of catalogued texts; ``unheld``: (stem, extension, size) of catalogued files of which ``files``
    has no exact copy to compare with."""
    union = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)

    def emit(file: File) -> list[tuple]:
        named, measured, kind, evidence = path_kind(file.path, libraries), {}, None, None
        ext = _extension(file.path)
        language = next((x for x in (language_of(r[1], file.path) for r in file.rows) if x), None)
        text = (file.text or "").removeprefix("\ufeff")
        judged = bool(text) and (ext in CODE or bool(language) and language != "json")
        lexer = language if language and language != "json" else _LEXED_AS.get(ext)
        if judged and lexer:
            measured = layout(text, lexer)
            if measured["expansion"] >= EXPANSION:
                kind, evidence = "minified", "layout"
            elif measured["literal_share"] >= LITERAL_SHARE and measured["literal_chars"] >= BLOB_CHARS and not measured["declares"]:
                kind, evidence = "data", "literals"
        if kind is None and any((r[5] or "").lower() in hashes for r in file.rows):
            kind, evidence = "vendored", "catalogue"
        if kind is None and judged:
            said = header_kind(LEADING.match(text).group())
            if said == "generated" and measured.get("uniform", 1.0) >= UNIFORM:
                kind, evidence = said, "header_and_layout" if measured else "header"
            elif said == "vendored":
                kind, evidence = said, "header"
            elif _COMPILED.search(text):
                kind, evidence = "generated", "compiler"
        if kind is None and named:
            kind, evidence = named, "path"
        if kind is None and judged and known and _similar(text, known, union):
            kind, evidence = "vendored", "similar"
        if kind is None and judged and unheld and _named_like(file.path, len(text.encode()), unheld):
            kind, evidence = "vendored", "name_and_size"
        return [
            (r[0], file.project, file.path, language, kind, evidence, *(float(measured[m]) if m in measured else None for m in ("expansion", "literal_share", "uniform")))
            for r in dict.fromkeys(file.rows)
        ]

    return emit


def _catalogued(files: DataFrame, chunks: DataFrame, hashes: frozenset[str]) -> list[tuple[str, np.ndarray]]:
    """(hash, shingles) for each listed hash that some file has; the shingles are made by the tasks.

    ``hashes`` and the files chosen, one for each, have no more rows than the catalogue.
    """
    listed = maybe_broadcast(files.sparkSession.createDataFrame([(h,) for h in sorted(hashes)], "content_hash string"), len(hashes), 100)
    held = files.where("project IS NOT NULL AND path IS NOT NULL").select(F.lower("content_hash").alias("content_hash"), "project", "path").join(listed, "content_hash")
    one = held.groupBy("content_hash").agg(F.min(F.struct("project", "path")).alias("f")).select("content_hash", "f.project", "f.path")
    some = chunks.join(maybe_broadcast(one.select("project", F.col("path").alias("file")), len(hashes), 400), ["project", "file"], "left_semi")

    def emit(file: File) -> list[tuple]:
        return [(file.rows[0][5], shingles(file.text).tobytes())] if file.text else []

    rows = durable(per_file(one, some, emit, "h string, s binary"))
    size = rows.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    if size > BROADCAST_LIMIT:
        raise ValueError(f"the catalogue's shingles take {size} bytes; a catalogue of so large files needs parts")
    return [(r["h"], np.frombuffer(bytes(r["s"]), dtype=np.uint64)) for r in rows.collect()]


def origins(files: DataFrame, chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per distinct ``files`` row; ``kind`` is null for hand-written ones, else lock, vendored, generated, minified or data.

    ``evidence`` names what showed it: layout, literals, catalogue, header (with or without layout), compiler, path,
    similar, or name_and_size.
    """
    rows = catalogue.select("library", "path", "size", F.lower("content_hash").alias("h")).collect()
    libraries = frozenset(r["library"].lower() for r in rows if r["library"])
    hashes = frozenset(r["h"] for r in rows if r["h"])
    held = _catalogued(files, chunks, hashes) if hashes else []
    names = [(*r["path"].rsplit("/", 1)[-1].rpartition(".")[::2], int(r["size"])) for r in rows if r["path"] and r["size"] and r["h"] not in {h for h, _ in held}]
    return per_file(files, chunks, _judge(libraries, hashes, [s for _, s in held], frozenset(names)), SCHEMA)
