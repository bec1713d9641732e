"""Edit plans: built, ordered, validated, previewed and applied in memory; small documents, so plain Python."""

from __future__ import annotations

import difflib
import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Edit:
    """Lines ``start`` to ``end`` (1-based, inclusive) of ``path`` become ``text``; end before start inserts before start."""

    path: str
    start: int
    end: int
    text: str


class PlanError(ValueError):
    """Why a plan can't be built or applied; ``rung`` names the check."""

    def __init__(self, rung: str, detail: str):
        super().__init__(f"{rung}: {detail}")
        self.rung = rung


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(document: dict) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def replace_body(path: str, span: tuple[int, int], text: str) -> Edit:
    return Edit(path, span[0], span[1], text)


def insert_symbol(path: str, lines: list[str], span: tuple[int, int] | None, where: str, text: str) -> Edit:
    """Before a symbol (and the comment block on it), after it, or at the end of the file."""
    if where == "end" or span is None:
        return Edit(path, len(lines) + 1, len(lines), text)
    if where == "after":
        return Edit(path, span[1] + 1, span[1], text)
    at = span[0]
    while at > 1 and lines[at - 2].lstrip().startswith(("#", "//", "*", "/*", "@")):
        at -= 1
    return Edit(path, at, at - 1, text)


def delete_declaration(path: str, span: tuple[int, int]) -> Edit:
    return Edit(path, span[0], span[1], "")


def ordered(edits: list[Edit]) -> list[Edit]:
    """By path, then bottom up, ranges before inserts at the same line; overlapping ranges are refused."""
    out = sorted(edits, key=lambda e: (e.path, -e.start, e.end < e.start))
    for upper, lower in zip(out[1:], out):
        if upper.path == lower.path and upper.end >= lower.start and upper.end >= upper.start and lower.end >= lower.start:
            raise PlanError("regions", f"{upper.path}: lines {upper.start}-{upper.end} overlap {lower.start}-{lower.end}")
    return out


def build(edits: list[Edit], texts: dict[str, str]) -> dict:
    """A content-addressed plan document over the files' present texts."""
    body = {"schema": 1, "files": {p: digest(texts[p]) for p in sorted({e.path for e in edits})}, "edits": [asdict(e) for e in ordered(edits)]}
    return body | {"id": digest(canonical(body))}


def validate(plan: dict, texts: dict[str, str]) -> None:
    """Raises at the first rung that fails: id, schema, paths, hash, coordinates, regions."""
    body = {k: v for k, v in plan.items() if k != "id"}
    if plan.get("id") != digest(canonical(body)):
        raise PlanError("id", "the document doesn't match its address")
    if plan.get("schema") != 1:
        raise PlanError("schema", str(plan.get("schema")))
    for path, was in plan["files"].items():
        if path.startswith("/") or ".." in path.split("/"):
            raise PlanError("paths", path)
        if path not in texts:
            raise PlanError("paths", f"{path} is missing")
        if digest(texts[path]) != was:
            raise PlanError("hash", f"{path} changed")
    for e in plan["edits"]:
        n = len(texts[e["path"]].split("\n"))
        if not 1 <= e["start"] <= n + 1 or e["end"] > n or e["end"] < e["start"] - 1:
            raise PlanError("coordinates", f"{e['path']}: {e['start']}-{e['end']} of {n} lines")
    ordered([Edit(**e) for e in plan["edits"]])


def apply(plan: dict, texts: dict[str, str]) -> dict[str, str]:
    """The texts after a valid plan."""
    validate(plan, texts)
    out = dict(texts)
    for e in plan["edits"]:
        lines = out[e["path"]].split("\n")
        lines[e["start"] - 1 : max(e["end"], e["start"] - 1)] = e["text"].split("\n") if e["text"] else []
        out[e["path"]] = "\n".join(lines)
    return out


def preview(plan: dict, texts: dict[str, str]) -> str:
    after = apply(plan, texts)
    return "".join("".join(difflib.unified_diff(texts[p].splitlines(True), after[p].splitlines(True), f"a/{p}", f"b/{p}")) for p in plan["files"])
