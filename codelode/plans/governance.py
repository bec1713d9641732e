"""Gates, states and exit codes that decide whether stored tables may answer, and a health table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SCHEMA_REVISION = "7"
READS = frozenset("overview changed-symbols find-callers find-callees deps list-projects lookup-project semantic-search index-status skeleton outline find-symbol find-definition get-code-context find-references plan-validate plan-show eval eval-compare doctor".split())
WRITES = frozenset("add-project index-more remove-project sweep-orphans reindex-project watch unwatch plan-replace-body plan-insert-symbol plan-delete-declaration plan-apply".split())


class EngineError(Exception):
    """An error with its exit code."""

    exit_code = 1


class UsageError(EngineError):
    exit_code = 2


class NotFound(EngineError):
    exit_code = 3


class NeedsReindex(EngineError):
    exit_code = 4


class Busy(EngineError):
    exit_code = 5


@dataclass(frozen=True)
class Fingerprint:
    """What shaped the stored rows and the stored vectors."""

    schema: str
    chunker: str
    model: str = ""
    dim: int = 0


def compare(stored: Fingerprint, now: Fingerprint) -> dict[str, str]:
    """State of rows and vectors: same, older, newer or different."""
    rows = "same" if (stored.schema, stored.chunker) == (now.schema, now.chunker) else "older" if int(stored.schema) < int(now.schema) else "newer" if int(stored.schema) > int(now.schema) else "different"
    return {"rows": rows, "vectors": "same" if (stored.model, stored.dim) == (now.model, now.dim) else "different"}


def gate(stored: Fingerprint, now: Fingerprint, needs_vectors: bool = False) -> None:
    """Refuses before any job is started."""
    state = compare(stored, now)
    if state["rows"] != "same":
        raise NeedsReindex(f"rows are {state['rows']}")
    if needs_vectors and state["vectors"] != "same":
        raise NeedsReindex("vectors are of another model")


def vector_mode(asked: str, recorded: bool | None) -> bool:
    """on, off or auto: auto follows what the store recorded, and an unrecorded store counts as on."""
    if asked not in ("on", "off", "auto"):
        raise UsageError(asked)
    return asked == "on" or asked == "auto" and recorded is not False


def is_write(command: str) -> bool:
    if command not in READS | WRITES:
        raise UsageError(command)
    return command in WRITES


def empty_reason(coverage: dict) -> str:
    """Why an answer is empty, the first that holds."""
    if not coverage["files"]:
        return "index-empty"
    if coverage["references"]:
        return "defined-not-referenced" if coverage["defined"] else "name-absent"
    if coverage["parsed"] < coverage["files"]:
        return "files-not-parsed"
    return "language-without-ast" if not coverage["ast_languages"] else "name-absent"


def health(spark: SparkSession, checks: dict[str, tuple[bool, str]]) -> DataFrame:
    """(name, status, detail) of named checks."""
    rows = [(n, "ok" if ok else "fail", detail) for n, (ok, detail) in sorted(checks.items())]
    return spark.createDataFrame(rows, "name string, status string, detail string")
