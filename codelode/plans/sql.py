"""Shared pieces of the oracle statements."""

from __future__ import annotations

from ..functions import paths as P


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def ends(column: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{s}')" for s in suffixes) + ")"


def dirs(column: str, names) -> str:
    return f"list_has_any(list_slice(string_split(lower({column}), '/'), 1, -2), {_list(names)})"


def base(column: str) -> str:
    return f"regexp_extract({column}, '([^/]*)$', 1)"


def file_class(column: str) -> str:
    b, low = base(column), f"lower({base(column)})"
    return f"""CASE WHEN {dirs(column, P.GENERATED_DIRS)} OR list_contains({_list(P.LOCK_NAMES)}, {low}) OR {ends(low, P.GENERATED_SUFFIXES)} OR {' OR '.join(f"contains({low}, '{m}')" for m in P.GENERATED_MARKERS)} THEN 'generated'
WHEN {dirs(column, P.DOC_DIRS)} OR {ends(low, P.DOC_SUFFIXES)} OR list_contains({_list(P.DOC_NAMES)}, {low}) THEN 'docs'
WHEN {dirs(column, P.TEST_DIRS)} OR regexp_matches(lower(regexp_extract({column}, '^(.*)/[^/]*$', 1)), '\\.tests?(/|$)') OR {b} = 'conftest.py' OR starts_with({b}, 'test_') OR starts_with({b}, 'test-') OR {ends(b, P.TEST_SUFFIXES)} OR {ends(b, P.TEST_CAMEL_SUFFIXES)} THEN 'tests'
WHEN {dirs(column, P.EXAMPLE_DIRS)} THEN 'examples' ELSE 'source' END"""


def class_weight(column: str) -> str:
    return f"list_position({_list(P.CLASSES)}, {file_class(column)}) - 1"


def glob_any(column: str, globs) -> str:
    return "(" + " OR ".join(f"{c} GLOB '{g}'" for g in globs for c in (column, base(column))) + ")"


#: Files, chunks and symbols without repeated rows.
FILES = "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY file_id) AS rn FROM files) WHERE rn = 1)"
CHUNKS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project, file, chunk_index ORDER BY chunk_id) AS rn FROM chunks) WHERE rn = 1)"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Resolved references: (refs columns, target_id, how).
RESOLVED = f"""d AS (SELECT *, {class_weight('file')} AS w FROM symbols WHERE name IS NOT NULL),
loc AS (SELECT project, file, name, min(id) AS id FROM d GROUP BY ALL HAVING count(*) = 1),
pw AS (SELECT project, name, w, count(*) AS n, min(id) AS id FROM d GROUP BY ALL),
wide AS (SELECT project, name, CASE WHEN n = 1 THEN id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY w) AS rn FROM pw) WHERE rn = 1),
r AS (SELECT refs.*, coalesce(loc.id, wide.id) AS target_id, CASE WHEN loc.id IS NOT NULL THEN 'same_file' WHEN wide.id IS NOT NULL THEN 'same_project' ELSE 'none' END AS how
      FROM refs LEFT JOIN loc ON refs.project = loc.project AND refs.file = loc.file AND refs.to_name = loc.name LEFT JOIN wide ON refs.project = wide.project AND refs.to_name = wide.name)"""
