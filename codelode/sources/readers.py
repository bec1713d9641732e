"""Small sources: version-control diffs, labelled query files, class ladders, configuration and the project registry."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = "id string, query string, relevant array<struct<file:string,symbol:string>>, tags array<string>"


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(file, from_line, to_line): new-side ranges of a zero-context unified diff given as (n, line) rows.

    The file of a hunk is the last ``+++`` line before it, carried by a window; pure deletions mark the line before.
    """
    from pyspark.sql import Window

    path = F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1), F.lit(""))
    carried = lines.withColumn("file", F.last(path, ignorenulls=True).over(Window.orderBy("n")))
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    count = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    rows = carried.where(start != "").withColumns({"from_line": start.cast("int"), "c": F.when(count != "", count.cast("int")).otherwise(1)})
    return rows.where("file IS NOT NULL").select("file", F.greatest("from_line", F.lit(1)).alias("from_line"), F.greatest(F.col("from_line") + F.greatest(F.col("c") - 1, F.lit(0)), F.lit(1)).alias("to_line"))


def name_status(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) of a name-status listing with renames."""
    parts = F.split("line", "\t")
    renamed = F.size(parts) == 3
    return lines.where(F.col("line").rlike(r"^[AMDRCT]\d*\t")).select(F.substring("line", 1, 1).alias("status"), F.when(renamed, parts[2]).otherwise(parts[1]).alias("path"), F.when(renamed, parts[1]).alias("old_path"))


class QueryFileError(ValueError):
    """A labelled query file that can't be used, with the line that is wrong."""


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries of a JSON-lines file; blank lines and ``#`` comments are skipped, anything else must be whole."""
    rows = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            try:
                r = json.loads(line)
            except ValueError as e:
                raise QueryFileError(f"line {n}: {e}") from e
            if not r.get("query") or not r.get("relevant"):
                raise QueryFileError(f"line {n}: query and relevant are required")
            rows.append((str(r.get("id", n)), r["query"], [(x.get("file"), x.get("symbol")) for x in r["relevant"]], r.get("tags", [])))
    if not rows:
        raise QueryFileError("no queries")
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def class_ladder(toml_text: str, table: str = "tool.codelode.ordering") -> dict[str, tuple[str, ...]]:
    """Directory names that a project adds to the docs, examples and tests classes; malformed text adds none."""
    try:
        section: object = tomllib.loads(toml_text)
    except tomllib.TOMLDecodeError:
        section = {}
    for key in table.split("."):
        section = section.get(key, {}) if isinstance(section, dict) else {}
    got = section if isinstance(section, dict) else {}
    return {k: tuple(str(x).strip("/").lower() for x in got.get(k, []) if str(x).strip("/")) if isinstance(got.get(k, []), list) else () for k in ("docs", "examples", "tests")}


@dataclass(frozen=True)
class Config:
    """Settings by environment variable (``CODELODE_`` and the upper-cased name), else default; arguments win."""

    max_file_bytes: int = 1 << 20
    quiet_seconds: int = 3
    sweep_seconds: int = 300
    embed_batch: int = 48
    search_limit: int = 8


def load_config(environ: dict[str, str] | None = None, **overrides: int) -> Config:
    env = os.environ if environ is None else environ
    values = {}
    for f in fields(Config):
        raw = overrides.get(f.name, env.get(f"CODELODE_{f.name.upper()}"))
        try:
            values[f.name] = f.default if raw is None else int(raw)
        except ValueError:
            values[f.name] = f.default
    return Config(**values)


def slug_of(path: str, name: str | None = None) -> str:
    """A project's slug: its name in safe characters, else the first eight digits of its path's hash."""
    clean = re.sub(r"[^a-z0-9_-]+", "-", (name or "").lower()).strip("-")
    return clean or hashlib.sha256(path.encode()).hexdigest()[:8]


class RegistryError(ValueError):
    """A slug or path that is already taken, or one that is not registered."""


def add_project(registry: DataFrame, path: str, name: str | None, now: float) -> DataFrame:
    """The registry with one more row; a slug held by another path is refused."""
    slug = slug_of(path, name)
    if registry.where((F.col("slug") == slug) & (F.col("path") != path)).limit(1).count():
        raise RegistryError(f"slug {slug} belongs to another path")
    row = registry.sparkSession.createDataFrame([(path, slug, now, name)], "path string, slug string, created_at double, name string")
    return registry.where(F.col("path") != path).unionByName(row)


def remove_project(registry: DataFrame, slug: str) -> DataFrame:
    if not registry.where(F.col("slug") == slug).limit(1).count():
        raise RegistryError(f"no project {slug}")
    return registry.where(F.col("slug") != slug)
