"""Whole files from their chunks in one shuffle: rows of both tables meet sorted in one partition and stream through Python.

``files`` and ``chunks`` rows are sent to the partition of their (project, path), sorted there by Spark (which spills),
and read as a stream, so a task holds one file at a time. No join and no collected list of chunks is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a ``files`` row that operators may use.
FILE_FIELDS = ("file_id", "language", "parse_verdict", "size", "loc", "content_hash")


class File(NamedTuple):
    project: str
    path: str
    rows: list[tuple]
    """One tuple of FILE_FIELDS for every ``files`` row of the path (repeated rows included)."""
    text: str | None
    """None where no chunk holds the file's text."""


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[File]:
    key, rows, parts, last = None, [], [], None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for project, path, index, *fields, text in zip(*cols):
            if (project, path) != key:
                if key is not None:
                    yield File(key[0], key[1], rows, "\n".join(parts) if parts else None)
                key, rows, parts, last = (project, path), [], [], None
            if index is None:
                rows.append(tuple(fields))
            elif index != last:  # a repeated chunk row is the same chunk again
                parts.append(text)
                last = index
    if key is not None:
        yield File(key[0], key[1], rows, "\n".join(parts) if parts else None)


def per_file(files: DataFrame, chunks: DataFrame, emit: Callable[[File], list[tuple]], schema: str) -> DataFrame:
    """``emit`` applied to every file that has a ``files`` row; its tuples make the result.

    Rows with a null project or path can't be joined and take no part; a null chunk text counts as empty, and a null
    chunk_index as no chunk.
    """
    keyed = files.where("project IS NOT NULL AND path IS NOT NULL").select(
        "project", "path", F.lit(None).cast("int").alias("i"),
        *[F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in FILE_FIELDS], F.lit(None).cast("string").alias("text"),
    )
    kinds = dict(keyed.dtypes)
    texts = chunks.where("project IS NOT NULL AND file IS NOT NULL AND chunk_index IS NOT NULL").select(
        "project", F.col("file").alias("path"), F.col("chunk_index").cast("int").alias("i"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in FILE_FIELDS], F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_rows = keyed.unionByName(texts).repartition("project", "path").sortWithinPartitions("project", "path", "i")
    names = [c.strip().rsplit(" ", 1)[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for file in _stream(batches):
            if file.rows:
                out.extend(emit(file))
            if len(out) >= 4096:
                yield _batch(out, names, arrow)
                out = []
        if out:
            yield _batch(out, names, arrow)

    arrow = _arrow_schema(schema)
    return sorted_rows.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_schema(schema: str) -> pa.Schema:
    fields = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    return pa.schema([pa.field(name, _ARROW[kind]) for name, kind in fields])


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
