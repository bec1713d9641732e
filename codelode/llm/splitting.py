"""Splitting oversized chunks at natural boundaries (problem 6) by content-defined chunking.

A rolling hash over the characters sets landmarks; from each piece's first new line the next landmark between the least
and the greatest size is taken and snapped to the nearest natural boundary (before a declaration, at a blank line, else
at a line end). An edit moves the cuts near it only; the next landmark brings the pieces back into step. Consecutive
pieces share ten lines, or as many as leave room for a new one. Lines are never cut: a line over the limit is a piece.

Defined results: texts within the limit, null and empty ones give no pieces; a null start_line counts as 1; repeated
chunk rows give repeated pieces; other columns are not carried over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest and least characters of a piece, and lines shared by consecutive pieces.
LIMIT, LEAST, SHARED = 1000, 350, 10
#: One landmark in so many characters on average; characters under the rolling hash.
SPACING, WINDOW = 256, 16

_DECLARATION = re.compile(r"\s{0,8}(?:@\w|(?:export |default |async |pub(?:\(\w+\))? |static |public |private |internal |protected |abstract |final )*(?:def|class|func|fn|function|impl|struct|enum|interface|namespace|trait|type|module)\b|#{1,6} )")
_GEAR = np.random.default_rng(20240517).integers(0, 1 << 63, 256, dtype=np.uint64)


def landmarks(text: str) -> np.ndarray:
    """Character offsets at which the rolling hash of the ``WINDOW`` characters before is a landmark, and all hashes."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    gear = _GEAR[(points ^ (points >> 8)) & 0xFF]
    h = gear.copy()
    for k in range(1, WINDOW):
        h[k:] += gear[:-k] << np.uint64(k)
    return h >> np.uint64(40)


def cut(text: str, limit: int = LIMIT, shared: int = SHARED) -> list[tuple[int, int]]:
    """First and last line (0-based, inclusive) of each piece of ``text``."""
    lines = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines])  # offset after each line's feed
    begin = np.concatenate(([0], ends[:-1]))
    hashes = landmarks(text)
    marks = np.flatnonzero(hashes % SPACING == 0)
    grade = [0 if k + 1 < len(lines) and _DECLARATION.match(lines[k + 1]) else 60 if not lines[k].strip() or k + 1 < len(lines) and not lines[k + 1].strip() else 200 for k in range(len(lines))]
    pieces, start, fresh = [], 0, 0
    while fresh < len(lines):
        # The last line that keeps the piece within the limit; at least the first new line.
        stop = max(fresh, int(np.searchsorted(ends, begin[start] + limit + 1, "right")) - 1)
        if stop >= len(lines) - 1:
            pieces.append((start, len(lines) - 1))
            break
        low = fresh
        while low < stop and ends[low] - begin[fresh] < min(LEAST, limit // 3):
            low += 1
        a, b = int(ends[low]), int(ends[stop])
        inside = marks[np.searchsorted(marks, a - 1) : np.searchsorted(marks, b)]
        at = int(inside[0]) if len(inside) else a - 1 + int(np.argmin(hashes[a - 1 : min(b, len(hashes))])) if a - 1 < len(hashes) else b
        end = min(range(low, stop + 1), key=lambda k: (abs(int(ends[k]) - at) + grade[k], k))
        pieces.append((start, end))
        fresh = end + 1
        back = max(start + 1, fresh - shared, 0)
        while back < fresh and ends[fresh] - 1 - begin[back] > limit:
            back += 1
        start = min(back, fresh)
    return pieces


SCHEMA = pa.schema(
    [("chunk_id", pa.int64()), ("project", pa.string()), ("file", pa.string()), ("chunk_index", pa.int32()), ("piece_no", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()),
     ("symbol", pa.string()), ("symbol_type", pa.string()), ("shared_lines", pa.int32()), ("text", pa.string())]
)
DDL = "chunk_id bigint, project string, file string, chunk_index int, piece_no int, start_line int, end_line int, symbol string, symbol_type string, shared_lines int, text string"


def pieces(chunks: DataFrame, limit: int = LIMIT, shared: int = SHARED) -> DataFrame:
    """The pieces of every chunk row whose text is longer than ``limit`` characters."""
    big = chunks.where(F.length("text") > limit).select(
        "chunk_id", "project", "file", F.col("chunk_index").cast("int"), F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("s"), "symbol", "symbol_type", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, project, file, index, s, symbol, kind, text in zip(*[c.to_pylist() for c in batch.columns]):
                lines, last = text.split("\n"), -1
                for k, (a, b) in enumerate(cut(text, limit, shared)):
                    out.append((cid, project, file, index, k, s + a, s + b, None if k else symbol, None if k else kind, max(0, last - a + 1), "\n".join(lines[a : b + 1])))
                    last = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return big.mapInArrow(run, DDL)
