"""Embedding of texts by an injected function, in batches with retries; a deterministic local embedder for tests."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of a request, attempts per request, and the longest pause between attempts in seconds.
BATCH, TRIES, LONGEST_PAUSE = 48, 5, 30.0

Embed = Callable[[list[str]], list[list[float]]]


class FatalEmbedding(RuntimeError):
    """An error that no repetition mends."""


def hash_embedder(dim: int = 64) -> Embed:
    """Signed hashing of word counts, normalised: needs no model and is the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                out[k, h % dim] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def with_retries(embed: Embed, texts: list[str], pause: float = 1.0) -> list[list[float] | None]:
    """Repeats with growing pauses; a batch that keeps failing is halved until the text at fault stands alone (null)."""
    for attempt in range(TRIES):
        try:
            return list(embed(texts))
        except FatalEmbedding:
            raise
        except Exception:  # noqa: BLE001
            time.sleep(min(pause * 2**attempt, LONGEST_PAUSE))
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return with_retries(embed, texts[:half], pause) + with_retries(embed, texts[half:], pause)


def embedded(rows: DataFrame, key: str, embed: Embed, pause: float = 1.0) -> DataFrame:
    """(key, vec): float16 bytes of each text's vector, as caches and searches use them; null where it can't be embedded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, vectors = b.column(1).to_pylist(), []
            for k in range(0, len(texts), BATCH):
                vectors += with_retries(embed, texts[k : k + BATCH], pause)
            blobs = [None if v is None else np.asarray(v, dtype="<f2").tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=[key, "vec"])

    typed = dict(rows.dtypes)[key]
    return rows.where("text IS NOT NULL").select(key, "text").mapInArrow(run, f"{key} {typed}, vec binary")


def half_precision(vector: list[float]) -> list[float]:
    """A query's vector as its stored bytes give it back."""
    return np.asarray(vector, dtype="<f2").astype(np.float64).tolist()
