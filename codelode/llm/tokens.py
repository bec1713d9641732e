"""Token counts of documents by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of the default tokenizer and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed to the tokenizer at once; longer texts are cut at white space, which the pattern splits at anyway.
STRIDE = 200_000


@lru_cache(maxsize=4)
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count(text: str, ranks: str = RANKS) -> int:
    """Tokens of the whole text."""
    enc = encoder(ranks)
    if len(text) <= STRIDE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + STRIDE)
        if end < len(text):
            # before a blank that follows a non-blank: the pattern always splits there
            space = next((k for k in range(end, at + STRIDE // 2, -1) if text[k].isspace() and not text[k - 1].isspace()), end)
            end = space
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def normal_lang(lang: Column) -> Column:
    """Two-letter language of any spelling (``EN``, ``en-GB``); null stays null."""
    return F.nullif(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit(""))


def normal_source(source: Column) -> Column:
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def counted(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, lang, source, n_tokens) of the documents that have a text; lang and source in one spelling."""
    rows = documents.where("text IS NOT NULL AND text != ''").select("doc_id", normal_lang(F.col("lang")).alias("lang"), normal_source(F.col("source")).alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t, ranks) for t in b.column(3).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], names=["doc_id", "lang", "source", "n_tokens"])

    return rows.mapInArrow(run, "doc_id bigint, lang string, source string, n_tokens int")
