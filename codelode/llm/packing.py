"""Filling fixed-capacity containers (problem 7): shortest-pack-first over the length histogram.

Only the histogram of lengths, which has no more entries than the capacity, reaches the driver. There the lengths are
placed longest first into the emptiest packs that hold them, updating counts of packing patterns. The patterns become
intervals of ranks per length; documents are ranked within their length in hash-salted parts (so that a length which a
third of all documents have is ranked by many tasks) and find their container by binary search in the intervals.

Defined results: null and empty texts need no room and get no row; repeated documents are packed each time they occur;
a text larger than the capacity is the only one split: into full containers and one rest that is packed like the others;
an unknown language of a specification matches no documents; capacities that are null or below one are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch, durable
from .tokens import RANKS, counted, normal_lang

#: Documents that one rank window aims at.
RANK_ROWS = 50_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, multiplicity), ...), number of containers) of every packing pattern."""
    open_packs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    spaces: list[int] = []
    full: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(space: int, pattern: tuple[tuple[int, int], ...], packs: int) -> None:
        if space == 0:
            full.append((pattern, packs))
            return
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((pattern, packs))

    def with_item(pattern: tuple[tuple[int, int], ...], length: int, n: int) -> tuple[tuple[int, int], ...]:
        return (*pattern[:-1], (length, pattern[-1][1] + n)) if pattern and pattern[-1][0] == length else (*pattern, (length, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and -spaces[0] not in open_packs:
                heapq.heappop(spaces)
            space = -spaces[0] if spaces else 0
            if space >= length:
                pattern, packs = open_packs[space].pop()
                if not open_packs[space]:
                    del open_packs[space]
                    heapq.heappop(spaces)
                # The emptiest packs get one item each, all at once.
                took = min(packs, left)
                if took < packs:
                    put(space, pattern, packs - took)
                put(space - length, with_item(pattern, length, 1), took)
                left -= took
            else:
                each = min(left, capacity // length)
                packs = left // each
                put(capacity - each * length, ((length, each),), packs)
                left -= packs * each
    return full + [x for group in open_packs.values() for x in group]


def _intervals(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first container, multiplicity), by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    container = 0
    for pattern, packs in patterns:
        for length, times in pattern:
            first = ranks.get(length, 0)
            runs.setdefault(length, []).append((first, container, times))
            ranks[length] = first + packs * times
        container += packs
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def pack(documents: DataFrame, specs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(spec_id, container, doc_id, part, n_tokens, capacity): every part of every document of each specification."""
    spark = documents.sparkSession
    wanted = [r.asDict() for r in specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens", normal_lang(F.col("lang")).alias("lang")).distinct().collect()]
    out = "spec_id int, container bigint, doc_id bigint, part int, n_tokens int, capacity int"
    if not wanted:
        return spark.createDataFrame([], out)
    sizes = Scratch(spark).write(counted(documents, ranks).where("n_tokens > 0"), "tokens")
    spec = F.array(*[F.struct(F.lit(w["spec_id"]).cast("int").alias("spec_id"), F.lit(w["capacity_tokens"]).alias("capacity"), F.lit(w["lang"]).cast("string").alias("lang")) for w in wanted])
    pairs = sizes.select("doc_id", "n_tokens", "lang", F.explode(spec).alias("s")).where("s.lang IS NULL OR s.lang = lang")
    parts = F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("s.capacity")).cast("int") - 1)
    items = pairs.select("doc_id", "s.spec_id", "s.capacity", F.col("n_tokens").alias("whole"), F.explode(parts).alias("part")).select(
        "spec_id", "doc_id", "part", "capacity", F.least("capacity", F.col("whole") - F.col("part") * F.col("capacity")).cast("int").alias("n_tokens")
    )
    rows = sizes.count() * len(wanted)
    salts = max(1, -(-rows // RANK_ROWS))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = durable(items.groupBy("spec_id", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")))
    histograms: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("spec_id", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histograms.setdefault(r["spec_id"], {})[r["n_tokens"]] = r["n"]
    capacities = {w["spec_id"]: w["capacity_tokens"] for w in wanted}
    plans = spark.sparkContext.broadcast({k: _intervals(shortest_pack_first(h, capacities[k])) for k, h in histograms.items()})
    before = Window.partitionBy("spec_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("spec_id", "n_tokens", "salt").orderBy("doc_id", "part")
    ranked = items.withColumn("r", F.row_number().over(within) - 1).join(offsets.hint("merge"), ["spec_id", "n_tokens", "salt"]).withColumn("r", F.col("r") + F.col("offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec_id, length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
            container = np.zeros(len(rank), dtype=np.int64)
            key = spec_id.astype(np.int64) << 32 | length
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                runs = plans.value[int(k >> 32)][int(k & 0xFFFFFFFF)]
                run = runs[np.searchsorted(runs[:, 0], rank[at], "right") - 1]
                container[at] = run[:, 1] + (rank[at] - run[:, 0]) // run[:, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(container), b.column(2), b.column(3), b.column(1), b.column(5)], names=["spec_id", "container", "doc_id", "part", "n_tokens", "capacity"])

    return ranked.select("spec_id", "n_tokens", "doc_id", "part", F.col("r").cast("bigint"), F.col("capacity").cast("int")).mapInArrow(place, out)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of unused space of each specification."""
    per = packed.groupBy("spec_id").agg(F.max("capacity").alias("capacity"), (F.max("container") + 1).alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return per.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
