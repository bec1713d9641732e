"""Mixing sources to target shares (problem 8) by hash-threshold histograms.

Every document gets a 64-bit hash. For each source of each mix, the budget decides how many whole passes over the source
are taken and how many tokens remain; the remainder is the set of documents whose hash lies under a threshold. The
thresholds are found without sorting: tokens are summed by source and the hash's leading bits, the bucket in which the
budget ends is located, and only that bucket is refined by the next bits, until it holds one document. Thresholds of
smaller budgets lie below those of larger ones, so mixes are nested. The documents are then filtered by hash.

Defined results: null and empty texts are never chosen; sources are compared without case and outer blanks; a source too
small for its share is taken whole ``max_repeats`` times and its reached share reported; an absent one has share zero;
budgets, shares and repeats that are null or not positive choose nothing; a repeated document counts each time it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch
from .tokens import RANKS, counted, normal_source

#: Bits of the hash that one round of histograms looks at, and bits altogether.
BITS, TOTAL = 12, 60


def _thresholds(sized: DataFrame, targets: list[dict]) -> None:
    """Sets ``passes`` and ``below`` (hashes under it get one more copy) of each target."""
    # Sources that no target names take no part: there may be very many.
    named = sized.sparkSession.createDataFrame([(s,) for s in sorted({t["source"] for t in targets})], "source string")
    have = {r["source"]: r["t"] for r in sized.join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    open_ = []
    for t in targets:
        want, total = t["target_share"] * t["budget_tokens"], have.get(t["source"], 0)
        t["available"] = total
        t["passes"], t["below"] = (0, 0) if not total else (min(t["max_repeats"], int(want // total)), 0)
        if total and t["passes"] < t["max_repeats"]:
            t["rest"] = want - t["passes"] * total
            t["prefix"] = 0
            open_.append(t)
    for level in range(1, TOTAL // BITS + 1):
        if not open_:
            return
        spots = sorted({(t["source"], t["prefix"]) for t in open_})
        shift = TOTAL - level * BITS
        # One row per boundary bucket: as many as there are targets, at most.
        few = sized.sparkSession.createDataFrame([(s, p) for s, p in spots], "source string, prefix bigint")
        hist = (
            sized.select("source", F.shiftright("h", shift).alias("b"), "n_tokens")
            .withColumn("prefix", F.shiftright("b", BITS) if level > 1 else F.lit(0).cast("bigint"))
            .join(F.broadcast(few), ["source", "prefix"], "left_semi")
            .groupBy("source", "prefix", "b")
            .agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        buckets: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for r in hist:
            buckets.setdefault((r["source"], r["prefix"]), []).append((r["b"], r["t"], r["n"]))
        still = []
        for t in open_:
            done = True
            for b, tokens, n in sorted(buckets.get((t["source"], t["prefix"]), [])):
                if tokens <= t["rest"]:
                    t["rest"] -= tokens
                    t["below"] = (b + 1) << shift
                    continue
                # The budget ends in this bucket: refine it, or take its last document if that comes closer.
                if n > 1 and shift:
                    t["prefix"], done = b, False
                elif t["rest"] > tokens / 2:
                    t["below"] = (b + 1) << shift
                break
            if not done:
                still.append(t)
        open_ = still


def mix(documents: DataFrame, targets: DataFrame, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): (mix_id, source, doc_id, n_tokens, copies) and the shares reached per mix and source."""
    spark = documents.sparkSession
    sized = Scratch(spark).write(
        counted(documents, ranks).where("source IS NOT NULL AND n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - TOTAL).alias("h")), "sized"
    )
    columns = ["mix_id", normal_source(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_tokens"]
    valid = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0 AND budget_tokens > 0")
    goals = [r.asDict() for r in valid.select(*columns).distinct().collect()]
    _thresholds(sized, goals)
    rules = spark.createDataFrame(
        [(g["mix_id"], g["source"], g["target_share"], g["max_repeats"], g["budget_tokens"], g["passes"], g["below"]) for g in goals],
        "mix_id int, source string, target_share double, max_repeats int, budget_tokens bigint, passes int, below bigint",
    )
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("int")
    chosen = sized.join(F.broadcast(rules), "source").select("mix_id", "source", "doc_id", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    shares = rules.join(got, ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", "max_repeats", "budget_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.col("budget_tokens"), 6).alias("share_of_budget"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_id")), 6).alias("share_of_mix"),
    )
    return chosen, shares
