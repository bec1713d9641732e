"""Quiet-period debouncing of change events: a batch form by islands and a streaming form with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TEMPORARY = r"(^|/)(\.|~)|(~|\.sw[a-z]|\.tmp|\.bak|#)$"
KINDS = ("modified", "created", "deleted", "moved", "closed")


def wanted_events(path: Column, kind: Column, is_dir: Column) -> Column:
    """Events that call for work: no dotfiles and editor leftovers; directories only where deleted or moved."""
    return ~path.rlike(TEMPORARY) & kind.isin(*KINDS) & (~is_dir | kind.isin("deleted", "moved"))


def firings(events: DataFrame, key: str, ts: str, quiet_seconds: int) -> DataFrame:
    """One row per quiet period: a key fires once its last event is ``quiet_seconds`` old (a gap of exactly that fires)."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("new", F.when(gap < quiet_seconds * 1_000_000, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(w)).groupBy(key, "island")
    out = islands.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return out.select(key, "first_ts", "last_ts", (F.col("last_ts") + F.expr(f"INTERVAL {quiet_seconds} SECONDS")).alias("fires_at"), "events")


def stream_firings(events: DataFrame, key: str, ts: str, quiet_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """The same over a stream, in event time: a key's timer restarts with every event and fires behind the watermark.

    The watermark bounds the state; events later than ``lateness`` are dropped, which the batch form doesn't do. State
    per key is its last event and count, so a hot key costs no more than another.
    """
    quiet = quiet_seconds * 1000

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], first, last, n))
            state.remove()
        else:
            stamps = sorted(int(t.value // 1_000_000) for pdf in batches for t in pdf["t"])
            for t in stamps:
                if n and t - last >= quiet:
                    out.append((k[0], first, last, n))
                    n = 0
                first, last, n = (t, t, 1) if not n else (min(first, t), max(last, t), n + 1)
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last + quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "first_ms", "last_ms", "events"])

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("t")).withWatermark("t", lateness)
    return keyed.groupBy("key").applyInPandasWithState(update, "key string, first_ms long, last_ms long, events long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def route(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events with the slug of the most specific project root that contains their path; roots are a small dimension."""
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    lookup = events.withColumn("up", F.explode(steps)).join(F.broadcast(roots.select(F.col("root").alias("up"), "slug")), "up")
    return lookup.groupBy(*[c for c in events.columns]).agg(F.max_by("slug", F.length("up")).alias("slug"))
