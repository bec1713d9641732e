"""A watcher as a streaming query: filtered, routed and debounced events start incremental passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.governance import Busy
from .debounce import stream_firings, wanted_events


def watch(events: DataFrame, run_pass: Callable[[str], None], checkpoint: str, quiet_seconds: int = 3, available_now: bool = False, on_busy: Callable[[str], None] | None = None) -> StreamingQuery:
    """Runs ``run_pass(key)`` for every key whose quiet period is over.

    ``events`` has key, ts, path, kind and is_dir. A pass that finds another writer is reported, not queued: the next
    event of the key brings the next try. With ``available_now`` the query ends when it has seen what there is.
    """
    wanted = events.where(wanted_events(F.col("path"), F.col("kind"), F.col("is_dir")))

    def fire(batch: DataFrame, _: int) -> None:
        # One row per fired project: as many as there are projects at most.
        for row in batch.select("key").distinct().collect():
            try:
                run_pass(row["key"])
            except Busy:
                if on_busy:
                    on_busy(row["key"])

    writer = stream_firings(wanted, "key", "ts", quiet_seconds).writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def due_for_sweep(last_fired: DataFrame, now: float, interval: int = 300) -> DataFrame:
    """Keys (key, fired_at epoch) that are due although no event came."""
    return last_fired.where(F.lit(now) - F.coalesce("fired_at", F.lit(0.0)) >= interval).select("key")


def stop(query: StreamingQuery, seconds: int) -> bool:
    """Stops a watcher; whether it ended within the time."""
    query.stop()
    return bool(query.awaitTermination(seconds)) if query.isActive else True
