"""Incremental maintenance: change detection, upserts, cascades, reuse of stored vectors, caches, orphans, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable, partitions_for

#: Rows of one range of a cache's keys.
RANGE_ROWS = 100_000


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with its rows of the new keys replaced: the declarative form of a merge."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_file(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """All rows of changed files replaced by the new ones, also where a file has fewer rows now."""
    return old.join(changed.select("project", "file").distinct(), ["project", "file"], "left_anti").unionByName(new)


def delete_cascade(child: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``child`` whose file is not among the removed ones."""
    return child.join(removed.select("project", F.col("path").alias("file")).distinct(), ["project", "file"], "left_anti")


def orphans(children: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(table, project, file, rows): child rows whose file has no row in ``files``."""
    known = files.select("project", F.col("path").alias("file")).distinct()
    out = None
    for name, child in children.items():
        lost = child.join(known, ["project", "file"], "left_anti").groupBy("project", "file").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "project", "file", "rows")
        out = lost if out is None else out.unionByName(lost)
    return out


def tree_changes(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(project, path, kind) by full outer join on the key: added, deleted, modified or unchanged; unreadable withheld."""
    a = indexed.select("project", "path", F.col("content_hash").alias("was"), F.lit(1).alias("i"))
    b = scanned.select("project", "path", F.col("content_hash").alias("now"), "status", F.lit(1).alias("s"))
    kind = F.when(F.col("i").isNull(), "added").when(F.col("s").isNull(), "deleted").when(F.col("status") != "ok", "unreadable").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return a.join(b, ["project", "path"], "full").select("project", "path", kind.alias("kind"))


def staleness(changes: DataFrame) -> DataFrame:
    """One row per project: counts by kind, five examples, and fresh, stale or unknown."""
    n = lambda k: F.count_if(F.col("kind") == k)
    listed = F.slice(F.array_sort(F.collect_set(F.when(F.col("rn") <= 5, F.struct("path", "kind")))), 1, 5)
    ranked = changes.withColumn("rn", F.when(F.col("kind") != "unchanged", F.row_number().over(Window.partitionBy("project", F.col("kind") == "unchanged").orderBy("path"))))
    out = ranked.groupBy("project").agg(*[n(k).alias(k) for k in ("added", "deleted", "modified", "unreadable", "unchanged")], listed.alias("reasons"))
    state = F.when((F.col("added") + F.col("deleted") + F.col("modified")) > 0, "stale").when(F.col("unreadable") > 0, "unknown").otherwise("fresh")
    return out.withColumn("state", state)


def stat_reuse(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Current files with ``reused``: size and mtime_ns are as before, so the stored hash holds without a read."""
    prev = previous.select("project", "path", F.col("size").alias("ps"), F.col("mtime_ns").alias("pm"), F.col("content_hash").alias("ph"))
    same = (F.col("size") == F.col("ps")) & (F.col("mtime_ns") == F.col("pm"))
    return current.join(prev, ["project", "path"], "left").withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("hash", F.when(F.col("reused"), F.col("ph")).otherwise(F.col("content_hash"))).drop("ps", "pm", "ph")


def reuse_vectors(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted point with a donor of the same (chunk_hash, symbol), null-safe: the same id first, each donor once."""
    key = ["chunk_hash", "symbol"]
    same = stored.join(wanted, (stored["id"] == wanted["id"]) & (stored["chunk_hash"] == wanted["chunk_hash"]) & stored["symbol"].eqNullSafe(wanted["symbol"])).select(stored["id"].alias("id"), stored["id"].alias("donor"))
    s = stored.join(same.select("id"), "id", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).select(F.col("id").alias("donor"), F.col("chunk_hash").alias("h"), F.col("symbol").alias("y"), "k")
    w = wanted.join(same.select("id"), "id", "left_anti").withColumn("kw", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    paired = w.join(s, (F.col("chunk_hash") == F.col("h")) & F.col("symbol").eqNullSafe(F.col("y")) & (F.col("kw") == F.col("k")), "left").select("id", "donor")
    return same.unionByName(paired)


def evict(cache: DataFrame, cap: int) -> DataFrame:
    """A cache over its cap without its least recently used quarter and one; others unchanged.

    The cut is exact and no task sorts the whole cache: its keys are spread over ranges of bounded size, the ranges are
    counted, and the row at the cut is looked for in one of them only. Rows equal to it go with it.
    """
    total = cache.count()
    if total <= cap:
        return cache
    order = ["last_used", "key", "vec_id"]
    ranges = cache.select(*order).repartitionByRange(partitions_for(total, RANGE_ROWS), *order)
    placed = durable(ranges.withColumn("part", F.spark_partition_id()))
    left = total // 4 + 1
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
        if left <= r["n"]:
            break
        left -= r["n"]
    inside = placed.where(F.col("part") == r["part"]).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    cut = inside.where(F.col("n") == left).select(*order).first()
    # Nulls come first in the order, so they are gone if anything is.
    beyond = F.lit(False)
    for c in reversed(order):
        value = F.lit(cut[c])
        beyond = F.coalesce(F.col(c) > value, F.col(c).isNotNull() & value.isNull()) | (F.col(c).eqNullSafe(value) & beyond)
    return cache.where(beyond)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def resolve_paths(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, slug): the most specific project whose root contains the path, by equality on the path's ancestors."""
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    up = paths.select("path", F.explode(steps).alias("root")).join(projects.select(F.regexp_replace("path", "/+$", "").alias("root"), "slug"), "root")
    return up.groupBy("path").agg(F.max_by("slug", F.length("root")).alias("slug"))
