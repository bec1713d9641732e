"""Caller, callee and dependency walks: one join per level, a visited set by anti-join, honest caps.

Each level is stored durably, which cuts lineage and lets a lost executor repeat one level only. A level may be far larger
than the cap: it is counted, and only its first nodes, found as a distributed top-k, are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable, maybe_broadcast
from ..functions.paths import class_weight
from .lookup import reference_order


#: What makes a call site one node.
SITE = ["file", "line", "from_symbol", "relationship"]


def _capped(found: DataFrame, order: list[Column], level: int, used: int, cap: int) -> tuple[DataFrame, int]:
    """The rows of a level that the cap leaves room for, with their position and the number ``refused``; and their number.

    Where it leaves none, one row holds that number alone: its position and all else but the level are null.
    """
    total, room = found.count(), max(0, cap - used)
    top = found.orderBy(*order).limit(max(1, room))
    position = (F.row_number().over(Window.orderBy(*order)) + used).cast("int")  # over at most the cap's rows
    shown = top.withColumn("position", position).withColumns({"level": F.lit(level), "refused": F.lit(max(0, total - room)).cast("bigint")})
    if not room:
        shown = shown.withColumns({c: F.lit(None).cast(t) for c, t in shown.dtypes if c not in ("level", "refused")})
    return shown, min(total, room)


def callers(refs: DataFrame, symbols: DataFrame, project: str, name: str, depth: int = 2, cap: int = 40) -> DataFrame:
    """Call sites reaching ``name``: (level, file, line, from_symbol, relationship, target, position), roots at level 0.

    A node is a site; the next level asks for the enclosing symbol's name. Positions follow the frontier's order and
    then the reference order; at most ``cap`` nodes are shown, roots included, and ``refused`` counts the others of the
    level: on each of its rows, or on a row without a position if none is shown. A site is refused once.
    """
    refs = refs.where(F.col("project") == project)
    roots = symbols.where((F.col("project") == project) & (F.col("name") == name)).select("file", F.col("start_line").alias("line"), F.col("name").alias("from_symbol")).distinct()
    found = durable(roots.select("file", "line", "from_symbol", F.lit("definition").alias("relationship"), F.lit(name).alias("target")))
    columns = ["level", *SITE, "target", "position", "refused"]
    shown, used = _capped(found, [F.col("file"), F.col("line")], 0, 0, cap)
    walked, seen = shown.select(columns), found.select(SITE)
    frontier = walked.sparkSession.createDataFrame([(name, 0)], "to_name string, at int")
    for level in range(1, depth + 1):
        # The frontier has no more rows than the cap.
        edges = refs.join(maybe_broadcast(frontier, cap, 200), "to_name").select("file", "line", "from_symbol", "relationship", "to_name", "at", "project", "confidence", "receiver")
        keys = seen.select([F.col(c).alias(f"seen_{c}") for c in SITE])
        fresh = edges.join(keys, [edges[c].eqNullSafe(keys[f"seen_{c}"]) for c in SITE], "left_anti")
        # Of the edges of one site the first in order counts.
        order = [F.col("at"), *reference_order()]
        first = fresh.groupBy(*SITE).agg(F.min_by(F.struct("to_name", "at", "project", "confidence", "receiver"), F.struct(*order)).alias("e")).select(*SITE, "e.*")
        found = durable(first.withColumn("target", F.col("to_name")))
        shown, taken = _capped(found, order, level, used, cap)
        walked, seen = walked.unionByName(shown.select(columns)), seen.unionByName(found.select(SITE))
        if not taken:
            break
        used += taken
        frontier = durable(shown.where("from_symbol IS NOT NULL").groupBy(F.col("from_symbol").alias("to_name")).agg(F.min("position").alias("at")))
    return walked


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes within ``depth`` steps of ``starts`` along (src, dst) edges, at their least level.

    A frontier may be hot or large: it is joined without a broadcast hint, and distinct nodes are kept before each join.
    """
    seen = durable(starts.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = seen.select("node")
    for level in range(1, depth + 1):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        fresh = durable(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh.select("node")
    return seen


def call_edges(resolved_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) between files: a call here whose target is defined there."""
    targets = symbols.select(F.col("id").alias("target_id"), F.col("project").alias("tp"), F.col("file").alias("tf"))
    key = lambda p, f: F.concat_ws("\u0001", p, f)
    return resolved_refs.where("target_id IS NOT NULL").join(targets, "target_id").select(key("project", "file").alias("src"), key("tp", "tf").alias("dst")).where("src != dst").distinct()


def callees(resolved_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, file, from_symbol, to_name, target_file, calls): what each declaration calls.

    The called name is tied to a file only where exactly one file of the project defines it.
    """
    homes = symbols.where("name IS NOT NULL").groupBy("project", F.col("name").alias("to_name")).agg(F.count_distinct("file").alias("n"), F.min("file").alias("f"))
    calls = resolved_refs.where("relationship = 'call'").groupBy("project", "file", "from_symbol", "to_name").agg(F.count(F.lit(1)).alias("calls"))
    return calls.join(homes, ["project", "to_name"], "left").select("project", "file", "from_symbol", "to_name", F.when(F.col("n") == 1, F.col("f")).alias("target_file"), "calls")


def callees_walk(refs: DataFrame, symbols: DataFrame, project: str, name: str, depth: int = 2, cap: int = 60) -> DataFrame:
    """(level, name, calls, target_file, position, refused): names called from ``name`` and from those, each at its first level.

    A declaration is known by the last part of its qualified name. Names called most come first; ``cap`` counts the start,
    and ``refused`` is as in ``callers``. A name has a file only where exactly one file of the project defines it.
    """
    mine = refs.where((F.col("project") == project) & (F.col("relationship") == "call") & F.col("from_symbol").isNotNull() & F.col("to_name").isNotNull())
    edges = durable(mine.groupBy(F.substring_index("from_symbol", ".", -1).alias("src"), F.col("to_name").alias("name")).agg(F.count(F.lit(1)).alias("calls")))
    spark = refs.sparkSession
    columns = ["level", "name", "calls", "position", "refused"]
    walked = spark.createDataFrame([(0, name, None, 1, 0)], "level int, name string, calls bigint, position int, refused bigint")
    seen, frontier, used = walked.select("name"), walked.select(F.col("name").alias("src")), 1
    for level in range(1, depth + 1):
        step = edges.join(maybe_broadcast(frontier, cap, 200), "src").groupBy("name").agg(F.sum("calls").alias("calls"))
        found = durable(step.join(seen, "name", "left_anti"))
        shown, taken = _capped(found, [F.desc("calls"), F.col("name")], level, used, cap)
        walked, seen = walked.unionByName(shown.select(columns)), seen.unionByName(found.select("name"))
        if not taken:
            break
        used, frontier = used + taken, shown.select(F.col("name").alias("src"))
    homes = symbols.where((F.col("project") == project) & F.col("name").isNotNull()).groupBy("name").agg(F.count_distinct("file").alias("n"), F.min("file").alias("f"))
    return walked.join(homes, "name", "left").select("level", "name", "calls", F.when(F.col("n") == 1, F.col("f")).alias("target_file"), "position", "refused")


def dependencies(imports: DataFrame, project: str, start: str, direction: str, depth: int = 2, cap: int = 60) -> DataFrame:
    """(level, file, position, refused) along resolved imports: ``out``, ``in`` or ``both``; ``cap`` counts the start.

    ``refused`` counts the files of the level that the cap left out, as in ``callers``.
    """
    edges = imports.where((F.col("project") == project) & F.col("resolved_file").isNotNull() & (F.col("resolved_file") != F.col("file"))).select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")).distinct()
    if direction != "out":
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = back if direction == "in" else edges.unionByName(back).distinct()
    edges = durable(edges)
    spark = imports.sparkSession
    walked = spark.createDataFrame([(0, start, 1, 0)], "level int, file string, position int, refused bigint")
    seen = frontier = walked.select("file")
    used = 1
    for level in range(1, depth + 1):
        step = edges.join(frontier.withColumnRenamed("file", "src"), "src").select(F.col("dst").alias("file")).distinct()
        fresh = step.join(seen, "file", "left_anti")
        found = durable(fresh)
        shown, taken = _capped(found, [class_weight(F.col("file")), F.col("file")], level, used, cap)
        shown = shown.select("level", "file", "position", "refused")
        walked, seen = walked.unionByName(shown), seen.unionByName(found.select("file"))
        if not taken:
            break
        used, frontier = used + taken, shown.select("file")
    return walked


def importers(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, name, importer): files that import a file which defines the name."""
    homes = symbols.where("name IS NOT NULL").select("project", "name", F.col("file").alias("resolved_file")).distinct()
    return imports.where("resolved_file IS NOT NULL").join(homes, ["project", "resolved_file"]).select("project", "name", F.col("file").alias("importer")).distinct()


def render(nodes: list[tuple[int, str]]) -> str:
    """Indented text of (level, label) nodes in order."""
    return "\n".join("  " * level + label for level, label in nodes)
