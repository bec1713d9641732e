"""Reference resolution: which definition a name used somewhere stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import class_weight

TYPE_KINDS = ("class", "struct", "enum", "interface", "record", "record struct")


def definitions_by_name(symbols: DataFrame) -> DataFrame:
    """(project, name, id, definitions): the one definition a name has in its project, or in the best file class there."""
    ranked = symbols.where("name IS NOT NULL").withColumn("w", class_weight(F.col("file")))
    per = ranked.groupBy("project", "name", "w").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    best = per.groupBy("project", "name").agg(F.min(F.struct("w", "n", "id")).alias("b"), F.sum("n").alias("definitions"))
    return best.select("project", "name", F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"), "definitions")


def definitions_in_file(symbols: DataFrame) -> DataFrame:
    per = symbols.where("name IS NOT NULL").groupBy("project", "file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return per.where("n = 1").select("project", "file", "name", F.col("id").alias("here"))


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference with ``target_id`` and ``how``: same_file, same_project or none.

    Both dimensions are aggregated to one row per name before they are joined, so a heavily used name adds no rows;
    skewed names are left to adaptive skew joins, as neither side of the join multiplies them.
    """
    local = definitions_in_file(symbols).withColumnRenamed("name", "to_name")
    wide = definitions_by_name(symbols).select("project", F.col("name").alias("to_name"), F.col("id").alias("there"))
    both = refs.join(local, ["project", "file", "to_name"], "left").join(wide, ["project", "to_name"], "left")
    how = F.when(F.col("here").isNotNull(), "same_file").when(F.col("there").isNotNull(), "same_project").otherwise("none")
    return both.withColumns({"target_id": F.coalesce("here", "there"), "how": how}).drop("here", "there")


def type_uses(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Interim ``type_use`` references that name a type become ``type``; the others are dropped; keys stay unique."""
    types = symbols.where(F.col("symbol_type").isin(*TYPE_KINDS)).select("project", F.col("name").alias("to_name")).distinct()
    use = refs.where("relationship = 'type_use'").join(types, ["project", "to_name"], "left_semi").withColumn("relationship", F.lit("type"))
    both = refs.where("relationship != 'type_use'").unionByName(use)
    w = Window.partitionBy("project", "file", "line", "to_name", "relationship").orderBy(F.col("receiver").isNull(), "receiver", "from_symbol")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def unattributed(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: references without a target, split by why."""
    with_symbols = symbols.where("language IS NOT NULL").select("language").distinct().withColumn("spoken", F.lit(True))
    names = symbols.where("name IS NOT NULL").groupBy("project", "name").agg(F.count(F.lit(1)).alias("defs"))
    langs = files.select("project", F.col("path").alias("file"), F.col("language").alias("lang"))
    open_ = resolved(refs, symbols).where("how = 'none'").join(langs, ["project", "file"], "left").join(names.withColumnRenamed("name", "to_name"), ["project", "to_name"], "left")
    open_ = open_.join(F.broadcast(with_symbols), open_["lang"] == with_symbols["language"], "left")
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    none, silent = F.col("defs").isNull(), F.col("spoken").isNull()
    return open_.agg(
        F.count(F.lit(1)).alias("unattributed"), total(none).alias("unresolved"), total(none & ~silent).alias("missing_definition"),
        total(none & silent).alias("language_without_symbols"), total(~none).alias("ambiguous"),
    )


def fan_in(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(project, file, fan_in): references from other files to definitions here, and resolved imports of the file."""
    targets = symbols.select(F.col("id").alias("target_id"), F.col("file").alias("to_file"))
    used = resolved(refs, symbols).where("target_id IS NOT NULL").join(targets, "target_id").where("file != to_file").groupBy("project", F.col("to_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    if imports is not None:
        used = used.unionByName(imports.where("resolved_file IS NOT NULL AND resolved_file != file").groupBy("project", F.col("resolved_file").alias("file")).agg(F.count(F.lit(1)).alias("n")))
    return used.groupBy("project", "file").agg(F.sum("n").alias("fan_in"))


def ambiguity(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, to_name, sites, definitions, files, ambiguous, candidates): what the names that references use may mean.

    A reference by name alone can't be given to one definition, so it names the labels (file and lines) of all. References
    and definitions are counted per name before they meet, so a name that a third of all references use is one row.
    """
    label = F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    per = symbols.where("name IS NOT NULL").groupBy("project", F.col("name").alias("to_name")).agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct("file").alias("files"), F.array_sort(F.collect_set(label)).alias("labels"))
    used = refs.groupBy("project", "to_name").agg(F.count(F.lit(1)).alias("sites"))
    met = used.join(per, ["project", "to_name"], "left")
    return met.select("project", "to_name", "sites", "definitions", "files", F.coalesce(F.size("labels") > 1, F.lit(False)).alias("ambiguous"), F.coalesce(F.array_join("labels", " "), F.lit("")).alias("candidates"))
