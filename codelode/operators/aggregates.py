"""Summaries of a corpus: languages, directories, hotspots, verdicts, coverage, trees, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import class_weight, file_class, top_directory

VERDICTS = ("parsed", "parse_error", "parse_unavailable")


def languages(files: DataFrame) -> DataFrame:
    per = files.groupBy("project", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    return per.withColumn("share", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy("project")), 1))


def directories(files: DataFrame, symbols: DataFrame) -> DataFrame:
    f = files.groupBy("project", top_directory(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    s = symbols.join(files.select("project", F.col("path").alias("file")), ["project", "file"], "left_semi").groupBy("project", top_directory(F.col("file")).alias("dir")).agg(F.count(F.lit(1)).alias("symbols"))
    return f.join(s, ["project", "dir"], "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def hotspots(values: DataFrame, n: int) -> DataFrame:
    """The n files of each project with the greatest ``value``, source before other classes."""
    w = Window.partitionBy("project").orderBy(class_weight(F.col("file")), F.desc("value"), "file")
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def verdict_counts(files: DataFrame) -> DataFrame:
    """One row per project with all three verdicts, zero where none has it."""
    return files.groupBy("project").agg(*[F.count_if(F.col("parse_verdict") == v).alias(v) for v in VERDICTS], F.count_if(F.col("parse_verdict").isNull()).alias("unknown"))


def relationship_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("relationship").agg(F.count(F.lit(1)).alias("refs")).orderBy(F.desc("refs"), "relationship")


def symbols_without_parse(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Files per project that have symbols although they were not parsed."""
    v = files.select("project", F.col("path").alias("file"), "parse_verdict")
    rows = symbols.select("project", "file").distinct().join(v, ["project", "file"], "left").where("parse_verdict IS DISTINCT FROM 'parsed'")
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("files"))


def directory_tree(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per directory: files, symbols, languages with counts, and the dominant one (most files, then the first name)."""
    directory = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    per_file = symbols.groupBy("project", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    rows = files.join(per_file, ["project", "path"], "left").select("project", directory.alias("dir"), F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("n", F.lit(0)).alias("n"))
    by_language = rows.groupBy("project", "dir", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("symbols"))
    return by_language.groupBy("project", "dir").agg(
        F.sum("files").alias("files"), F.sum("symbols").alias("symbols"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "files"))), lambda x: F.concat(x["language"], F.lit("="), x["files"].cast("string"))), ",").alias("languages"),
        F.min_by("language", F.struct(-F.col("files"), F.col("language"))).alias("dominant"),
    )


def entry_points(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols named main and runnable modules, at most five main symbols per project."""
    w = Window.partitionBy("project").orderBy("what")
    mains = symbols.where("name IN ('main', '__main__')").select("project", F.concat_ws(":", "file", "name").alias("what")).distinct().withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")
    return mains.unionByName(files.where("path IN ('__main__.py', 'src/__main__.py')").select("project", F.col("path").alias("what")))


def class_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("project", file_class(F.col("path")).alias("file_class")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def coverage(files: DataFrame, symbols: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per project: how much of it each table covers, and whether all files are complete."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("parse_verdict") == "parsed").alias("parsed"), F.count_if(F.col("loc").isNull()).alias("without_loc"))
    n = lambda t, name: t.groupBy("project").agg(F.count_distinct("file").alias(name))
    out = f.join(n(symbols, "with_symbols"), "project", "left").join(n(chunks, "with_chunks"), "project", "left").join(n(refs, "with_refs"), "project", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("with_symbols", "with_chunks", "with_refs")})
    return out.withColumn("complete", (F.col("files") == F.col("ok")) & (F.col("files") == F.col("with_chunks")))


def impact(changed: DataFrame, refs: DataFrame, per_name: int = 50, budget: int = 200) -> DataFrame:
    """Call sites of changed names (project, name), at most ``per_name`` of a name and ``budget`` of a project, by file."""
    sites = refs.where("relationship = 'call'").join(changed.select("project", F.col("name").alias("to_name")).distinct(), ["project", "to_name"], "left_semi")
    w = Window.partitionBy("project", "to_name").orderBy("file", "line", "relationship", "from_symbol", "receiver")
    capped = sites.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_name)
    all_ = Window.partitionBy("project").orderBy("to_name", "n")
    return capped.withColumn("k", F.row_number().over(all_)).where(F.col("k") <= budget).groupBy("project", "file").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("to_name").alias("names"))


def candidate_tests(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(project, path, test): test files whose name is that of a changed file with a test affix."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.*?)\.[^.]*$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    names = F.array(F.concat(F.lit("test_"), stem, ext), F.concat(stem, F.lit("_test"), ext), F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext), F.concat(stem, F.lit("Tests"), ext))
    wanted = changed.select("project", "path", F.explode(names).alias("base"))
    have = files.select("project", F.col("path").alias("test"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    return wanted.join(have, ["project", "base"]).select("project", "path", "test")


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a changed range (project, file, from_line, to_line): equality on the file first."""
    hit = symbols.join(hunks, ["project", "file"]).where((F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line")))
    return hit.select("id", "project", "file", "qualified_name").distinct()


def removed_symbols(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file, name) that files still present (project, file) had before and have nowhere now."""
    key = ["project", "file", "name"]
    old = before.where("name IS NOT NULL").select(key).distinct().join(files.select("project", "file").distinct(), ["project", "file"], "left_semi")
    return old.join(after.where("name IS NOT NULL").select(key).distinct(), key, "left_anti")


def fan_in_by_file(resolved_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, file, value): references from other files that resolve into a file; counted per target before the join."""
    per = resolved_refs.where("target_id IS NOT NULL").groupBy("target_id", F.col("project").alias("from_project"), F.col("file").alias("from_file")).agg(F.count(F.lit(1)).alias("n"))
    met = per.join(symbols.select(F.col("id").alias("target_id"), "project", "file"), "target_id")
    other = (F.col("from_file") != F.col("file")) | (F.col("from_project") != F.col("project"))
    return met.where(other).groupBy("project", "file").agg(F.sum("n").alias("value"))
