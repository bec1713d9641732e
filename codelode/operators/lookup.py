"""Symbol and reference lookups: one predicate builder shared by reads and counts, ordered before any limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import class_weight, glob_regex
from ..functions.text import ascii_fold

#: What a relationship filter's word stands for in the stored rows.
RELATIONSHIPS = {"calls": ("call",), "includes": ("includes",), "inherits": ("base_class",), "references": ("call", "type", "base_class", "member", "includes", "identifier")}


@dataclass(frozen=True)
class SymbolFilter:
    """Filters that compose with AND. ``match`` is exact, substring (``%`` and ``_`` unescaped) or glob."""

    name: str | None = None
    match: str = "exact"
    kind: str | None = None
    file: str | None = None
    container: str | None = None
    visibility: str | None = None
    language: str | None = None
    prefix: str | None = None
    inherits: str | None = None
    has_call: str | None = None


def name_matches(column: Column, name: str, match: str) -> Column:
    if match == "glob":
        return column.rlike(glob_regex(name))
    folded = ascii_fold(column)
    low = "".join(c.lower() if c.isascii() else c for c in name)
    return folded == low if match == "exact" else folded.like(f"%{low}%".replace("\\", "\\\\"))


def filtered(symbols: DataFrame, refs: DataFrame, f: SymbolFilter) -> DataFrame:
    out = symbols
    if f.name is not None:
        out = out.where(name_matches(F.col("name"), f.name, f.match))
    for column, value in (("symbol_type", f.kind), ("file", f.file), ("container", f.container)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if f.visibility == "public":  # a missing visibility reads as public
        out = out.where(F.coalesce("visibility", F.lit("public")) == "public")
    elif f.visibility:
        out = out.where(F.col("visibility") == f.visibility)
    if f.language is not None:
        out = out.where(ascii_fold(F.col("language")) == f.language.lower())
    if f.prefix is not None:
        out = out.where(F.col("file").startswith(f.prefix))
    for relation, target in (("base_class", f.inherits), ("call", f.has_call)):
        if target is not None:
            r = refs.where((F.col("relationship") == relation) & (ascii_fold(F.col("to_name")) == target.lower()))
            r = r.select("project", "file", F.col("from_symbol").alias("name")).where("name IS NOT NULL")
            out = out.join(r, ["project", "file", "name"], "left_semi")
    return out


def symbol_order() -> list[Column]:
    """Total order of symbols: file class, named kinds first, parsed before guessed, then name and place."""
    return [class_weight(F.col("file")), F.col("symbol_type").isNull().cast("int"), (F.col("source") != "ast").cast("int"), F.col("name"), F.col("project"), F.col("file"), F.col("start_line"), F.col("qualified_name"), F.col("decl_hash"), F.col("id")]


def reference_order() -> list[Column]:
    """Total order of references: class, named enclosing symbol first, parsed before guessed, then place."""
    return [class_weight(F.col("file")), F.col("from_symbol").isNull().cast("int"), (F.col("confidence") != "ast").cast("int"), F.col("project"), F.col("file"), F.col("line"), F.col("relationship"), F.col("from_symbol"), F.col("receiver"), F.col("to_name")]


def find_symbols(symbols: DataFrame, refs: DataFrame, f: SymbolFilter, limit: int) -> DataFrame:
    """The first ``limit`` matches in symbol order, with the number of all matches beside each."""
    got = filtered(symbols, refs, f)
    top = got.orderBy(*symbol_order()).limit(limit)
    return top.withColumn("match_count", got.agg(F.count(F.lit(1))).scalar())


def find_symbols_tiered(symbols: DataFrame, refs: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """Exact matches; where there are none, substring matches."""
    wide = symbols.where(name_matches(F.col("name"), name, "substring")).withColumn("tier", F.when(name_matches(F.col("name"), name, "exact"), 0).otherwise(1))
    return wide.where(F.col("tier") == wide.agg(F.min("tier")).scalar()).orderBy(*symbol_order()).limit(limit)


def find_references(refs: DataFrame, name: str, relationship: str | None, limit: int) -> DataFrame:
    got = refs.where(F.col("to_name") == name)
    if relationship:
        got = got.where(F.col("relationship").isin(*RELATIONSHIPS[relationship]))
    return got.orderBy(*reference_order()).limit(limit).withColumn("match_count", got.agg(F.count(F.lit(1))).scalar())


def skeleton(symbols: DataFrame, files: DataFrame, per_file: int) -> DataFrame:
    """The first symbols of each file by line, with the number of all of them."""
    keep = symbols.join(files.select("project", F.col("path").alias("file")), ["project", "file"], "left_semi")
    w = Window.partitionBy("project", "file")
    ranked = keep.withColumns({"n": F.row_number().over(w.orderBy("start_line", "qualified_name", "id")), "total": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("n") <= per_file)


def evidence(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's verdict and the evidence it gives: ast only where the file was parsed."""
    verdicts = files.select("project", F.col("path").alias("file"), "parse_verdict")
    e = F.when((F.col("source") == "ast") & (F.coalesce("parse_verdict", F.lit("")) == "parsed"), "ast").otherwise("unknown")
    return symbols.join(verdicts, ["project", "file"], "left").withColumn("evidence", e)


def code_context(chunks: DataFrame, wanted: DataFrame, pad: int) -> DataFrame:
    """Merged line ranges of ``wanted`` (project, file, start_line, end_line), padded, with the chunks they touch."""
    w = Window.partitionBy("project", "file").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = wanted.withColumn("new", F.coalesce((F.col("start_line") > before + 1).cast("int"), F.lit(1)))
    islands = flagged.withColumn("island", F.sum("new").over(w)).groupBy("project", "file", "island")
    ranges = islands.agg(F.greatest(F.min("start_line") - pad, F.lit(1)).alias("from_line"), (F.max("end_line") + pad).alias("to_line"))
    return ranges.join(chunks, ["project", "file"]).where((F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line")))


def exactly_one(symbols: DataFrame) -> DataFrame:
    """(project, name, candidates, id): the only symbol of a name in its project; null where there are several."""
    per = symbols.where("name IS NOT NULL").groupBy("project", "name").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("id"))
    return per.withColumn("id", F.when(F.col("candidates") == 1, F.col("id")))
