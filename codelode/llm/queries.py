"""The registered queries of this package; ``SQL`` holds the oracle statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import durable, table
from . import credentials, mixing, neighbours, origin, packing, splitting, syntax, tokens, truncation


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "vendor_catalog"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).where("kind IS NOT NULL").select("file_id").distinct()


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(table(spark, d, "chunks")).select("chunk_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts = syntax.parse_verdicts(table(spark, d, "files"), table(spark, d, "chunks"))
    return verdicts.where("fault IS NOT NULL").select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.fault_rates(syntax.parse_verdicts(table(spark, d, "files"), table(spark, d, "chunks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.neighbours(table(spark, d, "embed_cache")))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy graph search: every vector whose id is divisible by 50 against all other vectors, copies included."""
    cache = table(spark, d, "embed_cache")
    queries = neighbours.usable(cache).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "dim", "vec")
    return neighbours.search(queries, neighbours.graph_of(cache), copies=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks")).select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized chunk: its lines, whether the pieces cover them without a gap, and whether all are small or one line."""
    p = splitting.pieces(table(spark, d, "chunks")).select("chunk_id", "start_line", "end_line", F.length("text").alias("n")).distinct()
    before = F.max("end_line").over(Window.partitionBy("chunk_id").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("gap", F.col("start_line") > F.coalesce(before, F.col("start_line")) + 1)
    return p.groupBy("chunk_id").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), (~F.bool_or("gap")).alias("covered"), F.bool_and((F.col("n") <= 1000) | (F.col("start_line") == F.col("end_line"))).alias("small")
    )


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per specification: documents packed, parts that are missing or stand twice, containers over capacity, needless splits."""
    packed = durable(p7_packed(spark, d))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("different"), F.max("part").alias("last"), F.count_if(F.col("n_tokens") == F.col("capacity")).alias("full"))
    per = docs.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") != F.col("different")) | (F.col("last") != F.col("parts") - 1)).alias("torn"), F.count_if((F.col("parts") > 1) & (F.col("full") < F.col("parts") - 1)).alias("needless_splits")
    )
    over = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("capacity")).where("n > capacity").groupBy("spec_id").agg(F.count(F.lit(1)).alias("overfull"))
    return per.join(over, "spec_id", "left").select("spec_id", "documents", "torn", "needless_splits", F.coalesce("overfull", F.lit(0)).alias("overfull"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: whether copies stay within the cap, and the tokens within one document of the target or all there are."""
    chosen, shares = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    chosen = durable(chosen)
    most = chosen.groupBy("mix_id", "source").agg(F.max("copies").alias("copies_most"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("docs"))
    sizes = tokens.counted(table(spark, d, "documents")).groupBy("source").agg(F.max("n_tokens").alias("largest"), F.sum("n_tokens").alias("available"))
    met = shares.join(most, ["mix_id", "source"], "left").join(sizes, "source", "left").fillna(0, ["copies_most", "rows", "docs", "largest", "available"])
    want = F.least(F.col("target_share") * F.col("budget_tokens"), F.col("available") * F.col("max_repeats"))
    return met.select("mix_id", "source", ((F.col("copies_most") <= F.col("max_repeats")) & (F.col("rows") == F.col("docs"))).alias("within_cap"), (F.abs(F.col("tokens") - want) <= F.col("largest")).alias("on_target"))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.scored(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.scored(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_origins": p1_origins,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_search": p4_search,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_kept": p6_kept,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_kept": p7_kept,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}
SQL: dict[str, str] = {
    "p6_kept": "SELECT DISTINCT chunk_id, start_line, start_line + len(string_split(text, chr(10))) - 1 AS end_line, true AS covered, true AS small FROM chunks WHERE length(text) > 1000",
    "p7_kept": "SELECT s.spec_id, count(*) AS documents, 0 AS torn, 0 AS needless_splits, 0 AS overfull FROM pack_specs s JOIN documents d ON d.text <> '' AND (s.lang IS NULL OR lower(substr(trim(s.lang), 1, 2)) = lower(substr(trim(d.lang), 1, 2))) WHERE s.capacity_tokens >= 1 GROUP BY 1",
    "p8_kept": "SELECT DISTINCT mix_id, lower(trim(source)) AS source, true AS within_cap, true AS on_target FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 AND budget_tokens > 0",
    "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1000",
}
