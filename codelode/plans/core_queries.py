"""Registered queries of the core with the DuckDB statements they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import durable, table
from ..functions import paths as P
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import embed as B
from ..operators import evaluate as V
from ..operators import extract as E
from ..operators import graph as G
from ..operators import lexical
from ..operators import lookup as L
from ..operators import maintain as M
from ..operators import resolve as R
from ..operators import retrieve
from ..operators import search as X
from ..operators import shaping as H
from ..operators import snapshots
from ..streaming import debounce
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with its oracle statement if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""
WITH f AS (SELECT snap_no, project, regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS path,
                  regexp_replace(lower(trim(content_hash)), '^sha-?256[:=]', '') AS h, delivered_at
           FROM file_snaps WHERE snap_no IS NOT NULL AND project IS NOT NULL AND path IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snap_no, project, path ORDER BY delivered_at DESC, h DESC NULLS LAST) AS rn FROM f) WHERE rn = 1),
e AS (SELECT snap_no, project, path, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY snap_no), '') AS h FROM l),
s AS (SELECT DISTINCT snap_no FROM e),
fc AS (SELECT coalesce(b.snap_no, a.snap_no + 1) AS snap_no, coalesce(b.project, a.project) AS project, coalesce(b.path, a.path) AS path,
              CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM e a FULL JOIN e b ON a.project = b.project AND a.path = b.path AND b.snap_no = a.snap_no + 1
       WHERE a.h IS DISTINCT FROM b.h AND (b.snap_no IS NULL OR b.snap_no - 1 IN (SELECT snap_no FROM s)) AND (a.snap_no IS NULL OR a.snap_no + 1 IN (SELECT snap_no FROM s))),
c AS (SELECT DISTINCT snap_no, project, regexp_replace(regexp_replace(replace(trim(file), '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS path,
             regexp_replace(lower(trim(chunk_hash)), '^sha-?256[:=]', '') AS h
      FROM chunk_snaps WHERE snap_no IS NOT NULL AND project IS NOT NULL AND file IS NOT NULL AND chunk_hash IS NOT NULL),
cs AS (SELECT DISTINCT snap_no FROM c),
cc AS (SELECT coalesce(b.snap_no, a.snap_no + 1) AS snap_no, coalesce(b.project, a.project) AS project, coalesce(b.path, a.path) AS path,
              coalesce(b.h, a.h) AS h, CASE WHEN a.h IS NULL THEN 'added' ELSE 'removed' END AS change
       FROM c a FULL JOIN c b ON a.project = b.project AND a.path = b.path AND a.h = b.h AND b.snap_no = a.snap_no + 1
       WHERE (a.h IS NULL OR b.h IS NULL) AND (b.snap_no IS NULL OR b.snap_no - 1 IN (SELECT snap_no FROM cs)) AND (a.snap_no IS NULL OR a.snap_no + 1 IN (SELECT snap_no FROM cs)))
SELECT CAST(snap_no AS INTEGER) AS snap_no, 'file' AS grain, project, path, '' AS chunk_hash, change FROM fc
UNION ALL SELECT CAST(snap_no AS INTEGER), 'chunk', project, path, h, change FROM cc
"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_snaps"), table(spark, d, "chunk_snaps"))


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """Current files without repeated rows."""
    w = Window.partitionBy("project", "path").orderBy("file_id")
    return table(spark, d, "files").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without repeated rows, found by a narrow aggregate so that texts are shuffled once at most."""
    return table(spark, d, "chunks").dropDuplicates(["project", "file", "chunk_index"])


# -- sources and scans ---------------------------------------------------------------------------------------------


@query(f"WITH {S.FILES} SELECT project, path, {S.class_weight('path')} AS weight, {S.file_class('path')} AS file_class FROM f")
def f15_file_class(spark: SparkSession, d: str) -> DataFrame:  # noqa: D103
    return files_of(spark, d).select("project", "path", P.class_weight(F.col("path")).alias("weight"), P.file_class(F.col("path")).alias("file_class"))


@query(f"WITH {S.FILES} SELECT project, path FROM f WHERE {S.glob_any('path', P.IGNORED_NAMES)} OR {S.dirs('path', P.SKIP_DIRS)}")
def s2_s4_ignored(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).where(P.is_ignored(F.col("path")) | P.is_skipped(F.col("path"))).select("project", "path")


@query("SELECT vec_id, key, last_used, regexp_matches(hex(vec), '^(?:..)*?00') AS binary_content FROM embed_cache")
def s5_binary_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embed_cache").select("vec_id", "key", "last_used", T.is_binary(F.col("vec")).alias("binary_content"))


@query("SELECT doc_id, true AS utf8 FROM documents WHERE text IS NOT NULL")
def s6_utf8_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.is_utf8_sample(F.encode("text", "UTF-8")).alias("utf8"))


@query(f"WITH {S.FILES} SELECT project, path, size > 8192 AS oversized FROM f WHERE size IS NOT NULL")
def s7_size_cap(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).where("size IS NOT NULL").select("project", "path", (F.col("size") > 8192).alias("oversized"))


@query(
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snap_no, project, path ORDER BY delivered_at DESC, coalesce(content_hash, '') DESC, coalesce(size, 0) DESC, coalesce(mtime_ns, 0) DESC) AS rn FROM file_snaps) WHERE rn = 1)
SELECT b.project, b.path, coalesce(a.size = b.size AND a.mtime_ns = b.mtime_ns, false) AS reused FROM (SELECT * FROM l WHERE snap_no = 3) b LEFT JOIN (SELECT * FROM l WHERE snap_no = 2) a ON a.project = b.project AND a.path = b.path"""
)
def s8_stat_fast_path(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("delivered_at"), F.coalesce("content_hash", F.lit("")).desc(), F.coalesce("size", F.lit(0)).desc(), F.coalesce("mtime_ns", F.lit(0)).desc()]
    last = table(spark, d, "file_snaps").withColumn("rn", F.row_number().over(Window.partitionBy("snap_no", "project", "path").orderBy(*order))).where("rn = 1")
    return M.stat_reuse(last.where("snap_no = 2"), last.where("snap_no = 3")).select("project", "path", "reused")


@query(f"WITH {S.FILES} SELECT project, path, starts_with(path, 'src/core/') AS priority FROM f WHERE regexp_matches(path, '^(src|lib)/')")
def s9_scope_and_priority(spark: SparkSession, d: str) -> DataFrame:
    scoped = files_of(spark, d).where(F.col("path").rlike("^(src|lib)/"))
    return scoped.select("project", "path", F.col("path").startswith("src/core/").alias("priority")).orderBy(F.desc("priority"), "project", "path")


_REASON = f"CASE WHEN {S.dirs('path', P.SKIP_DIRS)} THEN 'ignored-directory' WHEN {S.glob_any('path', P.IGNORED_NAMES)} THEN 'ignored' WHEN {S.glob_any('path', P.SENSITIVE_NAMES)} THEN 'sensitive' WHEN status <> 'ok' THEN 'unreadable' WHEN size > 8192 THEN 'oversized' ELSE 'indexed' END"


@query(f"WITH {S.FILES} SELECT project, {_REASON} AS reason, count(*) AS files, list_slice(list_sort(list(path)), 1, 50) AS examples FROM f GROUP BY ALL")
def s11_scan_accounting(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    reason = F.when(P.is_skipped(path), "ignored-directory").when(P.is_ignored(path), "ignored").when(P.is_sensitive_name(path), "sensitive").when(F.col("status") != "ok", "unreadable").when(F.col("size") > 8192, "oversized").otherwise("indexed")
    rows = files_of(spark, d).select("project", "path", reason.alias("reason"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("project", "reason").orderBy("path")))
    return ranked.groupBy("project", "reason").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list(F.when(F.col("rn") <= 50, F.col("path")))).alias("examples"))


@query(f"WITH {S.FILES} SELECT project, path FROM f WHERE {S.glob_any('path', P.SENSITIVE_NAMES)}")
def s12_sensitive_names(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).where(P.is_sensitive_name(F.col("path"))).select("project", "path")


@query("SELECT DISTINCT project, file FROM chunks WHERE regexp_matches(substr(text, 1, 262144), '" + "|".join(f"(?:{p})" for p in P.SENSITIVE_CONTENT) + "')")
def s13_sensitive_contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(P.is_sensitive_text(F.col("text"))).select("project", "file").distinct()


@query("SELECT chunk_id, project, file, chunk_index, start_line, end_line, chunk_hash FROM chunks")
def s14_chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "project", "file", "chunk_index", "start_line", "end_line", "chunk_hash")


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def s15_vector_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"))


@query("SELECT path || '/src/module.py' AS path, arg_max(slug, length(path)) AS slug FROM projects GROUP BY path")
def s20_resolve_project(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "projects")
    return M.resolve_paths(projects.select(F.concat("path", F.lit("/src/module.py")).alias("path")), projects)


# -- write operators -----------------------------------------------------------------------------------------------


_PATH = "regexp_replace(regexp_replace(replace(trim({0}), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
_HASH = "regexp_replace(lower(trim({0})), '^sha-?256[:=]', '')"
_SNAPS = f"""fs AS (SELECT snap_no, project, {_PATH.format('path')} AS path, {_HASH.format('content_hash')} AS content_hash, status, size FROM (SELECT *, row_number() OVER (PARTITION BY snap_no, project, {_PATH.format('path')} ORDER BY delivered_at DESC, coalesce(content_hash, '') DESC, coalesce(size, 0) DESC) AS rn FROM file_snaps) WHERE rn = 1),
cs AS (SELECT DISTINCT snap_no, project, {_PATH.format('file')} AS file, chunk_index, {_HASH.format('chunk_hash')} AS chunk_hash FROM chunk_snaps)"""


def file_snapshot(spark: SparkSession, d: str, n: int) -> DataFrame:
    """One row per file of a snapshot, paths and digests in one spelling."""
    rows = table(spark, d, "file_snaps").where(F.col("snap_no") == n).withColumn("raw", F.coalesce("content_hash", F.lit("")))
    rows = rows.withColumns({"path": snapshots.canonical_path(F.col("path")), "content_hash": snapshots.canonical_digest(F.col("content_hash"))})
    w = Window.partitionBy("project", "path").orderBy(F.desc("delivered_at"), F.desc("raw"), F.coalesce("size", F.lit(0)).desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("project", "path", "content_hash", "status", "size")


def chunk_snapshot(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "chunk_snaps").where(F.col("snap_no") == n)
    return rows.select("project", snapshots.canonical_path(F.col("file")).alias("file"), "chunk_index", snapshots.canonical_digest(F.col("chunk_hash")).alias("chunk_hash")).distinct()


@query(f"WITH {_SNAPS}, n AS (SELECT * FROM fs WHERE snap_no = 3 AND status = 'ok') SELECT project, path, content_hash FROM n UNION ALL SELECT o.project, o.path, o.content_hash FROM fs o WHERE snap_no = 2 AND NOT EXISTS (SELECT 1 FROM n WHERE n.project = o.project AND n.path = o.path)")
def w1_upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """The second snapshot's files with the third's put over them."""
    return M.upsert(file_snapshot(spark, d, 2), file_snapshot(spark, d, 3).where("status = 'ok'"), ["project", "path"]).select("project", "path", "content_hash")


_GONE = "g AS (SELECT a.project, a.path FROM fs a WHERE snap_no = 2 AND NOT EXISTS (SELECT 1 FROM fs b WHERE b.snap_no = 3 AND b.project = a.project AND b.path = a.path))"


@query(f"WITH {_SNAPS}, {_GONE} SELECT project, file, chunk_index, chunk_hash FROM cs WHERE snap_no = 2 AND NOT EXISTS (SELECT 1 FROM g WHERE g.project = cs.project AND g.path = cs.file)")
def w2_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the second snapshot without those of files that the third no longer has."""
    gone = file_snapshot(spark, d, 2).join(file_snapshot(spark, d, 3).select("project", "path"), ["project", "path"], "left_anti")
    return M.delete_cascade(chunk_snapshot(spark, d, 2), gone)


_MODIFIED = "m AS (SELECT a.project, a.path AS file FROM fs a JOIN fs b ON a.project = b.project AND a.path = b.path WHERE a.snap_no = 2 AND b.snap_no = 3 AND a.content_hash <> b.content_hash)"


@query(f"WITH {_SNAPS}, {_MODIFIED} SELECT project, file, chunk_index, chunk_hash FROM cs WHERE snap_no = 2 AND (project, file) NOT IN (SELECT (project, file) FROM m) UNION ALL SELECT project, file, chunk_index, chunk_hash FROM cs WHERE snap_no = 3 AND (project, file) IN (SELECT (project, file) FROM m)")
def w3_replace_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the second snapshot, those of modified files replaced by the third's."""
    was, now = file_snapshot(spark, d, 2), file_snapshot(spark, d, 3)
    modified = was.join(now.select("project", "path", F.col("content_hash").alias("now")), ["project", "path"]).where("content_hash != now").select("project", F.col("path").alias("file"))
    return M.replace_by_file(chunk_snapshot(spark, d, 2), chunk_snapshot(spark, d, 3).join(modified, ["project", "file"], "left_semi"), modified)


@query(
    f"""WITH {_SNAPS}, p AS (SELECT snap_no, project || '|' || file || '|' || chunk_index AS id, max(chunk_hash) AS chunk_hash, file AS symbol FROM cs GROUP BY snap_no, project, file, chunk_index), st AS (SELECT * FROM p WHERE snap_no = 2), wa AS (SELECT * FROM p WHERE snap_no = 3),
same AS (SELECT st.id, st.id AS donor FROM st JOIN wa ON st.id = wa.id AND st.chunk_hash = wa.chunk_hash AND st.symbol IS NOT DISTINCT FROM wa.symbol),
s AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash, symbol ORDER BY id) AS k FROM st WHERE id NOT IN (SELECT id FROM same)), w AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash, symbol ORDER BY id) AS k FROM wa WHERE id NOT IN (SELECT id FROM same))
SELECT id, donor FROM same UNION ALL SELECT w.id, s.id AS donor FROM w LEFT JOIN s ON w.chunk_hash = s.chunk_hash AND w.symbol IS NOT DISTINCT FROM s.symbol AND w.k = s.k"""
)
def w6_j13_reuse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the second snapshot's chunks for the third's."""
    point = lambda n: chunk_snapshot(spark, d, n).groupBy("project", "file", "chunk_index").agg(F.max("chunk_hash").alias("chunk_hash")).select(F.concat_ws("|", "project", "file", "chunk_index").alias("id"), "chunk_hash", F.col("file").alias("symbol"))
    return M.reuse_vectors(point(2), point(3))


@query("SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def w7_last_errors(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("event_id", "event_type", "ts")


@query("WITH n AS (SELECT count(*) // 4 + 1 AS gone FROM embed_cache), o AS (SELECT *, row_number() OVER (ORDER BY last_used, key, vec_id) AS rn FROM embed_cache) SELECT vec_id, key, last_used FROM o, n WHERE rn > gone")
def w9_evict_cache(spark: SparkSession, d: str) -> DataFrame:
    return M.evict(table(spark, d, "embed_cache"), 100).select("vec_id", "key", "last_used")


@query(
    f"""WITH {_SNAPS}, k AS (SELECT project, path FROM fs WHERE snap_no = 1), a AS (SELECT 'chunks' AS "table", project, file FROM chunks UNION ALL SELECT 'refs', project, file FROM refs UNION ALL SELECT 'symbols', project, file FROM symbols)
SELECT "table", project, file, count(*) AS rows FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.project = a.project AND k.path = a.file) GROUP BY ALL"""
)
def w10_j4_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows of today's tables whose file the first snapshot did not have."""
    children = {n: table(spark, d, n).select("project", "file") for n in ("chunks", "refs", "symbols")}
    return M.orphans(children, file_snapshot(spark, d, 1))


@query("SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) / count(*), 6) AS low_share FROM events GROUP BY 1")
def w11_usage_report(spark: SparkSession, d: str) -> DataFrame:
    low = F.sum(F.when(F.col("value") < 10, 1).otherwise(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(low / F.count(F.lit(1)), 6).alias("low_share"))


# -- extraction ----------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\r\n|\n|\r')) - CASE WHEN regexp_matches(text, '(\r\n|\n|\r)$') THEN 1 ELSE 0 END END AS INTEGER) AS n_lines FROM documents WHERE text IS NOT NULL")
def x1_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"))


def x2_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return E.window_chunks(table(spark, d, "documents"), "doc_id")


QUERIES["x2_window_chunks"] = x2_window_chunks


@query(
    r"""WITH c AS (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY 1), n AS (SELECT chunk_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS t FROM (SELECT chunk_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM c)),
g AS (SELECT chunk_id, i, coalesce(nullif(regexp_extract(t, '^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(t, '^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(t, '^\s*(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_$]*)', 1), ''),
  nullif(regexp_extract(t, '^\s*(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(t, '^[\w<>\[\],\s]+\s([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), '')) AS guess FROM n)
SELECT chunk_id, arg_min(guess, i) AS guess FROM g WHERE guess IS NOT NULL GROUP BY 1"""
)
def x3_symbol_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", E.first_symbol(F.col("text")).alias("guess")).where("guess IS NOT NULL")


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, text, chunk_hash FROM chunks) SELECT chunk_id, 'sha256:' || sha256(text) AS hash, 'sha256:' || sha256(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))) AS decl_hash FROM c""")
def x4_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes are made where the chunks lie, and only they are shuffled."""
    c = table(spark, d, "chunks")
    return c.select("chunk_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"), T.declaration_hash(F.lit(None).cast("string"), F.split("text", "\n")[0]).alias("decl_hash")).distinct()


@query("SELECT id, project, file, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY project, file, qualified_name, symbol_type, decl_hash ORDER BY start_line, end_line, id) AS rn FROM symbols WHERE source = 'ast') WHERE rn = 1")
def x9_symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return E.symbol_table(table(spark, d, "symbols")).select("id", "project", "file", "qualified_name")


@query(
    r"""WITH n AS (SELECT project, file, start_line + i - 1 AS line, trim(replace(ls[i], chr(9), ' ')) AS t FROM (SELECT project, file, start_line, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT DISTINCT project, file, start_line, string_split(text, chr(10)) AS ls FROM chunks WHERE file NOT LIKE '%.py'))),
code AS (SELECT * FROM n WHERE t <> '' AND NOT (starts_with(t, '#') AND NOT starts_with(t, '#include') OR starts_with(t, '//') OR starts_with(t, '*') OR starts_with(t, '--'))),
m AS (SELECT *, CASE WHEN regexp_matches(t, '^export\b') AND NOT regexp_matches(t, '^export\b.*\bfrom\s*["'']') OR regexp_matches(t, '^from\b') AND NOT regexp_matches(t, '^from\s+[\w.]+\s+import\b') OR regexp_matches(t, '^using\b') AND NOT contains(t, ';') THEN NULL
  ELSE coalesce(nullif(regexp_extract(t, '^(?:import|export|require|#include)\b.*[\"''<]([^\"''<>]+)[\"''>]', 1), ''), nullif(regexp_extract(t, '^(?:from|import|use|using)\s+([A-Za-z_.][\w.:]*)', 1), '')) END AS target FROM code),
w AS (SELECT project, file, line, unnest(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]{2,}\(?')) AS w FROM m WHERE target IS NULL),
r AS (SELECT project, file, line, target AS to_name, 'includes' AS relationship FROM m WHERE target IS NOT NULL UNION SELECT project, file, line, rtrim(w, '('), CASE WHEN ends_with(w, '(') THEN 'call' ELSE 'identifier' END FROM w)
SELECT project, file, relationship, count(*) AS refs FROM r GROUP BY ALL"""
)
def x12_x13_textual_references(spark: SparkSession, d: str) -> DataFrame:
    """Counts of textual references per file, over every chunk of a language without a parser here: all but Python."""
    rows = E.textual_references(table(spark, d, "chunks").where("file NOT LIKE '%.py'"))
    return rows.groupBy("project", "file", "relationship").agg(F.count(F.lit(1)).alias("refs"))


def x14_resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import lines and the paths of Go import groups with the files they mean."""
    chunks = table(spark, d, "chunks")
    imports = E.imports_of(chunks).unionByName(E.grouped_imports(chunks)).distinct()
    return E.resolve_imports(imports, files_of(spark, d), E.go_modules(chunks))


QUERIES["x14_resolved_imports"] = x14_resolved_imports


@query(
    f"WITH {S.FILES} SELECT project, path, CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " WHEN '' THEN 'text' ELSE lower(regexp_extract(path, '\\.([^.]*)$', 1)) END AS by_extension, language FROM f"
)
def x16_languages(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).select("project", "path", P.language(F.col("path")).alias("by_extension"), "language")


@query(f"WITH {S.FILES} SELECT language, count(*) AS files, CASE WHEN language IN ('python','javascript','typescript','go','c','cpp','csharp','rust') THEN 'ast' WHEN language IN ('json','yaml','toml','ini','markdown') THEN 'none' ELSE 'heuristic' END AS reader FROM f GROUP BY ALL")
def x15_x17_reader_policy(spark: SparkSession, d: str) -> DataFrame:
    reader = F.when(F.col("language").isin("python", "javascript", "typescript", "go", "c", "cpp", "csharp", "rust"), "ast").when(F.col("language").isin("json", "yaml", "toml", "ini", "markdown"), "none").otherwise("heuristic")
    return files_of(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files")).select("language", "files", reader.alias("reader"))


@query("WITH c AS (SELECT DISTINCT chunk_id, file, symbol, text FROM chunks) SELECT chunk_id, sha256(file || chr(10) || CASE WHEN coalesce(symbol, '') <> '' THEN 'symbol: ' || symbol || chr(10) ELSE '' END || text) AS digest FROM c")
def x18_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(T.embedding_text(F.col("file"), F.col("symbol"), F.col("text")), 256).alias("digest")
    return table(spark, d, "chunks").select("chunk_id", digest).distinct()


@query(f"WITH {S.CHUNKS} SELECT project, file, count(*) AS chunks, CAST((count(*) + 511) // 512 AS BIGINT) AS groups FROM c GROUP BY ALL")
def x20_embed_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("project", "file", "chunk_index").distinct()
    return c.groupBy("project", "file").agg(F.count(F.lit(1)).alias("chunks")).withColumn("groups", F.floor((F.col("chunks") + 511) / 512))


@query(
    r"""WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(name, '[A-Za-z0-9_]+')) AS t FROM symbols), p AS (SELECT id, t, unnest(list_filter(string_split(t, '_'), lambda x: x <> '')) AS p FROM w),
s AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' ') AS parts FROM p),
k AS (SELECT id, t AS token FROM w UNION SELECT id, unnest(CASE WHEN len(parts) > 1 THEN list_transform(parts, lambda x: lower(x)) WHEN p <> t THEN [p] ELSE [] END) FROM s)
SELECT id, token FROM k"""
)
def x21_index_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select("id", F.explode(T.index_tokens(F.col("name"))).alias("token"))


# -- predicates, lookups, order ------------------------------------------------------------------------------------


_ORDER = f"{S.class_weight('file')}, CASE WHEN symbol_type IS NULL THEN 1 ELSE 0 END, CASE WHEN source <> 'ast' THEN 1 ELSE 0 END, name NULLS FIRST, project, file, start_line, qualified_name, decl_hash, id"


def _found(where: str, limit: int) -> str:
    return f"WITH m AS (SELECT * FROM symbols WHERE {where}) SELECT id, name, file, (SELECT count(*) FROM m) AS match_count FROM m ORDER BY {_ORDER} LIMIT {limit}"


def _symbols(spark: SparkSession, d: str, f: L.SymbolFilter, limit: int) -> DataFrame:
    return L.find_symbols(table(spark, d, "symbols"), table(spark, d, "refs"), f, limit).select("id", "name", "file", "match_count")


@query(_found(f"{S.FOLD.format('name')} = 'accept_anchor'", 50))
def o1_exact_name(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d, L.SymbolFilter(name="ACCEPT_anchor"), 50)


@query(_found(f"{S.FOLD.format('name')} LIKE '%to_en%'", 60))
def lookup_substring(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d, L.SymbolFilter(name="to_en", match="substring"), 60)


@query(_found("name GLOB 'fold*[a-h]?*'", 60))
def lookup_glob(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d, L.SymbolFilter(name="fold*[a-h]?*", match="glob"), 60)


@query(_found(f"symbol_type = 'method' AND coalesce(visibility, 'public') = 'public' AND {S.FOLD.format('language')} = 'python' AND starts_with(file, 'src/')", 80))
def lookup_filters(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d, L.SymbolFilter(kind="method", visibility="public", language="Python", prefix="src/"), 80)


@query("SELECT id, name FROM symbols s WHERE EXISTS (SELECT 1 FROM refs r WHERE r.project = s.project AND r.file = s.file AND r.from_symbol = s.name AND r.relationship = 'call' AND lower(r.to_name) = 'accept_anchor')")
def lookup_has_call(spark: SparkSession, d: str) -> DataFrame:
    return L.filtered(table(spark, d, "symbols"), table(spark, d, "refs"), L.SymbolFilter(has_call="accept_anchor")).select("id", "name")


@query("SELECT id, name FROM symbols s WHERE EXISTS (SELECT 1 FROM refs r WHERE r.project = s.project AND r.file = s.file AND r.from_symbol = s.name AND r.relationship = 'base_class')")
def j5_inherits(spark: SparkSession, d: str) -> DataFrame:
    bases = table(spark, d, "refs").where("relationship = 'base_class' AND from_symbol IS NOT NULL").select("project", "file", F.col("from_symbol").alias("name"))
    return table(spark, d, "symbols").join(bases, ["project", "file", "name"], "left_semi").select("id", "name")


@query(f"WITH t AS (SELECT *, CASE WHEN {S.FOLD.format('name')} = 'token' THEN 0 ELSE 1 END AS tier FROM symbols WHERE {S.FOLD.format('name')} LIKE '%token%') SELECT id, name FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY {_ORDER} LIMIT 25")
def lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    return L.find_symbols_tiered(table(spark, d, "symbols"), table(spark, d, "refs"), "token").select("id", "name")


@query(
    f"""WITH m AS (SELECT * FROM refs WHERE to_name = 'accept_anchor' AND relationship = 'call')
SELECT project, file, line, from_symbol, (SELECT count(*) FROM m) AS match_count FROM m ORDER BY {S.class_weight('file')}, CASE WHEN from_symbol IS NULL THEN 1 ELSE 0 END, CASE WHEN confidence <> 'ast' THEN 1 ELSE 0 END, project, file, line, relationship, from_symbol NULLS FIRST, receiver NULLS FIRST, to_name LIMIT 100"""
)
def o2_find_references(spark: SparkSession, d: str) -> DataFrame:
    return L.find_references(table(spark, d, "refs"), "accept_anchor", "calls", 100).select("project", "file", "line", "from_symbol", "match_count")


@query(f"WITH {S.FILES} SELECT s.id, s.source, f.parse_verdict, CASE WHEN s.source = 'ast' AND f.parse_verdict = 'parsed' THEN 'ast' ELSE 'unknown' END AS evidence FROM symbols s LEFT JOIN f ON f.project = s.project AND f.path = s.file")
def f13_j1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return L.evidence(table(spark, d, "symbols"), files_of(spark, d)).select("id", "source", "parse_verdict", "evidence")


@query("SELECT id, name, count(*) OVER (PARTITION BY project, name) AS candidates, count(*) OVER (PARTITION BY project, name) > 1 AS ambiguous FROM symbols WHERE name IS NOT NULL")
def f14_candidates(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "symbols").where("name IS NOT NULL").groupBy("project", "name").agg(F.count(F.lit(1)).alias("candidates"))
    return table(spark, d, "symbols").join(per, ["project", "name"]).select("id", "name", "candidates", (F.col("candidates") > 1).alias("ambiguous"))


@query(f"WITH {S.FILES} SELECT project, path, coalesce(language IN ('json', 'yaml', 'toml'), false) OR {S.ends('lower(path)', P.DATA_EXTENSIONS)} AS data FROM f")
def f16_data_payload(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).select("project", "path", P.is_data(F.col("path"), F.col("language")).alias("data"))


@query("WITH c AS (SELECT DISTINCT chunk_id, file, symbol, text FROM chunks) SELECT DISTINCT chunk_id, coalesce(nullif(trim(symbol), ''), nullif(substr(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 1, 80), ''), file, 'file') AS label FROM c")
def f18_hit_label(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    first = F.left(F.trim(F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))), F.lit(80))
    return c.select("chunk_id", F.coalesce(F.nullif(F.trim("symbol"), F.lit("")), F.nullif(first, F.lit("")), F.col("file"), F.lit("file")).alias("label")).distinct()


@query(f"WITH {S.FILES}, s AS (SELECT symbols.* FROM symbols JOIN f ON f.project = symbols.project AND f.path = symbols.file) SELECT id, file, n, total FROM (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY start_line, qualified_name, id) AS n, count(*) OVER (PARTITION BY project, file) AS total FROM s) WHERE n <= 3")
def o7_q8_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return L.skeleton(table(spark, d, "symbols"), files_of(spark, d), 3).select("id", "file", "n", "total")


@query(
    f"""WITH {S.CHUNKS}, w AS (SELECT DISTINCT project, file, line AS start_line, line AS end_line FROM refs WHERE relationship = 'base_class'),
i AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY project, file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY project, file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM i),
r AS (SELECT project, file, island, greatest(min(start_line) - 2, 1) AS a, max(end_line) + 2 AS b FROM g GROUP BY ALL)
SELECT DISTINCT r.project, r.file, r.a AS from_line, r.b AS to_line, c.chunk_id FROM r JOIN c ON c.project = r.project AND c.file = r.file AND c.start_line <= r.b AND c.end_line >= r.a"""
)
def q7_code_context(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("project", "file", "chunk_index").orderBy("chunk_id")
    c = table(spark, d, "chunks").select("project", "file", "chunk_index", "chunk_id", "start_line", "end_line").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    wanted = table(spark, d, "refs").where("relationship = 'base_class'").select("project", "file", F.col("line").alias("start_line"), F.col("line").alias("end_line")).distinct()
    return L.code_context(c, wanted, 2).select("project", "file", "from_line", "to_line", "chunk_id").distinct()


# -- resolution and joins ------------------------------------------------------------------------------------------


@query(f"WITH {S.RESOLVED} SELECT project, file, line, to_name, relationship, target_id, how FROM r")
def g1_j6_resolved(spark: SparkSession, d: str) -> DataFrame:
    return R.resolved(table(spark, d, "refs"), table(spark, d, "symbols")).select("project", "file", "line", "to_name", "relationship", "target_id", "how")


@query("SELECT r.project, r.file, r.line, s.file AS target_file, s.name FROM refs r JOIN symbols s ON r.target_symbol_id = s.id WHERE r.file <> s.file")
def j2_attributed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select(F.col("id").alias("target_symbol_id"), F.col("file").alias("target_file"), "name")
    return table(spark, d, "refs").where("target_symbol_id IS NOT NULL").join(s, "target_symbol_id").where("file != target_file").select("project", "file", "line", "target_file", "name")


@query(
    f"""WITH {S.RESOLVED}, {S.FILES}, nm AS (SELECT project, name, count(*) AS defs FROM symbols WHERE name IS NOT NULL GROUP BY ALL), sp AS (SELECT DISTINCT language FROM symbols WHERE language IS NOT NULL),
o AS (SELECT r.*, nm.defs, sp.language AS spoken FROM r LEFT JOIN f ON f.project = r.project AND f.path = r.file LEFT JOIN nm ON nm.project = r.project AND nm.name = r.to_name LEFT JOIN sp ON sp.language = f.language WHERE how = 'none')
SELECT count(*) AS unattributed, count(*) FILTER (defs IS NULL) AS unresolved, count(*) FILTER (defs IS NULL AND spoken IS NOT NULL) AS missing_definition, count(*) FILTER (defs IS NULL AND spoken IS NULL) AS language_without_symbols, count(*) FILTER (defs IS NOT NULL) AS ambiguous FROM o"""
)
def a5_j3_unattributed(spark: SparkSession, d: str) -> DataFrame:
    return R.unattributed(table(spark, d, "refs"), table(spark, d, "symbols"), files_of(spark, d))


@query(f"WITH {S.RESOLVED} SELECT r.project, s.file, count(*) AS fan_in FROM r JOIN symbols s ON s.id = r.target_id WHERE r.file <> s.file GROUP BY ALL")
def a6_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return R.fan_in(table(spark, d, "refs"), table(spark, d, "symbols"))


_HUNKS = "SELECT DISTINCT c.project, c.file, c.start_line AS a, c.end_line AS b FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.snap_no = 2 AND cs.project = c.project AND cs.file = c.file AND cs.chunk_hash = c.chunk_hash)"


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    """Line ranges of today's chunks that the second snapshot's file did not hold."""
    now = table(spark, d, "chunks").select("project", "file", "chunk_hash", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line")).distinct()
    return now.join(chunk_snapshot(spark, d, 2).select("project", "file", "chunk_hash"), ["project", "file", "chunk_hash"], "left_anti").drop("chunk_hash").distinct()


@query(f"WITH {_SNAPS}, h AS ({_HUNKS}) SELECT DISTINCT s.id, s.qualified_name FROM symbols s JOIN h ON h.project = s.project AND h.file = s.file AND s.start_line <= h.b AND s.end_line >= h.a")
def j10_g8_changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.changed_symbols(table(spark, d, "symbols"), _hunks(spark, d)).select("id", "qualified_name")


@query(
    f"""WITH {_SNAPS}, h AS ({_HUNKS}), ch AS (SELECT DISTINCT s.project, s.name FROM symbols s JOIN h ON h.project = s.project AND h.file = s.file AND s.start_line <= h.b AND s.end_line >= h.a WHERE s.name IS NOT NULL),
st AS (SELECT *, row_number() OVER (PARTITION BY project, to_name ORDER BY file, line, relationship, from_symbol NULLS FIRST, receiver NULLS FIRST) AS n FROM refs WHERE relationship = 'call' AND (project, to_name) IN (SELECT (project, name) FROM ch)),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY to_name, n) AS k FROM st WHERE n <= 50)
SELECT project, file, count(*) AS sites, count(DISTINCT to_name) AS names FROM k WHERE k <= 200 GROUP BY ALL"""
)
def a17_g9_impact(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    changed = A.changed_symbols(symbols, _hunks(spark, d)).join(symbols.select("id", "name"), "id").where("name IS NOT NULL")
    return A.impact(changed, table(spark, d, "refs"))


@query(
    f"""WITH {S.FILES}, n AS (SELECT project, path, regexp_extract(path, '([^/]*)$', 1) AS b FROM f), w AS (SELECT project, path, regexp_extract(b, '^(.*?)\\.[^.]*$', 1) AS stem, regexp_extract(b, '(\\.[^.]*)$', 1) AS ext FROM n)
SELECT w.project, w.path, n.path AS test FROM w JOIN n ON n.project = w.project AND n.b IN ('test_' || stem || ext, stem || '_test' || ext, stem || '.test' || ext, stem || '.spec' || ext, stem || 'Tests' || ext)"""
)
def j14_candidate_tests(spark: SparkSession, d: str) -> DataFrame:
    f = files_of(spark, d)
    return A.candidate_tests(f, f)


@query(
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snap_no, project, path ORDER BY delivered_at DESC, coalesce(content_hash, '') DESC) AS rn FROM file_snaps) WHERE rn = 1)
SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN b.status <> 'ok' THEN 'unreadable' WHEN a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'modified' END AS kind
FROM (SELECT * FROM l WHERE snap_no = 1) a FULL JOIN (SELECT * FROM l WHERE snap_no = 2) b ON a.project = b.project AND a.path = b.path"""
)
def j12_q1_tree_changes(spark: SparkSession, d: str) -> DataFrame:
    return M.tree_changes(*_two_scans(spark, d))


def _two_scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("snap_no", "project", "path").orderBy(F.desc("delivered_at"), F.coalesce("content_hash", F.lit("")).desc())
    last = table(spark, d, "file_snaps").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return last.where("snap_no = 1"), last.where("snap_no = 2")


@query(
    f"WITH k AS ({SQL['j12_q1_tree_changes']}) SELECT project, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'unreadable') AS unreadable, count(*) FILTER (kind = 'unchanged') AS unchanged, CASE WHEN count(*) FILTER (kind IN ('added', 'deleted', 'modified')) > 0 THEN 'stale' WHEN count(*) FILTER (kind = 'unreadable') > 0 THEN 'unknown' ELSE 'fresh' END AS state FROM k GROUP BY 1"
)
def a18_q2_staleness(spark: SparkSession, d: str) -> DataFrame:
    return M.staleness(M.tree_changes(*_two_scans(spark, d))).drop("reasons")


# -- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT project, symbol_type, count(*) AS symbols FROM symbols WHERE coalesce(visibility, 'public') = 'public' GROUP BY ALL")
def a1_count_symbols(spark: SparkSession, d: str) -> DataFrame:
    return L.filtered(table(spark, d, "symbols"), table(spark, d, "refs"), L.SymbolFilter(visibility="public")).groupBy("project", "symbol_type").agg(F.count(F.lit(1)).alias("symbols"))


@query(f"WITH {S.FILES} SELECT project, " + ", ".join(f"count(*) FILTER (parse_verdict = '{v}') AS {v}" for v in A.VERDICTS) + ", count(*) FILTER (parse_verdict IS NULL) AS unknown FROM f GROUP BY 1")
def a2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return A.verdict_counts(files_of(spark, d))


@query("SELECT relationship, count(*) AS refs FROM refs GROUP BY 1")
def a3_relationships(spark: SparkSession, d: str) -> DataFrame:
    return A.relationship_counts(table(spark, d, "refs"))


@query(f"WITH {S.FILES}, s AS (SELECT DISTINCT project, file FROM symbols) SELECT s.project, count(*) AS files FROM s LEFT JOIN f ON f.project = s.project AND f.path = s.file WHERE f.parse_verdict IS DISTINCT FROM 'parsed' GROUP BY 1")
def a4_unparsed_with_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.symbols_without_parse(table(spark, d, "symbols"), files_of(spark, d))


@query(f"WITH {S.FILES}, l AS (SELECT project, coalesce(language, 'unknown') AS language, count(*) AS files, coalesce(sum(loc), 0) AS loc FROM f GROUP BY ALL) SELECT project, language, files, loc, round(CAST(100.0 AS DOUBLE) * files / sum(files) OVER (PARTITION BY project), 1) AS share FROM l")
def a7_languages(spark: SparkSession, d: str) -> DataFrame:
    return A.languages(files_of(spark, d))


_TOP = "CASE WHEN contains({0}, '/') THEN string_split({0}, '/')[1] ELSE '.' END"


@query(f"WITH {S.FILES}, a AS (SELECT project, {_TOP.format('path')} AS dir, count(*) AS files FROM f GROUP BY ALL), b AS (SELECT s.project, {_TOP.format('s.file')} AS dir, count(*) AS symbols FROM symbols s JOIN f ON f.project = s.project AND f.path = s.file GROUP BY ALL) SELECT a.project, a.dir, a.files, coalesce(b.symbols, 0) AS symbols FROM a LEFT JOIN b ON a.project = b.project AND a.dir = b.dir")
def a8_directories(spark: SparkSession, d: str) -> DataFrame:
    return A.directories(files_of(spark, d), table(spark, d, "symbols"))


@query(f"WITH {S.FILES} SELECT project, file, value, rank FROM (SELECT project, path AS file, size AS value, row_number() OVER (PARTITION BY project ORDER BY {S.class_weight('path')}, size DESC NULLS LAST, path) AS rank FROM f) WHERE rank <= 10")
def a9_o4_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return A.hotspots(files_of(spark, d).select("project", F.col("path").alias("file"), F.col("size").alias("value")), 10)


@query(
    f"""WITH {S.FILES}, n AS (SELECT project, file, count(*) AS n FROM symbols GROUP BY ALL), r AS (SELECT f.project, coalesce(nullif(regexp_extract(f.path, '^(.*)/[^/]*$', 1), ''), '.') AS dir, coalesce(f.language, 'unknown') AS language, coalesce(n.n, 0) AS n FROM f LEFT JOIN n ON n.project = f.project AND n.file = f.path),
l AS (SELECT project, dir, language, count(*) AS files, sum(n) AS symbols FROM r GROUP BY ALL)
SELECT project, dir, CAST(sum(files) AS BIGINT) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, string_agg(language || '=' || files, ',' ORDER BY language) AS languages, first(language ORDER BY files DESC, language) AS dominant FROM l GROUP BY 1, 2"""
)
def a10_directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return A.directory_tree(files_of(spark, d), table(spark, d, "symbols"))


@query(f"WITH {S.FILES}, m AS (SELECT DISTINCT project, file || ':' || name AS what FROM symbols WHERE name IN ('main', '__main__')) SELECT project, what FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY what) AS rn FROM m) WHERE rn <= 5 UNION ALL SELECT project, path FROM f WHERE path IN ('__main__.py', 'src/__main__.py')")
def a11_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return A.entry_points(files_of(spark, d), table(spark, d, "symbols"))


@query(
    f"""WITH {S.FILES}, a AS (SELECT project, count(*) AS files, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (parse_verdict = 'parsed') AS parsed, count(*) FILTER (loc IS NULL) AS without_loc FROM f GROUP BY 1),
s AS (SELECT project, count(DISTINCT file) AS n FROM symbols GROUP BY 1), c AS (SELECT project, count(DISTINCT file) AS n FROM chunks GROUP BY 1), r AS (SELECT project, count(DISTINCT file) AS n FROM refs GROUP BY 1)
SELECT a.*, coalesce(s.n, 0) AS with_symbols, coalesce(c.n, 0) AS with_chunks, coalesce(r.n, 0) AS with_refs, a.files = a.ok AND a.files = coalesce(c.n, 0) AS complete FROM a LEFT JOIN s USING (project) LEFT JOIN c USING (project) LEFT JOIN r USING (project)"""
)
def a12_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(files_of(spark, d), table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "refs"))


@query("SELECT DISTINCT name FROM symbols")
def a14_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select("name").distinct()


@query(f"WITH {S.FILES} SELECT project, {S.file_class('path')} AS file_class, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def q18_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.class_counts(files_of(spark, d))


# -- graph walks ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {S.RESOLVED}, e AS (SELECT DISTINCT r.project || chr(1) || r.file AS src, s.project || chr(1) || s.file AS dst FROM r JOIN symbols s ON s.id = r.target_id WHERE r.file <> s.file OR r.project <> s.project),
st AS (SELECT DISTINCT src AS node FROM e WHERE hash(1) = hash(1) AND src LIKE '%' || chr(1) || 'src/%'),
w AS (SELECT node, 0 AS level FROM st UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node WHERE w.level < 3)
SELECT node, min(level) AS level FROM w GROUP BY 1"""
)
def g3_g4_reach(spark: SparkSession, d: str) -> DataFrame:
    """Files within three calls of the files under src/."""
    symbols = table(spark, d, "symbols")
    edges = durable(G.call_edges(R.resolved(table(spark, d, "refs"), symbols), symbols))
    return G.reach(edges, edges.where(F.col("src").contains("\u0001src/")).select(F.col("src").alias("node")), 3)


def _callers_sql(cap: int) -> str:
    """Two levels of callers of the most called name, as a statement: each level's sites ranked, and what the cap refuses."""
    order = f"depth_at, {S.class_weight('file')}, CASE WHEN from_symbol IS NULL THEN 1 ELSE 0 END, CASE WHEN confidence <> 'ast' THEN 1 ELSE 0 END, project NULLS FIRST, file NULLS FIRST, line NULLS FIRST, relationship NULLS FIRST, from_symbol NULLS FIRST, receiver NULLS FIRST, to_name NULLS FIRST"
    site = "file, line, from_symbol, relationship"

    def level(n: int, before: str, frontier: str) -> str:
        seen = " UNION ALL ".join(f"SELECT {site} FROM e{k}" for k in range(n))
        return f"""s{n} AS (SELECT *, row_number() OVER (PARTITION BY {site} ORDER BY {order}) AS k FROM (SELECT refs.*, f.depth_at FROM refs JOIN t ON t.project = refs.project JOIN {frontier} f ON f.name = refs.to_name) r
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.file IS NOT DISTINCT FROM r.file AND x.line IS NOT DISTINCT FROM r.line AND x.from_symbol IS NOT DISTINCT FROM r.from_symbol AND x.relationship IS NOT DISTINCT FROM r.relationship)),
e{n} AS (SELECT {site}, to_name AS target, row_number() OVER (ORDER BY {order}) AS n FROM s{n} WHERE k = 1),
u{n} AS (SELECT {before}.used AS base, greatest({cap} - {before}.used, 0) AS room, (SELECT count(*) FROM e{n}) AS total, {before}.used + least(greatest({cap} - {before}.used, 0), (SELECT count(*) FROM e{n})) AS used FROM {before}),
w{n} AS (SELECT {n} AS level, CASE WHEN room > 0 THEN file END AS file, CASE WHEN room > 0 THEN line END AS line, CASE WHEN room > 0 THEN from_symbol END AS from_symbol, CASE WHEN room > 0 THEN relationship END AS relationship, CASE WHEN room > 0 THEN target END AS target,
  CASE WHEN room > 0 THEN base + n END AS position, greatest(total - room, 0) AS refused FROM e{n}, u{n} WHERE n <= greatest(room, 1)),
f{n + 1} AS (SELECT from_symbol AS name, min(position) AS depth_at FROM w{n} WHERE from_symbol IS NOT NULL GROUP BY 1)"""

    return f"""WITH t AS (SELECT project, to_name FROM refs WHERE relationship = 'call' GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1),
e0 AS (SELECT *, row_number() OVER (ORDER BY file, line) AS n FROM (SELECT DISTINCT s.file, s.start_line AS line, s.name AS from_symbol, 'definition' AS relationship, s.name AS target FROM symbols s JOIN t ON s.project = t.project AND s.name = t.to_name)),
u0 AS (SELECT least({cap}, (SELECT count(*) FROM e0)) AS used), w0 AS (SELECT 0 AS level, {site}, target, n AS position, greatest((SELECT count(*) FROM e0) - {cap}, 0) AS refused FROM e0 WHERE n <= {cap}), f1 AS (SELECT to_name AS name, 0 AS depth_at FROM t),
{level(1, 'u0', 'f1')},
{level(2, 'u1', 'f2')}
SELECT CAST(level AS INTEGER) AS level, file, line, from_symbol, relationship, target, CAST(position AS INTEGER) AS position, CAST(refused AS BIGINT) AS refused FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)"""


def _most_called(refs: DataFrame) -> tuple[str, str]:
    top = refs.where("relationship = 'call'").groupBy("project", "to_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project", "to_name").first()
    return top["project"], top["to_name"]


@query(_callers_sql(40))
def g2_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the most called name of the most called project, two levels."""
    refs = table(spark, d, "refs")
    return G.callers(refs, table(spark, d, "symbols"), *_most_called(refs))


@query(_callers_sql(5000))
def g2_o3_callers_wide(spark: SparkSession, d: str) -> DataFrame:
    """The same with room for five thousand nodes, so that sites of both levels are ranked and shown."""
    refs = table(spark, d, "refs")
    return G.callers(refs, table(spark, d, "symbols"), *_most_called(refs), cap=5000)


@query(
    f"""WITH d AS (SELECT project, name, count(*) AS definitions, count(DISTINCT file) AS files, list_sort(list(DISTINCT file || ':' || start_line || '-' || end_line)) AS labels FROM symbols WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT r.project, r.to_name, count(*) AS sites, d.definitions, d.files, coalesce(len(d.labels), 0) > 1 AS ambiguous, coalesce(array_to_string(d.labels, ' '), '') AS candidates FROM refs r LEFT JOIN d ON d.project = r.project AND d.name = r.to_name WHERE r.relationship = 'call' GROUP BY ALL"""
)
def g6_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Every called name with the labels of all its definitions; more than one makes its calls ambiguous."""
    return R.ambiguity(table(spark, d, "refs").where("relationship = 'call'"), table(spark, d, "symbols"))


# -- search --------------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM v, q)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def v1_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return X.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("project", "file", "chunk_index").orderBy("chunk_id")
    keep = table(spark, d, "chunks").select("chunk_id", "project", "file", "chunk_index").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("chunk_id").distinct()
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).join(keep, "chunk_id", "left_semi")
    return c.select("chunk_id", "project", "file", "start_line", "end_line", "symbol", "symbol_type", F.col("text").alias("content"), F.col("file").alias("path"))


#: Parts of ``p`` as the index makes them, in SQL.
_PARTS = r"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' ')"
_LEXICAL_QUERIES = [(1, "verify loader token catalog"), (2, "cached window"), (3, "Parse the eager manifest 7"), (4, "acceptanchor")]


@query(
    f"""WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(symbol) AS symbol, any_value(file) AS file FROM chunks GROUP BY 1),
l AS (SELECT chunk_id, CAST(1 AS DOUBLE) AS w, text AS v FROM c UNION ALL SELECT chunk_id, 8, coalesce(symbol, '') FROM c UNION ALL SELECT chunk_id, 4, file FROM c),
raw AS (SELECT DISTINCT chunk_id, w, unnest(regexp_extract_all(v, '[A-Za-z0-9_]+')) AS t FROM l), p AS (SELECT chunk_id, w, t, unnest(list_filter(string_split(t, '_'), lambda x: x <> '')) AS p FROM raw),
tok AS (SELECT chunk_id, w, t AS tok FROM raw UNION SELECT chunk_id, w, unnest(CASE WHEN len({_PARTS.format('p')}) > 1 THEN list_transform({_PARTS.format('p')}, lambda x: lower(x)) WHEN p <> t THEN [p] ELSE [] END) FROM p),
term AS (SELECT chunk_id, w, unnest(list_filter(string_split(lower(tok), '_'), lambda x: x <> '')) AS term FROM tok), size AS (SELECT chunk_id, count(*) AS n FROM term GROUP BY 1),
st AS (SELECT count(*) AS total, avg(coalesce(n, 0)) AS avgdl FROM c LEFT JOIN size USING (chunk_id)),
q AS (SELECT query_id, unnest(list_transform(regexp_extract_all(lower(query), '[a-z0-9_]+'), lambda x: x)) AS phrase FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in _LEXICAL_QUERIES)}) AS v(query_id, query)),
f AS (SELECT phrase, chunk_id, sum(w) AS f FROM (SELECT DISTINCT phrase FROM q) JOIN term ON starts_with(term, phrase) GROUP BY ALL), df AS (SELECT phrase, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(greatest(ln((total - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), CAST(1e-6 AS DOUBLE)) * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / avgdl))), 6) AS score
      FROM q JOIN f USING (phrase) JOIN df USING (phrase) JOIN size USING (chunk_id), st GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s) WHERE rn <= 30"""
)
def l2_l3_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Four queries against the inverted index over all chunks."""
    index = lexical.indexed(_searchable(spark, d).select(F.lit("").alias("scope"), F.col("chunk_id").alias("doc"), "content", "symbol", "path"))
    queries = spark.createDataFrame(_LEXICAL_QUERIES, "query_id bigint, query string")
    return lexical.bm25(index, queries, 30).select("query_id", F.col("doc").alias("chunk_id"), F.round("score", 4).alias("score"))


@query(
    f"""WITH {S.CHUNKS}, h AS (SELECT project, file, chunk_index, string_split(symbol, ', ')[1] AS wanted FROM c WHERE coalesce(symbol, '') <> ''),
m AS (SELECT h.*, s.name, s.start_line, s.end_line, s.id FROM h LEFT JOIN symbols s ON s.project = h.project AND s.file = h.file),
n AS (SELECT *, row_number() OVER (PARTITION BY project, file, chunk_index ORDER BY start_line, id) AS rn FROM m WHERE wanted <> '' AND contains(name, wanted)), e AS (SELECT project, file, chunk_index, greatest(coalesce(max(end_line), 1), 1) AS last FROM m GROUP BY ALL)
SELECT e.project, e.file, e.chunk_index, n.name AS symbol, CAST(coalesce(n.start_line, 1) AS INTEGER) AS start_line, CAST(CASE WHEN n.id IS NULL THEN e.last ELSE n.end_line END AS INTEGER) AS end_line
FROM e LEFT JOIN n ON n.project = e.project AND n.file = e.file AND n.chunk_index = e.chunk_index AND n.rn = 1"""
)
def j9_lexical_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with a symbol, as a lexical hit, at the range of the symbol it names."""
    hits = files_chunks(spark, d).where("coalesce(symbol, '') <> ''").select(F.lit(0).alias("query_id"), "project", "file", "symbol", F.col("chunk_index").alias("pos"))
    return retrieve.anchored(hits, table(spark, d, "symbols")).select("project", "file", F.col("pos").alias("chunk_index"), "symbol", "start_line", "end_line")


def files_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' places and symbols without repeated rows; no text is read."""
    w = Window.partitionBy("project", "file", "chunk_index").orderBy("chunk_id")
    return table(spark, d, "chunks").select("chunk_id", "project", "file", "chunk_index", "start_line", "end_line", "symbol", "symbol_type").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


_ASKED = [(1, "accept_anchor"), (2, "how are tests of the loader tokens written"), (3, "Parse the eager manifest"), (4, "where is the session configuration read in json")]


def r15_r17_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Text to shaped answers over all projects: BM25 and vectors in each, fused, exact symbols first, shaped."""
    rows = table(spark, d, "chunks").dropDuplicates(["project", "file", "chunk_index"])
    index = lexical.indexed(rows.select(F.col("project").alias("scope"), F.col("chunk_id").alias("doc"), F.col("text").alias("content"), "symbol", F.col("file").alias("path")))
    embed = B.hash_embedder(64)
    vectors = B.embedded(rows.select(F.struct("project", "chunk_id").alias("k"), T.embedding_text(F.col("file"), F.col("symbol"), F.col("text")).alias("text")), "k", embed)
    vectors = vectors.select(F.col("k.project").alias("scope"), F.col("k.chunk_id").alias("doc"), "vec")
    found = retrieve.search(rows, table(spark, d, "symbols"), files_of(spark, d), index, vectors, spark.createDataFrame(_ASKED, "query_id bigint, query string"), embed)
    return found.select("query_id", "pos", "project", "file", "start_line", "end_line", "symbol", "score", "merged_count")


QUERIES["r15_r17_text_search"] = r15_r17_text_search


@query(
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM documents), p AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(t, '_'), lambda x: x <> '')) AS p FROM w),
q AS (SELECT doc_id, lower(p) AS term FROM p UNION SELECT doc_id, unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), ' ')) FROM p)
SELECT term, count(DISTINCT doc_id) AS df FROM q GROUP BY 1"""
)
def a20_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return X.document_frequencies(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Two queries' candidate pools: symbols' ranges with scores derived from their ids."""
    s = table(spark, d, "symbols").where("name IS NOT NULL")
    pool = s.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), "project", "file", "id", "name", "symbol_type", "language", "start_line", "end_line", "signature")
    score = F.round(0.3 + (F.pmod(F.col("id") * 7919 * F.col("query_id"), F.lit(4001))) / 10000.0, 4)
    scored = pool.withColumn("score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "project", "file", "start_line", "end_line", "name", "id")
    top = scored.withColumn("pos", F.row_number().over(w)).where("pos <= 60")
    return top.select("query_id", "project", "file", "score", F.col("name").alias("symbol"), "symbol_type", F.col("language").alias("lang"), "start_line", "end_line", F.coalesce("signature", F.lit("")).alias("snippet"), "pos")


_POOL = """h AS (SELECT query_id, project, file, score, name AS symbol, symbol_type, language AS lang, start_line, end_line, coalesce(signature, '') AS snippet, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project, file, start_line, end_line, name, id) AS pos
FROM (SELECT *, round(CAST(0.3 AS DOUBLE) + (id * 7919 * query_id % 4001) / CAST(10000.0 AS DOUBLE), 4) AS score FROM (SELECT unnest([1, 2]) AS query_id, * FROM symbols WHERE name IS NOT NULL))) WHERE pos <= 60)"""
_ASK = "how are tests of the loader tokens written"


@query(f"WITH {_POOL} SELECT query_id, file, symbol, pos, round(score + CASE WHEN coalesce(symbol, '') <> '' THEN CAST(0.02 AS DOUBLE) ELSE 0 END, 4) AS score FROM h")
def r1_definition_boost(spark: SparkSession, d: str) -> DataFrame:
    return H.boost_definitions(_hits(spark, d)).select("query_id", "file", "symbol", "pos", "score")


@query(
    f"""WITH {_POOL}, t AS (SELECT *, list_distinct(list_transform(regexp_extract_all(concat_ws(' ', symbol, file, snippet), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))) AS have, list_distinct(regexp_extract_all('{_ASK}', '[A-Za-z_][A-Za-z0-9_]*')) AS want FROM h),
o AS (SELECT *, round(len(list_intersect(want, have)) / len(want) + CASE WHEN len(list_filter(want, lambda x: contains(lower(symbol), x))) > 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END, 4) AS lexical_score FROM t)
SELECT query_id, pos, symbol, lexical_score, round(score + CAST(0.25 AS DOUBLE) * lexical_score, 4) AS score FROM o"""
)
def l5_r2_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return H.fuse_lexical(_hits(spark, d), F.lit(_ASK)).select("query_id", "pos", "symbol", "lexical_score", "score")


_DATA = f"(coalesce(lang IN ('json', 'yaml', 'toml'), false) OR {S.ends('lower(file)', P.DATA_EXTENSIONS)})"


@query(f"WITH {_POOL}, x AS (SELECT *, {_DATA} AS data FROM h), y AS (SELECT *, CASE WHEN data AND row_number() OVER (PARTITION BY query_id, data ORDER BY pos) > 4 THEN 1 ELSE 0 END AS over FROM x) SELECT query_id, project, file, symbol, row_number() OVER (PARTITION BY query_id ORDER BY over, pos) AS pos FROM y")
def r4_data_cap(spark: SparkSession, d: str) -> DataFrame:
    return H.cap_data(_hits(spark, d), F.lit("x"), 10).select("query_id", "project", "file", "symbol", "pos")


@query(f"WITH {_POOL} SELECT query_id, project, file, symbol, round(score - CASE WHEN {_DATA} THEN CAST(0.03 AS DOUBLE) ELSE 0 END, 4) AS score FROM h")
def r3_data_penalty(spark: SparkSession, d: str) -> DataFrame:
    return H.penalise_data(_hits(spark, d), F.lit("x")).select("query_id", "project", "file", "symbol", "score")


@query(f"WITH {_POOL}, x AS (SELECT *, CASE WHEN {S.class_weight('file')} = 2 THEN 0 ELSE {S.class_weight('file')} END AS rung FROM h) SELECT query_id, project, file, symbol, row_number() OVER (PARTITION BY query_id ORDER BY rung, pos) AS pos FROM x")
def r7_class_order(spark: SparkSession, d: str) -> DataFrame:
    return H.class_order(_hits(spark, d), F.lit(_ASK)).select("query_id", "project", "file", "symbol", "pos")


@query(
    f"""WITH {_POOL}, i AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY query_id, project, file ORDER BY start_line, end_line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY query_id, project, file ORDER BY start_line, end_line, pos ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT query_id, project, file, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score, count(*) AS merged_count FROM g GROUP BY query_id, project, file, island"""
)
def r9_r10_merge(spark: SparkSession, d: str) -> DataFrame:
    return H.merge_overlapping(_hits(spark, d)).select("query_id", "project", "file", "start_line", "end_line", "score", "merged_count")


@query(f"WITH {_POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, project, file ORDER BY pos) AS nth FROM h) SELECT query_id, project, file, symbol, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM n WHERE nth <= 1")
def r11_cap_per_file(spark: SparkSession, d: str) -> DataFrame:
    return H.cap_per_file(_hits(spark, d), 1).select("query_id", "project", "file", "symbol", "pos")


_LISTS = "l AS (SELECT query_id, project, file, start_line, min(pos) AS pos, 'dense' AS list FROM h GROUP BY ALL UNION ALL SELECT query_id, project, file, start_line, min(61 - pos), 'lexical' FROM h WHERE pos % 2 = 0 GROUP BY ALL)"


@query(f"WITH {_POOL}, {_LISTS}, s AS (SELECT query_id, project, file, start_line, round(sum(CAST(1 AS DOUBLE) / (60 + pos)), 6) AS score FROM l GROUP BY ALL) SELECT query_id, project, file, start_line, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project, file, start_line) AS pos FROM s) WHERE pos <= 30")
def r12_r15_hybrid(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    dense = h.groupBy("query_id", "project", "file", "start_line").agg(F.min("pos").alias("pos"))
    lexical = h.where("pos % 2 = 0").groupBy("query_id", "project", "file", "start_line").agg(F.min(61 - F.col("pos")).alias("pos"))
    return X.hybrid(dense, lexical, 10).select("query_id", "project", "file", "start_line", "score", "pos")


_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))"


def _sub(text: str) -> str:
    """Lower-case identifier parts of at least three characters, in SQL."""
    spaced = f"regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g')"
    return f"list_transform(list_filter({_PARTS_SQL.format(spaced)}, lambda x: length(x) >= 3), lambda x: lower(x))"


_PARTS_SQL = r"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' ')"


@query(
    f"""WITH {_POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, project, file ORDER BY pos) AS nth FROM h WHERE pos <= 30),
b AS (SELECT *, CASE WHEN list_has_any({_TOKENS.format("coalesce(symbol, '')")}, {_TOKENS.format("'" + _ASK + "'")}) THEN CAST(0.04 AS DOUBLE) WHEN list_has_any({_sub("coalesce(symbol, '')")}, {_sub("lower('" + _ASK + "')")}) THEN CAST(0.02 AS DOUBLE) ELSE 0 END
  + CASE WHEN list_has_any({_TOKENS.format("coalesce(file, '')")}, {_TOKENS.format("'" + _ASK + "'")}) THEN CAST(0.02 AS DOUBLE) ELSE 0 END - CASE WHEN nth >= 3 THEN CAST(0.03 AS DOUBLE) ELSE 0 END AS delta FROM n),
s AS (SELECT query_id, project, file, symbol, start_line, pos AS was, round(score + round(delta, 4), 4) AS score FROM b)
SELECT query_id, project, file, symbol, start_line, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(file, ''), coalesce(start_line, 0), was) AS pos FROM s
UNION ALL SELECT query_id, project, file, symbol, start_line, score, pos FROM h WHERE pos > 30"""
)
def r6_rerank(spark: SparkSession, d: str) -> DataFrame:
    return H.rerank(_hits(spark, d), F.lit(_ASK)).select("query_id", "project", "file", "symbol", "start_line", "score", "pos")


@query(
    f"""WITH RECURSIVE {_POOL}, o AS (SELECT *, {S.class_weight('file')} AS rung, row_number() OVER (PARTITION BY query_id, {S.class_weight('file')}, project, file ORDER BY pos) AS nth FROM h),
r AS (SELECT query_id, rung, project, file, pos, nth, false AS again, [{{'s': start_line, 'e': end_line}}] AS shown FROM o WHERE nth = 1
  UNION ALL SELECT o.query_id, o.rung, o.project, o.file, o.pos, o.nth, len(list_filter(r.shown, lambda x: o.start_line <= x.e AND o.end_line >= x.s)) > 0,
    CASE WHEN len(list_filter(r.shown, lambda x: o.start_line <= x.e AND o.end_line >= x.s)) > 0 THEN r.shown ELSE list_append(r.shown, {{'s': o.start_line, 'e': o.end_line}}) END
  FROM r JOIN o ON o.query_id = r.query_id AND o.rung = r.rung AND o.project = r.project AND o.file = r.file AND o.nth = r.nth + 1)
SELECT query_id, project, file, pos AS was, row_number() OVER (PARTITION BY query_id ORDER BY rung, again, pos) AS pos FROM r"""
)
def r8_repeat_demotion(spark: SparkSession, d: str) -> DataFrame:
    pool = _hits(spark, d)
    return H.demote_repeats(pool.withColumn("was", F.col("pos"))).select("query_id", "project", "file", "was", "pos")


@query(
    f"""WITH RECURSIVE {_POOL}, t AS (SELECT *, left(snippet, 120) AS cut, 80 + least(length(left(snippet, 120)), 500) AS cost FROM h),
k AS (SELECT query_id, pos, cost AS used, true AS kept FROM t WHERE pos = 1 UNION ALL SELECT t.query_id, t.pos, k.used + CASE WHEN k.used + t.cost <= 2000 THEN t.cost ELSE 0 END, k.used + t.cost <= 2000 FROM k JOIN t ON t.query_id = k.query_id AND t.pos = k.pos + 1)
SELECT t.query_id, t.project, t.file, t.cut AS snippet, row_number() OVER (PARTITION BY t.query_id ORDER BY t.pos) AS pos FROM k JOIN t ON t.query_id = k.query_id AND t.pos = k.pos WHERE kept"""
)
def r13_r14_budget(spark: SparkSession, d: str) -> DataFrame:
    return H.trim_to_budget(H.truncate_snippets(_hits(spark, d), 4000, 20), 500).select("query_id", "project", "file", "snippet", "pos")


def r16_r18_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole shaping pipeline over both pools, ten answers each."""
    return H.shape(H.penalise_data(H.boost_definitions(_hits(spark, d)), F.lit(_ASK)), F.lit(_ASK), 10, per_file=3, budget=2000)


QUERIES["r16_r18_search"] = r16_r18_search


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, v.label = q.label AS rel, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings v, q),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10),
f AS (SELECT q.query_id, min(rank) FILTER (rel AND k.vec_id <> q.query_id) AS rank FROM q LEFT JOIN k USING (query_id) GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS recall_10,
round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN CAST(1 AS DOUBLE) / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10, list_sort(list(rank) FILTER (rank IS NOT NULL))[CAST(ceil(0.95 * count(rank)) AS INTEGER)] AS p95_rank FROM f"""
)
def a15_q16_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the same label as relevant answers."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0")
    hits = X.nearest(v, q.select(F.col("vec_id").alias("query_id"), "embedding"), 10).withColumnRenamed("vec_id", "item")
    relevant = q.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("item"), "label"), "label").where("query_id != item")
    return V.metrics(V.first_ranks(hits, relevant))


@query(
    """WITH r AS (SELECT event_type || user_id AS query_id, min(event_id % 13 + 1) AS a, min(event_id % 11 + 1) AS b FROM events GROUP BY 1), x AS (SELECT query_id, CASE WHEN a <= 10 THEN a END AS rank_a, CASE WHEN b <= 9 THEN b END AS rank_b FROM r)
SELECT query_id, rank_a, rank_b, CASE WHEN coalesce(rank_b, 999) < coalesce(rank_a, 999) THEN 'win' WHEN coalesce(rank_b, 999) > coalesce(rank_a, 999) THEN 'loss' ELSE 'tie' END AS outcome FROM x"""
)
def a16_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy(F.concat("event_type", F.col("user_id").cast("string")).alias("query_id")).agg(F.min(F.col("event_id") % 13 + 1).alias("a"), F.min(F.col("event_id") % 11 + 1).alias("b"))
    return V.compare(r.select("query_id", F.when(F.col("a") <= 10, F.col("a")).alias("rank")), r.select("query_id", F.when(F.col("b") <= 9, F.col("b")).alias("rank")))


# -- streams -------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + INTERVAL 1 HOUR AS fires_at, count(*) AS events FROM g GROUP BY user_id, island"""
)
def t4_debounce(spark: SparkSession, d: str) -> DataFrame:
    return debounce.firings(table(spark, d, "events"), "user_id", "ts", 3600)


# -- second inventory ----------------------------------------------------------------------------------------------


@query(
    r"""WITH c AS (SELECT DISTINCT project, file, start_line, text FROM chunks), l AS (SELECT project, file, start_line, string_split(text, chr(10)) AS ls FROM c), n AS (SELECT project, file, start_line + i - 1 AS line, ls[i] AS t FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
m AS (SELECT *, coalesce(nullif(regexp_extract(t, '^(?:import|export|require|#include)\b.*[\"''<]([^\"''<>]+)[\"''>]', 1), ''), nullif(regexp_extract(t, '^(?:from|import|use|using)\s+([A-Za-z_.][\w.:]*)', 1), '')) AS raw_target FROM n WHERE regexp_matches(t, '^(from|import|use|using|export|require|#include)\b'))
SELECT DISTINCT project, file, CAST(line AS INTEGER) AS line, raw_target FROM m WHERE raw_target IS NOT NULL"""
)
def x12_imports(spark: SparkSession, d: str) -> DataFrame:
    return E.imports_of(table(spark, d, "chunks"))


def x5_x7_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations and verdicts of all files."""
    return E.declarations(E.whole_texts(table(spark, d, "chunks")))


def x10_parsed_references(spark: SparkSession, d: str) -> DataFrame:
    """References of every file in a language with a syntax tree or braces."""
    return E.parsed_references(E.whole_texts(table(spark, d, "chunks")))


QUERIES |= {"x5_x7_declarations": x5_x7_declarations, "x10_parsed_references": x10_parsed_references}


@query("SELECT r.project, r.file, r.line, r.to_name, r.relationship, arg_max(s.id, (s.start_line, -s.end_line, s.id)) AS enclosing_id FROM refs r JOIN symbols s ON s.project = r.project AND s.file = r.file AND r.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2, 3, 4, 5")
def x10_j11_enclosing(spark: SparkSession, d: str) -> DataFrame:
    return E.enclosing(table(spark, d, "refs"), table(spark, d, "symbols"))


def x19_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic local embeddings of all documents, as float16 bytes."""
    return B.embedded(table(spark, d, "documents"), "doc_id", B.hash_embedder(64))


QUERIES["x19_embedder"] = x19_embedder


@query("SELECT name, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS seen_as, count(*) AS symbols FROM symbols WHERE language = 'python' AND name IS NOT NULL GROUP BY ALL")
def x8_visibility(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("language = 'python' AND name IS NOT NULL")
    return s.groupBy("name", E.visibility(F.col("name"), F.coalesce("signature", F.lit("")), F.col("language")).alias("seen_as")).agg(F.count(F.lit(1)).alias("symbols"))


@query(f"WITH {S.RESOLVED}, hm AS (SELECT project, name, count(DISTINCT file) AS n, min(file) AS f FROM symbols WHERE name IS NOT NULL GROUP BY 1, 2) SELECT r.project, r.file, r.from_symbol, r.to_name, CASE WHEN hm.n = 1 THEN hm.f END AS target_file, count(*) AS calls FROM r LEFT JOIN hm ON hm.project = r.project AND hm.name = r.to_name WHERE relationship = 'call' GROUP BY ALL")
def g3_callees(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return G.callees(table(spark, d, "refs"), symbols)


def g4_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Two steps both ways from the file that most others of its project import."""
    imports = durable(x14_resolved_imports(spark, d))
    top = imports.where("resolved_file IS NOT NULL").groupBy("project", "resolved_file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project", "resolved_file").first()
    return G.dependencies(imports, *(top["project"], top["resolved_file"]) if top else ("", ""), "both")


def g5_j7_importers(spark: SparkSession, d: str) -> DataFrame:
    return G.importers(x14_resolved_imports(spark, d), table(spark, d, "symbols"))


QUERIES |= {"g4_dependencies": g4_dependencies, "g5_j7_importers": g5_j7_importers}


@query("SELECT relationship, confidence, count(*) AS refs, count(DISTINCT to_name) AS names FROM refs WHERE relationship IN ('base_class') GROUP BY ALL")
def f10_relationship_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").where(F.col("relationship").isin(*L.RELATIONSHIPS["inherits"]))
    return r.groupBy("relationship", "confidence").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("to_name").alias("names"))


@query(f"WITH {S.FILES} SELECT project, path FROM f WHERE path = 'src/core' OR starts_with(path, 'src/core/')")
def f11_prefix_scope(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).where((F.col("path") == "src/core") | F.col("path").startswith("src/core/")).select("project", "path")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label = 3)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def f12_filtered_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the top-k, so that it never empties an answer."""
    v = table(spark, d, "embeddings")
    return X.nearest(v.where("label = 3"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {_POOL}, c AS (SELECT DISTINCT project, file, chunk_id, start_line, end_line FROM chunks), j AS (SELECT h.query_id, h.pos, min(c.chunk_id) AS chunk_id FROM h LEFT JOIN c ON c.project = h.project AND c.file = h.file AND h.start_line BETWEEN c.start_line AND c.end_line GROUP BY 1, 2) SELECT query_id, pos, chunk_id FROM j")
def j8_hits_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("project", "file", "chunk_id", F.col("start_line").alias("a"), F.col("end_line").alias("b")).distinct()
    h = _hits(spark, d)
    hit = h.join(c, ["project", "file"]).where("start_line BETWEEN a AND b").groupBy("query_id", "pos").agg(F.min("chunk_id").alias("chunk_id"))
    return h.select("query_id", "pos").join(hit, ["query_id", "pos"], "left")


@query(f"WITH {S.FILES} SELECT project, count(*) AS files, count(*) FILTER (status <> 'ok') AS faulty, max(mtime_ns) AS newest, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM f GROUP BY 1")
def q18_status(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") != "ok").alias("faulty"), F.max("mtime_ns").alias("newest"), F.sum("size").alias("bytes"), F.sum("chunk_count").alias("chunks"))


@query("SELECT project, file, line, relationship, to_name, receiver, from_symbol FROM (SELECT *, row_number() OVER (PARTITION BY project, to_name ORDER BY file, line, relationship, receiver NULLS FIRST, from_symbol NULLS FIRST) AS rn FROM refs) WHERE rn <= 3")
def o3_o5_call_sites(spark: SparkSession, d: str) -> DataFrame:
    """The first three sites of every name in store order."""
    w = Window.partitionBy("project", "to_name").orderBy("file", "line", "relationship", "receiver", "from_symbol")
    return table(spark, d, "refs").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("project", "file", "line", "relationship", "to_name", "receiver", "from_symbol")


# -- third inventory -----------------------------------------------------------------------------------------------


_CALLING = "t AS (SELECT project, regexp_extract(from_symbol, '[^.]*$') AS name FROM refs WHERE relationship = 'call' AND from_symbol IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"


@query(
    f"""WITH {_CALLING}, e AS (SELECT regexp_extract(from_symbol, '[^.]*$') AS src, to_name AS name, count(*) AS calls FROM refs r JOIN t ON t.project = r.project WHERE relationship = 'call' AND from_symbol IS NOT NULL AND to_name IS NOT NULL GROUP BY ALL),
e1 AS (SELECT e.name, sum(calls) AS calls FROM e JOIN t ON t.name = e.src WHERE e.name <> t.name GROUP BY 1), n1 AS (SELECT *, row_number() OVER (ORDER BY calls DESC, name) AS n FROM e1), s1 AS (SELECT * FROM n1 WHERE n <= 59), u1 AS (SELECT 59 - count(*) AS room, count(*) + 1 AS used FROM s1),
e2 AS (SELECT e.name, sum(calls) AS calls FROM e JOIN (SELECT name AS src FROM s1) f USING (src) WHERE e.name NOT IN (SELECT name FROM e1) AND e.name NOT IN (SELECT name FROM t) GROUP BY 1), n2 AS (SELECT *, row_number() OVER (ORDER BY calls DESC, name) AS n FROM e2),
w AS (SELECT 0 AS level, name, NULL AS calls, 1 AS position, 0 AS refused FROM t UNION ALL SELECT 1, name, calls, n + 1, greatest((SELECT count(*) FROM e1) - 59, 0) FROM s1
  UNION ALL SELECT 2, CASE WHEN room > 0 THEN name END, CASE WHEN room > 0 THEN calls END, CASE WHEN room > 0 THEN n + used END, greatest((SELECT count(*) FROM e2) - room, 0) FROM n2, u1 WHERE n <= greatest(room, 1)),
h AS (SELECT s.name, count(DISTINCT file) AS n, min(file) AS f FROM symbols s JOIN t ON t.project = s.project GROUP BY 1)
SELECT CAST(level AS INTEGER) AS level, w.name, CAST(calls AS BIGINT) AS calls, CASE WHEN h.n = 1 THEN h.f END AS target_file, CAST(position AS INTEGER) AS position, CAST(refused AS BIGINT) AS refused FROM w LEFT JOIN h ON h.name = w.name"""
)
def g3_callees_walk(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of callees of the declaration that calls most."""
    refs = table(spark, d, "refs")
    top = refs.where("relationship = 'call' AND from_symbol IS NOT NULL").groupBy("project", F.substring_index("from_symbol", ".", -1).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project", "name").first()
    return G.callees_walk(refs, table(spark, d, "symbols"), top["project"], top["name"])


@query(
    f"""WITH {S.RESOLVED}, v AS (SELECT s.project, s.file, count(*) AS value FROM r JOIN symbols s ON s.id = r.target_id WHERE r.file <> s.file OR r.project <> s.project GROUP BY 1, 2)
SELECT project, file, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {S.class_weight('file')}, value DESC, file) AS rank FROM v) WHERE rank <= 10"""
)
def a9_fan_in_hotspots(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return A.hotspots(A.fan_in_by_file(R.resolved(table(spark, d, "refs"), symbols), symbols), 10).select("project", "file", "value", "rank")


@query("SELECT project, name, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM symbols WHERE name IS NOT NULL GROUP BY 1, 2")
def f14_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    return L.exactly_one(table(spark, d, "symbols"))


@query(
    f"""WITH {S.CHUNKS}, w AS (SELECT DISTINCT project, file, start_line, end_line FROM symbols WHERE name = 'accept_anchor' AND start_line IS NOT NULL),
i AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY project, file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY project, file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM i), r AS (SELECT project, file, island, greatest(min(start_line) - 3, 1) AS a, max(end_line) + 3 AS b FROM g GROUP BY ALL)
SELECT DISTINCT r.project, r.file, r.a AS from_line, r.b AS to_line, c.chunk_id FROM r JOIN c ON c.project = r.project AND c.file = r.file AND c.start_line <= r.b AND c.end_line >= r.a"""
)
def q7_symbol_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of every definition of a name, three lines around."""
    wanted = table(spark, d, "symbols").where("name = 'accept_anchor' AND start_line IS NOT NULL").select("project", "file", "start_line", "end_line").distinct()
    return L.code_context(files_chunks(spark, d), wanted, 3).select("project", "file", "from_line", "to_line", "chunk_id").distinct()


@query(
    f"""WITH {_SNAPS}, k AS (SELECT DISTINCT chunk_hash, symbol AS name FROM chunks WHERE symbol IS NOT NULL), v AS (SELECT DISTINCT cs.snap_no, cs.project, cs.file, k.name FROM cs JOIN k USING (chunk_hash)),
n AS (SELECT DISTINCT project, file FROM cs WHERE snap_no = 1)
SELECT project, file, name FROM v WHERE snap_no = 3 AND (project, file) IN (SELECT (project, file) FROM n) AND NOT EXISTS (SELECT 1 FROM v x WHERE x.snap_no = 1 AND x.project = v.project AND x.file = v.file AND x.name = v.name)"""
)
def g8_removed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Names that going back from the third snapshot to the first would remove from files that both have."""
    known = table(spark, d, "chunks").where("symbol IS NOT NULL").select("chunk_hash", F.col("symbol").alias("name")).distinct()
    then = chunk_snapshot(spark, d, 1)
    return A.removed_symbols(chunk_snapshot(spark, d, 3).join(known, "chunk_hash"), then.join(known, "chunk_hash"), then)


# -- times and offsets ---------------------------------------------------------------------------------------------


@query("SELECT slug, strftime(make_timestamp(CAST(floor(created_at * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || 'Z' AS created FROM projects")
def u1_epoch_to_iso(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("slug", T.iso_time(F.col("created_at")).alias("created"))


@query(
    r"""SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16_units FROM documents WHERE text IS NOT NULL"""
)
def u2_text_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of whole texts in characters, bytes and UTF-16 units, by which editors and diffs count columns."""
    text = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(text).cast("bigint").alias("chars"), F.octet_length(text).cast("bigint").alias("bytes"), T.utf16_units(text).cast("bigint").alias("utf16_units"))
