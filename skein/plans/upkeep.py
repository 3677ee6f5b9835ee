"""Queries over the state of the index: changes, overlays, coverage, status, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import embed
from skein.functions import text as T
from skein.operators import state
from skein.runtime import table
from skein.sources import scan

KEY = ["repo", "relative_path"]


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each file by its chunks."""
    return table(spark, d, "chunk_doc").where("relative_path is not null").groupBy(*KEY).agg(F.max("file_hash").alias("file_hash"))


def _present(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_state").groupBy(*KEY).agg(F.max("file_hash").alias("file_hash"))


def file_diff(spark: SparkSession, d: str) -> DataFrame:
    return state.changes(_indexed(spark, d), _present(spark, d))


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.change_counts(file_diff(spark, d), ["repo"])


def carry_forward_hashes(spark: SparkSession, d: str) -> DataFrame:
    old, now = _indexed(spark, d), _present(spark, d)
    changed = state.changes(old, now)
    fresh = now.join(changed.where(F.col("change").isin("added", "modified")), KEY, "left_semi")
    return state.carried_forward(old, changed, fresh)


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    """An overlay of all Rust and Go files; its state goes by extension."""
    rows = _present(spark, d).where(F.col("relative_path").rlike(r"\.(?:rs|go)$"))
    return rows.select(*KEY, F.when(F.col("relative_path").endswith(".rs"), "completed").otherwise("stale").alias("overlay_status"))


def suppress_overlay(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "chunk_doc").select(*KEY, "id").distinct()
    return state.suppressed(hits, _overlay(spark, d))


def overlay_union(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "chunk_doc").select(*KEY, "id").distinct()
    fresh = hits.where(F.col("relative_path").endswith(".rs")).withColumn("id", F.concat(F.lit("overlay:"), "id"))
    return state.merged(hits, fresh, _overlay(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = state.coverage(table(spark, d, "chunk_doc").select(*KEY, "id").distinct())
    return c.withColumn("status", state.index_status(F.col("files"), F.col("chunks"), 1000))


def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return state.totals(table(spark, d, "repo_state"))


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "chunk_doc").select(*KEY, "id", "file_hash").distinct()
    return state.stale(hits, _present(spark, d)).select("id", "stale")


def stale_collections(spark: SparkSession, d: str) -> DataFrame:
    """Collections of chunks and of symbols that no indexed or indexing repository expects; each expects one of both."""

    def names(repos: DataFrame) -> DataFrame:
        return repos.where("repo is not null").select(F.explode(F.array(*(F.concat(F.lit(k), F.md5("repo")) for k in ("hybrid_code_chunks_", "hybrid_symbols_")))).alias("name")).distinct()

    have = table(spark, d, "chunk_doc").select("repo").unionByName(table(spark, d, "symbol_row").select("repo"))
    return state.orphans(names(have), names(table(spark, d, "repo_state").where("status in ('indexed', 'indexing')")))


def root_hash(spark: SparkSession, d: str) -> DataFrame:
    return state.root_hashes(_present(spark, d), "md5")


def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "chunk_doc").select(*KEY, "id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunks"))
    return state.within_budget(files, 60)


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks after all Python files were indexed anew."""
    rows = table(spark, d, "chunk_doc").select(*KEY, "id", "start_line").distinct()
    fresh = rows.where(F.col("relative_path").endswith(".py")).withColumn("id", F.concat(F.lit("new_"), "id"))
    return state.replaced(rows, fresh)


def delete_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_doc").select(*KEY, "id").distinct()
    return state.deleted(rows, file_diff(spark, d).where("change = 'removed'"))


def queue_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    requests = e.select(F.col("user_id").cast("string").alias("repo"), (F.col("event_type") == "error").alias("force"), (F.col("event_type") == "click").alias("explicit"), F.col("ts").alias("at"))
    return state.merge_requests(requests).drop("at")


def indexing_age(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that have been indexing for an hour or an unknown time, at a fixed moment."""
    s = table(spark, d, "repo_state").where("status = 'indexing'")
    age = F.unix_timestamp(F.lit("2027-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("last_updated"))
    return s.select("repo", F.coalesce(F.greatest(age, F.lit(0)), F.lit(-1)).cast("long").alias("age")).where("age < 0 or age >= 3600")


def distinct_files_of_stores(spark: SparkSession, d: str) -> DataFrame:
    """Files that chunks and symbols agree on, and files that only one of them has."""
    a = table(spark, d, "chunk_doc").select(*KEY).distinct().withColumn("in_chunks", F.lit(True))
    b = table(spark, d, "symbol_row").where("repo is not null and relative_path is not null").select(*KEY).distinct().withColumn("in_symbols", F.lit(True))
    return a.join(b, KEY, "full_outer").fillna(False, ["in_chunks", "in_symbols"]).groupBy("in_chunks", "in_symbols").agg(F.count(F.lit(1)).alias("n"))


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in the text of every chunk."""
    files = table(spark, d, "chunk_doc").select("repo", F.concat_ws("#", "id", "relative_path").alias("relative_path"), F.col("content").alias("text")).distinct()
    made = scan.chunks_and_symbols(files).where("name is not null")
    return made.select(T.symbol_id(F.col("relative_path"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line")).alias("symbol_id"), "repo", "relative_path", "kind", "name", "container", "start_line", "end_line")


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, which are files of their source here."""
    docs = table(spark, d, "documents").where("text is not null")
    files = docs.select(F.coalesce("source", F.lit("")).alias("repo"), F.coalesce("relative_path", F.concat(F.lit("doc_"), "doc_id")).alias("relative_path"), "text")
    return scan.chunks_and_symbols(files).select("repo", "relative_path", "start_line", "end_line", F.length("content").cast("long").alias("size"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", embed.embed(F.col("text"), embed.HashingEmbedder(64)).alias("vector"))


_I = "old AS (SELECT repo, relative_path, max(file_hash) AS h0 FROM chunk_doc WHERE relative_path IS NOT NULL GROUP BY ALL)"
_P = "now_ AS (SELECT repo, relative_path, max(file_hash) AS h1 FROM file_state GROUP BY ALL)"
_CH = f"""{_I}, {_P}, ch AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.relative_path, b.relative_path) AS relative_path, h0, h1,
  CASE WHEN a.relative_path IS NULL THEN 'added' WHEN b.relative_path IS NULL THEN 'removed' WHEN h0 IS NOT DISTINCT FROM h1 THEN 'unchanged' ELSE 'modified' END AS change
  FROM old a FULL JOIN now_ b ON a.repo = b.repo AND a.relative_path = b.relative_path)"""
_C = "c AS (SELECT DISTINCT repo, relative_path, id, start_line, file_hash FROM chunk_doc)"
_HIDDEN = "hidden AS (SELECT DISTINCT repo, relative_path FROM file_state WHERE ends_with(relative_path, '.rs'))"
_KEPT = "SELECT repo, relative_path, id FROM c WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.repo = c.repo AND h.relative_path = c.relative_path)"

QUERIES = {
    f.__name__: f
    for f in (file_diff, change_counts, carry_forward_hashes, suppress_overlay, overlay_union, coverage, status_totals, stale_files, stale_collections, root_hash, chunk_budget, upsert_chunks, delete_paths, queue_merge, indexing_age, distinct_files_of_stores, extract_symbols, chunk_files, embed_documents)
}
SQL = {
    "file_diff": f"WITH {_CH} SELECT repo, relative_path, change FROM ch",
    "change_counts": f"WITH {_CH} SELECT repo, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM ch GROUP BY repo",
    "carry_forward_hashes": f"WITH {_CH} SELECT repo, relative_path, CASE WHEN change = 'unchanged' THEN h0 ELSE h1 END AS file_hash FROM ch WHERE change <> 'removed'",
    "suppress_overlay": f"WITH {_C}, {_HIDDEN} {_KEPT}",
    "overlay_union": f"WITH {_C}, {_HIDDEN} {_KEPT} UNION ALL SELECT repo, relative_path, 'overlay:' || id FROM c WHERE ends_with(relative_path, '.rs')",
    "coverage": "SELECT repo, count(DISTINCT relative_path) AS files, count(DISTINCT id) AS chunks, CASE WHEN count(DISTINCT relative_path) = 0 OR count(DISTINCT id) = 0 THEN 'empty' WHEN count(DISTINCT id) >= 1000 THEN 'limit_reached' ELSE 'completed' END AS status FROM chunk_doc GROUP BY repo",
    "status_totals": """SELECT CAST(coalesce(sum(indexed_files), 0) AS BIGINT) AS indexed_files, CAST(coalesce(sum(total_chunks), 0) AS BIGINT) AS total_chunks, count(error_message) AS errors,
CASE WHEN bool_or(coalesce(status = 'indexing', false)) THEN 'indexing' WHEN bool_or(coalesce(status = 'indexfailed', false)) THEN 'indexfailed' WHEN bool_or(coalesce(status = 'indexed', false)) THEN 'indexed' ELSE 'not_indexed' END AS status FROM repo_state""",
    "stale_files": f"WITH {_C}, {_P} SELECT c.id, n.relative_path IS NULL OR coalesce(n.h1, '') <> coalesce(c.file_hash, '') AS stale FROM c LEFT JOIN now_ n ON c.repo = n.repo AND c.relative_path = n.relative_path",
    "stale_collections": "WITH h AS (SELECT repo FROM chunk_doc WHERE repo IS NOT NULL UNION SELECT repo FROM symbol_row WHERE repo IS NOT NULL), k AS (SELECT unnest(['hybrid_code_chunks_', 'hybrid_symbols_']) AS k) SELECT k || md5(repo) AS name FROM h, k WHERE repo NOT IN (SELECT repo FROM repo_state WHERE repo IS NOT NULL AND status IN ('indexed', 'indexing'))",
    "root_hash": f"WITH {_P} SELECT repo, md5(string_agg(relative_path || ':' || coalesce(h1, '') || chr(10), '' ORDER BY relative_path)) AS root_hash FROM now_ WHERE relative_path IS NOT NULL GROUP BY repo",
    "chunk_budget": """WITH f AS (SELECT repo, relative_path, count(DISTINCT id) AS chunks FROM chunk_doc GROUP BY ALL), r AS (SELECT *, sum(chunks) OVER (PARTITION BY repo ORDER BY relative_path) AS t FROM f)
SELECT repo, relative_path, chunks FROM r WHERE t <= 60""",
    "upsert_chunks": f"WITH {_C} SELECT repo, relative_path, CASE WHEN ends_with(relative_path, '.py') THEN 'new_' || id ELSE id END AS id, start_line FROM c",
    "delete_paths": f"WITH {_CH}, {_C} SELECT c.repo, c.relative_path, c.id FROM c JOIN ch ON c.repo = ch.repo AND c.relative_path = ch.relative_path WHERE change <> 'removed'",
    "queue_merge": "SELECT CAST(user_id AS VARCHAR) AS repo, bool_or(event_type = 'error') AS force, bool_or(event_type = 'click') AS explicit, count(*) AS n FROM events GROUP BY user_id",
    "indexing_age": "WITH a AS (SELECT repo, coalesce(greatest(CAST(floor(epoch(TIMESTAMP '2027-01-01 00:00:00') - floor(epoch(try_cast(last_updated AS TIMESTAMP)))) AS BIGINT), 0), -1) AS age FROM repo_state WHERE status = 'indexing') SELECT repo, age FROM a WHERE age < 0 OR age >= 3600",
    "distinct_files_of_stores": """WITH a AS (SELECT DISTINCT repo, relative_path FROM chunk_doc), b AS (SELECT DISTINCT repo, relative_path FROM symbol_row WHERE repo IS NOT NULL AND relative_path IS NOT NULL)
SELECT a.repo IS NOT NULL AS in_chunks, b.repo IS NOT NULL AS in_symbols, count(*) AS n FROM a FULL JOIN b ON a.repo = b.repo AND a.relative_path = b.relative_path GROUP BY ALL""",
}
