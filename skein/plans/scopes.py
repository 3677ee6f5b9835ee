"""Queries over several repositories and working copies: filters, fusion, overlays, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import planner, shapes
from skein.functions import text as T
from skein.operators import filters, fusion, retrieval, state, symbols
from skein.plans.search import _FIELDS, _WEIGHTS, LATEST, _bm25_sql, _dense_sql, _source_sql
from skein.plans.scalars import KIND, terms_sql
from skein.plans.upkeep import _overlay, _present
from skein.runtime import table
from skein.streaming import jobs

KEY = ["repo", "relative_path"]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits with the repository of their chunk."""
    best = table(spark, d, "chunk_search_hit").where("score is not null").groupBy("id").agg(F.max("score").alias("score"))
    files = table(spark, d, "chunk_doc").where("id is not null").groupBy("id").agg(F.min(F.struct("repo", "relative_path")).alias("f"))
    return best.join(files, "id").select("f.repo", "f.relative_path", "id", "score")


def chunk_filters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by plain prefix, language and extensions."""
    rows = table(spark, d, "chunk_doc").select("id", *KEY, "language", "extension")
    return filters.chunks(rows, prefix="src", language="rust", extensions=[".rs", ".py"]).select("id").distinct()


def flavor_fields(spark: SparkSession, d: str) -> DataFrame:
    """What every search query looks for, and in which fields."""
    q = planner.flavored(table(spark, d, "search_query").select("query_id", "query"))
    return q.select("query_id", "kind", F.array_join("fields", " ").alias("fields"), "text")


def flavored_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of every query, searched as its kind asks for."""
    asked = retrieval.flavored_terms(table(spark, d, "search_query").select("query_id", "query"))
    scored = retrieval.field_bm25(table(spark, d, "chunk_doc"), "id", retrieval.chunk_fields(), asked)
    return retrieval.top_k(scored.withColumn("score", T.rounded(F.col("score"))), 10).select("query_id", F.col("doc").alias("id"), "rank", "score")


def symbol_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by name, and by the vector of the chunk that begins with them, fused by a plan's shares."""
    rows = symbols.latest_symbols(table(spark, d, "symbol_row"))
    named = rows.select("repo", "symbol_id", T.rounded(retrieval.symbol_boost(F.lit("kernel"))).alias("score")).where("score > 0")
    near = retrieval.dense_scores(retrieval.one_vector(table(spark, d, "vector_doc")), _vector()).select("id", "score")
    starts = table(spark, d, "chunk_doc").where("id is not null").select(*KEY, "id", "start_line").distinct().join(near, "id")
    by_vector = rows.join(starts, [*KEY, "start_line"]).groupBy("repo", "symbol_id").agg(F.max("score").alias("score"))
    got = symbols.fused(named, by_vector, rows.select("repo", "symbol_id", "relative_path", "language", "kind", "name", "container"), 0.55, 0.45, 5)
    return got.select("repo", "symbol_id", "position", T.rounded(F.col("score")).alias("score"), "match_type", "name")


def _vector() -> list[float]:
    from skein.plans.search import VECTOR

    return VECTOR


def symbol_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols.latest_symbols(table(spark, d, "symbol_row")).where("name is not null and kind is not null and relative_path is not null and language is not null")
    return rows.select("repo", "symbol_id", symbols.semantic_text(F.col("kind"), F.col("name"), F.col("container"), F.col("relative_path"), F.col("language")).alias("text"))


def source_scores(spark: SparkSession, d: str) -> DataFrame:
    """The parts of both sources of every fused hit beside their sum."""
    weights = planner.plan(table(spark, d, "search_query").select("query_id", "query")).select("query_id", "dense_weight", "lexical_weight")
    lists = []
    for name, source in (("dense", "search_document"), ("lexical", "chunk_search_hit")):
        best = table(spark, d, source).where("score is not null").groupBy("query_id", "id").agg(F.max("score").alias("score")).join(weights, "query_id")
        lists.append(fusion.source(best, name, F.col(f"{name}_weight"), ["query_id"]))
    got = fusion.fuse(lists, ["query_id"], by_source=["dense", "lexical"])
    return got.select("query_id", "id", *(T.rounded(F.col(c)).alias(c) for c in ("score", "dense_score", "lexical_score")), "match_type")


def overlay_union_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best three hits a repository after an overlay replaced its files."""
    hits = _hits(spark, d)
    fresh = hits.where(F.col("relative_path").endswith(".rs")).select(*KEY, F.concat(F.lit("overlay:"), "id").alias("id"), (F.col("score") + 1).alias("score"))
    return state.merged_top(hits, fresh, _overlay(spark, d), 3).select("repo", "rank", "id")


def overlay_candidates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "chunk_doc").where("repo is not null and relative_path is not null").select(*KEY).distinct()
    return state.candidate_files(files, files.where(F.col("relative_path").endswith(".rs")), _overlay(spark, d))


def overlay_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every file's hash, from the index where it has one, else from the stored hashes."""
    first = table(spark, d, "chunk_doc").where("relative_path is not null and file_hash is not null").groupBy(*KEY).agg(F.max("file_hash").alias("file_hash"))
    return state.overlay_first(first, _present(spark, d), KEY)


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return state.file_metadata(table(spark, d, "chunk_doc"), symbols.latest_symbols(table(spark, d, "symbol_row"))).select(*KEY, F.coalesce("indexed_at", F.lit("")).alias("indexed_at"), F.coalesce("file_hash", F.lit("")).alias("file_hash"))


def profile_usage(spark: SparkSession, d: str) -> DataFrame:
    """How many repositories use each embedding profile."""
    return state.profile_usage(table(spark, d, "repo_state"))


def status_filters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "repo_state")
    return state.with_status(s, ["indexfailed"], profile="default").select("repo", "reason")


def response_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits as they are answered: the repository is named only where a query's hits span several."""
    fused = source_scores(spark, d).select("query_id", "id", "score", "match_type")
    files = table(spark, d, "chunk_doc").join(fused.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("repo", "relative_path", "start_line", "end_line")).alias("f"))
    hits = fused.join(files, "id").select("query_id", "id", "score", "match_type", "f.*")
    return shapes.compact_hits(hits, ["query_id"]).drop("match_type")


def restart_healing(spark: SparkSession, d: str) -> DataFrame:
    return jobs.healed(table(spark, d, "repo_state")).select("repo", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


def audit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What an audit does with each repository, given a head for some of them."""
    now = table(spark, d, "repo_state").where("repo is not null and indexed_files is not null").select("repo", F.when(F.col("indexed_files") % 2 == 0, F.col("last_head")).otherwise("new").alias("last_head"), "last_index_mtime", "last_root_mtime")
    return jobs.audit(table(spark, d, "repo_state"), now).select("repo", "action")


def runnable_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Pending requests whose repository is queued, in the order in which a worker takes them."""
    s = table(spark, d, "repo_state").where("repo is not null")
    pending = s.select("repo", F.lit(True).alias("force"))
    states = s.select("repo", F.when(F.coalesce(F.col("total_chunks"), F.lit(0)) % 2 == 0, "queued").otherwise("running").alias("queue_state"))
    recovering = s.where("status = 'indexfailed'").select("repo")
    return jobs.runnable(pending, states, recovering).select("repo", "position")


def progress_saved(spark: SparkSession, d: str) -> DataFrame:
    """Which progress reports are stored: a new whole percent, or two seconds after the last stored one."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at_id"), F.unix_timestamp("ts").cast("double").alias("at"), (F.col("value") % 100).alias("percent"))
    return jobs.stored_progress(e, "run", ["at", "at_id"], "percent").select("run", "at_id")


QUERIES = {
    f.__name__: f
    for f in (chunk_filters, flavor_fields, flavored_search, symbol_fusion, symbol_texts, source_scores, overlay_union_topk, overlay_candidates, overlay_lookup, file_metadata, profile_usage, status_filters, response_rows, restart_healing, audit_decisions, runnable_jobs, progress_saved)
}
_FILES = "files AS (SELECT id, min({'a': repo, 'b': relative_path}) AS f FROM chunk_doc WHERE id IS NOT NULL GROUP BY id)"
_HITS = f"""{_FILES}, hits AS (SELECT f.a AS repo, f.b AS relative_path, id, score FROM (SELECT id, max(score) AS score FROM chunk_search_hit WHERE score IS NOT NULL GROUP BY id) z JOIN files USING (id))"""
_HIDDEN = "hidden AS (SELECT DISTINCT repo, relative_path FROM file_state WHERE ends_with(relative_path, '.rs'))"
_PARTS = f"WITH {_WEIGHTS}, parts AS ({_source_sql('search_document', 'dense', 'dw')} UNION ALL {_source_sql('chunk_search_hit', 'lexical', 'lw')})"
_FUSED = f"""{_PARTS}, fused AS (SELECT query_id, id, round(sum(part), 6) AS score, round(coalesce(sum(part) FILTER (source = 'dense'), 0), 6) AS dense_score, round(coalesce(sum(part) FILTER (source = 'lexical'), 0), 6) AS lexical_score,
  CASE WHEN count(*) FILTER (part > 0) > 1 THEN 'hybrid' WHEN count(*) FILTER (part > 0) = 1 THEN max(source) FILTER (part > 0) ELSE 'unknown' END AS match_type FROM parts GROUP BY query_id, id)"""
_T = terms_sql("coalesce(query, '')")
_FLAVOR = f"""asked AS (SELECT query_id, query FROM search_query), {KIND},
flavor AS (SELECT query_id, kind, CASE kind WHEN 'identifier' THEN 'identifiers basename path content' WHEN 'path' THEN 'path basename identifiers' WHEN 'mixed' THEN 'content identifiers path basename' ELSE 'content identifiers basename path' END AS fields,
  CASE WHEN kind IN ('identifier', 'path') THEN array_to_string({_T}, ' ') WHEN kind = 'mixed' THEN q || ' ' || array_to_string({_T}, ' ') ELSE q END AS text FROM kinds)"""
_SYMBOL_LIST = """SELECT repo, symbol_id, '{0}' AS source, {1} / (100 + rank + 1) + 0.35::DOUBLE * {1} * least(greatest(score / greatest(most, 1.0), 0.0), 1.25) AS part
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, symbol_id) - 1 AS rank FROM (SELECT *, max(score) OVER (PARTITION BY repo) AS most FROM {2}) y) z WHERE rank < {3}"""
def _flavored_sql() -> str:
    made = _bm25_sql("chunks", _FIELDS, "id", "id")
    head, tail = made.split("asked AS (", 1)
    tail = "scored AS (" + tail.split("scored AS (", 1)[1]
    for f in _FIELDS:
        tail = tail.replace(f"JOIN d_{f} USING (term) JOIN asked USING (term)", f"JOIN d_{f} USING (term) JOIN (SELECT query_id, term FROM wanted WHERE list_contains(string_split(fields, ' '), '{f}')) x USING (term)")
    words = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda x: x <> '')"
    terms = f"CASE WHEN kind = 'natural_language' THEN list_concat({words}, {terms_sql('text')}) ELSE {words} END"
    return f"WITH chunks AS (SELECT DISTINCT id, repo, relative_path, content FROM chunk_doc WHERE id IS NOT NULL), {_FLAVOR}, wanted AS (SELECT DISTINCT query_id, fields, unnest({terms}) AS term FROM flavor), {head}{tail}"


_NAME = r"list_extract(string_split(trim(replace(relative_path, '\', '/'), '/'), '/'), -1)"
SQL = {
    "chunk_filters": "SELECT DISTINCT id FROM chunk_doc WHERE starts_with(relative_path, 'src') AND language = 'rust' AND extension IN ('.rs', '.py')",
    "flavor_fields": f"WITH {_FLAVOR} SELECT query_id, kind, fields, text FROM flavor",
    "flavored_search": _flavored_sql(),
    "symbol_texts": f"WITH {LATEST} SELECT repo, symbol_id, kind || ' ' || name || ' in ' || CASE WHEN coalesce(container, '') <> '' THEN container ELSE 'root' END || ' from ' || relative_path || ' (' || language || ')' AS text FROM latest WHERE name IS NOT NULL AND kind IS NOT NULL AND relative_path IS NOT NULL AND language IS NOT NULL",
    "symbol_fusion": f"""WITH {LATEST}, near AS ({_dense_sql("").removesuffix("ORDER BY score DESC, id LIMIT 50").replace("SELECT DISTINCT id, vector::DOUBLE[] AS v FROM vector_doc WHERE vector IS NOT NULL AND len(vector) = 64 ", "SELECT id, max(vector)::DOUBLE[] AS v FROM vector_doc WHERE id IS NOT NULL AND vector IS NOT NULL GROUP BY id HAVING len(max(vector)) = 64")}),
named AS (SELECT * FROM (SELECT repo, symbol_id, (CASE WHEN lower(name) = 'kernel' THEN 8.0 ELSE 0 END + CASE WHEN lower({_NAME}) = 'kernel' THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(relative_path), 'kernel') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(container, '')), 'kernel') THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM latest) z WHERE score > 0),
starts AS (SELECT DISTINCT repo, relative_path, start_line, n.id, score FROM chunk_doc c JOIN near n ON c.id = n.id),
byvec AS (SELECT l.repo, l.symbol_id, max(score) AS score FROM latest l JOIN starts s ON l.repo = s.repo AND l.relative_path = s.relative_path AND l.start_line = s.start_line GROUP BY ALL),
parts AS ({_SYMBOL_LIST.format("lexical", "0.55::DOUBLE", "named", 5)} UNION ALL {_SYMBOL_LIST.format("semantic", "0.45::DOUBLE", "byvec", 20)}),
f AS (SELECT repo, symbol_id, sum(part) AS score, CASE WHEN count(*) FILTER (part > 0) > 1 THEN 'hybrid' WHEN count(*) FILTER (part > 0) = 1 THEN max(source) FILTER (part > 0) ELSE 'unknown' END AS match_type FROM parts GROUP BY repo, symbol_id),
r AS (SELECT f.*, l.name, row_number() OVER (PARTITION BY f.repo ORDER BY score DESC, f.symbol_id) AS position FROM f JOIN latest l ON f.repo = l.repo AND f.symbol_id = l.symbol_id)
SELECT repo, symbol_id, position, round(score, 6) AS score, match_type, name FROM r WHERE position <= 5""",
    "source_scores": _FUSED + " SELECT query_id, id, score, dense_score, lexical_score, match_type FROM fused",
    "overlay_union_topk": f"""WITH {_HITS}, {_HIDDEN}, every AS (SELECT repo, relative_path, id, score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hidden x WHERE x.repo = h.repo AND x.relative_path = h.relative_path)
  UNION ALL SELECT repo, relative_path, 'overlay:' || id, score + 1 FROM hits WHERE ends_with(relative_path, '.rs'))
SELECT repo, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, relative_path, id) - 1 AS rank FROM every) z WHERE rank < 3""",
    "overlay_candidates": f"""WITH {_HIDDEN}, f AS (SELECT DISTINCT repo, relative_path FROM chunk_doc WHERE repo IS NOT NULL AND relative_path IS NOT NULL)
SELECT repo, relative_path FROM f WHERE NOT EXISTS (SELECT 1 FROM hidden x WHERE x.repo = f.repo AND x.relative_path = f.relative_path) OR ends_with(relative_path, '.rs')""",
    "overlay_lookup": """WITH a AS (SELECT repo, relative_path, max(file_hash) AS h FROM chunk_doc WHERE relative_path IS NOT NULL AND file_hash IS NOT NULL GROUP BY ALL), b AS (SELECT repo, relative_path, max(file_hash) AS h FROM file_state GROUP BY ALL)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN a.relative_path IS NOT NULL THEN a.h ELSE b.h END AS file_hash FROM a FULL JOIN b ON a.repo = b.repo AND a.relative_path = b.relative_path""",
    "file_metadata": f"""WITH {LATEST}, a AS (SELECT repo, relative_path, indexed_at, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, relative_path ORDER BY start_line, end_line, id) AS rn FROM chunk_doc WHERE repo IS NOT NULL AND relative_path IS NOT NULL) z WHERE rn = 1),
b AS (SELECT repo, relative_path, indexed_at, file_hash FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY repo, relative_path ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, symbol_id) AS rn FROM latest WHERE relative_path IS NOT NULL) z WHERE rn = 1)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.relative_path, b.relative_path) AS relative_path, coalesce(a.indexed_at, b.indexed_at, '') AS indexed_at, coalesce(a.file_hash, b.file_hash, '') AS file_hash FROM a FULL JOIN b ON a.repo = b.repo AND a.relative_path = b.relative_path""",
    "profile_usage": "SELECT coalesce(embedding_profile, '') AS profile, count(DISTINCT repo) AS repos FROM repo_state WHERE repo IS NOT NULL GROUP BY 1",
    "status_filters": "SELECT repo, CASE WHEN status = 'indexfailed' THEN 'status' ELSE 'profile' END AS reason FROM repo_state WHERE repo IS NOT NULL AND (coalesce(status = 'indexfailed', false) OR embedding_profile IS DISTINCT FROM 'default')",
    "response_rows": _FUSED
    + """, files AS (SELECT id, min({'repo': repo, 'relative_path': relative_path, 'start_line': start_line, 'end_line': end_line}) AS f FROM chunk_doc WHERE id IS NOT NULL GROUP BY id),
h AS (SELECT query_id, id, score, f.repo AS repo, f.relative_path AS relative_path, f.start_line AS start_line, f.end_line AS end_line FROM fused JOIN files USING (id)), n AS (SELECT query_id, count(DISTINCT repo) AS n FROM h GROUP BY query_id)
SELECT h.query_id, id, CASE WHEN n > 1 THEN repo END AS repo, relative_path, start_line, end_line, score FROM h JOIN n ON h.query_id = n.query_id""",
    "restart_healing": "SELECT repo, CASE WHEN status = 'indexing' THEN 'indexfailed' ELSE status END AS status, CASE WHEN status = 'indexing' THEN 'interrupted by a restart' ELSE coalesce(error_message, '') END AS error_message FROM repo_state",
    "audit_decisions": """SELECT repo, CASE WHEN indexed_files IS NULL THEN 'clear' WHEN indexed_files % 2 <> 0 AND last_head IS DISTINCT FROM 'new' THEN 'index' ELSE 'record' END AS action FROM repo_state WHERE repo IS NOT NULL AND status = 'indexed'""",
    "runnable_jobs": "SELECT repo, row_number() OVER (ORDER BY repo) AS position FROM repo_state WHERE repo IS NOT NULL AND coalesce(total_chunks, 0) % 2 = 0 AND coalesce(status, '') <> 'indexfailed'",
}
