"""Queries over paths, terms, query classification and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import planner
from skein.functions import text as T
from skein.runtime import table


def _n(x):
    return x.cast("long")


def identifier_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbol_row").select("repo", "symbol_id", "name").distinct()
    return rows.select("repo", "symbol_id", "name", F.array_join(T.terms(F.coalesce("name", F.lit(""))), " ").alias("terms"))


def path_terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunk_doc").select("relative_path").distinct()
    return p.select("relative_path", F.array_join(T.terms(F.col("relative_path")), " ").alias("terms"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "file_state").select("relative_path").distinct()
    c = F.col("relative_path")
    return p.select(c, T.normalized_path(c).alias("path"), T.basename(c).alias("basename"), T.extension(c).alias("extension"), T.language(T.extension(c)).alias("language"))


def prefix_filters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "file_state").select("repo", "relative_path").distinct()
    c = F.col("relative_path")
    plain, whole = c.startswith("src"), T.under_prefix(c, F.lit("src"))
    return p.groupBy("repo").agg(F.count_if(plain).alias("plain"), F.count_if(whole).alias("by_segment"))


def classify_queries(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of all queries, and of whole documents taken as queries."""
    q = table(spark, d, "search_query").select("query_id", "query")
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("query_id"), F.col("text").alias("query"))
    return q.unionByName(docs).select("query_id", planner.classify(F.col("query")).alias("kind"))


def plan_weights(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(table(spark, d, "search_query").select("query_id", "query")).drop("query")


def plan_weights_in_file(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(table(spark, d, "search_query").select("query_id", "query"), scoped=True, language=True, one_file=True).drop("query")


def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vector_doc").select("id", "metadata").distinct()
    field = {n: T.json_string(F.col("metadata"), n) for n in ("codebasePath", "language", "basename", "chunkIndex")}
    return rows.select("id", field["codebasePath"].alias("repo"), field["language"].alias("language"), field["basename"].alias("basename"), F.coalesce(field["chunkIndex"].try_cast("long"), F.lit(-1)).cast("long").alias("chunk_index"))


def rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_document").select("query_id", "id", "score").distinct()
    return rows.select("query_id", "id", T.rounded(T.positive(F.col("score"))).alias("score"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """A snippet of every chunk; of repeated rows each distinct one gives a row."""
    rows = table(spark, d, "chunk_doc").where("id is not null")
    return rows.select("id", F.md5(T.snippet(F.lit("return broker"), F.col("content"), 220)).alias("snippet_md5")).distinct()


def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_doc").select("id", T.preview(F.col("content"), 180).alias("preview")).distinct()


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids recomputed from path, lines and content with xxh3."""
    rows = table(spark, d, "chunk_doc").select("id", "relative_path", "start_line", "end_line", "content").distinct()
    return rows.select("id", T.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("computed_id"))


_TERMS = "lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'))"


def terms_sql(text: str) -> str:
    return f"list_filter(string_split({_TERMS.format(text)}, ' '), lambda x: x <> '')"


NORMAL = r"trim(replace({0}, '\', '/'), '/')"
_BASE = f"list_extract(string_split({NORMAL.format('relative_path')}, '/'), -1)"
_EXT = f"regexp_extract({_BASE}, '^.+(\\.[^.]+)$', 1)"
_LANG = "CASE " + " ".join(f"WHEN extension = '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'text' END"
_STOPS = ", ".join(f"'{w}'" for w in planner.STOP_WORDS)
KIND = f"""
signals AS (
  SELECT *, regexp_replace(coalesce(query, ''), '^{T.BLANKS}+|{T.BLANKS}+$', '', 'g') AS q,
         list_filter(string_split_regex(coalesce(query, ''), '{T.BLANKS}+'), lambda w: w <> '') AS words FROM asked),
measured AS (
  SELECT *, len(words) AS n, len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS stops,
         list_extract(string_split(q, '/'), -1) AS last FROM signals),
flags AS (
  SELECT *, regexp_matches(q, '[/\\\\]|::') OR (contains(last, '.') AND NOT starts_with(last, '.') AND regexp_matches(last, '[A-Za-z]')) AS p,
         regexp_matches(q, '[_()<>#A-Z]|->') OR (n = 1 AND regexp_matches(q, '^[A-Za-z0-9_:-]+$')) AS i,
         starts_with(q, '"') AND ends_with(q, '"') AND length(q) > 2 AS ph FROM measured),
kinds AS (
  SELECT *, CASE WHEN q = '' THEN 'natural_language'
    WHEN p THEN CASE WHEN n > 1 AND (i OR stops > 0 OR ph) THEN 'mixed' ELSE 'path' END
    WHEN i THEN CASE WHEN n > 2 AND stops > 0 THEN 'mixed' ELSE 'identifier' END
    WHEN stops > 0 AND n >= 3 THEN 'natural_language' WHEN n > 1 THEN 'mixed' ELSE 'identifier' END AS kind FROM flags)
"""


def _plan_sql(narrowed: bool) -> str:
    dense = "CASE mode WHEN 'semantic' THEN 2.0 WHEN 'hybrid' THEN 1.3 ELSE 0.0 END"
    if narrowed:
        dense = f"CASE WHEN {dense} > 0 THEN greatest({dense} - 0.15, 0.15) ELSE 0.0 END"
    a, b, c = ("+ 0.35 + 0.1", "+ 0.1 + 0.15", "0.1") if narrowed else ("", "", "0.0")
    lex = f"(CASE kind WHEN 'natural_language' THEN 0.35 WHEN 'mixed' THEN 0.55 ELSE 1.0 END + {c})"
    sem = f"greatest(CASE kind WHEN 'natural_language' THEN 0.65 WHEN 'mixed' THEN 0.45 ELSE 0.0 END - {c}, 0.0)"
    return f"""WITH asked AS (SELECT query_id, query FROM search_query), {KIND},
moded AS (SELECT *, CASE kind WHEN 'natural_language' THEN 'semantic' WHEN 'identifier' THEN 'identifier' WHEN 'path' THEN 'path' ELSE 'hybrid' END AS mode FROM kinds)
SELECT query_id, kind, mode, CAST(round({dense}, 6) AS DOUBLE) AS dense_weight,
  CAST(round(CASE mode WHEN 'semantic' THEN 0.6 WHEN 'hybrid' THEN 1.5 WHEN 'identifier' THEN 2.35 ELSE 2.5 END {a}, 6) AS DOUBLE) AS lexical_weight,
  CAST(round(CASE mode WHEN 'semantic' THEN 0.6 WHEN 'hybrid' THEN 1.2 WHEN 'identifier' THEN 2.15 ELSE 1.1 END {b}, 6) AS DOUBLE) AS symbol_weight,
  round(CAST({lex} AS DOUBLE) / CAST({lex} + {sem} AS DOUBLE), 6) AS symbol_lexical_share,
  round(CAST({sem} AS DOUBLE) / CAST({lex} + {sem} AS DOUBLE), 6) AS symbol_semantic_share,
  CAST(CASE WHEN mode IN ('semantic', 'hybrid') THEN 2 ELSE 1 END AS BIGINT) AS neighbours FROM moded"""


def _json(key: str) -> str:
    return f"CASE WHEN json_type(m, '$.{key}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(m, '$.{key}') END"


QUERIES = {f.__name__: f for f in (identifier_terms, path_terms, path_parts, prefix_filters, classify_queries, plan_weights, plan_weights_in_file, json_metadata, rounded_scores, snippets, previews, chunk_ids)}
SQL = {
    "identifier_terms": f"SELECT repo, symbol_id, name, array_to_string({terms_sql('coalesce(name, $$$$)')}, ' ') AS terms FROM (SELECT DISTINCT repo, symbol_id, name FROM symbol_row)",
    "path_terms": f"SELECT relative_path, array_to_string({terms_sql('relative_path')}, ' ') AS terms FROM (SELECT DISTINCT relative_path FROM chunk_doc)",
    "path_parts": f"WITH p AS (SELECT DISTINCT relative_path FROM file_state), e AS (SELECT relative_path, {NORMAL.format('relative_path')} AS path, {_BASE} AS basename, {_EXT} AS extension FROM p) SELECT *, {_LANG} AS language FROM e",
    "prefix_filters": "SELECT repo, count(*) FILTER (starts_with(relative_path, 'src')) AS plain, count(*) FILTER (relative_path = 'src' OR starts_with(relative_path, 'src/')) AS by_segment FROM (SELECT DISTINCT repo, relative_path FROM file_state) GROUP BY repo",
    "classify_queries": f"WITH asked AS (SELECT query_id, query FROM search_query UNION ALL SELECT 'd' || doc_id, text FROM documents), {KIND} SELECT query_id, kind FROM kinds",
    "plan_weights": _plan_sql(False),
    "plan_weights_in_file": _plan_sql(True),
    "json_metadata": f"""WITH r AS (SELECT DISTINCT id, metadata FROM vector_doc), j AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM r)
SELECT id, {_json("codebasePath")} AS repo, {_json("language")} AS language, {_json("basename")} AS basename, coalesce(try_cast({_json("chunkIndex")} AS BIGINT), -1) AS chunk_index FROM j""",
    "rounded_scores": "SELECT query_id, id, CASE WHEN score > 0 THEN round(score, 6) END AS score FROM (SELECT DISTINCT query_id, id, score FROM search_document)",
    "snippets": r"""WITH c AS (SELECT DISTINCT id, content, lower(replace(content, 'İ', 'i')) AS low FROM chunk_doc),
f AS (SELECT *, CASE WHEN instr(low, 'return') > 0 THEN instr(low, 'return') - 1 WHEN instr(low, 'broker') > 0 THEN instr(low, 'broker') - 1 END AS at_ FROM c),
w AS (SELECT *, greatest(at_ - 73, 0) AS a, least(at_ + 146, length(content)) AS b FROM f)
SELECT id, md5(CASE WHEN length(content) <= 220 THEN content
  WHEN at_ IS NOT NULL THEN CASE WHEN a > 0 THEN '...' ELSE '' END || substr(content, a + 1, b - a) || CASE WHEN b < length(content) THEN '...' ELSE '' END
  ELSE substr(content, 1, 220) || chr(10) || '...' END) AS snippet_md5 FROM w""",
    "previews": "WITH c AS (SELECT id, trim(content, chr(13) || chr(10)) AS t FROM (SELECT DISTINCT id, content FROM chunk_doc)) SELECT id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || chr(10) || '...' ELSE t END AS preview FROM c",
}
