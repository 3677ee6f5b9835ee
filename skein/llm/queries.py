"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, neardup, packing, provenance, ranking, secrets, splitting, syntax, tokens, vectors
from skein.runtime import Stage, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lists = [ranking.rank_transform(table(spark, d, t), "query_id", "id", "score") for t in ("search_document", "chunk_search_hit")]
    limits = table(spark, d, "search_query").select(F.col("query_id").alias("group"), "top_n")
    return ranking.top_items(ranking.fuse(lists), limits).select(F.col("group").alias("query_id"), F.col("item").alias("id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(*neardup.similar_classes(table(spark, d, "chunk_doc"), "id", "content"), star_above=None)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk with the class of its equal word counts and the number of similar classes."""
    members, links = neardup.similar_classes(table(spark, d, "chunk_doc"), "id", "content")
    both = links.select(F.col("cls_1").alias("cls")).unionByName(links.select(F.col("cls_2").alias("cls")))
    n = both.groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    heads = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    return members.join(heads, "cls").join(n, "cls", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.mark_files(table(spark, d, "chunk_doc")).where("marked").select("repo", "relative_path")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Every code file with its label, the forest's score and the mark."""
    return provenance.mark_files(table(spark, d, "chunk_doc"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.detect(table(spark, d, "chunk_doc"), table(spark, d, "vector_doc")).select("tab", "id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "chunk_doc"), table(spark, d, "vector_doc"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both tables with secrets redacted; those without one are unchanged."""
    return secrets.redact(table(spark, d, "chunk_doc"), table(spark, d, "vector_doc"), only_changed=False)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "chunk_doc")).where("state != 'valid'").select("repo", "relative_path")


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file of a supported extension with its state and the language whose grammar it fits."""
    return syntax.check_files(table(spark, d, "chunk_doc"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.check_files(table(spark, d, "chunk_doc")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.neighbours(table(spark, d, "vector_doc"), "id", "vector")
    return near.select(F.least("id", "neighbour").alias("id_1"), F.greatest("id", "neighbour").alias("id_2")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every id's most similar others with their similarity."""
    return vectors.neighbours(table(spark, d, "vector_doc"), "id", "vector").withColumn("similarity", F.round("similarity", 6))


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same without loss: pruning by the whole triangle inequality."""
    return vectors.neighbours(table(spark, d, "vector_doc"), "id", "vector", slack=1.0).select("id", "neighbour", F.round("similarity", 6).alias("similarity"))


def _limits(spark: SparkSession, d: str) -> dict[str, int]:
    """The named sizes; the table has a row for each and does not grow."""
    return {r["limit_name"]: int(r["n_tokens"]) for r in table(spark, d, "size_limit").where(F.col("limit_name").isin("container_capacity", "piece_limit", "piece_overlap") & F.col("n_tokens").isNotNull()).collect()}


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, counted once."""
    docs = table(spark, d, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("source"), "text")
    return Stage(spark, "sizes").save(tokens.counted(docs, ["doc_id", "source"], "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text's (or oversized text's part's) container."""
    return packing.pack(_sized(spark, d), _limits(spark, d)["container_capacity"])


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sized, capacity = _sized(spark, d), _limits(spark, d)["container_capacity"]
    return packing.report(sized, packing.pack(sized, capacity), capacity)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must keep: texts with tokens, of them packed whole, containers over the capacity."""
    sized, capacity = _sized(spark, d), _limits(spark, d)["container_capacity"]
    packed = Stage(spark, "checks").save(packing.pack(sized, capacity))
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("over_capacity"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"))
    texts = sized.where("n_tokens > 0").join(whole, "doc_id", "left").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("packed") == F.col("n_tokens")).alias("packed_whole"))
    return texts.crossJoin(over)  # one row each


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every taken copy of a text with its training position."""
    sized = _sized(spark, d)
    return mixing.mix(sized, mixing.plan(sized, table(spark, d, "mix_target")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    plan = mixing.plan(sized, table(spark, d, "mix_target"))
    return mixing.shares(mixing.mix(sized, plan), plan)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What any mix must keep, per target source: no text more often than allowed, nothing from elsewhere, no copy twice."""
    sized = _sized(spark, d)
    plan = mixing.plan(sized, table(spark, d, "mix_target"))
    mixed = Stage(spark, "checks").save(mixing.mix(sized, plan))
    copies = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("different")).groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("different")).alias("apart"))
    both = plan.select("source", "max_repeat").join(copies, "source", "full_outer")
    fine = F.coalesce(F.col("apart") & (F.col("most") <= F.col("max_repeat")), F.col("max_repeat").isNotNull())
    return both.select("source", F.col("max_repeat").cast("long").alias("max_repeat"), fine.alias("kept"))


def p10_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The bodies of every text's pieces put together again, and whether each piece keeps to the limit."""
    limits = _limits(spark, d)
    pieces = splitting.split_all(table(spark, d, "documents"), limits["piece_limit"], limits["piece_overlap"])
    body = F.substring("text", F.col("body_start") - F.col("start") + 1, F.col("stop") - F.col("body_start"))
    parts = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", body.alias("body")))).alias("parts"), F.max("n_tokens").alias("most"))
    return parts.select("doc_id", F.md5(F.array_join(F.transform("parts", lambda x: x["body"]), "")).alias("text_md5"), (F.col("most") <= limits["piece_limit"]).alias("within_limit"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = _limits(spark, d)
    return splitting.split_all(table(spark, d, "documents"), limits["piece_limit"], limits["piece_overlap"])


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def _ranks(table_: str) -> str:
    return f"""SELECT query_id, id, (low + (ties - 1) / 2.0::DOUBLE) / n AS value FROM (
  SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY s) AS low, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id, s) AS ties
  FROM (SELECT query_id, id, max(score) AS s FROM {table_} WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL) a) b"""


_W = "0.7071067811865475::DOUBLE"
#: Two lists of equal standing: the first principal component is their even mix, whatever their correlation.
_P2 = f"""WITH v AS (SELECT *, 1 AS l FROM ({_ranks("search_document")}) x UNION ALL SELECT *, 2 FROM ({_ranks("chunk_search_hit")}) y),
w AS (SELECT query_id, id, coalesce(max(value) FILTER (l = 1), 0.0) AS a, coalesce(max(value) FILTER (l = 2), 0.0) AS b FROM v GROUP BY ALL),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(a * {_W} + b * {_W}, 12) DESC, id) AS position FROM w)
SELECT r.query_id, r.id FROM r JOIN search_query q ON r.query_id = q.query_id WHERE r.position <= q.top_n"""
_P3 = """WITH t AS (SELECT DISTINCT id, lower(content) AS c FROM chunk_doc WHERE id IS NOT NULL AND content IS NOT NULL),
words AS (SELECT id, unnest(regexp_extract_all(c, '[a-z0-9_]{3,}')) AS w FROM t),
tf AS (SELECT id, w, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT id, sum(n) AS s FROM tf GROUP BY id HAVING sum(n) >= 30),
kept AS (SELECT tf.* FROM tf JOIN total USING (id)),
shared AS (SELECT a.id AS id_1, b.id AS id_2, sum(least(a.n, b.n)) AS m FROM kept a JOIN kept b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT id_1, id_2 FROM shared JOIN total x ON x.id = id_1 JOIN total y ON y.id = id_2 WHERE m >= 0.7 * (x.s + y.s - m)"""


_P3_CLASSES = """WITH t AS (SELECT DISTINCT id, lower(content) AS c FROM chunk_doc WHERE id IS NOT NULL AND content IS NOT NULL),
words AS (SELECT id, unnest(regexp_extract_all(c, '[a-z0-9_]{3,}')) AS w FROM t),
tf AS (SELECT id, w, count(*) AS n FROM words GROUP BY ALL),
member AS (SELECT id, sum(n) AS s, md5(string_agg(w || ':' || n, ' ' ORDER BY w)) AS cls FROM tf GROUP BY id HAVING sum(n) >= 30),
head AS (SELECT cls, min(id) AS class_id, first(s) AS s FROM member GROUP BY cls),
kept AS (SELECT class_id AS id, w, n FROM head JOIN tf ON tf.id = class_id),
shared AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS m FROM kept a JOIN kept b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
links AS (SELECT x AS class_id, count(*) AS n_links FROM shared JOIN head h ON h.class_id = x JOIN head g ON g.class_id = y WHERE m >= 0.7 * (h.s + g.s - m) GROUP BY x)
SELECT id, h.class_id, coalesce(n_links, 0) AS n_links FROM member JOIN head h USING (cls) LEFT JOIN links l ON l.class_id = h.class_id"""
_P7_EXACT = """WITH v AS (SELECT id, max(vector) AS v FROM vector_doc WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
d AS (SELECT id, v::DOUBLE[64] AS v, sqrt(list_sum(list_transform(v::DOUBLE[], lambda x: x * x))) AS norm FROM v),
p AS (SELECT a.id, b.id AS neighbour, round(array_inner_product(a.v, b.v) / (a.norm * b.norm), 10) AS similarity FROM d a JOIN d b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rn FROM p WHERE similarity >= 0.8)
SELECT id, neighbour, round(similarity, 6) AS similarity FROM r WHERE rn <= 5"""
_P8_CHECKS = "SELECT count(*) AS texts, count(*) AS packed_whole, 0::BIGINT AS over_capacity FROM documents WHERE text <> ''"
_P9_CHECKS = "SELECT lower(trim(source, ' ')) AS source, max(coalesce(max_repeat, 1))::BIGINT AS max_repeat, true AS kept FROM mix_target WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1"
_P10_REJOINED = "SELECT doc_id, md5(text) AS text_md5, true AS within_limit FROM documents WHERE doc_id IS NOT NULL AND text <> ''"


def oracle_sql() -> dict[str, str]:
    """The other queries are checked against brute force, round trips or held-out accuracy in the tests."""
    return {"p2_found": _P2, "p3_found": _P3, "p3_classes": _P3_CLASSES, "p7_exact": _P7_EXACT, "p8_checks": _P8_CHECKS, "p9_checks": _P9_CHECKS, "p10_rejoined": _P10_REJOINED}
