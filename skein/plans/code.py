"""Queries over symbols, lines and places to edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lines, symbols
from skein.plans.search import LATEST
from skein.runtime import table

FILE = ["repo", "relative_path"]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk id, the greatest of differing ones."""
    rows = table(spark, d, "chunk_doc")
    rest = [c for c in rows.columns if c != "id"]
    return rows.where("id is not null").groupBy("id").agg(F.max(F.struct(*rest)).alias("x")).select("id", "x.*")


def _matches(spark: SparkSession, d: str, needle: str, keys: list[str], **how: bool) -> DataFrame:
    """Lines with the needle: the filter comes right above the scan, and only what it leaves is freed of repeated rows."""
    rows = table(spark, d, "chunk_doc").where("id is not null").withColumn("first", F.col("start_line"))
    return lines.literal_matches(rows, keys, "content", needle, **how).groupBy(*keys, "line_no").agg(F.max("n_matches").alias("n_matches"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols.latest_symbols(table(spark, d, "symbol_row"))


def latest_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select("repo", "symbol_id", "relative_path", "name", "kind", "container", "parent_symbol_id")


def symbol_filters(spark: SparkSession, d: str) -> DataFrame:
    return symbols.filtered(_symbols(spark, d), prefix="src", language="java", kind="method", container="e").select("repo", "symbol_id", "name")


def symbol_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    return symbols.chunk_of_symbol(_symbols(spark, d).where("start_line is not null"), _chunks(spark, d))


def symbol_rows_joined(spark: SparkSession, d: str) -> DataFrame:
    """Symbol hits (all rows, outdated ones too) with the values of the stored symbol."""
    hits = table(spark, d, "symbol_row").select("repo", "symbol_id", "name", "kind", "start_line", "end_line").distinct()
    joined = symbols.authoritative(hits, _symbols(spark, d)).select("repo", "symbol_id", "name", "kind", "start_line", "end_line").distinct()
    return joined.select("repo", "symbol_id", "name", "kind", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("start_line", "end_line")))


def outline_tree(spark: SparkSession, d: str) -> DataFrame:
    return symbols.outline(_symbols(spark, d).where("relative_path is not null"), most_nodes=12, top_level=8, depth=2)


def line_index(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every chunk, numbered in their file."""
    numbered = lines.numbered(_chunks(spark, d).where("content is not null"), ["id"], "content", F.col("start_line"))
    return numbered.select("id", "line_no", F.md5("line").alias("line_md5"))


def literal_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, "return", ["id"], case_sensitive=True)


def literal_matches_any_case(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, "TOKEN", ["id"], case_sensitive=False)


def literal_whole_word(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, "return", ["id"], whole_word=True)


def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first lines with the literal, by path and line: the feature is a top-k."""
    found = _matches(spark, d, "token", ["repo", "relative_path", "id", "first"])
    at = (F.col("first") + F.col("line_no") - 1).cast("long").alias("line_no")
    return found.select("repo", "relative_path", at, "id").orderBy("repo", "relative_path", "line_no", "id").limit(50)


def literal_spans(spark: SparkSession, d: str) -> DataFrame:
    """Byte offsets and lines of a literal that goes over a line end."""
    rows = table(spark, d, "chunk_doc").where("id is not null")
    return lines.literal_spans(rows, ["id"], "content", ";\n").distinct()


def narrowest_symbol(spark: SparkSession, d: str) -> DataFrame:
    """For the start line of every chunk the smallest symbol of its file that covers it."""
    places = _chunks(spark, d).select(*FILE, "id", F.col("start_line").alias("line_no"))
    spans = _symbols(spark, d).where("start_line <= end_line").select(*FILE, "symbol_id", "start_line", "end_line")
    return lines.narrowest(places, spans, FILE, "symbol_id").select("id", "symbol_id")


def match_pick(spark: SparkSession, d: str) -> DataFrame:
    return lines.pick(_matches(spark, d, "return", ["id"]).withColumn("hint", F.lit(10)), ["id"], "hint")


def match_nth(spark: SparkSession, d: str) -> DataFrame:
    """The second line with the literal, and the line of texts that have just one."""
    found = _matches(spark, d, "return", ["id"])
    return lines.pick_nth(found, ["id"], 2).withColumn("rule", F.lit("second")).unionByName(lines.pick_nth(found, ["id"]).withColumn("rule", F.lit("only")))


def _anchors(spark: SparkSession, d: str, count: int, query: str | None = None) -> DataFrame:
    """Anchors of every chunk, with uniqueness in its whole file."""
    return lines.anchors(lines.numbered(_chunks(spark, d), [*FILE, "id", "start_line"], "content", F.col("start_line")), ["id"], count, query, file=FILE, start="start_line", signature="start_line")


def anchor_rank(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d, 2, "return")


def line_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.numbered(_chunks(spark, d), FILE, "content").withColumn("line", T.trimmed(F.col("line"))).where("line != ''")
    return rows.groupBy(*FILE, F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def bounded_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window around every symbol in its file."""
    total = table(spark, d, "chunk_doc").groupBy(*FILE).agg(F.max("end_line").alias("total"))
    rows = _symbols(spark, d).where("start_line <= end_line").join(total, FILE)
    return rows.select("repo", "symbol_id", lines.bounded_window(F.col("total"), F.col("start_line"), F.col("end_line"), 8, 24, 40).alias("w")).select("repo", "symbol_id", "w.start", "w.end", "w.truncated")


def neighbor_context(spark: SparkSession, d: str) -> DataFrame:
    return lines.with_neighbours(_chunks(spark, d), 2).select("id", F.md5("context").alias("context_md5"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return lines.overlapped(_chunks(spark, d)).select("id", "start_line", F.md5("content").alias("content_md5"))


def window_ready(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("end_line") - F.col("start_line") + 1).cast("long")
    unique = _anchors(spark, d, 3).groupBy("id").agg(F.count_if("unique_in_file").alias("u"))
    return _chunks(spark, d).join(unique, "id", "left").select("id", lines.readiness(size, F.coalesce("u", F.lit(0))).alias("state"))


def line_slices(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.md5(T.line_slice(F.col("content"), 2, 4)).alias("slice_md5"))


_C = "c AS (SELECT DISTINCT id, repo, relative_path, content, start_line, end_line FROM chunk_doc)"
_LINES = "CASE WHEN ends_with({0}, chr(10)) THEN string_split(left({0}, length({0}) - 1), chr(10)) ELSE string_split({0}, chr(10)) END"
_NUMBERED = f"l AS (SELECT id, repo, relative_path, start_line, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT *, {_LINES.format('content')} AS ls FROM c) z)"
_TRIM = f"regexp_replace(line, '^{T.BLANKS}+|{T.BLANKS}+$', '', 'g')"
_ANCHORS = f"""{_NUMBERED},
t AS (SELECT id, repo, relative_path, start_line, line_no + start_line - 1 AS line_no, line, {_TRIM} AS anchor FROM l),
n AS (SELECT repo, relative_path, anchor, count(DISTINCT line_no) AS seen FROM t WHERE anchor <> '' GROUP BY ALL),
s AS (SELECT id, line_no, anchor, seen = 1 AS unique_in_file, CASE WHEN seen = 1 THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(anchor, '[=:()\\[\\]{{}}]') THEN 25 ELSE 0 END + 100 - (line_no - start_line)
  + CASE WHEN line_no = start_line THEN 500 ELSE 0 END + QUERY AS score FROM t JOIN n USING (repo, relative_path, anchor) WHERE regexp_matches(anchor, '[\\p{{L}}\\p{{N}}]')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, line_no) AS rn FROM s)"""


def _literal(needle: str, column: str, ctes: str = "") -> str:
    return f"WITH {_C}, {_NUMBERED} SELECT id, line_no, (length({column}) - length(replace({column}, '{needle}', ''))) // {len(needle)} AS n_matches FROM l WHERE contains({column}, '{needle}')"


QUERIES = {
    f.__name__: f
    for f in (latest_symbols, symbol_filters, symbol_to_chunk, symbol_rows_joined, outline_tree, line_index, literal_matches, literal_matches_any_case, literal_whole_word, text_search_topk, narrowest_symbol, match_pick, match_nth, literal_spans, bounded_windows, anchor_rank, line_histogram, neighbor_context, chunk_overlap, window_ready, line_slices)
}
SQL = {
    "outline_tree": f"""WITH RECURSIVE {LATEST},
nodes AS (SELECT repo, relative_path, symbol_id, name, kind, coalesce(parent_symbol_id, '') AS parent, {{'a': coalesce(start_line, -1), 'b': coalesce(end_line, -1), 'c': coalesce(name, ''), 'd': symbol_id}} AS key FROM latest WHERE relative_path IS NOT NULL),
walk AS (SELECT repo, relative_path, symbol_id, name, kind, CAST(0 AS BIGINT) AS depth, [key] AS place FROM nodes WHERE parent = ''
  UNION ALL SELECT n.repo, n.relative_path, n.symbol_id, n.name, n.kind, w.depth + 1, list_append(w.place, n.key) FROM walk w JOIN nodes n ON n.repo = w.repo AND n.relative_path = w.relative_path AND n.parent = w.symbol_id),
z AS (SELECT *, count(*) OVER (PARTITION BY repo, relative_path) AS all_nodes FROM walk),
o AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, relative_path ORDER BY place ROWS UNBOUNDED PRECEDING) AS top_ FROM z WHERE depth <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, relative_path ORDER BY place) AS position FROM o WHERE top_ <= 8)
SELECT repo, relative_path, position, symbol_id, name, kind, depth, count(*) OVER (PARTITION BY repo, relative_path) < all_nodes AS truncated, all_nodes FROM n WHERE position <= 12""",
    "match_nth": f"""WITH {_C}, {_NUMBERED}, m AS (SELECT id, line_no, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY id) AS n FROM l WHERE contains(line, 'return'))
SELECT id, line_no, 'second' AS rule FROM m WHERE rn = 2 UNION ALL SELECT id, line_no, 'only' FROM m WHERE n = 1""",
    "literal_spans": f"""WITH {_C}, p AS (SELECT id, string_split(content, ';' || chr(10)) AS ps FROM c WHERE contains(content, ';' || chr(10))),
k AS (SELECT id, ps, unnest(range(1, len(ps))) AS k FROM p), b AS (SELECT id, k, array_to_string(ps[1:k], ';' || chr(10)) AS before_ FROM k)
SELECT id, CAST(strlen(before_) AS BIGINT) AS start_byte, CAST(strlen(before_) + 2 AS BIGINT) AS end_byte, length(before_) - length(replace(before_, chr(10), '')) + 1 AS start_line, length(before_) - length(replace(before_, chr(10), '')) + 1 AS end_line FROM b""",
    "bounded_windows": f"""WITH {LATEST}, f AS (SELECT repo, relative_path, max(end_line) AS total FROM chunk_doc GROUP BY ALL),
a AS (SELECT l.repo, symbol_id, total, greatest(1, least(start_line, total)) AS fs, start_line, end_line FROM latest l JOIN f ON l.repo = f.repo AND l.relative_path = f.relative_path WHERE start_line <= end_line),
b AS (SELECT *, greatest(fs, least(end_line, total)) AS fe FROM a), c AS (SELECT *, greatest(fs - 8, 1) AS s, least(fe + 24, total) AS e FROM b),
g AS (SELECT *, fs - s AS fr, e - fe AS bk, greatest(e - s + 1 - 40, 0) AS ov FROM c), h AS (SELECT *, least(ov, fr + bk) AS cut, greatest(least(ov, fr + bk) - abs(fr - bk), 0) AS rest FROM g)
SELECT repo, symbol_id, CAST(s + CASE WHEN fr > bk THEN cut - rest ELSE 0 END + (rest + 1) // 2 AS BIGINT) AS start, CAST(e - CASE WHEN bk > fr THEN cut - rest ELSE 0 END - rest // 2 AS BIGINT) AS end, ov > 0 AS truncated FROM h""",
    "latest_symbols": f"WITH {LATEST} SELECT repo, symbol_id, relative_path, name, kind, container, parent_symbol_id FROM latest",
    "symbol_filters": f"WITH {LATEST} SELECT repo, symbol_id, name FROM latest WHERE starts_with(relative_path, 'src') AND language = 'java' AND kind = 'method' AND contains(lower(container), 'e')",
    "symbol_to_chunk": f"""WITH {LATEST}, {_C},
j AS (SELECT s.repo, s.symbol_id, c.id, greatest(c.start_line - s.start_line, s.start_line - c.end_line, 0) AS d, c.start_line AS a, c.end_line AS b
  FROM latest s LEFT JOIN c ON s.repo = c.repo AND s.relative_path = c.relative_path WHERE s.start_line IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, symbol_id ORDER BY id IS NULL, d, a, b, id) AS rn FROM j)
SELECT repo, symbol_id, coalesce(id, 'symbol:' || symbol_id) AS chunk_id, coalesce(id IS NOT NULL AND d = 0, false) AS covers FROM r WHERE rn = 1""",
    "symbol_rows_joined": f"""WITH {LATEST}, h AS (SELECT DISTINCT repo, symbol_id, name, kind, start_line, end_line FROM symbol_row)
SELECT DISTINCT h.repo, h.symbol_id, coalesce(s.name, h.name) AS name, coalesce(s.kind, h.kind) AS kind, coalesce(s.start_line, h.start_line, -1) AS start_line, coalesce(s.end_line, h.end_line, -1) AS end_line
FROM h LEFT JOIN latest s ON h.repo = s.repo AND h.symbol_id = s.symbol_id""",
    "line_index": f"WITH {_C}, {_NUMBERED} SELECT id, line_no + start_line - 1 AS line_no, md5(line) AS line_md5 FROM l",
    "literal_matches": _literal("return", "line"),
    "literal_matches_any_case": _literal("token", "lower(line)"),
    "literal_whole_word": f"WITH {_C}, {_NUMBERED} SELECT id, line_no, len(list_filter(regexp_split_to_array(line, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w = 'return')) AS n_matches FROM l WHERE len(list_filter(regexp_split_to_array(line, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w = 'return')) > 0",
    "text_search_topk": f"WITH {_C}, {_NUMBERED} SELECT repo, relative_path, line_no + start_line - 1 AS line_no, id FROM l WHERE contains(line, 'token') ORDER BY repo, relative_path, line_no + start_line - 1, id LIMIT 50",
    "narrowest_symbol": f"""WITH {LATEST}, {_C}, j AS (SELECT c.id, s.symbol_id, row_number() OVER (PARTITION BY c.id ORDER BY s.end_line - s.start_line, s.start_line, s.end_line, s.symbol_id) AS rn
FROM c JOIN latest s ON c.repo = s.repo AND c.relative_path = s.relative_path AND s.start_line <= c.start_line AND c.start_line <= s.end_line) SELECT id, symbol_id FROM j WHERE rn = 1""",
    "match_pick": f"""WITH {_C}, {_NUMBERED}, m AS (SELECT id, line_no, abs(line_no - 10) AS d FROM l WHERE contains(line, 'return')), n AS (SELECT *, min(d) OVER (PARTITION BY id) AS least_ FROM m)
SELECT id, max(line_no) AS line_no, max(d) AS distance FROM n WHERE d = least_ GROUP BY id HAVING count(*) = 1""",
    "anchor_rank": f"WITH {_C}, {_ANCHORS.replace('QUERY', 'CASE WHEN contains(line, $$return$$) THEN 600 ELSE 0 END')} SELECT id, line_no, anchor, score, unique_in_file FROM r WHERE rn <= 2",
    "line_histogram": f"WITH {_C}, {_NUMBERED}, t AS (SELECT repo, relative_path, {_TRIM} AS line FROM l) SELECT repo, relative_path, md5(line) AS line_md5, count(*) AS n FROM t WHERE line <> '' GROUP BY ALL",
    "neighbor_context": f"WITH {_C} SELECT id, md5(array_to_string(list(content) OVER (PARTITION BY repo, relative_path ORDER BY start_line, end_line, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10) || chr(10))) AS context_md5 FROM c",
    "chunk_overlap": f"""WITH {_C}, p AS (SELECT *, right(lag(content) OVER (PARTITION BY repo, relative_path ORDER BY start_line, end_line, id), 300) AS tail FROM c)
SELECT id, greatest(start_line - CASE WHEN tail IS NULL THEN 0 ELSE len({_LINES.format('tail')}) END, 0) AS start_line, md5(CASE WHEN tail IS NULL THEN content ELSE tail || chr(10) || content END) AS content_md5 FROM p""",
    "window_ready": f"""WITH {_C}, {_ANCHORS.replace('QUERY', '0')}, u AS (SELECT id, count(*) FILTER (unique_in_file) AS u FROM r WHERE rn <= 3 GROUP BY id)
SELECT c.id, CASE WHEN end_line - start_line + 1 > 160 THEN 'window_too_broad' WHEN coalesce(u, 0) = 0 THEN 'weak_anchors' ELSE 'ready' END AS state FROM c LEFT JOIN u ON c.id = u.id""",
    "line_slices": f"WITH {_C}, z AS (SELECT id, content, {_LINES.format('content')} AS ls FROM c) SELECT id, md5(array_to_string(ls[2:4], chr(10)) || CASE WHEN len(ls) >= 2 AND (len(ls) > 4 OR ends_with(content, chr(10))) THEN chr(10) ELSE '' END) AS slice_md5 FROM z",
}
