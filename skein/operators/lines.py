"""Lines of texts: exact search, context, and picking places to edit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

#: Lines that never serve as anchors, and their points.
PUNCTUATION = ("{", "}", "(", ")", "[", "]", ",", ");", "};", "];")
UNIQUE, QUERY, SIGNATURE, WORDY, STRUCTURAL = 1000, 600, 500, 100, 25
#: Fixed value: the widest window that counts as ready to edit.
WIDEST = 160


def numbered(rows: DataFrame, keys: list[str], text: str, first: Column | None = None) -> DataFrame:
    """``keys, line_no, line``: one row per line, numbered from ``first`` (1)."""
    at = F.lit(1) if first is None else first
    return rows.select(*keys, at.alias("_first"), F.posexplode(T.lines(F.col(text))).alias("_at", "line")).select(*keys, (F.col("_at") + F.col("_first")).cast("long").alias("line_no"), "line")


def literal_matches(rows: DataFrame, keys: list[str], text: str, needle: str, case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
    """``keys, line_no, n_matches, line`` of lines with the needle; matches do not overlap.

    Texts without the needle are dropped before any line is made. Word
    boundaries know all letters and digits, and ``_``.
    """
    if not needle:
        return numbered(rows.where(F.lit(False)), keys, text).select(*keys, "line_no", F.lit(0).cast("long").alias("n_matches"), "line")
    plain = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", needle)
    bounded = rf"(?<![\p{{L}}\p{{N}}_]){plain}(?![\p{{L}}\p{{N}}_])" if whole_word else plain
    pattern = F.lit(bounded if case_sensitive else f"(?iu){bounded}")
    there = F.contains(F.col(text), F.lit(needle)) if case_sensitive else F.contains(F.lower(text), F.lit(needle.lower()))
    found = numbered(rows.where(there), keys, text)
    return found.withColumn("n_matches", F.regexp_count("line", pattern).cast("long")).where("n_matches > 0").select(*keys, "line_no", "n_matches", "line")


def literal_spans(rows: DataFrame, keys: list[str], text: str, needle: str) -> DataFrame:
    """``keys, start_byte, end_byte, start_line, end_line`` of every match of a literal, which may go over line ends.

    Bytes are those of UTF-8 from 0, lines are counted from 1; matches do not overlap.
    """
    if not needle:
        raise ValueError("the needle is empty")
    size, ends = len(needle.encode()), needle.count("\n") - needle.endswith("\n")
    pieces = rows.where(F.contains(F.col(text), F.lit(needle))).select(*keys, F.split(F.col(text), re.escape(needle).replace("\\\n", "\\n")).alias("_p"))
    lengths = F.struct(F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("l"), F.array().cast("array<struct<b:bigint,l:bigint>>").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        at = acc["b"] + F.octet_length(piece)
        line = acc["l"] + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.struct((at + size).cast("long").alias("b"), (line + needle.count("\n")).cast("long").alias("l"), F.concat(acc["out"], F.array(F.struct(at.cast("long").alias("b"), line.cast("long").alias("l")))).alias("out"))

    found = F.aggregate(F.slice("_p", 1, F.size("_p") - 1), lengths, add, lambda acc: acc["out"])
    each = pieces.select(*keys, F.explode(found).alias("_m"))
    return each.select(*keys, F.col("_m.b").alias("start_byte"), (F.col("_m.b") + size).alias("end_byte"), F.col("_m.l").alias("start_line"), (F.col("_m.l") + ends).cast("long").alias("end_line"))


def narrowest(places: DataFrame, spans: DataFrame, owner: list[str], span_id: str, line: str = "line_no") -> DataFrame:
    """For each place the smallest span of its owner that covers it; ties by start, end and id. None: no row."""
    joined = places.join(spans, owner).where((F.col("start_line") <= F.col(line)) & (F.col(line) <= F.col("end_line")))
    width = F.col("end_line") - F.col("start_line")
    return joined.groupBy(*places.columns).agg(F.min(F.struct(width.alias("w"), "start_line", "end_line", F.col(span_id).alias("i")))["i"].alias(span_id))


def pick(matches: DataFrame, owner: list[str], hint: str) -> DataFrame:
    """The match nearest to the hinted line, per owner; none where two are equally near."""
    d = F.abs(F.col("line_no") - F.col(hint))
    w = Window.partitionBy(*owner)
    near = matches.withColumn("d", d).withColumn("least", F.min("d").over(w)).where("d = least").withColumn("ties", F.count(F.lit(1)).over(w))
    return near.where("ties = 1").select(*owner, "line_no", F.col("d").alias("distance"))


def anchors(lines: DataFrame, owner: list[str], count: int = 2, query: str | None = None, file: list[str] | None = None, start: str | None = None, signature: str | None = None) -> DataFrame:
    """The best ``count`` (1 to 3) anchor lines per owner, in line order.

    ``lines(file..., owner..., line_no, line)``: a line may belong to several owners
    (nested symbols), and lines of no owner (null) count for uniqueness only. A line
    scores for being unique in its ``file`` (else in its owner), for the query, for
    being the ``signature`` line, for letters or digits and for brackets and the like,
    and loses a point for each line from the owner's ``start`` (else its first line).
    """
    count = min(max(count, 1), 3)
    file = file or owner
    w = Window.partitionBy(*owner)
    first = F.col(start) if start else F.min("line_no").over(w)
    plain = lines.withColumn("anchor", T.trimmed(F.col("line"))).withColumn("first", first).where("anchor != ''")
    seen = plain.groupBy(*file, "anchor").agg(F.countDistinct("line_no").alias("seen"))  # pre-aggregated, unlike a window
    able = plain.where(F.col(owner[-1]).isNotNull() & F.col("anchor").rlike(r"[\p{L}\p{N}]") & ~F.col("anchor").isin(*PUNCTUATION)).join(seen, [*file, "anchor"]).withColumn("unique_in_file", F.col("seen") == 1)

    def points(x: Column, n: int) -> Column:
        return F.when(x, n).otherwise(0)

    score = points(F.col("unique_in_file"), UNIQUE) + points(F.col("anchor").rlike(r"[=:()\[\]{}]"), STRUCTURAL) + WORDY - (F.col("line_no") - F.col("first"))
    if query:
        score = score + points(F.contains("line", F.lit(query)), QUERY)
    if signature is not None:
        score = score + points(F.col("line_no") == F.col(signature), SIGNATURE)
    ranked = able.withColumn("score", score.cast("long")).withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "line_no")))
    return ranked.where(F.col("rn") <= count).select(*owner, "line_no", "anchor", "score", "unique_in_file")


def bounded_window(total: Column, first: Column, last: Column, before: int = 8, after: int = 24, most: int = 96) -> Column:
    """``struct(start, end, truncated)``: the focus grown by before and after, clipped to the text, and cut to ``most`` lines.

    What is too much goes from the longer side until both are equal, then from
    both by turns, the front first; the focus itself is never cut. A text without
    lines gives 0, 0.
    """
    focus = F.greatest(F.lit(1), F.least(first, total))
    end_of_focus = F.greatest(focus, F.least(last, total))
    start, end = F.greatest(focus - before, F.lit(1)), F.least(end_of_focus + after, total)
    front, back = focus - start, end - end_of_focus
    over = F.greatest(end - start + 1 - max(most, 1), F.lit(0))
    cut = F.least(over, front + back)
    rest = F.greatest(cut - F.abs(front - back), F.lit(0))
    longer = cut - rest
    off_front = F.when(front > back, longer).otherwise(0) + F.ceil(rest / 2)
    off_back = F.when(back > front, longer).otherwise(0) + F.floor(rest / 2)
    empty = total == 0

    def bound(x: Column) -> Column:
        return F.when(empty, 0).otherwise(x).cast("long")

    return F.struct(bound(start + off_front).alias("start"), bound(end - off_back).alias("end"), (~empty & (over > 0)).alias("truncated"))


def pick_nth(matches: DataFrame, owner: list[str], occurrence: int | None = None) -> DataFrame:
    """The ``occurrence``-th match (from 1) of each owner by line; without it the only one, and none where there are several."""
    w = Window.partitionBy(*owner)
    ranked = matches.withColumn("rn", F.row_number().over(w.orderBy("line_no"))).withColumn("all", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("rn") == occurrence) if occurrence is not None else (F.col("all") == 1)).select(*owner, "line_no")


def readiness(lines: Column, unique_anchors: Column) -> Column:
    return F.when(lines > WIDEST, "window_too_broad").when(unique_anchors == 0, "weak_anchors").otherwise("ready")


def with_neighbours(chunks: DataFrame, n: int) -> DataFrame:
    """``repo, relative_path, id, context``: each chunk with its ``n`` neighbours on both sides, joined by blank lines."""
    w = Window.partitionBy("repo", "relative_path").orderBy("start_line", "end_line", "id").rowsBetween(-n, n)
    return chunks.select("repo", "relative_path", "id", F.array_join(F.collect_list("content").over(w), "\n\n").alias("context"))


def overlapped(chunks: DataFrame, chars: int = 300) -> DataFrame:
    """Chunks that begin with the last characters of the chunk before them; the start line may become 0."""
    w = Window.partitionBy("repo", "relative_path").orderBy("start_line", "end_line", "id")
    tail = F.right(F.lag("content").over(w), F.lit(chars))
    more = F.when(tail.isNotNull(), F.size(T.lines(tail))).otherwise(0)
    return chunks.select(
        "repo", "relative_path", "id", F.when(tail.isNotNull(), F.concat(tail, F.lit("\n"), "content")).otherwise(F.col("content")).alias("content"), F.greatest(F.col("start_line") - more, F.lit(0)).cast("long").alias("start_line")
    )
