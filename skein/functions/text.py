"""Column functions over texts, paths and identifiers; all stay in Catalyst but the xxh3 hash."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Extension to language; everything else is ``text``.
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".py": "python",
    ".java": "java",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".go": "go",
    ".rs": "rust",
    ".cs": "csharp",
    ".scala": "scala",
    ".php": "php",
    ".rb": "ruby",
    ".swift": "swift",
    ".kt": "kotlin",
    ".m": "objective-c",
    ".mm": "objective-c",
    ".ipynb": "jupyter",
    ".md": "markdown",
    ".markdown": "markdown",
}
#: Multipliers of byte-size units.
UNITS = {"": 1, "b": 1, "kb": 1024, "kib": 1024, "mb": 1024**2, "mib": 1024**2, "gb": 1024**3, "gib": 1024**3}


def terms(text: Column) -> Column:
    """Lower-case ASCII terms: runs of letters, digits and ``_``, also cut before a capital after a small letter."""
    broken = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(broken), " "), lambda x: x != "")


def normalized_path(path: Column) -> Column:
    return F.btrim(F.regexp_replace(path, r"\\", "/"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalized_path(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last dotted part of the name, ``''`` if there is none; dot files have none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def language(ext: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ext), F.lit("text"))


def under_prefix(path: Column, prefix: Column) -> Column:
    """Path equal to the prefix, or below it by whole segments."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n..."))).otherwise(text)


def preview(text: Column, most: int) -> Column:
    return truncated(F.btrim(text, F.lit("\r\n")), most)


def snippet(query: Column, content: Column, most: int) -> Column:
    """The content, or a window of it around the first query term that occurs: a third before, two thirds after."""
    low = F.lower(F.replace(content, F.lit("\u0130"), F.lit("i")))  # the one letter that grows in lower case
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0)
    at = F.try_element_at(hits, F.lit(1)) - 1
    start = F.greatest(at - most // 3, F.lit(0))
    stop = F.least(at + most * 2 // 3, F.length(content))
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, stop - start), F.when(stop < F.length(content), "...").otherwise(""))
    return F.when(F.length(content) <= most, content).when(at.isNotNull(), window).otherwise(truncated(content, most))


def line_distance(first: Column, last: Column, line: Column) -> Column:
    return F.greatest(first - line, line - last, F.lit(0)).cast("long")


def rounded(score: Column) -> Column:
    return F.round(score, 6)


def positive(score: Column) -> Column:
    return F.when(score > 0, score)


def byte_size(text: Column) -> Column:
    """``25MB`` and the like to bytes; null if it cannot be read."""
    number = F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 2))
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.when(number != "", number.try_cast("long") * F.try_element_at(table, unit))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at its end does not open another line."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` with their line ends; the text's last line has one only if the text does."""
    parts = lines(text)
    cut = F.slice(parts, first, last - first + 1)
    ended = (F.size(parts) > last) | text.endswith("\n")
    return F.concat(F.array_join(cut, "\n"), F.when((F.size(cut) > 0) & ended, "\n").otherwise(""))


#: Fixed value: the characters that are blank in Unicode.
BLANKS = r"[\x{09}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def json_string(json: Column, key: str) -> Column:
    """A field of a JSON text as a string; null for nulls, arrays, objects and texts that are no JSON."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    return F.when(~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID")), F.get_json_object(json, f"$.{key}"))


@pandas_udf(StringType())
def xxh3(text: pd.Series) -> pd.Series:
    """Hex of the 128-bit xxh3 hash of the UTF-8 bytes; Spark has no such function."""
    return text.map(lambda t: None if t is None else xxhash.xxh3_128_hexdigest(t.encode()))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.left(F.concat(F.lit("chunk_"), xxh3(F.concat_ws(":", path, start, end, content))), F.lit(22))


def symbol_id(path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    return F.left(F.concat(F.lit("sym_"), xxh3(F.concat_ws(":", path, kind, name, start, end))), F.lit(22))
