"""Reading repositories: scan with ignore rules, text test, chunks and symbols."""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.sources.definitions import definitions, refined

#: Extensions that are read unless others are named.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".scala", ".m", ".mm", ".md", ".markdown", ".ipynb")
#: Sizes of chunks in bytes and characters.
CHUNK_BYTES, OVERLAP_CHARS, TEXT_CHARS, TEXT_OVERLAP = 2500, 300, 1000, 200
_LFS = "version https://git-lfs.github.com/spec/"
_CHUNKS = "repo string, relative_path string, kind string, name string, container string, language string, content string, start_line long, end_line long"


def glob_regex(pattern: str) -> str:
    """A plain glob over a relative path; without a slash it may match any name, and a directory means all below it."""
    p = pattern.strip().strip("/")
    body = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if "/" in p else "(?:^|/)") + body + "(?:/.*)?$"


def ignore_rules(root: str, extra: list[str] | None = None, user_file: str | None = "~/.context/.contextignore") -> list[tuple[str, bool]]:
    """``(regex over relative paths, is it taken back)`` in order; the last rule that matches a path decides.

    Rules come from the user's own file, from ``.*ignore`` files of every directory
    (which hold for all below it) and from ``extra`` globs. Comments and blanks are
    left out; ``!`` takes a path back.
    """
    lines: list[tuple[str, str]] = []
    if user_file and (mine := Path(user_file).expanduser()).is_file():
        lines += [("", x) for x in mine.read_text(errors="replace").splitlines()]
    base = Path(root)
    found = (Path(d) / n for d, dirs, names in os.walk(base) for n in names if not dirs.sort() and n.startswith(".") and n.endswith("ignore"))
    for f in sorted(found, key=lambda f: (len(f.parts), f)):
        inside = f.parent.relative_to(base).as_posix()
        lines += [("" if inside == "." else inside, x) for x in f.read_text(errors="replace").splitlines()]
    lines += [("", x) for x in extra or []]
    out = []
    for inside, line in lines:
        x = line.strip()
        if not x or x.startswith("#"):
            continue
        back = x.startswith("!")
        pattern = glob_regex(x.removeprefix("!"))
        if inside:
            pattern = f"^{re.escape(inside)}/" + (pattern.removeprefix("^") if pattern.startswith("^") else "(?:.*/)?" + pattern.removeprefix("(?:^|/)"))
        out.append((pattern, back))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def extension_set(extra: list[str] | None = None) -> list[str]:
    """The default extensions and the given ones, to which a missing dot is added; case counts."""
    more = [e if e.startswith(".") else f".{e}" for e in (x.strip() for x in extra or ()) if e]
    for e in more:
        if re.search(r"\s", e):
            raise ValueError(f"an extension has no blanks: {e!r}")
    return sorted({*EXTENSIONS, *more})


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None, below: str | None = None) -> DataFrame:
    """``repo, relative_path, text, file_hash, bytes, modified`` of the text files below ``root``.

    Hidden files and directories, ignored paths, files with NUL or invalid UTF-8, LFS
    pointers, links and extensions other than the default and given ones are left
    out. ``below`` limits the listing itself to a directory, or to the directory of a
    file. Paths come out of the listing, so filters on them prune before any file is
    read.
    """
    root = str(Path(root).resolve())
    start = inside(root, below) if below else root
    if not Path(start).is_dir():
        start = str(Path(start).parent)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(start)
    path = F.substring(F.regexp_replace("path", "^file:(?://)?", ""), len(root) + 2, 1 << 20)
    named = files.select(path.alias("relative_path"), "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    kept = named.where(T.extension(F.col("relative_path")).isin(*extension_set(extensions)) & ~F.col("relative_path").rlike(r"(?:^|/)\."))
    kept = kept.where(~ignored(F.col("relative_path"), ignore_rules(root, ignore)))
    links = [f"^{re.escape(x)}(?:/|$)" for x in _links(start, root)]
    for x in links:
        kept = kept.where(~F.col("relative_path").rlike(x))
    if below:
        kept = kept.where(T.under_prefix(F.col("relative_path"), F.lit(str(Path(inside(root, below)).relative_to(root).as_posix()))))
    text = F.decode("content", "UTF-8")
    sound = F.expr("is_valid_utf8(cast(content as string))") & ~F.contains(F.col("content"), F.lit(b"\x00"))
    out = kept.where(sound).select(F.lit(root).alias("repo"), "relative_path", text.alias("text"), "bytes", "modified")
    return out.where(~F.col("text").startswith(_LFS)).select("repo", "relative_path", "text", T.xxh3(F.col("text")).alias("file_hash"), "bytes", "modified")


def _links(start: str, root: str) -> list[str]:
    """Relative paths of symbolic links, which are not followed."""
    return [Path(d, n).relative_to(root).as_posix() for d, dirs, names in os.walk(start) for n in [*dirs, *names] if Path(d, n).is_symlink()]


def inside(root: str, relative: str) -> str:
    """The absolute path of ``relative`` in ``root``; a path that leads out of it is refused."""
    base = Path(root).resolve()
    at = (base / relative.strip().replace("\\", "/").strip("/")).resolve()
    if at != base and base not in at.parents:
        raise ValueError(f"{relative!r} leads out of {root!r}")
    return str(at)


def candidate_paths(spark: SparkSession, root: str, prefix: str | None = None, language: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """``relative_path`` of live text files, each once and in order, bounded by a prefix, a language and extensions."""
    files = scan(spark, root, extensions, below=prefix)
    if language:
        files = files.where(T.language(T.extension(F.col("relative_path"))) == language.lower())
    if extensions:
        files = files.where(T.extension(F.col("relative_path")).isin(*extensions))
    return files.select("relative_path").distinct().orderBy("relative_path")


def snapshot(spark: SparkSession, root: str, relative_path: str) -> DataFrame:
    """``relative_path, text, file_hash, bytes, modified, lines`` of one live file; no row if it is no text file.

    A path that leads out of the repository is refused.
    """
    at = inside(root, relative_path)
    if not Path(at).is_file():
        raise FileNotFoundError(relative_path)
    name = Path(at).relative_to(Path(root).resolve()).as_posix()
    one = spark.read.format("binaryFile").load(at)
    sound = F.expr("is_valid_utf8(cast(content as string))") & ~F.contains(F.col("content"), F.lit(b"\x00"))
    read = one.where(sound).select(F.lit(name).alias("relative_path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return read.select("relative_path", "text", T.xxh3(F.col("text")).alias("file_hash"), "bytes", "modified", F.size(T.lines(F.col("text"))).cast("long").alias("lines"))


def chunk_file(path: str, text: str) -> list[tuple]:
    """``(kind, name, container, content, start, end)`` of one file.

    Every definition is a chunk, a method again inside its class; those over the size
    limit are cut at line ends and keep their name on the first piece. Files
    without definitions, and minified ones, are packed by lines.
    """
    ext = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    language = T.LANGUAGES.get(ext, "text")
    found: list[tuple] = []
    if language == "python":
        try:
            found = list(_python(ast.parse(text), text.split("\n"), ()))
        except (SyntaxError, ValueError, RecursionError):
            pass
    elif not (language in ("javascript", "typescript") and is_minified(text)):
        rows = text.split("\n")
        found = [(d.kind, d.name, d.container, "\n".join(rows[d.start - 1 : d.end]), d.start, d.end) for d in definitions(text, language)]
    out = []
    for kind, name, box, content, a, b in found:
        for i, (c, x, y) in enumerate(refined(content, a)):
            out.append((kind, None if i else name, box, c, x, b if i == 0 and name else y))
    if out:
        return out
    pieces = markdown_sections(text, TEXT_CHARS) if language == "markdown" else pack_lines(text, TEXT_CHARS)
    return [("text", None, None, c, a, b) for c, a, b in with_overlap(pieces, TEXT_OVERLAP)]


def markdown_sections(text: str, most: int) -> list[tuple[str, int, int]]:
    """Sections from heading to heading, headings in fences not counted; longer ones are packed by lines."""
    rows, starts, fence = text.split("\n"), [0], False
    for i, line in enumerate(rows):
        fence ^= line.lstrip().startswith(("```", "~~~"))
        if i and not fence and re.match(r"#{1,6}\s", line):
            starts.append(i)
    out = []
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        out += [(c, a + x, a + y) for c, x, y in pack_lines("\n".join(rows[a:b]), most)]
    return out


def with_overlap(pieces: list[tuple[str, int, int]], most: int) -> list[tuple[str, int, int]]:
    """Each piece begins with whole last lines of the one before it, ``most`` characters of them at most."""
    out = pieces[:1]
    for (before, _, end), (content, a, b) in zip(pieces, pieces[1:], strict=False):
        tail: list[str] = []
        for line in reversed(before.split("\n")):
            if sum(map(len, tail)) + len(tail) + len(line) > most:
                break
            tail.append(line)
        adjoining = tail and end + 1 == a
        out.append(("\n".join([*reversed(tail), content]), a - len(tail), b) if adjoining else (content, a, b))
    return out


def _python(tree: ast.AST, lines: list[str], above: tuple[str, ...]) -> Iterator[tuple]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if above and isinstance(tree, ast.ClassDef) else "function"
            yield kind, node.name, "::".join(above) or None, "\n".join(lines[first - 1 : node.end_lineno]), first, node.end_lineno
            yield from _python(node, lines, (*above, node.name))
        else:
            yield from _python(node, lines, above)


def pack_lines(text: str, most: int) -> list[tuple[str, int, int]]:
    """Lines packed greedily to ``most`` characters; a single longer line stands alone; blank pieces are dropped."""
    out, part, first, size = [], [], 1, 0
    for i, line in enumerate(text.split("\n"), 1):
        if part and size + len(line) + 1 > most:
            out.append(("\n".join(part), first, i - 1))
            part, first, size = [], i, 0
        part.append(line)
        size += len(line) + 1
    if part:
        out.append(("\n".join(part), first, first + len(part) - 1))
    return [(c, a, b) for c, a, b in out if c.strip()]


def is_minified(text: str) -> bool:
    """Few lines, one of them very long."""
    lines = text.split("\n")
    longest = max(map(len, lines))
    return len(lines) <= 5 and longest >= 2000 or len(lines) <= 20 and longest >= 4000


def chunks_and_symbols(files: DataFrame) -> DataFrame:
    """Chunks and symbols of ``files(repo, relative_path, text)`` in one pass; symbols are the rows with a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ext = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
                rows += [(repo, path, kind, name, box, T.LANGUAGES.get(ext, "text"), c, a, b) for kind, name, box, c, a, b in chunk_file(path, text)]
            if rows:
                types = [pa.string()] * 7 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _CHUNKS.split(", ")])

    return files.where("text is not null and relative_path is not null").select("repo", "relative_path", "text").mapInArrow(run, _CHUNKS)
