"""Source files that do not fit the grammar of their language.

Every file is parsed against the grammars of all supported languages, in the
order of a ranking by typical tokens. A file that fits the grammar of its
extension's language is valid; one that fits only others has a wrong extension,
and the first of them in the ranking names its language; one that no grammar
accepts is corrupt (cut off, merged badly, or no source at all). Foreign grammars
look at a text's opening first, which rules most of them out without reading on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.files import path_extension, whole_files
from skein.llm.grammars import Languages

#: The extensions of the supported languages.
LANGUAGE_OF = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".h": "c"}
#: Tokens that are typical of a language.
TYPICAL = {
    "python": ("def ", "elif ", "self.", "None", "):\n"),
    "typescript": (": string", ": number", "interface ", "export ", "=> "),
    "javascript": ("const ", "function", "require(", "===", "=> "),
    "rust": ("fn ", "let mut ", "impl ", "&str", "::"),
    "go": ("package ", "func ", ":= ", "nil", "import ("),
    "java": ("public ", "private ", "throw new ", "import java", "final "),
    "c": ("#include", "#define", "sizeof(", "struct ", "->"),
}


def ranked(text: str) -> list[str]:
    """All supported languages, those of which the text holds more typical tokens first."""
    return sorted(TYPICAL, key=lambda k: (-sum(w in text for w in TYPICAL[k]), k))


def fitting(languages: Languages, extension: str, text: str) -> list[str]:
    """The languages whose grammar the whole of ``text`` fits, in the order of their rank."""
    own = LANGUAGE_OF[extension]
    likely = (own, "typescript") if own == "javascript" else (own,)  # every script is nearly always a typed one too
    return [k for k in ranked(text) if languages.fits(k, text, markup=extension != ".ts" or k != own, early=k not in likely)]


def verdict(languages: Languages, extension: str, text: str) -> tuple[str, str | None]:
    """``(state, language found)`` with state ``valid``, ``foreign`` or ``corrupt``."""
    found = fitting(languages, extension, text)
    if LANGUAGE_OF[extension] in found:
        return "valid", LANGUAGE_OF[extension]
    return ("foreign", found[0]) if found else ("corrupt", None)


@lru_cache(maxsize=1)
def _languages() -> Languages:
    """Compiled once in a worker, whatever the number of its tasks."""
    return Languages()


def check_files(chunks: DataFrame) -> DataFrame:
    """``repo, relative_path, language, state, found`` for every file of a supported extension.

    An empty file is valid where the grammar allows it. Nulls: see ``whole_files``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages()
        for batch in batches:
            repo, path, ext, text = (batch.column(i) for i in range(4))
            found = [verdict(languages, e, t) for e, t in zip(ext.to_pylist(), text.to_pylist(), strict=True)]
            own = [LANGUAGE_OF[e] for e in ext.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [repo, path, pa.array(own, pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                names=["repo", "relative_path", "language", "state", "found"],
            )

    of_kind = chunks.withColumn("ext", path_extension(F.col("relative_path"))).where(F.col("ext").isin(*LANGUAGE_OF))
    files = whole_files(of_kind).select("repo", "relative_path", path_extension(F.col("relative_path")).alias("ext"), "text")
    return files.mapInArrow(run, "repo string, relative_path string, language string, state string, found string")


def rates(checked: DataFrame) -> DataFrame:
    """Files, foreign files, corrupt files and the rate of invalid ones per repo and language."""
    bad = F.count_if(F.col("state") != "valid")
    return checked.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("state") == "foreign").alias("n_foreign"),
        F.count_if(F.col("state") == "corrupt").alias("n_corrupt"),
        F.round(bad / F.count(F.lit(1)), 6).alias("invalid_rate"),
    )
