"""The public functions: search, outlines, edit targets and upkeep over an index of tables.

Each function returns a lazy DataFrame; nothing runs until it is read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import embed, planner
from skein.functions import text as T
from skein.operators import fusion, lines, retrieval, state, symbols
from skein.runtime import table
from skein.sources import scan
from skein.sources.store import Store

#: Bounds of arguments, as (least, most).
BOUNDS = {"limit": (1, 50), "context_lines": (0, 12), "snippet_chars": (1, 1200), "before": (0, 32), "after": (0, 96), "max_lines": (1, 160), "anchors": (1, 3), "depth": (1, 16), "nodes": (1, 512), "top_level": (1, 256)}


def clamp(name: str, value: int) -> int:
    low, high = BOUNDS[name]
    return max(low, min(high, value))


def extension_filter(extensions: list[str]) -> list[str]:
    """Sorted and unique; an extension begins with a dot and has no blanks."""
    out = sorted({e.strip() for e in extensions})
    for e in out:
        if not e.startswith(".") or any(c.isspace() for c in e):
            raise ValueError(f"an extension begins with a dot and has no blanks: {e!r}")
    return out


@dataclass
class Found:
    """Hits of several repositories, and what went wrong in which (first error each); failed ones give no hits."""

    hits: DataFrame | None
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def partial(self) -> bool:
        return bool(self.errors)


@dataclass
class Index:
    """An index: a folder of Parquet tables ``chunk_doc.parquet`` and so on, or a ``Store`` that ``ingest.refresh`` keeps.

    ``overlay`` names a working copy whose changed files, as ``ingest.refresh_overlay``
    stored them, take the place of the indexed ones.
    """

    spark: SparkSession
    root: str | Store
    overlay: str | None = None

    def table(self, name: str) -> DataFrame:
        return self.root.read(name) if isinstance(self.root, Store) else table(self.spark, self.root, name)

    def has(self, name: str) -> bool:
        return self.root.exists(name) if isinstance(self.root, Store) else False

    def _overlaid(self, name: str) -> DataFrame:
        """A table with the files of the overlay in place of the hidden ones; an overlay that does not hold hides nothing."""
        rows = self.table(name)
        if not self.overlay or not self.has("overlay_state"):
            return rows
        own = self.table("overlay_state").where((F.col("overlay_id") == self.overlay) & F.col("overlay_status").isin(*state.HIDING))
        kept = rows.join(state.hidden_files(own), ["repo", "relative_path"], "left_anti")
        if not self.has(f"overlay_{name}"):
            return kept
        fresh = self.table(f"overlay_{name}").join(own.where(F.col("overlay_status").isin(*state.SEARCHABLE)).select("overlay_id"), "overlay_id", "left_semi")
        return kept.unionByName(fresh.select(*rows.columns))

    def _chunks(self, repos: list[str] | None, prefix: str | None, language: str | None, file: str | None, extensions: list[str] | None) -> DataFrame:
        """The chunks that the filters leave; repeated rows are still in it."""
        c = self._overlaid("chunk_doc").where("id is not null")
        if repos:
            c = c.where(F.col("repo").isin(*repos))
        if prefix:
            c = c.where(T.under_prefix(T.normalized_path(F.col("relative_path")), F.lit(prefix.strip("/"))))
        if language:
            c = c.where(F.lower("language") == language.lower())
        if file:
            c = c.where(T.normalized_path(F.col("relative_path")) == file.strip("/"))
        if extensions:
            c = c.where(F.col("extension").isin(*extension_filter(extensions)))
        return c

    def _symbols(self) -> DataFrame:
        return symbols.latest_symbols(self._overlaid("symbol_row"))

    def chunks_for_file(self, repo: str, file: str) -> DataFrame:
        """All chunks of a file, in the order of their lines."""
        return _one_per_id(self._chunks([repo], None, None, file, None)).orderBy("start_line", "end_line", "id")

    def search_code(self, query: str, limit: int = 5, mode: str = "auto", repos: list[str] | None = None, prefix: str | None = None, language: str | None = None, file: str | None = None, extensions: list[str] | None = None, vector: list[float] | None = None, dedupe_by_file: bool = True, snippet_chars: int = 220, context: bool = False) -> DataFrame:
        """Fused lexical, symbol and (with a query vector) dense hits; filters come before any ranking.

        Candidates are ranked and cut within each repository. Statistics of BM25 are over
        the filtered chunks. With ``context`` a snippet is cut from the hit and its neighbours.
        """
        limit = clamp("limit", limit)
        if not has_terms(query):
            raise ValueError("the query has no terms")
        p = planner.plan_one(self.spark, query, mode, prefix is not None, language is not None, file is not None)
        per = min(max(limit, 5) * 4, 64)
        chunks = self._chunks(repos, prefix, language, file, extensions)
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        found = retrieval.field_bm25(chunks, "id", retrieval.chunk_fields(), retrieval.flavored_terms(asked)).select(F.col("doc").alias("id"), "score")
        scored = _one_per_id(chunks.join(found.select("id"), "id", "left_semi")).join(found, "id").withColumn("score", F.col("score") + retrieval.chunk_boost(F.lit(query)))
        sources = [fusion.source(scored.select("repo", "id", "score"), "lexical", F.lit(p.lexical_weight), ["repo"], per)]
        places = chunks.select("repo", "relative_path", "id", F.col("start_line").alias("a"), F.col("end_line").alias("b")).distinct()
        rows = self._symbols().join(places.select("repo", "relative_path").distinct(), ["repo", "relative_path"], "left_semi")
        named = self._scored_symbols(query, rows).join(places, ["repo", "relative_path"])
        best = F.dense_rank().over(Window.partitionBy("repo").orderBy(F.desc("score"), "symbol_id"))
        within = named.where((F.col("a") <= F.col("start_line")) & (F.col("start_line") <= F.col("b"))).withColumn("best", best).where(F.col("best") <= per)
        held = within.groupBy("repo", "id").agg(F.sum("score").alias("score"))
        sources.append(fusion.source(held, "symbol", F.lit(p.symbol_weight), ["repo"], per, floor=None))
        if vector is not None and p.dense_weight > 0:
            near = retrieval.dense_scores(retrieval.one_vector(self.table("vector_doc")), vector).select("id", "score").join(places.select("id", "repo").distinct(), "id")
            sources.append(fusion.source(near.select("repo", "id", "score"), "dense", F.lit(p.dense_weight), ["repo"], per))
        fused = fusion.fuse(sources, ["repo"], by_source=["lexical", "symbol", "dense"])
        hits = fused.join(_one_per_id(chunks.join(fused.select("id"), "id", "left_semi")).drop("repo"), "id")
        if dedupe_by_file:
            hits = fusion.best_per_file(hits, [], ["repo", "relative_path"])
        order = [F.desc("score"), "relative_path", "start_line", "id"]
        top = hits.withColumn("score", T.rounded(F.greatest(F.col("score"), F.lit(0.0)))).orderBy(*order).limit(limit)
        fresh = state.stale(top, self.table("file_state"))
        if context:  # neighbours come from the files of the few hits
            files = _one_per_id(chunks.join(fresh.select("repo", "relative_path").distinct(), ["repo", "relative_path"], "left_semi"))
            fresh = fresh.drop("content").join(lines.with_neighbours(files, p.neighbours).select("id", F.col("context").alias("content")), "id")
        snippet = T.snippet(F.lit(query), F.col("content"), clamp("snippet_chars", snippet_chars)).alias("snippet")
        own = [T.rounded(T.positive(F.col(f"{x}_score"))).alias(f"{x}_score") for x in ("lexical", "symbol", "dense")]
        return fresh.select("repo", "relative_path", "start_line", "end_line", "id", "score", "match_type", "stale", "indexed_at", snippet, *own).orderBy(*order)

    def search_scope(self, query: str, repos: list[str], limit: int = 5, vectors: dict[str, list[float]] | None = None, profiles: dict[str, str] | None = None, **how: object) -> Found:
        """Search each repository of a scope apart; one that fails is reported and the others answer.

        ``profiles`` names each repository's embedding profile, ``vectors`` holds one query
        vector a profile, so a query is embedded once for all repositories of a profile.
        """
        found: DataFrame | None = None
        errors: dict[str, str] = {}
        for repo in dict.fromkeys(repos):  # as many as the scope has repositories
            try:
                vector = (vectors or {}).get((profiles or {}).get(repo, "default"))
                one = self.search_code(query, limit, repos=[repo], vector=vector, **how)
                found = one if found is None else found.unionByName(one)
            except Exception as e:  # noqa: BLE001 - one repository's failure does not stop the others
                errors.setdefault(repo, str(e))
        return Found(found.orderBy(F.desc("score"), "relative_path", "start_line", "id").limit(clamp("limit", limit)) if found is not None else None, errors)

    def search_symbols(self, query: str, limit: int = 5, repos: list[str] | None = None, prefix: str | None = None, language: str | None = None, kind: str | None = None, container: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """Symbols by name, and with a query vector by meaning too, fused by the plan's shares."""
        limit = clamp("limit", limit)
        rows = self._symbols()
        if repos:
            rows = rows.where(F.col("repo").isin(*repos))
        hits = self._scored_symbols(query, symbols.filtered(rows, prefix, language, kind, container))
        if vector is None or not self.has("symbol_vector"):
            return hits.orderBy(F.desc("score"), "repo", "symbol_id").limit(limit)
        p = planner.plan_one(self.spark, query, "auto", prefix is not None, language is not None)
        near = retrieval.dense_scores(self.table("symbol_vector").where("vector is not null"), vector).select("repo", "symbol_id", "score")
        stored = rows.select("repo", "symbol_id", "relative_path", "language", "name", "kind", "container", "start_line", "end_line")
        both = symbols.fused(hits.select("repo", "symbol_id", "score"), near, stored, p.symbol_lexical_share, p.symbol_semantic_share, limit, prefix, language, kind, container)
        return both.withColumn("score", T.rounded(F.col("score"))).orderBy(F.desc("score"), "repo", "symbol_id").limit(limit)

    def _scored_symbols(self, query: str, rows: DataFrame) -> DataFrame:
        """Every symbol of ``rows`` that shares a term with the query, with its score."""
        rows = rows.withColumn("key", F.concat_ws("\x1f", "repo", "symbol_id"))
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        scored = retrieval.field_bm25(rows, "key", retrieval.symbol_fields(), retrieval.flavored_terms(asked, symbols=True))
        hits = scored.join(rows, scored["doc"] == rows["key"]).withColumn("score", F.col("score") + retrieval.symbol_boost(F.lit(query)))
        return hits.select("repo", "symbol_id", "relative_path", "name", "kind", "container", "start_line", "end_line", T.rounded(F.col("score")).alias("score"))

    def symbol(self, symbol_id: str, repos: list[str] | None = None) -> DataFrame:
        rows = self._symbols().where(F.col("symbol_id") == symbol_id)
        return rows.where(F.col("repo").isin(*repos)) if repos else rows

    def search_text(self, needle: str, limit: int = 10, repos: list[str] | None = None, prefix: str | None = None, language: str | None = None, file: str | None = None, extensions: list[str] | None = None, case_sensitive: bool = True, whole_word: bool = False) -> DataFrame:
        """Lines with the literal, by path and line; a target must be bounded by file, prefix or one repository."""
        if not (file or prefix or repos and len(repos) == 1):
            raise ValueError("name a file, a prefix or one repository")
        rows = self._chunks(repos, prefix, language, file, extensions).withColumn("first", F.col("start_line"))
        found = lines.literal_matches(rows, ["repo", "relative_path", "first"], "content", needle, case_sensitive, whole_word)
        at = (F.col("first") + F.col("line_no") - 1).cast("long").alias("line_no")
        return found.select("repo", "relative_path", at, T.preview(F.col("line"), 180).alias("preview")).distinct().orderBy("relative_path", "line_no", "repo").limit(clamp("limit", limit))

    def get_file_outline(self, file: str, repos: list[str] | None = None, depth: int = 1, nodes: int = 12, top_level: int = 8) -> DataFrame:
        rows = self._symbols().where(T.normalized_path(F.col("relative_path")) == file.strip("/"))
        if repos:
            rows = rows.where(F.col("repo").isin(*repos))
        return symbols.outline(rows, clamp("nodes", nodes), clamp("top_level", top_level), clamp("depth", depth) - 1)

    def prepare_edit_target(self, repo: str, file: str | None = None, line_hint: int | None = None, query: str | None = None, symbol_name: str | None = None, symbol_id: str | None = None, occurrence: int | None = None, anchors: int = 2, before: int = 8, after: int = 24, max_lines: int = 96) -> DataFrame:
        """Places of a file to edit, the narrowest first: their lines, whether they are ready, and their anchors.

        A place is a symbol, given by id, by name, or as the smallest one around a line or
        around the chosen match of a literal (the nth, else the nearest to the line, else
        the only one). Lines are those of the live file if it can be read, else of its chunks. Where it has more than ``max_lines`` lines, or no symbol is there, a
        window around the match or line is the place (``kind`` is ``window``).
        """
        if line_hint is None and not query and not symbol_name and not symbol_id:
            raise ValueError("name a line, a literal or a symbol")
        if file is None and not symbol_id:
            raise ValueError("name a file or a symbol's id")
        spans = self._symbols().where(F.col("repo") == repo)
        if symbol_id:
            spans = spans.where(F.col("symbol_id") == symbol_id)
        if file:
            spans = spans.where(T.normalized_path(F.col("relative_path")) == file.strip("/"))
        if symbol_name:
            spans = spans.where(F.col("name") == symbol_name)
        spans = spans.where("start_line <= end_line").select("repo", "relative_path", "symbol_id", "name", "kind", "start_line", "end_line")
        key = ["repo", "relative_path"]
        chunks = self._live(repo, file) if file else None
        if chunks is None:
            chunks = self._chunks([repo], None, None, file, None)
            chunks = chunks if file else chunks.join(spans.select(*key).distinct(), key, "left_semi")
        numbered = lines.numbered(chunks, key, "content", F.col("start_line")).groupBy(*key, "line_no").agg(F.max("line").alias("line"))
        total = numbered.groupBy(*key).agg(F.max("line_no").alias("total"))
        focus = None
        if query:
            hits = numbered.where(F.contains("line", F.lit(query))).select(*key, "line_no")
            if symbol_id or symbol_name:
                hits = hits.join(spans, key).where(F.col("line_no").between(F.col("start_line"), F.col("end_line"))).select(*key, "line_no").distinct()
            if occurrence is None and line_hint is not None:
                focus = lines.pick(hits.withColumn("hint", F.lit(line_hint)), key, "hint").select(*key, "line_no")
            else:
                focus = lines.pick_nth(hits, key, occurrence)
        elif line_hint is not None:
            focus = total.where(F.col("total") >= line_hint).select(*key, F.lit(line_hint).cast("long").alias("line_no"))
        places = spans.withColumn("focus", F.col("start_line"))
        if focus is not None:
            most = clamp("max_lines", max_lines)
            around = spans.join(focus, key).where(F.col("line_no").between(F.col("start_line"), F.col("end_line")) & (F.col("end_line") - F.col("start_line") < most))
            fitting = around.select(*spans.columns, F.col("line_no").alias("focus"))
            window = lines.bounded_window(F.col("total"), F.col("line_no"), F.col("line_no"), clamp("before", before), clamp("after", after), most)
            alone = focus.join(fitting.select(*key).distinct(), key, "left_anti").join(total, key).withColumn("w", window)
            none = F.lit(None).cast("string")
            places = fitting.unionByName(alone.select(*key, none.alias("symbol_id"), none.alias("name"), F.lit("window").alias("kind"), F.col("w.start").alias("start_line"), F.col("w.end").alias("end_line"), F.col("line_no").alias("focus")))
        places = places.withColumn("place", F.concat_ws(":", "relative_path", F.coalesce("symbol_id", F.lit("")), F.col("start_line").cast("string")))
        owned = places.select(*key, "place", "start_line", "end_line")
        inside = (F.col("line_no") >= F.col("start_line")) & (F.col("line_no") <= F.col("end_line"))
        covered = numbered.join(owned, key).where(inside).select(*key, "place", "start_line", "line_no", "line")
        whole = numbered.select(*key, F.lit(None).cast("string").alias("place"), F.lit(None).cast("long").alias("start_line"), "line_no", "line")  # for uniqueness in the file
        best = lines.anchors(covered.unionByName(whole), ["place"], clamp("anchors", anchors), query, file=key, start="start_line", signature=None if not (symbol_id or symbol_name) else "start_line")
        picked = best.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("line_no", "anchor"))).alias("anchors"), F.count_if("unique_in_file").alias("unique"))
        size = (F.col("end_line") - F.col("start_line") + 1).cast("long")
        out = places.join(picked, "place", "left")
        return out.select("repo", "relative_path", "symbol_id", "name", "kind", "start_line", "end_line", lines.readiness(size, F.coalesce("unique", F.lit(0))).alias("status"), "anchors").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "symbol_id")

    def _live(self, repo: str, file: str) -> DataFrame | None:
        """The whole text of a file as it is now, if it is there to be read; chunks leave out what lies between definitions."""
        if not os.path.isdir(repo) or not os.path.isfile(scan.inside(repo, file)):
            return None
        now = scan.snapshot(self.spark, repo, file)
        return now.select(F.lit(repo).alias("repo"), "relative_path", F.col("text").alias("content"), F.lit(1).alias("start_line"))

    def explain_search(self, query: str, mode: str = "auto") -> planner.Plan:
        return planner.plan_one(self.spark, query, mode)

    def get_indexing_status(self) -> DataFrame:
        return state.totals(self.table("repo_state"))

    def list_scopes(self) -> DataFrame:
        return self.table("repo_state").select("repo", "status").distinct().orderBy("repo")

    def clear_index(self, repos: list[str]) -> dict[str, DataFrame]:
        """The tables without the given repositories and the vectors of their chunks; a ``Store`` drops them at once."""
        if isinstance(self.root, Store):
            self.root.clear(repos)
            return {t: self.root.read(t) for t in self.root.tables()}
        others = {t: self.table(t).where(~F.coalesce(F.col("repo").isin(*repos), F.lit(False))) for t in ("chunk_doc", "symbol_row", "file_state", "repo_state")}
        gone = self.table("chunk_doc").where(F.col("repo").isin(*repos)).select("id").distinct()
        return others | {"vector_doc": self.table("vector_doc").join(gone, "id", "left_anti")}


def insert_vectors(vectors: DataFrame, rows: DataFrame, metadata: list[str], embedder: embed.Embedder) -> DataFrame:
    """``vectors`` with new ``rows(id, content, ...)`` embedded and appended; the named columns become the JSON metadata."""
    made = rows.withColumn("metadata", F.to_json(F.struct(*metadata))).withColumn("vector", embed.embed(F.col("content"), embedder))
    return vectors.unionByName(made.select(*vectors.columns))


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def vector_ids_of_path(vectors: DataFrame, path: str) -> DataFrame:
    return vectors.where(F.col("relative_path") == path).select("id").distinct()


def _one_per_id(rows: DataFrame) -> DataFrame:
    """One row per id, the greatest of differing ones."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max(F.struct(*rest)).alias("x")).select("id", "x.*")


def has_terms(query: str) -> bool:
    return any(c.isascii() and (c.isalnum() or c == "_") for c in query)
