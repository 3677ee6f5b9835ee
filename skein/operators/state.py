"""The state of an index: differences of file hashes, upserts, overlays, coverage and status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import filters

KEY = ["repo", "relative_path"]
#: Statuses by priority; overlay states that hide canonical files, and that can be searched.
STATUS_ORDER = ("indexing", "indexfailed", "indexed")
HIDING, SEARCHABLE = ("completed", "empty", "too_large"), ("completed", "empty")
#: How many chunks one run may add, and when vectors are flushed.
CHUNK_BUDGET, FLUSH_FILES = 450_000, 32


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``repo, relative_path, change``: added, removed, modified or unchanged. A null hash differs from any other."""
    a = before.select(*KEY, F.col("file_hash").alias("h0"), F.lit(True).alias("was"))
    b = now.select(*KEY, F.col("file_hash").alias("h1"), F.lit(True).alias("is_"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged").otherwise("modified")
    return a.join(b, KEY, "full_outer").select(*KEY, change.alias("change"))


def change_counts(changed: DataFrame, by: list[str], indexed: DataFrame | None = None) -> DataFrame:
    """Counts by kind; of added and modified files only those count that were really indexed, if these are given."""
    if indexed is not None:
        done = indexed.select(*KEY).distinct().withColumn("done", F.lit(True))
        changed = changed.join(done, KEY, "left").where(F.col("done") | ~F.col("change").isin("added", "modified"))
    return changed.groupBy(*by).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed", "unchanged")))


def carried_forward(before: DataFrame, changed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Hashes to keep: those neither removed nor modified, and those just indexed."""
    gone = changed.where(F.col("change").isin("removed", "modified")).select(*KEY)
    return before.join(gone, KEY, "left_anti").select(*KEY, "file_hash").unionByName(indexed.select(*KEY, "file_hash"))


def replaced(stored: DataFrame, fresh: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Upsert: all stored rows of the fresh rows' files give way to the fresh rows."""
    by = by or KEY
    return stored.join(fresh.select(*by).distinct(), by, "left_anti").unionByName(fresh)


def deleted(stored: DataFrame, keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or KEY
    return stored.join(keys.select(*by).distinct(), by, "left_anti")


def suppressed(hits: DataFrame, overlay: DataFrame) -> DataFrame:
    """Canonical hits whose file the overlay does not replace or delete; ``overlay(repo, relative_path, overlay_status)``."""
    hides = F.col("overlay_status").isNull() | F.col("overlay_status").isin(*HIDING)
    return hits.join(overlay.where(hides).select(*KEY).distinct(), KEY, "left_anti")


def merged(canonical: DataFrame, overlay_hits: DataFrame, overlay: DataFrame) -> DataFrame:
    return suppressed(canonical, overlay).unionByName(overlay_hits)


def merged_top(canonical: DataFrame, overlay_hits: DataFrame, overlay: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the merged hits of every repository, by score, path and id, with their 0-based rank."""
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "relative_path", "id")
    return merged(canonical, overlay_hits, overlay).withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < k)


def candidate_files(canonical: DataFrame, overlay_files: DataFrame, overlay: DataFrame) -> DataFrame:
    """``repo, relative_path``, each once: canonical files that no overlay hides, and the overlay's own."""
    return suppressed(canonical.select(*KEY), overlay).unionByName(overlay_files.select(*KEY)).distinct()


def overlay_first(overlay_rows: DataFrame, canonical: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the overlay's where it has one, else the canonical one."""
    return overlay_rows.unionByName(canonical.join(overlay_rows.select(*key).distinct(), key, "left_anti"))


def hidden_files(overlay_states: DataFrame) -> DataFrame:
    """``repo, relative_path`` that overlays replace or delete; ``overlay_states(repo, replaced_paths, deleted_paths)``."""
    paths = F.array_union(F.coalesce("replaced_paths", F.array().cast("array<string>")), F.coalesce("deleted_paths", F.array().cast("array<string>")))
    return overlay_states.select("repo", F.explode(paths).alias("relative_path")).distinct()


def file_metadata(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, relative_path, indexed_at, file_hash``: of a file's first chunk, else of its first symbol."""

    def first(rows: DataFrame, tie: str) -> DataFrame:
        best = F.min_by(F.struct("indexed_at", "file_hash"), F.struct("start_line", "end_line", tie))
        return rows.where("repo is not null and relative_path is not null").groupBy(*KEY).agg(best.alias("m"))

    both = first(chunks, "id").join(first(symbols, "symbol_id").withColumnRenamed("m", "s"), KEY, "full_outer")
    return both.select(*KEY, F.coalesce("m.indexed_at", "s.indexed_at").alias("indexed_at"), F.coalesce("m.file_hash", "s.file_hash").alias("file_hash"))


def coverage(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo").agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"))


def index_status(files: Column, chunks: Column, limit: int = CHUNK_BUDGET) -> Column:
    return F.when((files == 0) | (chunks == 0), "empty").when(chunks >= limit, "limit_reached").otherwise("completed")


def totals(states: DataFrame) -> DataFrame:
    """Totals over all repositories and the overall status: the first of the priority order that occurs."""
    overall = F.lit("not_indexed")
    for s in reversed(STATUS_ORDER):
        overall = F.when(F.bool_or(F.coalesce(F.col("status") == s, F.lit(False))), s).otherwise(overall)
    zero = F.lit(0).cast("long")
    return states.agg(
        F.coalesce(F.sum(F.coalesce("indexed_files", zero)), zero).alias("indexed_files"),
        F.coalesce(F.sum(F.coalesce("total_chunks", zero)), zero).alias("total_chunks"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"),
        overall.alias("status"),
    )


def stale(hits: DataFrame, now: DataFrame) -> DataFrame:
    """Hits with ``stale``: the file is gone, or its hash differs from the indexed one."""
    current = now.groupBy(*KEY).agg(F.max(F.coalesce("file_hash", F.lit(""))).alias("now"))
    return hits.join(current, KEY, "left").withColumn("stale", F.col("now").isNull() | ~F.col("now").eqNullSafe(F.coalesce("file_hash", F.lit("")))).drop("now")


def root_hashes(files: DataFrame, algorithm: str = "xxh3") -> DataFrame:
    """``repo, root_hash``: one hash over the lines ``path:hash`` of a repository's files, each with its line end, in path order.

    Files stream through one task per repository in order, so no repository is held
    in memory. ``algorithm`` is ``xxh3`` (128 bits) or ``md5``. Repeated files count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo: str | None = None
        done: list[tuple[str, str]] = []
        begun, digest = False, None
        for batch in batches:
            for r, path, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or r != repo:
                    if begun:
                        done.append((repo, digest.hexdigest()))
                    begun, repo, digest = True, r, xxhash.xxh3_128() if algorithm == "xxh3" else hashlib.md5()
                digest.update(f"{path}:{h}\n".encode())
        if begun:
            done.append((repo, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["repo", "root_hash"])

    rows = files.where("relative_path is not null").select("repo", "relative_path", F.coalesce("file_hash", F.lit("")).alias("file_hash")).distinct()
    return rows.repartition("repo").sortWithinPartitions("repo", "relative_path", "file_hash").mapInArrow(run, "repo string, root_hash string")


def profile_usage(states: DataFrame) -> DataFrame:
    """``profile, repos``: how many repositories use each embedding profile; none is ``''``."""
    return states.where("repo is not null").groupBy(F.coalesce("embedding_profile", F.lit("")).alias("profile")).agg(F.countDistinct("repo").alias("repos"))


def with_status(states: DataFrame, statuses: list[str], profile: str | None = None) -> DataFrame:
    """Entries of one of the statuses, or, if a profile is wanted, of another profile; ``reason`` says which."""
    by_status = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    by_profile = ~F.col("embedding_profile").eqNullSafe(F.lit(profile)) if profile is not None else F.lit(False)
    return states.where("repo is not null").where(by_status | by_profile).withColumn("reason", F.when(by_status, "status").otherwise("profile"))


def overlay_size(changed: DataFrame, files_at_most: int, bytes_at_most: int) -> DataFrame:
    """``repo, changed_files, overlay_bytes, too_large`` of the changed files of working copies; ``changed(repo, relative_path, bytes)``."""
    sums = changed.groupBy("repo").agg(F.count(F.lit(1)).alias("changed_files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("overlay_bytes"))
    return sums.withColumn("too_large", (F.col("changed_files") > files_at_most) | (F.col("overlay_bytes") > bytes_at_most))


def within_budget(files: DataFrame, limit: int = CHUNK_BUDGET) -> DataFrame:
    """Files in path order until the next would exceed the chunk budget; ``files(repo, relative_path, chunks)``."""
    w = Window.partitionBy("repo").orderBy("relative_path")
    running = F.sum("chunks").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((running > limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("over", over).where("over = 0").drop("over")


def orphans(existing: DataFrame, expected: DataFrame, by: str = "name") -> DataFrame:
    return existing.join(expected.select(by).distinct(), by, "left_anti")


def hygiene(existing: DataFrame, expected: DataFrame, warm: int) -> tuple[DataFrame, int]:
    """Managed collections that nothing expects any more, and how many should be loaded at most: two for each warm repository."""
    return orphans(existing.where(filters.managed(F.col("name"))), expected), 2 * warm


def maintenance(full: bool, changed_files: int) -> tuple[bool, bool]:
    """``(release, flush)`` of vectors after a run: on any change, and after a full run or many changed files."""
    return full or changed_files > 0, full or changed_files >= FLUSH_FILES


def merge_requests(requests: DataFrame) -> DataFrame:
    """Pending requests per repository: flags are OR-ed, the last non-empty lists win."""
    last = [F.max_by(c, F.when(F.size(c) > 0, F.col("at"))).alias(c) for c in ("custom_extensions", "ignore_patterns") if c in requests.columns]
    return requests.groupBy("repo").agg(F.bool_or("force").alias("force"), F.bool_or("explicit").alias("explicit"), F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), *last)


def changed_fingerprint(a: str = "old", b: str = "new") -> Column:
    """Any of head and times differs; without an entry nothing has changed."""
    parts = [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("last_head", "last_index_mtime", "last_root_mtime")]
    return F.coalesce(F.col(f"{a}.repo").isNotNull() & (parts[0] | parts[1] | parts[2]), F.lit(False))


def identity_reason(entry: dict[str, Column], wanted: dict[str, str]) -> Column:
    """The first of format, root version, profile and fingerprint that differs; null if none does."""
    return F.coalesce(*(F.when(~entry[k].eqNullSafe(F.lit(v)), k) for k, v in wanted.items()))
