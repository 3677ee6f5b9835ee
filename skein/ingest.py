"""Indexing repositories: scan, compare with the stored hashes, and renew what changed."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import embed
from skein.functions import text as T
from skein.operators import state, symbols
from skein.sources import config, scan
from skein.sources.store import Store

KEY = ["repo", "relative_path"]


def index_repo(spark: SparkSession, root: str, before: DataFrame | None = None, extensions: list[str] | None = None, ignore: list[str] | None = None, embedder: embed.Embedder | None = None, now: str | None = None) -> dict[str, DataFrame]:
    """``file_state``, ``changes`` and the fresh rows of ``chunk_doc``, ``symbol_row``, ``vector_doc`` and ``symbol_vector``.

    Without stored hashes every file counts as added. Only added and modified files
    are cut and embedded; rows of removed and modified ones are for the caller to
    drop. Of symbols with one id the first by line counts.
    """
    now = now or datetime.now(UTC).isoformat(timespec="seconds")
    files = scan.scan(spark, root, extensions, ignore)
    old = before if before is not None else files.select(*KEY, "file_hash").where(F.lit(False))
    changes = state.changes(old, files)
    todo = files.join(changes.where(F.col("change").isin("added", "modified")), KEY, "left_semi")
    hashes = todo.select(*KEY, "file_hash")
    made = scan.chunks_and_symbols(todo)
    stamp = F.lit(now).alias("indexed_at")
    rows = made.join(hashes, KEY)
    chunk = T.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content"))
    name, ext = T.basename(F.col("relative_path")), T.extension(F.col("relative_path"))
    chunks = rows.select(chunk.alias("id"), *KEY, name.alias("basename"), ext.alias("extension"), "language", "content", "start_line", "end_line", stamp, "file_hash").distinct()
    return {
        "file_state": files.select(*KEY, "file_hash"),
        "changes": changes,
        "chunk_doc": chunks,
        "symbol_row": _symbols(rows, stamp),
        **({"vector_doc": _vectors(chunks, embedder)} if embedder else {}),
    }


def _symbols(rows: DataFrame, stamp: Column) -> DataFrame:
    """Symbols with the id of the narrowest symbol around each as its parent."""
    sid = T.symbol_id(F.col("relative_path"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line"))
    named = rows.where("name is not null").withColumn("symbol_id", sid)
    first = Window.partitionBy("repo", "symbol_id").orderBy("start_line", "end_line", "name")
    one = named.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    above = one.select(*KEY, F.col("symbol_id").alias("p"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    around = (F.col("a") <= F.col("start_line")) & (F.col("end_line") <= F.col("b")) & (F.col("p") != F.col("symbol_id")) & ((F.col("b") - F.col("a")) > (F.col("end_line") - F.col("start_line")))
    parents = one.join(above, KEY).where(around).groupBy("repo", "symbol_id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("w"), "a", "p"))["p"].alias("parent_symbol_id"))
    return one.join(parents, ["repo", "symbol_id"], "left").select("symbol_id", *KEY, "name", "kind", "container", "language", "start_line", "end_line", stamp, "file_hash", "parent_symbol_id")


def _vectors(chunks: DataFrame, embedder: embed.Embedder) -> DataFrame:
    meta = F.to_json(F.struct(F.col("repo").alias("codebasePath"), "language", "basename"))
    return chunks.select("id", "repo", "relative_path", F.col("extension").alias("file_extension"), "content", meta.alias("metadata"), embed.embed(F.col("content"), embedder).alias("vector"), "start_line", "end_line")


def symbol_vectors(rows: DataFrame, embedder: embed.Embedder) -> DataFrame:
    """``repo, symbol_id, relative_path, vector``: symbols embedded by a sentence about them."""
    text = symbols.semantic_text(F.col("kind"), F.col("name"), F.col("container"), F.col("relative_path"), F.col("language"))
    return rows.select("repo", "symbol_id", "relative_path", embed.embed(text, embedder).alias("vector"))


def refresh(store: Store, root: str, embedder: embed.Embedder | None = None, force: bool = False, extensions: list[str] | None = None, ignore: list[str] | None = None) -> dict[str, int | str]:
    """Bring the stored tables up to date with a repository; what was done, as counts and a status.

    Everything is indexed anew if forced, if no hashes are stored, or if the stored
    fingerprint of the embedder is another. Hashes are stored after all else, so a run
    that breaks off is made good by the next.
    """
    spark = store.spark
    root = config.clean_path(root)
    wanted = embed.fingerprint(embedder) if embedder else "none"
    before = None
    if store.exists("file_state") and store.exists("repo_state") and not force:
        entry = store.read("repo_state").where(F.col("repo") == root).select("embedding_fingerprint").first()
        if entry and entry[0] == wanted:
            before = store.read("file_state").where(F.col("repo") == root)
    made = index_repo(spark, root, before, extensions, ignore, embedder)
    changes = made["changes"].persist()
    try:
        gone = changes.where("change != 'unchanged'").select(*KEY)
        if before is None and store.exists("file_state"):  # a full run replaces all that was there
            gone = gone.unionByName(store.read("file_state").where(F.col("repo") == root).select(*KEY)).distinct()
        for name in ("chunk_doc", "symbol_row", "vector_doc"):
            if name in made:
                store.upsert(name, made[name], KEY, gone)
            else:
                store.delete(name, gone, KEY)
        if embedder:
            fresh = store.read("symbol_row").join(changes.where("change in ('added', 'modified')"), KEY, "left_semi")
            store.upsert("symbol_vector", symbol_vectors(fresh, embedder), KEY, gone)
        store.upsert("file_state", made["file_state"], KEY, gone)
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    finally:
        changes.unpersist()
    have = store.read("chunk_doc").where(F.col("repo") == root).agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks")).first()
    status = "empty" if not have["files"] else "limit_reached" if have["chunks"] >= state.CHUNK_BUDGET else "completed"
    mark = config.fingerprint(root)
    row = (root, "indexed", status, have["files"], have["chunks"], wanted, mark["last_head"], mark["last_index_mtime"], mark["last_root_mtime"], datetime.now(UTC).isoformat(timespec="seconds"))
    schema = "repo string, status string, index_status string, indexed_files long, total_chunks long, embedding_fingerprint string, last_head string, last_index_mtime long, last_root_mtime long, last_updated string"
    entry = spark.createDataFrame([row], schema).withColumn("error_message", F.lit(None).cast("string"))
    store.upsert("repo_state", entry, ["repo"])
    return {"added": 0, "modified": 0, "removed": 0, "unchanged": 0, **counts, "files": have["files"], "chunks": have["chunks"], "status": status}


def refresh_overlay(store: Store, canonical: str, copy: str, embedder: embed.Embedder | None = None, files_at_most: int = config.OVERLAY_FILES, bytes_at_most: int = config.OVERLAY_BYTES) -> dict[str, object]:
    """Index what a working copy changed against the indexed repository, as tables ``overlay_...`` under the repository's name.

    Over the caps only the hidden paths are kept (``too_large``). The state lists the
    replaced and deleted files; a refresh of the repository makes it stale.
    """
    spark = store.spark
    canonical, copy = config.clean_path(canonical), config.clean_path(copy)
    own = store.read("file_state").where(F.col("repo") == canonical)
    live = scan.scan(spark, copy).withColumn("repo", F.lit(canonical))
    changes = state.changes(own, live.select(*KEY, "file_hash"))
    replaced = changes.where("change in ('added', 'modified')")
    fresh = live.join(replaced, KEY, "left_semi")
    size = state.overlay_size(fresh, files_at_most, bytes_at_most).first()
    gone = [r[0] for r in changes.where("change = 'removed'").select("relative_path").collect()]  # of one repository
    over = bool(size and size["too_large"]) or len(gone) + (size["changed_files"] if size else 0) > files_at_most
    paths = [r[0] for r in replaced.select("relative_path").collect()]
    oid = config.overlay_id(canonical, copy)
    mine = spark.createDataFrame([(canonical, oid)], "repo string, overlay_id string")
    if not over and paths:
        made = scan.chunks_and_symbols(fresh).join(fresh.select(*KEY, "file_hash"), KEY)
        stamp = F.lit(datetime.now(UTC).isoformat(timespec="seconds")).alias("indexed_at")
        chunk = T.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content"))
        name, ext = T.basename(F.col("relative_path")), T.extension(F.col("relative_path"))
        rows = made.select(F.lit(oid).alias("overlay_id"), chunk.alias("id"), *KEY, name.alias("basename"), ext.alias("extension"), "language", "content", "start_line", "end_line", stamp, "file_hash").distinct()
        store.upsert("overlay_chunk_doc", rows, ["repo", "overlay_id"], mine)
        store.upsert("overlay_symbol_row", _symbols(made, stamp).withColumn("overlay_id", F.lit(oid)), ["repo", "overlay_id"], mine)
    else:
        for table_ in ("overlay_chunk_doc", "overlay_symbol_row"):
            store.delete(table_, mine, ["repo", "overlay_id"])
    status = "too_large" if over else "completed" if paths or gone else "empty"
    row = (oid, canonical, copy, paths, gone, len(paths), len(gone), int(size["overlay_bytes"]) if size else 0, status)
    schema = "overlay_id string, repo string, root string, replaced_paths array<string>, deleted_paths array<string>, changed_files long, deleted_files long, overlay_bytes long, overlay_status string"
    store.upsert("overlay_state", spark.createDataFrame([row], schema), ["repo", "overlay_id"])
    return {"overlay_id": oid, "status": status, "replaced": paths, "deleted": gone}


def make_overlays_stale(store: Store, canonical: str) -> None:
    """After a repository was indexed anew, its working copies' overlays no longer hold."""
    if store.exists("overlay_state"):
        mine = F.col("repo") == config.clean_path(canonical)
        old = store.read("overlay_state").where(mine)
        store.upsert("overlay_state", old.withColumn("overlay_status", F.lit("stale")), ["repo", "overlay_id"])
