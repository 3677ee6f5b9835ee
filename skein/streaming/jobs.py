"""Decisions of the indexing queue: what runs next, what is healed after a restart, what an audit does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between heartbeats, and seconds after which progress is stored again.
HEARTBEAT, PROGRESS_EVERY = 15, 2.0
FINGERPRINT = ("last_head", "last_index_mtime", "last_root_mtime")


def healed(states: DataFrame) -> DataFrame:
    """After a restart nothing runs: entries that were being indexed have failed."""
    cut_off = F.coalesce(F.col("status") == "indexing", F.lit(False))
    return states.withColumn("error_message", F.when(cut_off, "interrupted by a restart").otherwise(F.col("error_message"))).withColumn("status", F.when(cut_off, "indexfailed").otherwise(F.col("status")))


def audit(states: DataFrame, present: DataFrame) -> DataFrame:
    """``repo, action`` of every indexed repository: ``clear`` if it is gone, ``index`` if its fingerprint differs, else ``record``.

    ``present(repo, fingerprint columns)`` has a row for each repository that is there.
    """
    stored = states.where("repo is not null and status = 'indexed'").select("repo", *(F.col(c).alias(f"old_{c}") for c in FINGERPRINT))
    both = stored.join(present.select("repo", *FINGERPRINT, F.lit(True).alias("there")), "repo", "left")
    differs = F.lit(False)
    for c in FINGERPRINT:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(c))
    return both.select("repo", F.when(F.col("there").isNull(), "clear").when(differs, "index").otherwise("record").alias("action"))


def runnable(pending: DataFrame, states: DataFrame, recovering: DataFrame) -> DataFrame:
    """Pending requests in the order in which they are taken: only queued repositories that are not recovering, by name."""
    ready = pending.join(states.where("queue_state = 'queued'").select("repo").distinct(), "repo", "left_semi").join(recovering.select("repo").distinct(), "repo", "left_anti")
    return ready.withColumn("position", F.row_number().over(Window.orderBy("repo")).cast("long"))  # as many rows as repositories


def after(state: Column, event: Column) -> Column:
    """The state of a repository's job after an event; an event that does not apply changes nothing.

    Requests wait behind a running job; a job that failed or fell silent recovers
    before it may wait again.
    """
    return (
        F.when((event == "request") & (state == "idle"), "pending")
        .when((event == "start") & (state == "pending"), "running")
        .when((event == "request") & (state == "running"), "running")
        .when((event == "done") & (state == "running"), "idle")
        .when(event.isin("failed", "silent") & (state == "running"), "recovering")
        .when((event == "recovered") & (state == "recovering"), "pending")
        .otherwise(state)
    )


def queue_states(states: DataFrame, queued: DataFrame, failed: DataFrame) -> DataFrame:
    """Entries with ``index_status`` queued for waiting requests and failed with a message for refused ones; ``failed(repo, message)``."""
    waiting = queued.select("repo").distinct().withColumn("waiting", F.lit(True))
    both = states.join(waiting, "repo", "left").join(failed.groupBy("repo").agg(F.max("message").alias("message")), "repo", "left")
    status = F.when(F.col("message").isNotNull(), "indexfailed").otherwise(F.col("status"))
    marked = F.when(F.col("message").isNotNull(), "failed").when(F.col("waiting"), "queued").otherwise(F.col("index_status"))
    return both.withColumn("status", status).withColumn("index_status", marked).withColumn("error_message", F.coalesce("message", "error_message")).drop("waiting", "message")


def removed(states: DataFrame, present: DataFrame) -> DataFrame:
    """Repositories whose folder is gone, to be dropped from every table."""
    return states.where("repo is not null").select("repo").distinct().join(present.select("repo"), "repo", "left_anti")


def stored_progress(reports: DataFrame, run: str, order: list[str], percent: str, every: float = PROGRESS_EVERY) -> DataFrame:
    """Reports that are stored: the first of a run, a new whole percent, or ``every`` seconds after the last stored one.

    ``order`` begins with the time in seconds. A report depends on the last stored
    one before it, so a run's reports are folded in order: they are one job's.
    """
    fields = [*order, percent]
    listed = reports.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    kind = reports.select(F.struct(*fields).alias("x")).schema["x"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(None).cast("long").alias("percent"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        whole = F.floor(row[percent]).cast("long")
        store = acc["at"].isNull() | (whole != acc["percent"]) | (row[order[0]] - acc["at"] >= every)
        return F.when(store, F.struct(row[order[0]].cast("double").alias("at"), whole.alias("percent"), F.concat(acc["out"], F.array(row)).alias("out"))).otherwise(acc)

    return listed.select(run, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x")).select(run, "x.*")
