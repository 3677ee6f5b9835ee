"""Refresh requests as a stream: merged per repository, kept as a small state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import state

REQUESTS = "repo string, force boolean, explicit boolean, at timestamp, custom_extensions array<string>, ignore_patterns array<string>"
#: Fixed value: seconds of silence after which a running request counts as failed.
STALE_AFTER = 300


def pending(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming requests from Parquet files below ``path``."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_queue(requests: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Merge every batch into the queue table at ``target``; a batch that is run again changes nothing.

    The table has one version a batch, of which the last two are kept; the newest
    complete version is the state. Lists that come later and are not empty replace
    earlier ones.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = state.merge_requests(batch)
        if number:
            old = spark.read.parquet(f"{target}/v={number - 1}")
            last = [F.max_by(c, F.when(F.size(c) > 0, F.col("at"))).alias(c) for c in ("custom_extensions", "ignore_patterns")]
            fresh = old.unionByName(fresh).groupBy("repo").agg(F.bool_or("force").alias("force"), F.bool_or("explicit").alias("explicit"), F.sum("n").alias("n"), F.max("at").alias("at"), *last)
        fresh.write.mode("overwrite").parquet(f"{target}/v={number}")
        if number > 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return requests.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed_out(running: DataFrame, now: str) -> DataFrame:
    """Running entries without a heartbeat for too long; an unknown time counts as too long."""
    silent = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("heartbeat"))
    return running.where(F.coalesce(silent > STALE_AFTER, F.lit(True)))
