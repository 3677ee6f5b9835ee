"""Session helpers: table access, and cutting lineage in shared storage.

Iterative operators write their intermediate tables below the folder named by
``spark.checkpoint.dir``, which every executor shares, so a lost executor never
loses a result. Only where the setting is absent (tests on one machine) is a
temporary folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; one is made only where none is set and all runs on one machine."""
    there = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="skein-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(_KEY, f"file://{made}")
    return f"file://{made}"


class Stage:
    """Written tables of one run of an operator.

    ``drop`` frees those that are superseded; what is left can be freed by
    ``release`` once the results have been read. A ``lean`` run deletes the shuffle
    files of a table as soon as it is written, not when the driver collects garbage.
    """

    made: ClassVar[list[tuple[SparkSession, str]]] = []

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.root = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
        self._n = 0
        Stage.made.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(_CLEANUP, None)
        if self.lean:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if self.lean:
                self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._skein_path = path  # noqa: SLF001 - lives as long as the table
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._skein_path)  # noqa: SLF001


def small_side(table_: DataFrame, at_most: int) -> DataFrame:
    """``table_``, written before, for one side of a join: broadcast if it has at most ``at_most`` rows, shuffled beyond."""
    return F.broadcast(table_) if table_.count() <= at_most else table_


def release() -> None:
    """Delete the intermediate tables of all runs so far; results that are still to be read need theirs."""
    while Stage.made:
        spark, root = Stage.made.pop()
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
