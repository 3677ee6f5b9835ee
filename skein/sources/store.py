"""Stored tables of an index: parts by repository and path, behind one small pointer a table.

A change writes new parts beside the old ones and becomes current by an atomic
rename of the pointer, so readers never see half a table and a failed write leaves
the old one in place. Only the parts that hold a changed file are written anew. All
files go through the Hadoop file system of the root, which may be any shared folder.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators import state

#: When a table is rewritten into fewer files.
MOST_FILES, LEAST_DELETED, DELETED_SHARE = 64, 256, 0.2
#: Parts of a repository, by its files' paths.
BUCKETS = 16


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root if "://" in root else f"file://{os.path.abspath(root)}"
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{name}.json"))

    def tables(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))

    def _pointer(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{name}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _point(self, name: str, pointer: dict) -> None:
        """Whole or not at all: a temporary file is renamed over the pointer."""
        temporary = self._path(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, self._path(f"{name}.json"), overwrite)

    def read(self, name: str) -> DataFrame:
        return self._parts(self._pointer(name))

    def _parts(self, pointer: dict, keys: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(pointer["schema"])
        folders = sorted({f"{self.root}/{f}" for k, f in pointer["parts"].items() if keys is None or k in keys})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table; the version before stays on disk until the next."""
        old = self._pointer(name) if self.exists(name) else {"parts": {}, "stale": []}
        self._commit(name, df.schema, self._save(name, df), {}, old)

    def _save(self, name: str, df: DataFrame) -> dict[str, str]:
        folder = f"{name}-{uuid.uuid4().hex}"
        keyed = df.withColumn("_part", _part(df.columns))
        keyed.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {m.removeprefix("_part="): f"{folder}/{m}" for m in made}

    def _commit(self, name: str, schema: StructType, new: dict[str, str], kept: dict[str, str], old: dict) -> None:
        parts = kept | new
        gone = sorted(set(old["parts"].values()) - set(parts.values()))
        self._point(name, {"schema": schema.jsonValue(), "parts": parts, "stale": gone})
        for folder in set(old.get("stale", [])) - set(parts.values()):
            self._fs.delete(self._path(folder), True)

    def _renew(self, name: str, changed: DataFrame, keys: list[str], fresh: DataFrame | None) -> None:
        pointer = self._pointer(name)
        columns = StructType.fromJson(pointer["schema"]).names
        if "repo" in keys and ("relative_path" in keys or "relative_path" not in columns):  # else a key may stand in any part
            touched = {r[0] for r in changed.select(_part([c for c in columns if c in changed.columns]).alias("p")).distinct().collect()}  # at most as many as parts
        else:
            touched = set(pointer["parts"])
        old = self._parts(pointer, touched)
        rows = state.deleted(old, changed, keys)
        if fresh is not None:
            rows = rows.unionByName(fresh)
        kept = {k: v for k, v in pointer["parts"].items() if k not in touched}
        self._commit(name, old.schema, self._save(name, rows), kept, pointer)

    def upsert(self, name: str, fresh: DataFrame, keys: list[str], gone: DataFrame | None = None) -> None:
        """Rows of the fresh rows' keys, and of ``gone``, give way to the fresh rows."""
        if not self.exists(name):
            self.write(name, fresh)
            return
        changed = fresh.select(*keys)
        self._renew(name, changed if gone is None else changed.unionByName(gone.select(*keys)), keys, fresh)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        if self.exists(name):
            self._renew(name, gone, keys, None)

    def clear(self, repos: list[str]) -> dict[str, str]:
        """Drop repositories from every table; what went wrong by table, empty if nothing did."""
        errors = {}
        gone = self.spark.createDataFrame([(r,) for r in repos], "repo string")
        for name in self.tables():
            try:
                if "repo" in self.read(name).columns:
                    self.write(name, state.deleted(self.read(name), gone, ["repo"]))
            except Exception as e:  # noqa: BLE001 - one table's failure does not stop the others
                errors[name] = str(e)
        return errors

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{name}.json"), False)
        for s in self._fs.listStatus(self._path()):
            if s.getPath().getName().startswith(f"{name}-"):
                self._fs.delete(s.getPath(), True)

    def files(self, name: str) -> int:
        return len(self.read(name).inputFiles())

    def compact(self, name: str, deleted: int = 0, rows: int = 0) -> bool:
        """Rewrite a table of too many files a part, or of which much was deleted; says whether it did."""
        many = MOST_FILES * max(1, len(self._pointer(name)["parts"]))
        if self.files(name) <= many and not (deleted >= LEAST_DELETED and deleted >= DELETED_SHARE * max(rows, 1)):
            return False
        df = self.read(name)
        self.write(name, df.repartition(*[c for c in ("repo", "relative_path") if c in df.columns]) if "repo" in df.columns else df.coalesce(1))
        return True


def _part(columns: list[str]) -> Column:
    """The part of a row, by the hash of its repository and a bucket of its path; plain letters and digits."""
    if "repo" not in columns:
        return F.lit("all")
    bucket = F.pmod(F.xxhash64("relative_path"), F.lit(BUCKETS)).cast("string") if "relative_path" in columns else F.lit("0")
    return F.concat_ws("-", F.left(F.md5(F.coalesce("repo", F.lit(""))), F.lit(16)), bucket)


def write_json(path: Path, value: object) -> None:
    """Whole or not at all: a temporary file is renamed. For small driver-side files."""
    temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    temporary.write_text(json.dumps(value, indent=2, sort_keys=True))
    os.replace(temporary, path)


def read_json(path: Path, default: object) -> object:
    return json.loads(path.read_text()) if path.exists() else default
