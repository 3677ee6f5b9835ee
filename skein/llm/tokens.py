"""Token counts by a public byte-level vocabulary whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary to the workers, which need no file of their own at that path."""
    spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> list[int]:
    return encoding(path).encode_ordinary(text)


def counted(rows: DataFrame, keys: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens``; a null text has none."""
    fields = rows.select(*keys).schema
    ship(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(path, t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    return rows.select(*keys, F.col(text)).mapInArrow(run, fields.add("n_tokens", "long"))
