"""Embeddings: any class with ``name``, ``dimension`` and ``embed``; a hashing one is built in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

#: Fixed value: texts given to a provider at once.
BATCH = 64


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashes of lower-case words, scaled to unit length; the same text gives the same vector anywhere."""

    name = "hashing"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(out[i])
            out[i] = out[i] / n if n else out[i]
        return out.astype(np.float32).tolist()


def fingerprint(embedder: Embedder) -> str:
    return f"{embedder.name}:{embedder.dimension}"


def embed(text: Column, embedder: Embedder) -> Column:
    """Vectors of texts in batches; a null text gives null. A provider must answer each text."""

    @pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[list[float] | None] = [None] * len(s)
            there = [i for i, t in enumerate(s) if t is not None]
            for at in range(0, len(there), BATCH):
                part = there[at : at + BATCH]
                got = embedder.embed([s.iloc[i] for i in part])
                if len(got) != len(part):
                    raise RuntimeError("the provider left out texts")
                for i, v in zip(part, got, strict=True):
                    out[i] = v
            yield pd.Series(out)

    return run(text)
