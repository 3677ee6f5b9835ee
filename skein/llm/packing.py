"""Filling containers of fixed capacity, with certified bounds.

Items are packed partition by partition with best-fit decreasing. A lower bound
from dual feasible functions certifies a partition whose containers cannot be
fewer; partitions with a gap give the items of their containers that are not
full into a common pool, which is partitioned anew and packed again, a few
times over. An item larger than the capacity is cut into full containers and a
rest; no other item is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Stage

_PACKED = "doc_id long, piece int, n_tokens long, part int, bin int, free int, gap int"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(container of each item, free space of each container)``; equal sizes are taken in their order."""
    where = np.zeros(len(sizes), dtype=np.int64)
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    there = 0  # bit f is set while a container has f free
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = there >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            stack = by_free[f]
            b = stack.pop()
            if not stack:
                there &= ~(1 << f)
        else:
            b, f = len(free), capacity
            free.append(capacity)
        free[b] = rest = f - size
        by_free.setdefault(rest, []).append(b)
        there |= 1 << rest
        where[i] = b
    return where, np.array(free, dtype=np.int64)


def lower_bound(counts: np.ndarray, capacity: int, most_k: int = 24) -> int:
    """Containers needed at least for ``counts[s]`` items of each size ``s``, by two families of dual feasible functions."""
    s = np.arange(len(counts), dtype=np.int64)
    c = counts.astype(np.int64)
    best = -(-int((s * c).sum()) // capacity)
    above = np.concatenate([np.cumsum(c[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(s * c)])
    for cut in range(1, capacity // 2 + 1):  # items over capacity - cut fill a container, items below cut count nothing
        high = capacity - cut
        total = int(above[min(high + 1, len(c))]) * capacity + int(mass[min(high + 1, len(c))] - mass[min(cut, len(c))])
        best = max(best, -(-total // capacity))
    for k in range(1, most_k + 1):  # sizes rounded down to multiples of 1/(k + 1), scaled to 1/k
        scaled, odd = (k + 1) * s // capacity, (k + 1) * s % capacity
        value = np.where(odd == 0, s * k, scaled * capacity)
        best = max(best, -(-int((value * c).sum()) // (capacity * k)))
    return best


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, n_tokens`` with every piece at most ``capacity``; items without tokens give no piece."""
    full = F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / capacity) - 1).cast("int"))
    return sized.where("doc_id is not null and n_tokens > 0").select("doc_id", F.explode(full).alias("piece"), F.col("n_tokens").alias("all")).select(
        "doc_id", "piece", F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("long").alias("n_tokens")
    )


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["piece"].to_numpy(), group["doc_id"].to_numpy()))
        group = group.take(pa.array(order))
        sizes = group["n_tokens"].to_numpy()
        where, free = best_fit_decreasing(sizes, capacity)
        gap = len(free) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        n = len(sizes)
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "piece": group["piece"].cast(pa.int32()),
                "n_tokens": group["n_tokens"],
                "part": group["part"].cast(pa.int32()),
                "bin": pa.array(where.astype(np.int32)),
                "free": pa.array(free[where].astype(np.int32)),
                "gap": pa.array(np.full(n, gap, np.int32)),
            }
        )

    return run


def pack(sized: DataFrame, capacity: int, rounds: int = 3, part_items: int = 20_000) -> DataFrame:
    """``doc_id, piece, n_tokens, container_id`` for all items with tokens.

    Each task packs about ``part_items`` items, whatever the table's size. Items
    with null ids, and texts that are null or empty, take no space and get no
    container; repeated ids are items of their own. Ties go by id.
    """
    stage = Stage(sized.sparkSession, "packing")
    pool = stage.save(pieces(sized, capacity))
    done: list[DataFrame] = []
    for k in range(rounds):
        n = pool.count()
        parts = max(1, -(-n // part_items))
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), F.lit(parts)).cast("int")
        packed = stage.save(pool.withColumn("part", part).groupBy("part").applyInArrow(_packer(capacity), _PACKED))
        # A certified partition stays; of the others, full containers stay and the rest is exchanged.
        stays = (F.col("gap") <= 0) | (F.col("free") == 0)
        last = k == rounds - 1 or parts == 1
        kept = packed if last else packed.where(stays)
        done.append(kept.select("doc_id", "piece", "n_tokens", F.format_string("%d-%d-%d", F.lit(k), "part", "bin").alias("container_id")))
        if last:
            break
        pool = packed.where(~stays).select("doc_id", "piece", "n_tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def report(sized: DataFrame, packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, tokens, containers, the lower bound over all items, and the share of filled space."""
    sizes = pieces(sized, capacity).groupBy("n_tokens").count().collect()  # at most one row per size up to the capacity
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes:
        counts[r["n_tokens"]] = r["count"]
    bound = lower_bound(counts, capacity)
    return packed.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.countDistinct("container_id").alias("containers")).select(
        "items", "tokens", "containers", F.lit(bound).cast("long").alias("lower_bound"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill")
    )
