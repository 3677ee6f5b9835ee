"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification.

A text's weighted words are taken as unit-weight elements ``(word, occurrence)``,
so that the probability Jaccard similarity that ProbMinHash estimates equals the
sum of minima over the sum of maxima of the word counts. Each element is a
Poisson process of arrivals at registers; a register keeps the element that
arrives first, and an element stops as soon as its next arrival is later than
every register of its text. Texts with equal word counts form one class and are
signed once. Classes that share a band are compared exactly.

Skew: copies collapse into classes before anything is shuffled by band; bands
with one class are dropped. Shared bands grow with the square of the corpus in
pairs, but not in rows, so pairs are made and judged inside the task that holds
the rows: in a band of few classes by their signatures, in a band of very many
(shared boilerplate) by exact counts of common elements, block against block, so
that no group is held by one task. Only pairs that pass are written.

Disk: rows that are shuffled with signatures or elements are taken in slices, as
many as their counted number asks for, and a slice's shuffle files are deleted
once its result is written.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import Stage, small_side

WORD = re.compile(r"[a-z0-9_]{3,}")
_PROFILE = "id string, cls binary, copy long, total int, sketch binary, elems array<long>, bands array<long>"
_SKETCH = 96
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, used as the random source of an element's process."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def probminhash(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signature matrix ``n_docs x registers`` of element ids (uint64; 0 for a text without elements)."""
    arrival = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    t = np.zeros(len(elem))
    doc, elem, rate = doc.copy(), elem.astype(np.uint64), 1.0 / weight
    step = 0
    with np.errstate(over="ignore"):
        while len(elem):
            step += 1
            r = _mix(elem + _U(step) * _U(0x9E3779B97F4A7C15))
            t = t - np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0**-53) * rate
            on = t < latest[doc]
            doc, elem, rate, t, r = doc[on], elem[on], rate[on], t[on], r[on]
            cell = doc * registers + (_mix(r) % _U(registers)).astype(np.int64)
            np.minimum.at(arrival, cell, t)
            won = arrival[cell] == t
            owner[cell[won]] = elem[won]
            latest = arrival.reshape(n_docs, registers).max(axis=1)
    return owner.reshape(n_docs, registers)


def _band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, k = signature.shape
    rows = k // bands
    key = np.zeros((n, bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        parts = signature[:, : bands * rows].reshape(n, bands, rows)
        for i in range(rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
        key = _mix(key + np.arange(bands, dtype=np.uint64)[None, :])
    return key.astype(np.int64)


class _Ids(dict):
    """64-bit ids of (word, occurrence); kept for the words seen by a task."""

    def __missing__(self, key: tuple[str, int]) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[key] = v = xxhash.xxh3_64_intdigest(f"{key[0]} {key[1]}")
        return v


def profile(texts: DataFrame, text_id: str, text: str, min_words: int, bands: int, rows: int) -> DataFrame:
    """One row per text of at least ``min_words`` words: class, hash of the text itself, elements and band keys.

    Null ids and null texts give no row; short and empty texts are below ``min_words``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        schema = pa.schema([("id", pa.string()), ("cls", pa.binary()), ("copy", pa.int64()), ("total", pa.int32()), ("sketch", pa.binary()), ("elems", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            names, copies, elems = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is None or body is None:
                    continue
                words = WORD.findall(body.lower())
                if len(words) < min_words:
                    continue
                seen: dict[str, int] = {}
                own = np.empty(len(words), dtype=np.uint64)
                for i, w in enumerate(words):
                    seen[w] = n = seen.get(w, 0) + 1
                    own[i] = ids[w, n]
                own.sort()
                names.append(name)
                copies.append(xxhash.xxh3_64_intdigest(body.encode(errors="surrogatepass")))
                elems.append(own)
            for at in range(0, len(names), 1024):
                part = elems[at : at + 1024]
                sizes = np.array([len(x) for x in part])
                flat = np.concatenate(part)
                owner = np.repeat(np.arange(len(part)), sizes)
                signature = probminhash(owner, flat, np.ones(len(flat)), len(part), bands * rows)
                keys = _band_keys(signature, bands)
                sketch = np.ascontiguousarray((signature[:, :_SKETCH] & _U(255)).astype(np.uint8))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cls = [xxhash.xxh3_128_digest(x.tobytes()) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[at : at + 1024], pa.string()),
                        pa.array(cls, pa.binary()),
                        pa.array(np.array(copies[at : at + 1024], dtype=np.uint64).view(np.int64)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                    ],
                    schema=schema,
                )

    return texts.select(F.col(text_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, _PROFILE)


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            keep, sims = [], []
            values = []
            for c in columns[2:]:
                values.append((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()))
            (va, oa), (vb, ob) = values
            for i in range(batch.num_rows):
                a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(a) + len(b) - len(np.union1d(a, b))
                s = both / (len(a) + len(b) - both)
                if s >= threshold:
                    keep.append(i)
                    sims.append(s)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([columns[0].take(at), columns[1].take(at), pa.array(sims)], names=["cls_1", "cls_2", "similarity"])

    return pairs.select("cls_1", "cls_2", "elems_1", "elems_2").mapInArrow(run, "cls_1 binary, cls_2 binary, similarity double")


def _near(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``rows(band, key, total, sketch)`` that share a band, whose sizes allow the threshold and whose signatures agree in enough registers.

    Of 96 registers, kept as bytes, a pair at the threshold agrees in 96 times the
    threshold on average; those five standard deviations or more below are left out.
    """
    least = threshold - 5 * (threshold * (1 - threshold) / _SKETCH) ** 0.5

    def pairs(band: np.ndarray, key: np.ndarray, total: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, step = np.arange(len(band)), 1
        while len(at := at[at + step < len(band)]) and len(at := at[band[at] == band[at + step]]):
            on = at[(key[at] != key[at + step]) & (np.minimum(total[at], total[at + step]) >= threshold * np.maximum(total[at], total[at + step]))]
            on = on[(sketch[on] == sketch[on + step]).mean(axis=1) >= least]
            if len(on):
                a, b = key[on], key[on + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key_1", "key_2"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1))
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            done = np.searchsorted(now[0], now[0][-1])  # the last band may go on in the next batch
            yield from pairs(*(x[:done] for x in now))
            held = [x[done:] for x in now]
        if held:
            yield from pairs(*held)

    return rows.select("band", "key", "total", "sketch").repartition("band").sortWithinPartitions("band").mapInArrow(run, "key_1 long, key_2 long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of common elements of every left and every right text, some left texts at a time: ``(first of them, counts)``.

    Elements that many texts hold are counted by a product of 0/1 matrices, others by their lists of texts.
    """
    n = len(right)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in left])])
    row = np.repeat(np.arange(n), [len(x) for x in right])
    names, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at_left, at_right = at[: starts[-1]], at[starts[-1] :]
    column = np.full(len(names), -1)
    many = np.bincount(at_right, minlength=len(names)) > n / 16
    column[many] = np.arange(many.sum())
    on = many[at_right]
    table = np.zeros((n, many.sum()), dtype=np.float32)
    table[row[on], column[at_right[on]]] = 1
    order = np.argsort(at_right[~on], kind="stable")
    texts, sizes = row[~on][order], np.bincount(at_right[~on], minlength=len(names))
    begins = np.cumsum(sizes) - sizes
    step = max(1, 2**20 // n)
    for i in range(0, len(left), step):
        own = at_left[starts[i] : starts[min(i + step, len(left))]]
        who = np.repeat(np.arange(len(left[i : i + step])), [len(x) for x in left[i : i + step]])
        on = many[own]
        part = np.zeros((len(left[i : i + step]), table.shape[1]), dtype=np.float32)
        part[who[on], column[own[on]]] = 1
        count = (part @ table.T).astype(np.int64)
        own, who = own[~on], who[~on]
        each = sizes[own]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - begins[own], each)
        count += np.bincount(np.repeat(who * n, each) + texts[place], minlength=count.size).reshape(count.shape)
        yield i, count


def _compare(cell: pa.Table, threshold: float) -> pa.Table:
    """Similar pairs of one cell ``(band, i, j)``: texts of block i against those of block j.

    Pairs that share several crowded bands (``crowds``) are given by the smallest of them only.
    """
    band, i, j = (cell.column(c)[0].as_py() for c in ("band", "i", "j"))
    own, cls = cell.column("own").to_numpy(), cell.column("cls").to_pylist()
    elems = [x.values.to_numpy() for x in cell.column("elems")]
    crowds = [x.values.to_numpy() for x in cell.column("crowds")]
    wide = max(map(len, crowds))
    earlier = np.full((len(crowds), wide), band)
    for k, x in enumerate(crowds):
        earlier[k, : len(x)] = np.minimum(x, band)
    lefts, rights = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found: list[list] = [[], [], []]
    if len(lefts) and len(rights):
        sizes = np.array([len(x) for x in elems])
        for at, both in _common([elems[k] for k in lefts], [elems[k] for k in rights]):
            one = lefts[at : at + len(both)]
            s = both / (sizes[one][:, None] + sizes[rights][None, :] - both)
            a, b = np.nonzero(s >= threshold)
            sims, a, b = s[a, b], one[a], rights[b]
            on = a < b if i == j else a != b
            sims, a, b = sims[on], a[on], b[on]
            for k in range(0, len(a), 4096):
                x, y = earlier[a[k : k + 4096]], earlier[b[k : k + 4096]]
                new = ~((x[:, :, None] == y[:, None, :]) & (x < band)[:, :, None]).any(axis=(1, 2))
                for p, q, v in zip(a[k : k + 4096][new].tolist(), b[k : k + 4096][new].tolist(), sims[k : k + 4096][new].tolist(), strict=True):
                    if cls[p] != cls[q]:
                        found[0].append(cls[p])
                        found[1].append(cls[q])
                        found[2].append(v)
    return pa.table([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary()), pa.array(found[2], pa.float64())], names=["cls_1", "cls_2", "similarity"])


def _slices(table_: DataFrame, size: int, at_most: int, *by: str) -> list[DataFrame]:
    """``table_`` in as many parts, by a hash of ``by``, as ``size`` is times ``at_most``."""
    n = max(1, math.ceil(size / at_most))
    return [table_.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)] if n > 1 else [table_]


def _together(sized: DataFrame, block: int) -> DataFrame:
    """Pairs of classes that share a band of ``n`` classes; a band of over ``block`` classes is compared block by block."""
    few = sized.where(F.col("n") <= block)
    a = few.select("band", F.col("cls").alias("cls_1"))
    b = few.select("band", F.col("cls").alias("cls_2"))
    small = a.join(b, "band").where("cls_1 < cls_2").select("cls_1", "cls_2")
    many = sized.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("cls", "band"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = many.select("band", F.col("cls").alias("cls_1"), F.col("own").alias("i"), F.explode(others).alias("j"))
    right = many.select("band", F.col("cls").alias("cls_2"), F.explode(others).alias("i"), F.col("own").alias("j"))
    large = left.join(right, ["band", "i", "j"]).where("cls_1 < cls_2").select("cls_1", "cls_2")
    return small.unionByName(large)


def _crowded(stage: Stage, hot: DataFrame, first: DataFrame, words: int, threshold: float, block: int, broadcast_rows: int) -> list[DataFrame]:
    """All similar pairs of classes that share a band of ``hot(band, key)``, from ``first(key, cls, total, elems)``; tables that may repeat a pair.

    A band's classes are cut into blocks of about ``2048 * block`` words, and every two blocks are one cell.
    """
    weighed = hot.join(first.select("key", "total"), "key").groupBy("band").agg(F.sum("total").alias("w"))
    blocks = stage.save(weighed.withColumn("blocks", F.ceil(F.col("w") / (2048 * block)).cast("int")))
    moved = blocks.agg(F.sum(F.col("w") * F.col("blocks"))).first()[0]
    crowds = stage.save(hot.groupBy("key").agg(F.collect_set("band").alias("crowds")))
    texts = stage.save(first.select("key", "cls", "elems").join(small_side(crowds, broadcast_rows), "key"))
    own = F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int")
    placed = hot.join(small_side(blocks, broadcast_rows), "band").select("band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    cells = placed.select("band", "key", "own", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"))
    compare = lambda cell: _compare(cell, threshold)
    parts = []
    for part in _slices(cells, moved, max(words // 2, 2**15 * block), "band", "i", "j"):
        parts.append(stage.save(part.join(texts, "key").drop("key").groupBy("band", "i", "j").applyInArrow(compare, "cls_1 binary, cls_2 binary, similarity double")))
    stage.drop(blocks, crowds, texts)
    return parts


def similar_classes(texts: DataFrame, text_id: str, text: str, threshold: float = 0.7, min_words: int = 30, bands: int = 40, rows: int = 5, block: int = 512, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of near-duplicate texts.

    ``members(id, cls, copy)`` names each text's class of equal word counts and
    the hash that only byte-equal texts share;
    ``links(cls_1, cls_2, similarity)`` holds every found pair of classes with a
    similarity of at least ``threshold``. A pair at 0.7 is missed with a
    probability of about 0.0006 by 40 bands of 5 rows. Repeated rows of an id
    count once; empty input gives empty results. Bands of over ``block`` classes are
    compared exactly, block by block. Copies, shared bands and linked classes are
    narrow rows that are broadcast up to ``broadcast_rows`` each, and shuffled beyond.
    """
    stage = Stage(texts.sparkSession, "neardup", lean=True)
    profiles = stage.save(profile(texts, text_id, text, min_words, bands, rows))
    members = stage.save(profiles.groupBy("id", "cls").agg(F.min("copy").alias("copy")))
    copies = stage.save(profiles.select("cls", "id").join(profiles.groupBy("cls").agg(F.min("id").alias("head")), "cls").where("id != head").select("cls", "id").distinct())
    count, words = profiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # Bands are shuffled with a 64-bit key of the class; should two classes share one, both are compared exactly below.
    first = profiles.join(small_side(copies, broadcast_rows), ["cls", "id"], "left_anti").withColumn("key", F.xxhash64("cls"))
    banded = first.select("key", F.explode("bands").alias("band"))
    # Sizes by partial aggregation: no task ever holds a hot band whole.
    shared = stage.save(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sized = stage.save(banded.join(small_side(shared, broadcast_rows), "band"))
    first = stage.save(first.drop("bands"))
    stage.drop(shared, profiles, copies)
    few, hot = sized.where(F.col("n") <= block).select("band", "key"), sized.where(F.col("n") > block).select("band", "key")
    signed = first.select("key", "total", "sketch")
    parts = [stage.save(_near(part.join(signed, "key"), threshold).distinct()) for part in _slices(few, few.count(), max(4 * count, 400 * block), "band")]
    likely = parts[0] if len(parts) == 1 else stage.save(reduce(DataFrame.unionByName, parts).distinct())
    named = stage.save(likely.select(F.explode(F.array("key_1", "key_2")).alias("key")).distinct())
    found = [] if hot.isEmpty() else _crowded(stage, hot.distinct(), first, words, threshold, block, broadcast_rows)
    stage.drop(sized, *parts[: len(parts) if len(parts) > 1 else 0])
    linked = first.join(small_side(named, broadcast_rows), "key", "left_semi")
    one = linked.select(F.col("key").alias("key_1"), F.col("cls").alias("cls_1"), F.col("elems").alias("elems_1"))
    two = linked.select(F.col("key").alias("key_2"), F.col("cls").alias("cls_2"), F.col("elems").alias("elems_2"))
    for part in _slices(likely, likely.count(), max(2 * count, 400 * block), "key_1", "key_2"):
        found.append(stage.save(_verify(part.join(one, "key_1").join(two, "key_2"), threshold)))
    every = reduce(DataFrame.unionByName, found).select(F.least("cls_1", "cls_2").alias("cls_1"), F.greatest("cls_1", "cls_2").alias("cls_2"), "similarity")
    links = stage.save(every.dropDuplicates(["cls_1", "cls_2"]))
    stage.drop(first, likely, named, *found)
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame, star_above: int | None = 64, block: int = 512) -> DataFrame:
    """``id_1 < id_2`` pairs of texts from the classes and their links; with ``star_above=None`` every pair.

    Else over ``star_above`` byte-equal texts are given as links of each to their
    smallest id, which stands for them in all other pairs. Texts of one class that
    differ in a byte (reordered, reformatted) are never left out.
    """
    open_, star = members, None
    if star_above is not None:
        sized = members.groupBy("cls", "copy").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
        headed = members.join(sized, ["cls", "copy"])
        open_ = headed.where((F.col("n") <= star_above) | (F.col("id") == F.col("head"))).select("id", "cls")
        star = headed.where((F.col("n") > star_above) & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    a = open_.select(F.col("cls").alias("cls_1"), F.col("id").alias("a"))
    b = open_.select(F.col("cls").alias("cls_2"), F.col("id").alias("b"))
    every = links.join(a, "cls_1").join(b, "cls_2").select("a", "b")
    several = open_.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = open_.join(several, "cls").select(F.col("cls").alias("band"), F.col("id").alias("cls"), "n")
    every = every.unionByName(_together(grouped, block).toDF("a", "b"))
    if star is not None:
        every = every.unionByName(star)
    return every.where("a != b").select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")).distinct()
