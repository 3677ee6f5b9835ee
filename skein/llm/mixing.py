"""Mixing sources to target shares of tokens, along a curriculum.

The weight of a source at training time t (0 to 1) is
``share * (1 + tilt * (2 t - 1))``; it integrates to the share. Sources of short
texts lean to the beginning, sources of long texts to the end, and the tilts
are centred so that the weights always sum to one. A source's cumulative demand
is a quadratic in t; inverting it at the cumulative tokens of its texts gives
every text its training position, by which the result is range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import Stage


def source_key(source: Column) -> Column:
    """Sources in other case or padded are the same source."""
    return F.lower(F.trim(source))


def plan(sized: DataFrame, targets: DataFrame, tilt: float = 0.5, total: int | None = None) -> DataFrame:
    """One row per target source: supply, effective share, budget and tilt.

    ``sized(doc_id, source, n_tokens)``. The budget is ``total`` tokens, or else the
    largest total for which every source meets its share within its repeats. A source
    that cannot meet its share of ``total`` gives all it may; ``shares`` reports it. A target without any tokens
    cannot be met; its share is spread over the others in proportion. Targets
    with null source or a share that is null or not positive are left out.
    """
    want = targets.where("source is not null and target_share > 0").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat")
    )
    have = sized.where("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.avg("n_tokens").alias("mean_tokens"))
    every = Window.partitionBy(F.lit(0))  # as many rows as targets
    both = want.join(have, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    met = F.when(F.col("supply") > 0, F.col("target_share"))
    shared = both.withColumn("share", met / F.sum(met).over(every))
    centre = F.sum(F.col("share") * F.log("mean_tokens")).over(every)
    off = F.log("mean_tokens") - centre
    widest = F.max(F.abs(off)).over(every)
    tilted = shared.withColumn("off", off).withColumn("tilt", F.coalesce(F.lit(tilt) * off / F.when(widest > 0, widest), F.lit(0.0)))
    most = F.col("supply") * F.col("max_repeat")
    budget = F.min(most / F.col("share")).over(every) if total is None else F.lit(float(total))
    return tilted.withColumn("budget", budget).select("source", "target_share", "max_repeat", "supply", "share", "tilt", "budget", F.least(F.col("share") * budget, most.cast("double")).alias("demand"))


def mix(sized: DataFrame, plan_: DataFrame, bucket_rows: int = 10_000) -> DataFrame:
    """``doc_id, source, copy, n_tokens, position``: what is taken, and at which training token.

    ``plan_`` comes from ``plan``. Texts of a source are taken in a hash order, again
    from its start once it is used up, until the demand is met to within half a
    text. Prefix sums are taken over groups by hash of some ``bucket_rows`` texts of a source
    at most, so a source with most of the rows is not held by one task. Texts without tokens
    or of no target source are not taken.
    """
    stage = Stage(sized.sparkSession, "mixing")
    texts = sized.where("doc_id is not null and source is not null and n_tokens > 0").withColumn("h", F.xxhash64("doc_id"))
    buckets = max(64, texts.count() // bucket_rows)
    texts = texts.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = texts.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    start = sums.withColumn("start", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    start = start.select("source", "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = texts.withColumn("inside", inside).join(start, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("start") + F.col("inside")).alias("before"))
    p = stage.save(plan_.where("share is not null").select("source", "max_repeat", "supply", "tilt", "budget", "demand"))
    copies = placed.join(p, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("max_repeat").cast("int") - 1)))
    at = F.col("before") + F.col("copy") * F.col("supply")
    middle = at + F.col("n_tokens") / 2
    taken = copies.withColumn("at", at).where(middle <= F.col("demand"))
    u = F.least(F.lit(1.0), F.col("at") / F.col("demand"))
    a = F.col("tilt")
    # Demand over its total is (1 - a) t + a t^2; its inverse without cancellation.
    t = 2 * u / ((1 - a) + F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * u)))
    out = taken.select("doc_id", "source", "copy", "n_tokens", F.floor(t * F.col("budget")).cast("long").alias("position"))
    return out.repartitionByRange("position", "source", "doc_id", "copy").sortWithinPartitions("position", "source", "doc_id", "copy")


def shares(mixed: DataFrame, plan_: DataFrame) -> DataFrame:
    """Target and reached share per source, with tokens, texts and the most copies of one text."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), (F.max("copy") + 1).cast("long").alias("most_copies"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    every = plan_.select("source", "target_share", "max_repeat").join(got, "source", "left").fillna(0, ["tokens", "texts", "most_copies"])
    return every.select("source", "target_share", F.round(F.col("tokens") / total, 6).alias("actual_share"), "tokens", "texts", "most_copies", "max_repeat")
