"""Forests from parent-child rows, by distributed tree contraction.

A round splices an independent set out of the unary chains of the live forest (a
node with one child whose chance this round is higher than that of its neighbours
in the chain) and rakes every leaf. Each removal is recorded with the live node it hung from and the
nodes already spliced out between the two. The live part shrinks geometrically, so
the number of rounds is logarithmic in the number of nodes, for deep chains as well
as for wide stars. A core that no longer shrinks consists of self-loops: a circle of
any length is spliced down to one node that is its own parent. The records are then
replayed backwards; every record's anchor was removed in a later round or is a root,
so one join a round recovers root, depth and path. Numbers of descendants come out
of the same contraction: a raked leaf hands its weight to its anchor, and a spliced
node is as large as its own weight and its child's size.

A round is one plan and one written table. Of the children of a node only a count,
a smallest one and a sum are taken, so a star's centre is no hot spot; the replay's
join on anchors is skewed there, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import Stage

_MAX_ROUNDS = 200


def latest_links(rows: DataFrame, scope: str, node: str, parent: str, order: str) -> DataFrame:
    """One row per (scope, node) with the parent of its latest row.

    A null ``order`` is older than any value; of rows with equal ``order`` the
    greatest parent counts. Rows without scope or node are no nodes.
    """
    return (
        rows.where(F.col(scope).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(scope).alias("scope"), F.col(node).alias("node"))
        .agg(F.max(F.struct(F.col(order).alias("o"), F.coalesce(F.col(parent), F.lit("")).alias("p")))["p"].alias("parent"))
    )


def resolve_forest(links: DataFrame, with_path: bool = False, with_size: bool = False) -> DataFrame:
    """Root, depth and optionally path and number of nodes below of every node of a forest.

    ``links`` has ``scope``, ``node``, ``parent``, one row per (scope, node). A
    parent that is null, blank or not a node of the scope makes its child a root
    of depth 0. Returns ``scope, node, root, depth`` and, if asked for, ``path``
    (array of node ids from the root to the node) and ``size`` (the node and all
    its descendants). Nodes whose parents run in a circle, or that hang from such
    a circle, get root ``''``, depth -1, an empty path and size 0. An empty input
    gives an empty result.
    """
    stage = Stage(links.sparkSession, "forest")
    nothing = F.array().cast("array<string>") if with_path else F.lit(0).cast("long")
    live = stage.save(_start(stage.save(links.select("scope", "node", "parent")))).withColumn("between", nothing).withColumn("weight", F.lit(1).cast("long")).withColumn("load", F.lit(0).cast("long"))
    rounds: list[DataFrame] = []
    raked = None
    for number in range(_MAX_ROUNDS):
        step = stage.save(_contract(live, raked, number, with_path))
        rounds.append(step)
        left = step.agg(F.count_if(F.col("kind") == "live").alias("live"), F.count_if(F.expr("kind = 'live' and parent <=> node")).alias("loops"), F.count_if(F.col("kind") != "live").alias("removed")).first()
        live = step.where("kind = 'live'").select("scope", "node", "parent", "between", "weight", "load")
        raked = step.where("kind = 'leaf'").select("scope", F.col("parent").alias("node"), (F.col("weight") + F.col("load")).alias("add"))
        if left["live"] == 0 or left["removed"] == 0 and left["loops"] == left["live"]:
            break
    else:
        raise RuntimeError("the forest did not contract")
    return _replay(stage, live, rounds, with_path, with_size)


def _start(links: DataFrame) -> DataFrame:
    """``scope, node, parent`` with a null parent where there is none to be found; blank ones take no part in the join."""
    own = links.select("scope", "node", F.col("parent").cast("string").alias("parent"))
    asking = own.where("parent != ''")
    there = own.select("scope", F.col("node").alias("parent"), F.lit(True).alias("there"))
    found = asking.join(there, ["scope", "parent"], "left").select("scope", "node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    return found.unionByName(own.where("coalesce(parent, '') = ''").select("scope", "node", F.lit(None).cast("string").alias("parent")))


def _contract(live: DataFrame, raked: DataFrame | None, number: int, with_path: bool) -> DataFrame:
    """One round: every live node with its ``kind`` (root, leaf, gone or live) and, if it stays, its new parent."""
    none = F.lit(None).cast("struct<node:string,load:bigint>")
    kids = live.where("parent is not null").select("scope", F.col("parent").alias("node"), F.struct("node", "load").alias("child"), F.lit(0).cast("long").alias("add"))
    if raked is not None:
        kids = kids.unionByName(raked.select("scope", "node", none.alias("child"), "add"))
    below = kids.groupBy("scope", "node").agg(F.count("child").alias("n"), F.min("child").alias("child"), F.sum("add").alias("add"))
    state = live.join(below, ["scope", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("weight", F.col("weight") + F.coalesce("add", F.lit(0))).drop("add")
    # Splicing: unary, not a root, not a self-loop, and of higher chance this round than such a parent or child.
    chance = F.struct(F.xxhash64("scope", "node", F.lit(number)), "node")
    heads = state.where((F.col("n") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).withColumn("chance", chance)
    pairs = heads.select("scope", "node", "parent", "chance").join(heads.select("scope", F.col("node").alias("parent"), F.col("chance").alias("above")), ["scope", "parent"])
    losers = pairs.select("scope", F.when(F.col("chance") < F.col("above"), F.col("node")).otherwise(F.col("parent")).alias("node"))
    spliced = heads.join(losers, ["scope", "node"], "left_anti")
    above = F.struct(F.col("node").alias("gone"), F.col("parent").alias("up"), "between", (F.col("weight") + F.col("load")).alias("load"))
    # A spliced node's child is never spliced itself, so each node has one mark at most.
    marks = spliced.select("scope", F.explode(F.array(F.struct("node", F.lit(None).cast(_above_type(with_path)).alias("above")), F.struct(F.col("child.node").alias("node"), above.alias("above")))).alias("m")).select("scope", "m.node", "m.above", F.lit(True).alias("marked"))
    joined = state.join(marks, ["scope", "node"], "left")
    moved = F.col("above").isNotNull()
    kind = F.when(F.col("marked") & ~moved, "gone").when(F.col("n") > 0, "live").when(F.coalesce("above.up", "parent").isNull(), "root").otherwise("leaf")
    chain = F.concat("above.between", F.array("above.gone"), "between") if with_path else F.col("above.between") + 1 + F.col("between")
    return joined.select(
        "scope",
        "node",
        kind.alias("kind"),
        F.when(moved, F.col("above.up")).otherwise(F.col("parent")).alias("parent"),
        F.when(moved, chain).otherwise(F.col("between")).alias("between"),
        "weight",
        (F.col("load") + F.when(moved, F.col("above.load")).otherwise(0)).alias("load"),
        F.when(kind == "gone", F.col("child.node")).alias("child"),
        F.when(kind == "gone", F.col("child.load")).alias("child_load"),
    )


def _above_type(with_path: bool) -> str:
    return f"struct<gone:string,up:string,between:{'array<string>' if with_path else 'bigint'},load:bigint>"


def _replay(stage: Stage, core: DataFrame, rounds: list[DataFrame], with_path: bool, with_size: bool) -> DataFrame:
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")

    def row(root: Column, depth: Column, path: Column, size: Column) -> list[Column]:
        return [F.col("scope"), F.col("node"), root.alias("root"), depth.cast("long").alias("depth"), *([path.alias("path")] if with_path else []), *([size.alias("size")] if with_size else [])]

    known = core.select(*row(F.lit(""), F.lit(-1), none, zero))
    for r in rounds:
        known = known.unionByName(r.where("kind = 'root'").select(*row(F.col("node"), zero, F.array("node"), F.col("weight"))))
    known = stage.save(known)
    for step in reversed(rounds):
        record = step.where("kind in ('leaf', 'gone')").withColumnRenamed("parent", "anchor")
        anchors = known.select("scope", F.col("node").alias("anchor"), "root", F.col("depth").alias("d"), *([F.col("path").alias("p")] if with_path else []))
        if with_size:  # a child was removed later, or is a leaf of the same round
            sizes = known.select("scope", F.col("node").alias("child"), F.col("size").alias("below")).unionByName(step.where("kind = 'leaf'").select("scope", F.col("node").alias("child"), F.col("weight").alias("below")))
            gone = record.where("kind = 'gone'").join(sizes, ["scope", "child"]).withColumn("size", F.col("weight") + F.col("child_load") + F.col("below"))
            record = gone.drop("below").unionByName(record.where("kind = 'leaf'").withColumn("size", F.col("weight")))
        circle = F.col("d") < 0
        hops = F.size("between") if with_path else F.col("between")
        path = F.when(circle, none).otherwise(F.concat("p", "between", F.array("node"))) if with_path else none
        size = F.when(circle, zero).otherwise(F.col("size")) if with_size else zero
        solved = record.join(anchors, ["scope", "anchor"]).select(*row(F.col("root"), F.when(circle, F.lit(-1)).otherwise(F.col("d") + hops + 1), path, size))
        before, known = known, stage.save(known.unionByName(solved))
        stage.drop(before, step)
    return known


def descendants(paths: DataFrame) -> DataFrame:
    """``scope, ancestor, descendant, distance`` for every ancestor pair, from ``resolve_forest(with_path=True)``.

    Nodes of circles have an empty path and so no rows.
    """
    return paths.select("scope", F.posexplode("path").alias("at", "ancestor"), F.col("node").alias("descendant"), "depth").where("ancestor != descendant").select(
        "scope", "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("long").alias("distance")
    )


def describe(forest: DataFrame) -> DataFrame:
    """Per node of ``resolve_forest(with_path=True, with_size=True)``: root, depth, path joined by ``/`` and number of descendants; 0 for nodes of circles."""
    return forest.select("scope", "node", "root", "depth", F.array_join("path", "/").alias("path"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long").alias("n_descendants"))
