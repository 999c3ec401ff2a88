"""Set operations behind the tables: upsert logs, references and trees. What goes along an order is in ``ranges``."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as checkpoint folder; where it is unset, a local one in local mode and an error on a cluster."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def newest_wins(log: DataFrame, key: list[str], order: Column, removed: Column) -> DataFrame:
    """The newest row of each key, unless that one says removed. A map-side maximum, no window."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest, removed.alias("_gone")), order).alias("_v"))
    return last.where("not _v._gone").select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def fill_free(first: DataFrame, second: DataFrame, key: list[str], value: str) -> DataFrame:
    """Values of ``first``, with those of ``second`` where they are null or missing."""
    b = second.select(*key, F.col(value).alias("_other"))
    return first.select(*key, value).join(b, key, "full").select(*key, F.coalesce(value, "_other").alias(value))


def resolve(df: DataFrame, objects: DataFrame, num: str, value: str = "value") -> DataFrame:
    """``df`` with the object that its (file_id, num) names; null when there is none or it's free."""
    found = objects.where("stored <> 0").select("file_id", F.col("obj_num").alias(num), F.col("value").alias(value))
    return df.join(found, ["file_id", num], "left")


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Objects that (file_id, num) roots reach over (file_id, src, dst) edges, with the fewest steps; ``depth`` is the most of them, if given."""
    shared_folder(spark)
    frontier = seen = roots.select("file_id", "num").distinct().withColumn("steps", F.lit(0))
    k = 0
    while depth is None or k < depth:
        k += 1
        step = frontier.join(edges, (edges["file_id"] == frontier["file_id"]) & (edges["src"] == frontier["num"])).select(frontier["file_id"], F.col("dst").alias("num")).distinct()
        frontier = step.join(seen, ["file_id", "num"], "left_anti").withColumn("steps", F.lit(k)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def inherit_sql(tree: str, attribute: str) -> str:
    """SQL for the nearest non-null attribute on the way to the root; ``tree`` has node, parent and the attribute.

    It goes down level by level, at most as deep as ``spark.sql.cteRecursionLevelLimit`` (100), beyond which Spark stops with an error; ``inherit`` has no such limit.
    """
    return (
        f"WITH RECURSIVE walk(node, value, depth) AS (SELECT node, {attribute}, 0 FROM {tree} WHERE parent IS NULL "
        f"UNION ALL SELECT t.node, coalesce(t.{attribute}, w.value), w.depth + 1 FROM {tree} t JOIN walk w ON t.parent = w.node) "
        "SELECT node, value, depth FROM walk"
    )


def inherit(tree: DataFrame, attribute: str) -> DataFrame:
    """The same by joins, for trees of any depth: each round looks twice as far up, until no node is open.

    A node whose whole way up has none gets null; so do those whose way up runs in a circle.
    """
    spark = tree.sparkSession
    shared_folder(spark)
    out = tree.select("node", F.when(F.col(attribute).isNull(), F.col("parent")).alias("up"), F.col(attribute).alias("value")).checkpoint()
    rounds = max(1, out.count()).bit_length()
    for _ in range(rounds):
        if out.where("up is not null").isEmpty():
            break
        above = out.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("value").alias("found"))
        out = out.join(above, "up", "left").select("node", F.when(F.col("found").isNull(), F.col("next")).alias("up"), F.coalesce("value", "found").alias("value")).checkpoint()
    return out.select("node", "value")


def rollup(tree: DataFrame, value: Column) -> DataFrame:
    """Every node of (node, parent) with the total of ``value`` over itself and all below it, at any depth.

    In round k a node has the total of what lies less than 2^k below it and knows the node 2^k above it, to which it adds its total next; so
    rounds are logarithmic in the depth, for chains as for stars, and what goes to one node is summed up map-side. Nodes on or below a circle
    get null; a parent that is no node ends the way up; a null value is zero.
    """
    spark = tree.sparkSession
    shared_folder(spark)
    rows = tree.select("node", F.col("parent").alias("up"), F.coalesce(value, F.lit(0)).alias("total"))
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    out = rows.join(known, "up", "left").select("node", F.when(F.col("_known"), F.col("up")).alias("up"), "total").checkpoint()
    for _ in range(out.count().bit_length() + 1):
        open_ = out.where("up is not null")
        if open_.isEmpty():
            break
        gain = open_.groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("gain"))
        above = out.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = out.join(gain, "node", "left").select("node", "up", (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total"))
        still = moved.where("up is not null").join(above, "up").select("node", F.col("next").alias("up"), "total")
        out = still.unionByName(moved.where("up is null")).checkpoint()
    # what still has a way up goes in a circle, and so does what such a node is below
    return out.select("node", F.when(F.col("up").isNull(), F.col("total")).alias("total"))


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, node, steps) for every node of (node, parent) and each of its ancestors, itself with 0 steps, in logarithmic rounds.

    The ways of 2^k steps that are known are put together with themselves, so the rows made are those of the result.
    """
    spark = tree.sparkSession
    shared_folder(spark)
    known = tree.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("steps")).checkpoint()
    jump = tree.where("parent is not null").join(tree.select(F.col("node").alias("parent")), "parent").select("node", F.col("parent").alias("up")).checkpoint()
    n, k = known.count(), 0
    while not jump.isEmpty():
        if 1 << k > n:
            raise ValueError("the tree has a circle")
        more = known.join(jump.select(F.col("node").alias("ancestor"), "up"), "ancestor").select(F.col("up").alias("ancestor"), "node", (F.col("steps") + (1 << k)).alias("steps"))
        known = known.unionByName(more).checkpoint()
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = jump.join(above, "up").select("node", F.col("next").alias("up")).checkpoint()
        k += 1
    return known


def renumber(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """A place from 0 in the order given."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
