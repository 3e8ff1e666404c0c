"""Settings that documents inherit from others: own values win, then those of the base named last, and so on through its bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.operators.graph import durable


def lineage(bases: DataFrame, depth: int = 8) -> DataFrame:
    """(node, ancestor, path) for ``bases`` (node, base, at), at most ``depth`` steps; a path holds, step by step, the base's place from the end of its list.

    Paths sort as values take effect: what a node says itself (no path) first, then all that
    its last base says or inherits, then the base before it. Walks are doubled each
    round, so eight steps take three joins. A walk that comes back to a node ends there.
    """
    last = bases.groupBy("node").agg(F.max("at").alias("last"))
    steps = durable(bases.join(last, "node").select("node", F.col("base").alias("ancestor"), F.array((F.col("last") - F.col("at")).cast("int")).alias("path"), F.array("node", "base").alias("seen")).where("node <> ancestor"))
    walks, reach = steps, 1
    while reach < depth:
        onward = walks.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("to"), F.col("path").alias("then"), F.col("seen").alias("later"))
        further = walks.where(F.size("path") == reach).join(onward, "ancestor").where(F.size(F.array_intersect("seen", "later")) == 1)
        joined = further.select("node", F.col("to").alias("ancestor"), F.concat("path", "then").alias("path"), F.concat("seen", F.slice("later", 2, F.size("later"))).alias("seen"))
        walks, reach = durable(walks.unionByName(joined)), 2 * reach
    return walks.where(F.size("path") <= depth).select("node", "ancestor", "path")


def cycles(bases: DataFrame, depth: int = 8) -> DataFrame:
    """(node) of those that inherit from themselves within ``depth`` steps."""
    own = bases.where("node = base").select("node")
    back = lineage(bases, depth - 1).select("node", "ancestor").join(bases.select(F.col("node").alias("ancestor"), "base"), "ancestor").where("base = node").select("node")
    return own.union(back).distinct()


def effective(settings: DataFrame, bases: DataFrame, depth: int = 8) -> DataFrame:
    """(node, key, value, source): what holds for each node, from ``settings`` (node, key, value), keys unique within a node."""
    own = settings.select("node", "key", "value", F.col("node").alias("source"), F.array().cast("array<int>").alias("path"))
    far = lineage(bases, depth).join(settings.withColumnRenamed("node", "ancestor"), "ancestor").select("node", "key", "value", F.col("ancestor").alias("source"), "path")
    best = F.min_by(F.struct("value", "source"), F.struct("path", "source"))
    return own.unionByName(far).groupBy("node", "key").agg(best.alias("b")).select("node", "key", "b.value", "b.source")
