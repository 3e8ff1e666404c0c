"""Graphs as edge tables: bounded search, cycles, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the folder that the session names; only a session in one JVM may do without."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexarium-"))
    return df.checkpoint(eager=True)


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    """(seed, node, hops): breadth first, each node once per seed at its least distance, seeds themselves left out.

    ``edges``: (src, dst); ``seeds``: (seed). One join per hop over the frontier
    alone, and an anti join with what was seen.
    """
    pairs = durable(edges.select("src", "dst").distinct())
    seen = durable(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(pairs, frontier["node"] == pairs["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = durable(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.limit(1).count() == 0:
            break
        seen = durable(seen.unionByName(frontier))
    return seen.where("hops > 0")


def on_cycles(edges: DataFrame, depth: int = 8) -> DataFrame:
    """(node, length): nodes that come back to themselves within ``depth`` hops, with the shortest way."""
    pairs = durable(edges.select("src", "dst").distinct())
    walk = pairs.select(F.col("src").alias("node"), F.col("dst").alias("at"))
    found = walk.where("node = at").select("node", F.lit(1).alias("length"))
    for hop in range(2, depth + 1):
        open_ = walk.where("node <> at")
        walk = durable(open_.join(pairs, open_["at"] == pairs["src"]).select("node", F.col("dst").alias("at")).distinct())
        found = found.unionByName(walk.where("node = at").select("node", F.lit(hop).alias("length")))
    return found.groupBy("node").agg(F.min("length").alias("length"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node of each connected component, by neighbourhood minima and pointer jumping."""
    links = durable(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = durable(links.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root")))
    for _ in range(rounds):
        near = links.join(labels, links["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = durable(step.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
