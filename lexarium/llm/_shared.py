"""Helpers that several operators use."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan that gives fewer tasks than there are cores, dealt over all cores; a larger scan stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    The folder is the one that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session in one JVM (a local test) may do without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lexarium-")


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strings(column) -> list[str]:
    """Python strings of an Arrow column, nulls as empty texts."""
    return [x if x is not None else "" for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


#: Labels (two numbers each) that are broadcast, so that a round shuffles its least labels alone; more are joined by shuffles.
BROADCAST_LABELS = 200_000
#: Rows of a few numbers that make a partition of their own.
PARTITION_ROWS = 50_000


def packed(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (``count`` of them, narrow ones) in no more partitions than that count needs: a shuffle of few rows writes few files."""
    return rows.coalesce(count // PARTITION_ROWS + 1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; root is the least node.

    Every round each node takes the least label in its neighbourhood and then
    the label of that label (pointer jumping), so long chains halve each round.
    Labels live in the checkpoint folder; nothing but one count per round
    reaches the driver.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    both = packed(both, both.count())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    count = labels.count()
    few = count <= BROADCAST_LABELS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    for _ in range(rounds):
        near = (
            both.join(side(labels.withColumnRenamed("node", "b")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        step = near.join(side(labels), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = durable(packed(step.join(side(jump), "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("root")), count))
        labels = moved.select("node", "root")
        if moved.where("root <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
