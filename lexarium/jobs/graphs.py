"""Impact graphs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.jobs.registry import query
from lexarium.operators import graph as g
from lexarium.sources.tables import table

EDGES_SQL = "edges AS (SELECT p_partkey AS src, (p_partkey * 7 + p_size) % 1009 AS dst FROM part)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 1009).alias("dst"))


@query("WITH RECURSIVE " + EDGES_SQL + """, walk(seed, node, hops) AS (SELECT src, src, 0 FROM (SELECT DISTINCT src FROM edges WHERE src % 20 = 0)
 UNION SELECT seed, dst, hops + 1 FROM walk JOIN edges ON src = node WHERE hops < 8)
SELECT seed, node, min(hops) AS hops FROM walk GROUP BY ALL HAVING seed <> node""")
def g02_bfs_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return g.reach(edges, edges.where("src % 20 = 0").select(F.col("src").alias("seed")).distinct())


@query("WITH RECURSIVE " + EDGES_SQL + """, walk(node, pos, hops) AS (SELECT src, dst, 1 FROM edges UNION SELECT node, dst, hops + 1 FROM walk JOIN edges ON src = pos WHERE hops < 8 AND node <> pos)
SELECT node, min(hops) AS length FROM walk WHERE node = pos GROUP BY node""")
def g03_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.on_cycles(_edges(spark, sf_dir))


@query("""WITH RECURSIVE links AS (SELECT DISTINCT a.conv_id AS src, b.conv_id AS dst FROM conversations a JOIN conversations b ON a.text = b.text AND a.turn = 0 AND b.turn = 0),
walk(node, pos) AS (SELECT src, dst FROM links UNION SELECT node, dst FROM walk JOIN links ON src = pos)
SELECT node, min(pos) AS root FROM walk GROUP BY node""")
def g04_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that share an opening turn stay together: each is tied to the least of its text."""
    opening = table(spark, sf_dir, "conversations").where("turn = 0 and text is not null").select("conv_id", "text")
    least = opening.groupBy("text").agg(F.min("conv_id").alias("dst"))
    return g.components(opening.join(least, "text").select(F.col("conv_id").alias("src"), "dst"))
