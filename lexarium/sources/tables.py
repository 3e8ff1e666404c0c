"""Readers: the given tables, and the collections that are derived from them by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task has of a table that is dealt by key.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan that gives fewer tasks than there are cores, dealt over all cores; a larger scan stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan by key, about ROWS_A_TASK in a task (at least one task a core): what a task sorts does not grow with the table, however small its files are."""
    n = max(-(-rows.count() // ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)  # Parquet tells the count without its columns
    return rows.repartition(n, *keys)


def chunks(documents: DataFrame) -> DataFrame:
    """Non-blank lines: (chunk_id, doc_id, lang, source, n, content); n counts all lines from 1."""
    return (
        documents.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "content"))
        .where(F.trim("content") != "")
        .select(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("p") + 1).cast("string")).alias("chunk_id"), "doc_id", "lang", "source", (F.col("p") + 1).alias("n"), "content")
    )


CHUNKS_SQL = """chunks AS (SELECT doc_id || ':' || n AS chunk_id, doc_id, lang, source, n, content FROM (
  SELECT doc_id, lang, source, generate_subscripts(ls, 1) AS n, unnest(ls) AS content
  FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE trim(content) <> '')"""


def sections(documents: DataFrame, version: int) -> DataFrame:
    """Sections of a version of each document: (doc_id, key, content).

    Version 1 is every document. Version 2 lacks documents of doc_id % 10 = 0,
    edits line 1 of those of doc_id % 7 = 0, and drops line 2 of doc_id % 3 = 0.
    """
    lines = chunks(documents).select("doc_id", F.concat(F.lit("line / "), F.col("n").cast("string")).alias("key"), "n", "content")
    if version == 1:
        return lines.select("doc_id", "key", "content")
    edited = F.when((F.col("doc_id") % 7 == 0) & (F.col("n") == 1), F.concat(F.col("content"), F.lit(" (edited)"))).otherwise(F.col("content"))
    return lines.where((F.col("doc_id") % 10 != 0) & ~((F.col("doc_id") % 3 == 0) & (F.col("n") == 2))).select("doc_id", "key", edited.alias("content"))


SECTIONS_SQL = CHUNKS_SQL + """,
v1 AS (SELECT doc_id, 'line / ' || n AS key, content FROM chunks),
v2 AS (SELECT doc_id, 'line / ' || n AS key, CASE WHEN doc_id % 7 = 0 AND n = 1 THEN content || ' (edited)' ELSE content END AS content
       FROM chunks WHERE doc_id % 10 <> 0 AND NOT (doc_id % 3 = 0 AND n = 2))"""
