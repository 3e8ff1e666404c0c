"""Versions of documents: scope, difference, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(content: Column) -> Column:
    """SHA-256 of the content with white space collapsed."""
    runs = F.contains(content, F.lit("  ")) | F.contains(content, F.lit("\t")) | F.contains(content, F.lit("\r")) | F.contains(content, F.lit("\n"))
    collapsed = F.when(runs, F.regexp_replace(content, "[ \\t\\r\\n]+", " ")).otherwise(content)
    return F.sha2(F.trim(collapsed).cast("binary"), 256)


def in_scope(row_versions: Column, wanted: list[str] | None, active: Column | None = None, null_passes: bool = False) -> Column:
    """A scope predicate: version in a list, or active; an unknown version passes only if ``null_passes``."""
    hit = F.lit(True)
    if wanted is not None:
        hit = hit & row_versions.isin(wanted)
    if active is not None:
        hit = hit & active
    return F.when(row_versions.isNull(), F.lit(null_passes)).otherwise(F.coalesce(hit, F.lit(False)))


def has_facet(facet: Column, wanted: Column) -> Column:
    """A facet list holds the wanted value or '*'; a null wish is no filter."""
    return wanted.isNull() | F.coalesce(F.array_contains(facet, "*") | F.array_contains(facet, wanted), F.lit(False))


def duplicates(sections: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once: a difference over them would be undefined."""
    return sections.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def compare(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Every key of either side as ADDED, REMOVED, MODIFIED or UNCHANGED, by content hash."""
    return compare_hashes(old, new, keys, content_hash(F.col(content)))


def compare_hashes(old: DataFrame, new: DataFrame, keys: list[str], content_hash: Column) -> DataFrame:
    """The same where both sides have, or make, a hash of the content."""
    was = old.select(*keys, content_hash.alias("old_hash"))
    now = new.select(*keys, content_hash.alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "REMOVED")
        .when(F.col("old_hash") != F.col("new_hash"), "MODIFIED").otherwise("UNCHANGED")
    )
    return was.join(now, keys, "full_outer").withColumn("change", change)


def change_counts(changes: DataFrame, *keys: str) -> DataFrame:
    """Counts of all four kinds, zeros too."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(c.lower()) for c in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")])


def missing_embeddings(wanted: DataFrame, cached: DataFrame, content: str, order: str) -> DataFrame:
    """One row per content hash that the cache lacks, the first by ``order``."""
    hashed = wanted.withColumn("content_hash", content_hash(F.col(content)))
    fresh = hashed.join(cached.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("uses"))


def activate(versions: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """Flip the chosen version of each document to ACTIVE; every other version of it becomes SUPERSEDED as of ``at``.

    ``chosen``: (document_id, chosen_id). Documents not chosen stay as they are.
    """
    both = versions.join(chosen, "document_id", "left")
    mine = F.col("version_id") == F.col("chosen_id")
    touched = F.col("chosen_id").isNotNull()
    return both.select(
        "document_id", "version_id",
        F.when(touched & mine, "ACTIVE").when(touched, "SUPERSEDED").otherwise(F.col("status")).alias("status"),
        F.when(touched & ~mine, at).when(touched & mine, F.lit(None)).otherwise(F.col("superseded_at")).alias("superseded_at"),
    )


def catalog_rows(versions: DataFrame) -> DataFrame:
    """Per document: its active version, how many there are, and all in order of creation."""
    return versions.groupBy("document_id").agg(
        F.max(F.when(F.col("status") == "ACTIVE", F.col("version_id"))).alias("active_version"),
        F.count("*").alias("n_versions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "version_id"))), lambda v: v["version_id"]), ",").alias("versions"),
    )


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Keep the first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
