"""Indexes and version stores that are written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.text import dimensions
from lexarium.jobs.lifecycle import HASH_SQL
from lexarium.jobs.registry import query
from lexarium.operators.versions import REPORT, TABLES, VersionStore
from lexarium.sources import artifact
from lexarium.sources.tables import CHUNKS_SQL, SECTIONS_SQL, sections, spread, table


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session shares; only a session in one JVM may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='lexarium-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lines(sources: DataFrame) -> DataFrame:
    """Each line that is not blank is a chunk."""
    return sources.select("source_id", F.posexplode(F.split("text", "\n")).alias("p", "content")).where(F.trim("content") != "").select("source_id", (F.col("p") + 1).alias("part"), "content")


def _index(spark: SparkSession, sf_dir: str) -> str:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    manifest = docs.select(F.col("doc_id").alias("source_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))
    root = shared(spark, "index")
    artifact.build(artifact.row_sources(docs, "doc_id", "text", manifest), root, lines)
    return root


@query("WITH " + CHUNKS_SQL + " SELECT doc_id AS source_id, lang, source, count(*) AS chunks, sum(length(content)) AS chars, min(n) AS first, max(n) AS last, 512 AS dimensions FROM chunks GROUP BY ALL")
def s01_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of ``documents``, checked against a manifest, written, verified and read back: what it holds of each source."""
    index = artifact.load(spark, _index(spark, sf_dir))
    both = index.chunks.join(index.stored.select("chunk_id", dimensions(index.stored).alias("dimensions")), "chunk_id")
    return both.groupBy("source_id", "lang", "source").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.min("part").alias("first"), F.max("part").alias("last"), F.max("dimensions").alias("dimensions"))


@query("WITH " + CHUNKS_SQL + ", n AS (SELECT chunk_id, unnest(list_transform(generate_series(1, length(t)), lambda i: substr(t, i, 1))) AS g, length(t) AS len FROM (SELECT chunk_id, regexp_replace(replace(lower(content), 'ß', 'ss'), '\\s', '', 'g') AS t FROM chunks)),\n"
       "c AS (SELECT chunk_id, CAST('0x' || substr(sha256(g), 1, 8) AS BIGINT) % 512 AS b, count(*) AS k, any_value(len) AS len FROM n GROUP BY ALL)\n"
       "SELECT chunk_id, any_value(len) AS chars, count(DISTINCT b) AS letters FROM c GROUP BY chunk_id")
def s06_validate_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk of a loaded index: characters without white space, and buckets of single characters, all of which its vector must hold."""
    index = artifact.load(spark, _index(spark, sf_dir))
    bare = F.regexp_replace(F.replace(F.lower("content"), F.lit("ß"), F.lit("ss")), "\\s", "")
    bucket = F.transform(F.filter(F.array_distinct(F.split("bare", "")), lambda g: g != ""), lambda g: F.conv(F.substring(F.sha2(g.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 512)
    rows = index.chunks.join(index.vectors, "chunk_id").withColumn("bare", bare).withColumn("buckets", F.array_distinct(bucket))
    held = F.size(F.filter("buckets", lambda b: F.element_at("vector", (b + 1).cast("int")) > 0))
    return rows.select("chunk_id", F.length("bare").alias("chars"), held.alias("letters"))


@query("WITH " + CHUNKS_SQL + " SELECT lang, count(*) AS chunks, sum(length(content)) AS chars, 1 AS releases FROM chunks GROUP BY lang")
def s16_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index staged twice is one release, named by its content; what the release holds of each language."""
    root, releases = _index(spark, sf_dir), shared(spark, "releases")
    names = {artifact.stage(root, releases, spark), artifact.stage(root, releases, spark)}
    held = artifact.load(spark, f"{releases}/{min(names)}").chunks
    return held.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars")).withColumn("releases", F.lit(len(names)))


INGEST_SQL = SECTIONS_SQL + f""",
h1 AS (SELECT doc_id, key, CAST(substr(key, 8) AS INTEGER) AS p, {HASH_SQL.format('content')} AS h FROM v1), h2 AS (SELECT doc_id, key, CAST(substr(key, 8) AS INTEGER) AS p, {HASH_SQL.format('content')} AS h FROM v2),
s1 AS (SELECT doc_id, string_agg(key || ' ' || h, chr(10) ORDER BY p) AS s FROM h1 GROUP BY doc_id), s2 AS (SELECT doc_id, string_agg(key || ' ' || h, chr(10) ORDER BY p) AS s FROM h2 GROUP BY doc_id),
n2 AS (SELECT * FROM h2 WHERE doc_id IN (SELECT s2.doc_id FROM s2 LEFT JOIN s1 USING (doc_id) WHERE s1.s IS DISTINCT FROM s2.s)),
f1 AS (SELECT doc_id, count(*) FILTER (k = 1) AS new_vectors, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h1) GROUP BY doc_id),
f2 AS (SELECT doc_id, count(*) FILTER (k = 1 AND h NOT IN (SELECT h FROM h1)) AS new_vectors, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM n2) GROUP BY doc_id),
d2 AS (SELECT doc_id, count(*) FILTER (o.h = n.h) AS unchanged, count(*) FILTER (o.h <> n.h) AS modified, count(*) FILTER (o.h IS NULL) AS added, count(*) FILTER (n.h IS NULL) AS removed
       FROM (SELECT * FROM h1 WHERE doc_id IN (SELECT doc_id FROM n2)) o FULL JOIN n2 n USING (doc_id, key) GROUP BY doc_id)"""


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[VersionStore, DataFrame, DataFrame]:
    store, docs = VersionStore(spark, shared(spark, "versions")), spread(table(spark, sf_dir, "documents"))
    reports = []
    for v in (1, 2):
        rows = sections(docs, v).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(f":v{v}")).alias("version_id"), F.substring("key", 8, 12).cast("int").alias("position"), "key", "content")
        reports.append(store.ingest(rows, repeated="skip"))
    return store, *reports


@query("WITH " + INGEST_SQL + """
SELECT 1 AS ingest, doc_id, doc_id || ':v1' AS version_id, total, 0 AS unchanged, 0 AS modified, total AS added, 0 AS removed, total - new_vectors AS reused_vectors, new_vectors FROM f1
UNION ALL SELECT 2, doc_id, doc_id || ':v2', total, unchanged, modified, added, removed, total - new_vectors, new_vectors FROM f2 JOIN d2 USING (doc_id)""")
def d08_ingest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of ``documents`` into a new store; texts that did not change are skipped the second time."""
    _, first, second = _two_versions(spark, sf_dir)
    return first.select(F.lit(1).alias("ingest"), *REPORT).union(second.select(F.lit(2), *REPORT))


@query("WITH " + INGEST_SQL + """, act AS (SELECT doc_id, p, key, h, 2 AS v FROM n2 UNION ALL SELECT doc_id, p, key, h, 1 FROM h1 WHERE doc_id NOT IN (SELECT doc_id FROM n2))
SELECT doc_id, doc_id || ':v' || v AS version_id, count(*) AS sections, doc_id || ':v' || v || ':chunk:' || substr(sha256(arg_min(key, p)), 1, 16) AS first_chunk, count(*) AS vectors FROM act GROUP BY doc_id, v""")
def u37_store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compacted store serves after two ingests: sections of active versions, each with its vector."""
    store, _, _ = _two_versions(spark, sf_dir)
    for t in TABLES:  # one at a time: the disk holds one table twice, not all
        store.compact([t])
        store.vacuum()
    return store.index(told=dimensions).groupBy("doc_id", "version_id").agg(F.count("*").alias("sections"), F.min_by("chunk_id", "position").alias("first_chunk"), F.count("vector").alias("vectors"))
