"""Index artifacts: built from sources that match a manifest, loaded only if every byte is as it was written.

A build reads the sources, refuses them as a whole if any is missing, unlisted,
repeated or changed, cuts them into chunks, makes a vector of each, and writes

    chunks/    (source_id, chunk_id, part, headings, content, metadata of the source)
    vectors/   (chunk_id, vector: the bytes of its 32-bit floats)
    manifest/  what was written: each file with its length and SHA-256, and the counts

The manifest is written last, when what was written has passed the checks of a
load: a folder without one is no artifact. Files are
hashed where Spark reads them, a file in a task; ``ROWS_A_FILE`` bounds their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.chunking import cut
from lexarium.functions.text import dimensions, hash_vector, norm, packed, unpacked

ROWS_A_FILE = 50_000
#: SHA-256 of no bytes. Spark's readers do not show empty files: a listed source of no bytes counts as there, and has no chunks.
NOTHING = hashlib.sha256(b"").hexdigest()
DIMENSIONS = 512
FORMAT = 2
ABOUT = "format int, status string, policy string, chunks long, sources long, vectors long, dimensions int"


class ArtifactError(ValueError):
    """Sources or files are not what their manifest says; nothing of them is used."""


@dataclass
class Index:
    """A loaded artifact; ``stored`` are its vectors as they stand in the files."""

    chunks: DataFrame
    stored: DataFrame
    manifest: dict

    @property
    def vectors(self) -> DataFrame:
        return self.stored.select("chunk_id", unpacked("vector").alias("vector"))


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path below ``root``, length, sha256[, content]) of all files that Spark takes for data."""
    bare = root.split("://")[-1].removeprefix("file:").rstrip("/").lstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index("path", f"{bare}/", -1)
    return found.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))


def refuse_unless_equal(listed: DataFrame, found: DataFrame, key: str, what: str) -> None:
    """``listed`` and ``found`` have (key, sha256); they must hold the same keys, each once, with the same hashes."""
    a = listed.select(F.col(key).alias("key"), F.col("sha256").alias("wanted")).groupBy("key").agg(F.count("*").alias("times"), F.first("wanted").alias("wanted"))
    b = found.select(F.col(key).alias("key"), F.col("sha256").alias("seen")).groupBy("key").agg(F.count("*").alias("copies"), F.first("seen").alias("seen"))
    fault = (
        F.when(F.col("copies").isNull() & ~F.col("wanted").eqNullSafe(F.lit(NOTHING)), "missing").when(F.col("times").isNull(), "unlisted").when((F.col("times") > 1) | (F.col("copies") > 1), "repeated")
        .when(F.col("copies").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("seen")), "changed")
    )
    wrong = a.join(b, "key", "full").select("key", fault.alias("fault")).where("fault IS NOT NULL")
    faults = wrong.groupBy("fault").agg(F.count("*").alias("n"), F.min("key").alias("example")).orderBy("fault").collect()  # four rows at most
    if faults:
        raise ArtifactError(f"{what}: " + ", ".join(f"{r['n']} {r['fault']} (such as {r['example']})" for r in faults))


def file_sources(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Text files below ``root`` that ``manifest`` (path, sha256, metadata) lists: its rows with source_id and text.

    All or nothing: ArtifactError if the folder and the manifest differ, or a file is not UTF-8.
    """
    found = files(spark, root, content=True)
    refuse_unless_equal(manifest, found, "path", "sources")
    body = F.col("content").cast("string")
    texts = manifest.join(found.select("path", body.alias("text"), F.is_valid_utf8(body).alias("valid")), "path")
    bad = texts.where(~F.col("valid")).agg(F.count("*").alias("n"), F.min("path").alias("path")).first()
    if bad["n"]:
        raise ArtifactError(f"sources: {bad['n']} not UTF-8 (such as {bad['path']})")
    return texts.withColumnRenamed("path", "source_id").drop("valid")


def row_sources(rows: DataFrame, key: str, text: str, manifest: DataFrame) -> DataFrame:
    """The same for sources that are rows: ``manifest`` (source_id, sha256) must list each row's text."""
    found = rows.withColumnRenamed(key, "source_id").withColumnRenamed(text, "text")
    refuse_unless_equal(manifest, found.select("source_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256")), "source_id", "sources")
    return found


def headed_parts(sources: DataFrame) -> DataFrame:
    """(source_id, part, headings, content) of Markdown texts."""
    return cut(sources, "source_id", "text")


def build(sources: DataFrame, root: str, cutter: Callable[[DataFrame], DataFrame] = headed_parts, encode: Callable[[Column], Column] = hash_vector, policy: str = "default") -> dict:
    """Write the artifact of ``sources`` (source_id, text, metadata) to ``root``, which must not hold one; returns its manifest."""
    spark = sources.sparkSession
    metadata = [c for c in sources.columns if c not in ("source_id", "text")]
    parts = cutter(sources).join(sources.select("source_id", *metadata), "source_id") if metadata else cutter(sources)
    chunks = parts.withColumn("chunk_id", F.concat_ws(":", F.col("source_id").cast("string"), F.col("part").cast("string")))
    chunks.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{root}/chunks")
    said = F.concat_ws(" ", F.try_element_at("headings", F.lit(-1)) if "headings" in chunks.columns else F.lit(None).cast("string"), "content")
    written = spark.read.parquet(f"{root}/chunks")
    written.select("chunk_id", packed(encode(said)).alias("vector")).write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{root}/vectors")
    return commit(spark, root, policy)


def commit(spark: SparkSession, root: str, policy: str) -> dict:
    listed = files(spark, f"{root}/chunks").select(F.concat(F.lit("chunks/"), "path").alias("path"), "length", "sha256").union(
        files(spark, f"{root}/vectors").select(F.concat(F.lit("vectors/"), "path"), "length", "sha256"))
    counts = spark.read.parquet(f"{root}/chunks").agg(F.count("*").alias("chunks"), F.count_distinct("source_id").alias("sources"))
    vectors = spark.read.parquet(f"{root}/vectors")
    size = vectors.agg(F.count("*").alias("vectors"), F.max(dimensions(vectors)).alias("dimensions"))
    about = counts.crossJoin(size).select(F.lit(FORMAT).alias("format"), F.lit("COMPLETE").alias("status"), F.lit(policy).alias("policy"), "*")  # one row each
    listed.write.parquet(f"{root}/manifest/files")
    manifest = about.first().asDict()
    check(spark.read.parquet(f"{root}/chunks"), vectors, manifest)
    spark.createDataFrame([manifest], ABOUT).coalesce(1).write.json(f"{root}/manifest/about")  # last
    return manifest


def load(spark: SparkSession, root: str, policy: str = "default") -> Index:
    """The artifact below ``root``; ArtifactError if it is incomplete, of another policy, or differs from its manifest in any byte."""
    from pyspark.errors import AnalysisException

    try:
        about = spark.read.schema(ABOUT).json(f"{root}/manifest/about").collect()
    except AnalysisException as e:
        raise ArtifactError(f"no complete artifact in {root}") from e
    if len(about) != 1 or about[0]["status"] != "COMPLETE" or about[0]["format"] != FORMAT:
        raise ArtifactError(f"no complete artifact in {root}")
    manifest = about[0].asDict()
    if manifest["policy"] != policy:
        raise ArtifactError(f"policy {manifest['policy']!r} where {policy!r} is wanted")
    listed = spark.read.parquet(f"{root}/manifest/files")
    for name in ("chunks", "vectors"):
        own = files(spark, f"{root}/{name}").withColumn("path", F.concat(F.lit(f"{name}/"), "path"))
        refuse_unless_equal(listed.where(F.startswith("path", F.lit(f"{name}/"))), own, "path", name)
    chunks, vectors = spark.read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/vectors")
    check(chunks, vectors, manifest)
    return Index(chunks, vectors, manifest)


def check(chunks: DataFrame, vectors: DataFrame, manifest: dict) -> None:
    """Counts, ids, dimensions and norms."""
    made = vectors.select("chunk_id", (dimensions(vectors) == manifest["dimensions"]).alias("sized"), norm("vector").alias("norm"))
    made = made.select("chunk_id", "sized", (F.abs(F.col("norm") - 1) <= 1e-4).alias("unit"), (F.col("norm") == 0).alias("zero"))
    met = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max(F.trim("content") == "").alias("blank")).join(made, "chunk_id", "full")
    seen = met.agg(
        F.sum("n").alias("chunks"), F.count("sized").alias("vectors"), F.count_if((F.col("n") > 1) | F.col("chunk_id").isNull()).alias("repeated ids"),
        F.count_if(F.col("n").isNull() | F.col("sized").isNull()).alias("chunks or vectors alone"), F.count_if(~F.col("sized")).alias("vectors of another length"),
        F.count_if(~(F.col("unit") | F.col("zero"))).alias("vectors that aren't of length 1"), F.count_if("blank").alias("blank chunks"),
    ).first().asDict()
    wrong = {k: v for k, v in seen.items() if k not in ("chunks", "vectors") and v} | {k: seen[k] for k in ("chunks", "vectors") if (seen[k] or 0) != manifest[k]}
    if wrong:
        raise ArtifactError("index: " + ", ".join(f"{v} {k}" for k, v in sorted(wrong.items())))


def stage(source: str, releases: str, spark: SparkSession, policy: str = "default") -> str:
    """Copy a valid artifact to a place below ``releases`` that its content names; returns the name. An existing release is only checked."""
    index = load(spark, source, policy)
    parts = [d.select(F.xxhash64(*d.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first() for d in (index.chunks, index.stored)]
    name = "-".join(f"{p['n']:x}.{(p['x'] or 0) & (1 << 64) - 1:016x}.{p['s'] or 0:x}" for p in parts)
    target = f"{releases.rstrip('/')}/{name}"
    try:
        load(spark, target, policy)
        return name
    except ArtifactError:
        pass
    index.chunks.write.option("maxRecordsPerFile", ROWS_A_FILE).mode("overwrite").parquet(f"{target}/chunks")  # what a failed copy left has no manifest
    index.stored.write.option("maxRecordsPerFile", ROWS_A_FILE).mode("overwrite").parquet(f"{target}/vectors")
    commit(spark, target, policy)
    return name

