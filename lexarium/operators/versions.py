"""A store of document versions that grows by batches: only what is new is encoded and written, and a batch counts once its catalog row is there.

Below the store's root, each table holds one folder a batch:

    sections/batch=<name>   (doc_id, version_id, position, key, content, content_hash, chunk_id)
    vectors/batch=<name>    (content_hash, vector: its 32-bit floats, ``leveled``): one vector for each different content, ever
    versions/batch=<name>   (doc_id, version_id, source_hash, activated)
    catalog/<number>        (number, table, batch): the batches that make up each table after so many commits

A content hash is the 32 bytes of a SHA-256: half of what its digits take in a shuffle.

Nothing that a catalog names is changed. A reader takes the batches of the highest
catalog; a batch that failed is in none, so the state before it stays readable,
and its number is free for the next try. Two writers of one number cannot both
commit. ``compact`` merges the batches of a table by the same rule; ``vacuum``
gives up earlier states, and their disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.text import dimensions, hash_vector, leveled, norm, unleveled, unpacked
from lexarium.operators import lifecycle
from lexarium.operators.retrieval import small

TABLES = {
    "sections": "doc_id long, version_id string, position int, key string, content string, content_hash binary, chunk_id string",
    "vectors": "content_hash binary, vector struct<levels: binary, places: binary>",
    "versions": "doc_id long, version_id string, source_hash string, activated boolean",
}
CATALOG = "number long, table string, batch string"
#: Keys that are broadcast at most (of documents, 8 bytes each; of contents, 32), so that rows with their contents stay where they are read; beyond, rows are shuffled.
IDS, HASHES = 2_000_000, 500_000
REPORT = ["doc_id", "version_id", "total", "unchanged", "modified", "added", "removed", "reused_vectors", "new_vectors"]


class IngestError(ValueError):
    """A batch breaks a rule of the store; nothing of it is visible."""


@dataclass
class VersionStore:
    spark: SparkSession
    root: str
    encode: Callable[[Column], Column] = hash_vector

    def catalog(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the last commit (0: none yet) and the batches of each table."""
        try:
            rows = self.spark.read.schema(CATALOG).option("recursiveFileLookup", "true").parquet(f"{self.root}/catalog")
            last = rows.agg(F.max("number")).first()[0] or 0
            live = rows.where(F.col("number") == last).select("table", "batch").collect()  # as many as there are uncompacted batches
        except AnalysisException:  # no folder yet
            last, live = 0, []
        batches: dict[str, list[str]] = {t: [] for t in TABLES}
        for r in live:
            batches[r["table"]].append(r["batch"])
        return last, batches

    def table(self, name: str, batches: dict[str, list[str]] | None = None) -> DataFrame:
        own = (batches or self.catalog()[1])[name]
        if not own:
            return self._nothing(TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/batch={b}" for b in sorted(own)])

    def versions(self, batches: dict[str, list[str]] | None = None) -> DataFrame:
        """(doc_id, version_id, source_hash, status, previous_version_id, at, activated): the version activated last is ACTIVE, earlier ones SUPERSEDED.

        Batches are named by their number, so the order of names is the order of commits.
        """
        own = (batches or self.catalog()[1])["versions"]
        if not own:
            return self._nothing("doc_id long, version_id string, source_hash string, status string, previous_version_id string, at string, activated boolean")
        paths = [f"{self.root}/versions/batch={b}" for b in sorted(own)]
        rows = self.spark.read.option("basePath", f"{self.root}/versions").schema(TABLES["versions"] + ", batch string, at string").parquet(*paths)
        rows = rows.withColumn("at", F.coalesce("at", "batch"))
        w = Window.partitionBy("doc_id").orderBy("at")
        active = F.max(F.when(F.col("activated"), F.col("at"))).over(Window.partitionBy("doc_id"))
        before = F.last(F.when(F.col("activated"), F.col("version_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.select("doc_id", "version_id", "source_hash", F.when(F.col("at") == active, "ACTIVE").otherwise("SUPERSEDED").alias("status"), before.alias("previous_version_id"), "at", "activated")

    def active(self, batches: dict[str, list[str]] | None = None, documents: DataFrame | None = None) -> DataFrame:
        """Sections of the active version of each document, or of each in ``documents`` (doc_id)."""
        batches = batches or self.catalog()[1]
        rows, versions = self.table("sections", batches), self.versions(batches).where("status = 'ACTIVE'").select("doc_id", "version_id")
        if documents is not None:
            rows = rows.join(documents, "doc_id", "left_semi")
        return rows.join(versions, ["doc_id", "version_id"], "left_semi")

    def index(self, batches: dict[str, list[str]] | None = None, told: Callable[[DataFrame], Column] | None = None) -> DataFrame:
        """Active sections with their vectors, or with what ``told`` says of the stored ones: then the vectors stay where they are read."""
        batches = batches or self.catalog()[1]
        vectors = self.table("vectors", batches)
        said = told(vectors) if told else unpacked(unleveled("vector"))
        return self.active(batches).join(vectors.select("content_hash", said.alias("vector")), "content_hash")

    def ingest(self, sections: DataFrame, activate: bool = True, repeated: str = "refuse") -> DataFrame:
        """Add one version of each document in ``sections`` (doc_id, version_id, position, key, content); returns the report by document.

        IngestError, and no change, if a document has two versions in the batch, a
        version id that the store has, a key twice, a null, or (unless ``repeated``
        is "skip", then such documents are left out) text that was ingested before.
        The first section of a content, by document and position, counts as its new vector.
        """
        last, batches = self.catalog()
        name = f"{last + 1:09d}-{uuid.uuid4().hex[:12]}"
        rows = sections.select("doc_id", "version_id", F.col("position").cast("int").alias("position"), "key", "content", F.unhex(lifecycle.content_hash(F.col("content"))).alias("content_hash"))
        chunk = F.concat(F.col("version_id"), F.lit(":chunk:"), F.substring(F.sha2("key", 256), 1, 16))
        rows = self._written("sections", name, rows.withColumn("chunk_id", chunk), "batch")  # no catalog names it before the commit
        listed = F.array_sort(F.collect_list(F.struct("position", "key", "content_hash")))  # the sections of one document
        text = F.sha2(F.array_join(F.transform("listed", lambda s: F.concat_ws(" ", s["key"], F.lower(F.hex(s["content_hash"])))), "\n"), 256)
        twice = F.size(F.array_distinct(F.transform("listed", lambda s: s["key"]))) < F.size("listed")
        documents = rows.groupBy("doc_id").agg(
            F.first("version_id").alias("version_id"), (F.min("version_id") < F.max("version_id")).alias("two"), listed.alias("listed"),
            F.count_if(F.expr("doc_id IS NULL OR version_id IS NULL OR position IS NULL OR key IS NULL OR content IS NULL")).alias("nulls"),
        ).select("doc_id", "version_id", "two", "nulls", twice.alias("twice"), text.alias("source_hash"))
        known = self.versions(batches)
        told = documents.join(known.select("version_id").distinct().withColumn("taken", F.lit(True)), "version_id", "left").join(
            known.select("doc_id", "source_hash").distinct().withColumn("seen", F.lit(True)), ["doc_id", "source_hash"], "left")
        told = self._written("versions", name, told, "staged")
        wrong = told.agg(
            F.count("*").alias("documents"), F.count_if(F.col("nulls") > 0).alias("with nulls"), F.count_if("two").alias("with two versions"), F.count_if("twice").alias("with a key twice"),
            F.count_if("taken").alias("with a version id that exists"), F.count_if("seen").alias("ingested before"), (F.count("version_id") - F.count_distinct("version_id")).alias("that share a version id"),
        ).first().asDict()
        if not wrong.pop("documents"):
            raise IngestError("a batch must hold a section")
        left_out = wrong.pop("ingested before") if repeated == "skip" else 0
        if any(wrong.values()):
            raise IngestError("documents: " + ", ".join(f"{v} {k}" for k, v in wrong.items() if v))
        new = told.where("seen IS NULL").select("doc_id", "version_id", "source_hash")
        ids = small(new.select("doc_id"), IDS)
        kept = f"{name}-new" if left_out else name
        if left_out:
            rows = self._written("sections", kept, rows.join(ids, "doc_id", "left_semi"), "batch")
            self._emptied("sections", name, "batch")

        first = F.row_number().over(Window.partitionBy("content_hash").orderBy("doc_id", "position", "key"))
        held, lacking = self.table("vectors", batches), rows
        if batches["vectors"]:  # told by hashes alone, and few as a rule
            hashes = self._written("vectors", name, rows.select("content_hash").distinct().join(held.select("content_hash"), "content_hash", "left_anti"), "staged")
            lacking = rows.join(small(hashes, HASHES), "content_hash", "left_semi")
        lacking = lacking.withColumn("k", first).where("k = 1")
        vectors = self._written("vectors", name, lacking.select("content_hash", leveled(self.encode(F.col("content"))).alias("vector"), "doc_id"), "batch")
        sizes = vectors.select(dimensions(vectors).alias("d"), F.isnan(norm("vector.levels")).alias("bad")).union(held.select(dimensions(held), F.lit(False)).limit(1))
        seen = sizes.agg(F.count_distinct("d").alias("sizes"), F.count_if(F.col("bad") | (F.col("d") <= 0)).alias("bad")).first()
        if seen["sizes"] > 1 or seen["bad"]:
            raise IngestError(f"vectors of {seen['sizes']} lengths, {seen['bad']} not finite")

        old = self.active(batches, ids)
        counts = lifecycle.change_counts(lifecycle.compare_hashes(old, rows, ["doc_id", "key"], F.col("content_hash")), "doc_id")
        totals = rows.groupBy("doc_id").agg(F.count("*").alias("total"))
        made = vectors.groupBy("doc_id").agg(F.count("*").alias("new_vectors"))
        report = new.join(totals, "doc_id").join(counts, "doc_id", "left").join(made, "doc_id", "left").select("*", F.coalesce("new_vectors", F.lit(0)).alias("n")).select(
            "doc_id", "version_id", "total", "unchanged", "modified", "added", "removed", (F.col("total") - F.col("n")).alias("reused_vectors"), F.col("n").alias("new_vectors"))
        self._written("reports", name, report, "batch")

        self._written("versions", name, new.select("*", F.lit(activate).alias("activated")), "batch")
        self._commit(last + 1, {t: [*b, kept if t == "sections" else name] for t, b in batches.items()})
        for t in ("versions", "vectors") if batches["vectors"] else ("versions",):
            self._emptied(t, name, "staged")
        return self.spark.read.parquet(f"{self.root}/reports/batch={name}").select(*REPORT)

    def compact(self, tables: Iterable[str] = tuple(TABLES)) -> None:
        """One batch for each of ``tables`` in place of all that there are."""
        (last, batches), tables = self.catalog(), list(tables)
        name = f"{last + 1:09d}-{uuid.uuid4().hex[:12]}"
        for t in tables:
            rows = self.versions(batches).select("doc_id", "version_id", "source_hash", "activated", "at") if t == "versions" else self.table(t, batches)
            self._written(t, name, rows, "batch")
        self._commit(last + 1, batches | {t: [name] for t in tables})

    def vacuum(self) -> None:
        """Empty the folders of batches that only earlier catalogs name: the last state is all that can be read then. Batches of other writers, which no catalog names yet, stay."""
        live = {(t, b) for t, own in self.catalog()[1].items() for b in own}
        known = self.spark.read.schema(CATALOG).option("recursiveFileLookup", "true").parquet(f"{self.root}/catalog").select("table", "batch").distinct()
        for t, b in sorted({(r["table"], r["batch"]) for r in known.collect()} - live):  # as many as there were commits
            self._emptied(t, b, "batch")

    def _nothing(self, schema: str) -> DataFrame:
        """No rows, which the optimizer knows: joins with them move nothing."""
        return self.spark.createDataFrame([], schema).where(F.lit(False))

    def _written(self, table: str, name: str, rows: DataFrame, kind: str) -> DataFrame:
        path = f"{self.root}/{table}/{kind}={name}"
        rows.write.option("compression", "zstd").parquet(path)  # two thirds of what Spark's default takes
        return self.spark.read.schema(rows.schema).parquet(path)

    def _emptied(self, table: str, name: str, kind: str) -> None:
        """A folder that no later catalog names takes no more disk; it stays, so its name isn't used again."""
        self._nothing("nothing string").write.mode("overwrite").parquet(f"{self.root}/{table}/{kind}={name}")

    def _commit(self, number: int, batches: dict[str, list[str]]) -> None:
        rows = [(number, t, b) for t, own in batches.items() for b in own]
        self.spark.createDataFrame(rows, CATALOG).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/catalog/{number:09d}")
