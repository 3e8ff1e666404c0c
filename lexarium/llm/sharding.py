"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed by doc_id (those without one by their text) into ``SLOTS`` slots;
bytes are summed by slot; a slot map (version, slot, shard) assigns slots to
shards, and a rebalance writes a further version in which only the slots that
must move have changed. The slot map is made by one fold over at most ``SLOTS``
rows of (slot, bytes), a number that does not grow with the data: each slot, largest
first, goes to the shard that has least so far. Maps are stored, a folder a version; rows are
placed by a map that is read from there, so that a placement can be told and repeated.

The law is that of bytes: groups of equal texts are not kept together, as one of
them may hold a third of all rows; each row goes by its doc_id. ``slot`` in the query's
result is a row's place in its shard, from 0 without gaps within each shard.

Null texts have no bytes (size 16, CRC of nothing); rows without a doc_id
are hashed by their text. Equal rows share a virtual slot. Slots of equal bytes come in the order of
their numbers, shards of equal load too. A very long text is one row of its size, and
the shard that has it may be that much larger. An empty table gives no rows and an empty map.
Further columns do not enter, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.llm._shared import durable, shared_folder, table

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(data).cast("long") + F.lit(OVERHEAD)).alias("size"), F.crc32(data).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32"))), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def slot_map(sizes: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map: (version, virtual_slot, shard)."""
    item = F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"))
    listed = sizes.agg(F.array_sort(F.collect_list(item)).alias("slots"))
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.lit(0).cast("long").alias("load"), s.alias("shard"))).alias("loads"),
        F.expr("cast(array() as array<struct<slot:int,shard:int>>)").alias("put"),
    )

    def step(acc: Column, own: Column) -> Column:
        least = F.array_min(acc["loads"])
        loads = F.transform(acc["loads"], lambda x: F.struct((x["load"] - F.when(x["shard"] == least["shard"], own["less"]).otherwise(0)).alias("load"), x["shard"].alias("shard")))
        return F.struct(loads.alias("loads"), F.concat(acc["put"], F.array(F.struct(own["slot"].alias("slot"), least["shard"].alias("shard")))).alias("put"))

    folded = listed.select(F.explode(F.aggregate("slots", start, step)["put"]).alias("p"))
    return folded.select(F.lit(version).alias("version"), F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards: slots leave a shard only above its new share.

    Within each old shard slots are kept, smallest first, up to the share of the
    total; those beyond it, and those of shards that no longer exist, fill the
    free room of the shards in order, so that what moves is about the surplus.
    """
    whole = Window.partitionBy(F.lit(0))  # over the slots of the map, whose number is fixed
    placed = current.join(sizes, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("share", F.sum("bytes").over(whole) / F.lit(shards))
    by_shard = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.withColumn("stay", (F.col("shard") < shards) & (F.sum("bytes").over(by_shard) <= F.col("share")))
    room = (
        current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        .join(marked.where("stay").groupBy("shard").agg(F.sum("bytes").alias("kept")), "shard", "left")
        .join(F.broadcast(marked.select("share").limit(1).withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).withColumn("free", F.greatest(F.col("share") - F.coalesce("kept", F.lit(0)), F.lit(0.0)))
    )
    line = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("upto", F.sum("free").over(line)).withColumn("from", F.col("upto") - F.col("free"))
    queue = Window.partitionBy(F.lit(0)).orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moving = marked.where("not stay").withColumn("at", F.sum("bytes").over(queue) - F.col("bytes") / 2)
    moved = (
        moving.select("version", "virtual_slot", "at")
        .join(F.broadcast(room.select(F.col("shard").alias("to"), "from", "upto").where("free > 0")), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto")), "left")
        .select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", F.lit(shards - 1)).alias("shard"))
    )
    kept = marked.where("stay").select((F.col("version") + 1).alias("version"), "virtual_slot", "shard")
    return kept.unionByName(moved)


def save_map(mapping: DataFrame, folder: str, version: int) -> None:
    """Store a version of a map; one that is there already is an error."""
    mapping.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(version, virtual_slot, shard) of a stored version, or of the last."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    chosen = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(chosen)).select("version", "virtual_slot", "shard")


def place(rows: DataFrame, mapping: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the row's place within its shard from 0 without gaps.

    A place is the count of rows in the shard's earlier virtual slots plus the
    rank within the virtual slot, so no task orders a whole shard. The map has
    at most ``SLOTS`` rows and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mapping.join(sizes, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))
        .drop("offset", "rank")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(records(table(spark, sf_dir, "documents")))
    sizes = durable(slot_bytes(rows))
    folder = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    save_map(slot_map(sizes), folder, 1)
    mapping = read_map(spark, folder, 1)
    save_map(rebalance(mapping, sizes, SHARDS + 1), folder, 2)  # the edit for one more shard
    later = read_map(spark, folder, 2).select("virtual_slot", F.col("version").alias("next_version"), F.col("shard").alias("next_shard"))
    return place(rows, mapping, sizes).join(F.broadcast(later), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version", "next_shard", "next_version",
    )
