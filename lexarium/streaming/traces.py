"""The trace log as a stream: daily usage, and the order of each run's events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session shares between its machines; only a session in one JVM may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="lexarium-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder of tables, as they come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Events per run and day. The log it stands for rejects what comes late; here it is dropped after ``late``."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("used")).select("user_id", F.col("window.start").alias("day"), "used")


def sequence_breaks(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, was): events whose number isn't above the highest of their run so far."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        found = []
        for pdf in frames:
            for number in pdf["event_id"]:
                if number <= top:
                    found.append((key[0], number, top))
                top = max(top, number)
        state.update((int(top),))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "was"])

    return stream.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(check, "user_id long, event_id long, was long", "top long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(result: DataFrame, mode: str, name: str) -> DataFrame:
    """Drive a stream over all that is there and read what it wrote."""
    spark = result.sparkSession
    folder = shared_folder(spark, name)

    def keep(rows: DataFrame, batch_id: int) -> None:
        # a batch that is run again writes the same folder again
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id if mode == 'append' else 0}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out").drop("batch")
