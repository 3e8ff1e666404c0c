"""Artifact builds as a state machine on a stream: every request is logged with the state it led to, refused ones with their reason."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "artifact_id long, sequence long, request_id long, action string, status string, completed int, attempt int, accepted boolean, reason string"
STATE = "status string, completed int, attempt int, sequence long, last long"


@dataclass
class Build:
    """What is known of one artifact."""

    status: str = "PENDING"
    completed: int = 0
    attempt: int = 0
    sequence: int = 0
    last: int = -(1 << 63)

    def refusal(self, action: str, completed: int | None, resume: bool, total: int) -> str | None:
        """Why a request is refused, in the log's fixed words."""
        if action == "start":
            if self.status == "COMPLETE":
                return "ARTIFACT_ALREADY_COMPLETE"
            return "RESUME_REQUIRED" if self.status in ("BUILDING", "FAILED") and not resume else None
        if action == "checkpoint":
            if self.status != "BUILDING":
                return "CHECKPOINT_REQUIRES_BUILDING_STATE"
            return None if completed is not None and self.completed <= completed <= total else "CHECKPOINT_PROGRESS_INVALID"
        if action == "complete":
            if self.status != "BUILDING":
                return "COMPLETE_REQUIRES_BUILDING_STATE"
            return None if self.completed == total else "PARTIAL_ARTIFACT_CANNOT_COMPLETE"
        if action == "fail":
            return "COMPLETE_ARTIFACT_CANNOT_FAIL" if self.status == "COMPLETE" else None
        return "UNKNOWN_ACTION"

    def take(self, request_id: int, action: str, completed: int | None, resume: bool, total: int) -> tuple:
        """Apply a request; what the log says of it after the artifact's id."""
        reason = "OUT_OF_ORDER" if request_id <= self.last else self.refusal(action, completed, resume, total)
        if reason is None:
            self.status = {"start": "BUILDING", "complete": "COMPLETE", "fail": "FAILED"}.get(action, self.status)
            self.attempt += action == "start"
            self.completed = completed if action == "checkpoint" else self.completed
        self.last = max(self.last, request_id)
        self.sequence += 1
        return self.sequence, request_id, action, self.status, self.completed, self.attempt, reason is None, reason


class Builds(StatefulProcessor):
    """One state a build, in the state store, so the log's numbers go on after a restart. A build that hears nothing for ``idle_ms`` of processing time fails."""

    def __init__(self, total: int, idle_ms: int | None = None):
        self.total, self.idle_ms = total, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("build", STATE)

    def _known(self) -> Build:
        return Build(*self.state.get()) if self.state.exists() else Build()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        build, out = self._known(), []
        for r in pd.concat(list(rows)).sort_values("request_id", kind="stable").itertuples():  # a key's requests of one micro-batch
            completed = None if pd.isna(r.completed) else int(r.completed)
            out.append((key[0], *build.take(int(r.request_id), r.action, completed, bool(r.resume), self.total)))
        self.state.update(astuple(build))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if build.status == "BUILDING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        build, out = self._known(), []
        if build.status == "BUILDING":
            build.status, build.sequence = "FAILED", build.sequence + 1
            out.append((key[0], build.sequence, None, "fail", build.status, build.completed, build.attempt, True, "IDLE"))
            self.state.update(astuple(build))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def build_log(requests: DataFrame, total: int, idle_ms: int | None = None) -> DataFrame:
    """The log of a stream of requests (artifact_id, request_id, action, completed, resume). The session's state store must be RocksDB."""
    return requests.groupBy("artifact_id").transformWithStateInPandas(Builds(total, idle_ms), LOG, "append", "processingTime" if idle_ms is not None else "none")


def append_log(log: DataFrame, folder: str) -> None:
    """Append what there is now to ``folder``/log as JSON lines; a later call with the same folder goes on where this one ended."""
    spark: SparkSession = log.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        log.writeStream.format("json").outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/log").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{folder}/log")
