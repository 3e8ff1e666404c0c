"""Streaming twins of log queries, and builds as a state machine on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.jobs.registry import query
from lexarium.streaming import lifecycle, traces


@query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS used FROM events GROUP BY ALL")
def q06_daily_quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = traces.run_to_table(traces.daily_usage(traces.event_stream(spark, sf_dir)), "complete", "daily")
    return usage.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'checkpoint' END AS action,
  CAST(floor(value) AS BIGINT) % 4 AS done, event_id % 2 = 0 AS resume, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s(user_id, n, event_id, action, status, completed, attempt, reason) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'PENDING', CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, n, event_id, action, CASE WHEN reason IS NOT NULL THEN was WHEN action = 'start' THEN 'BUILDING' WHEN action = 'complete' THEN 'COMPLETE' WHEN action = 'fail' THEN 'FAILED' ELSE was END,
   CASE WHEN reason IS NULL AND action = 'checkpoint' THEN done ELSE completed END, attempt + CASE WHEN reason IS NULL AND action = 'start' THEN 1 ELSE 0 END, reason
  FROM (SELECT s.user_id, e.n, e.event_id, e.action, s.status AS was, s.completed, s.attempt, e.done, CASE e.action
    WHEN 'start' THEN CASE WHEN s.status = 'COMPLETE' THEN 'ARTIFACT_ALREADY_COMPLETE' WHEN s.status IN ('BUILDING', 'FAILED') AND NOT e.resume THEN 'RESUME_REQUIRED' END
    WHEN 'checkpoint' THEN CASE WHEN s.status <> 'BUILDING' THEN 'CHECKPOINT_REQUIRES_BUILDING_STATE' WHEN NOT e.done BETWEEN s.completed AND 3 THEN 'CHECKPOINT_PROGRESS_INVALID' END
    WHEN 'complete' THEN CASE WHEN s.status <> 'BUILDING' THEN 'COMPLETE_REQUIRES_BUILDING_STATE' WHEN s.completed <> 3 THEN 'PARTIAL_ARTIFACT_CANNOT_COMPLETE' END
    ELSE CASE WHEN s.status = 'COMPLETE' THEN 'COMPLETE_ARTIFACT_CANNOT_FAIL' END END AS reason
   FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id AS artifact_id, n AS sequence, event_id AS request_id, action, status, completed, attempt, reason IS NULL AS accepted, reason FROM s WHERE n > 0""")
def s20_artifact_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests on builds (a user's), streamed through the state machine into an appended log, which is read back."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "start").when(kind == "purchase", "complete").when(kind == "error", "fail").otherwise("checkpoint")
    requests = traces.event_stream(spark, sf_dir).select(
        F.col("user_id").alias("artifact_id"), F.col("event_id").alias("request_id"), action.alias("action"), (F.floor("value") % 4).cast("int").alias("completed"), (F.col("event_id") % 2 == 0).alias("resume"))
    folder = traces.shared_folder(spark, "builds")
    lifecycle.append_log(lifecycle.build_log(requests, 3), folder)
    return lifecycle.read_log(spark, folder)
