"""Job and trace logs: events are the log, a user a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))


EV_SQL = "ev AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events)"


def by_run():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def until_now():
    return by_run().rowsBetween(Window.unboundedPreceding, 0)


@query("""WITH k AS (SELECT *, row_number() OVER w AS n, first_value(round(value, 2)) OVER w AS kept FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS submissions, min(CASE WHEN n = 1 THEN event_id END) AS task, count(*) FILTER (round(value, 2) <> kept) AS conflicts FROM k GROUP BY ALL""")
def q01_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent submission by identity: the first stays, later ones with another payload conflict."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    k = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 2).alias("v"), F.row_number().over(w).alias("n"), F.first(F.round("value", 2)).over(w).alias("kept"))
    return k.groupBy("user_id", "event_type").agg(F.count("*").alias("submissions"), F.min(F.when(F.col("n") == 1, F.col("event_id"))).alias("task"), F.count_if(F.col("v") != F.col("kept")).alias("conflicts"))


@query("SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value > 1 ORDER BY ts, event_id LIMIT 16")
def q02_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen oldest claimable tasks: the limit is the feature."""
    e = table(spark, sf_dir, "events")
    kind = F.broadcast(e.agg(F.min("event_type").alias("event_type")))
    return e.where("value > 1").join(kind, "event_type").orderBy("ts", "event_id").limit(16).select("event_id", "user_id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS beat FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def q03_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid event of each run holds its stage."""
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("beat"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS used, count(*) > 3 AS over_budget FROM events GROUP BY ALL""")
def q06_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("used"), (F.count("*") > 3).alias("over_budget"))


@query("SELECT event_type AS state, count(*) AS n, min(ts) AS oldest, count(*) FILTER (value > 50) AS active FROM events GROUP BY ALL")
def q07_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.count_if(F.col("value") > 50).alias("active"))


@query("WITH " + EV_SQL + """, n AS (SELECT user_id, event_id, CAST(floor(sec / 86400) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev)
SELECT user_id, event_id, i + max(t - i) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ordinal FROM n""")
def q09_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greatest(clock, previous + 1) for each event of a run, as a running maximum of clock - row number."""
    n = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor(F.col("sec") / 86400).alias("t"), F.row_number().over(by_run()).cast("long").alias("i"))
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("user_id", "event_id", (F.col("i") + F.max(F.col("t") - F.col("i")).over(w)).alias("ordinal"))


@query("""WITH a AS (SELECT user_id, event_type, min(event_id) AS id FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, min(event_id) AS id FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)""")
def q10_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    there = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))
    new = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))
    return there.unionByName(new.join(there, ["user_id", "event_type"], "left_anti"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(round(value, 4), (ts, event_id)) AS payload FROM events GROUP BY ALL")
def q11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the last event by key: its id and its payload."""
    last = F.max_by(F.struct("event_id", F.round("value", 4).alias("payload")), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("last")).select("user_id", "event_type", "last.event_id", "last.payload")


@query("""WITH s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (event_id <= was) AS out_of_order FROM s GROUP BY user_id""")
def s14_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(by_run()).alias("was"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") <= F.col("was")).alias("out_of_order"))


@query("SELECT event_id, user_id, ts FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 25")
def s19_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "ts")


@query("""WITH r AS (SELECT user_id, event_type, event_id, rank() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC) AS k FROM events)
SELECT user_id, event_type, count(*) AS ties, min(event_id) AS first FROM r WHERE k = 1 GROUP BY ALL""")
def w02_latest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the latest day of each kind: ties stay."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc(F.date_trunc("day", "ts")))
    return table(spark, sf_dir, "events").withColumn("k", F.rank().over(w)).where("k = 1").groupBy("user_id", "event_type").agg(F.count("*").alias("ties"), F.min("event_id").alias("first"))


@query("""WITH b AS (SELECT user_id, event_type, ts, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS x, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM events),
c AS (SELECT *, sum(CASE WHEN event_type <> last THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM b)
SELECT user_id, any_value(last) AS last_type, count(*) FILTER (breaks = 0) AS streak FROM c GROUP BY user_id""")
def w05_suffix_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events at a run's end are alike."""
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    b = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.first("event_type").over(back).alias("last"))
    c = b.withColumn("breaks", F.sum(F.when(F.col("event_type") != F.col("last"), 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("user_id").agg(F.first("last").alias("last_type"), F.count_if(F.col("breaks") == 0).alias("streak"))


@query("""WITH m AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
SELECT user_id, count(*) FILTER (best IS NULL OR value > best) AS progress, count(*) AS n FROM m GROUP BY user_id""")
def w06_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("user_id", "value", F.max("value").over(by_run().rowsBetween(Window.unboundedPreceding, -1)).alias("best"))
    return m.groupBy("user_id").agg(F.count_if(F.col("best").isNull() | (F.col("value") > F.col("best"))).alias("progress"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, event_type, count(*) FILTER (was IS NULL OR was <> event_type) AS entries FROM l GROUP BY ALL""")
def w07_stage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type").over(by_run()).alias("was"))
    return moved.groupBy("user_id", "event_type").agg(F.count_if(F.col("was").isNull() | (F.col("was") != F.col("event_type"))).alias("entries"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, CASE WHEN value > 60 THEN event_type END AS mark FROM events)
SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope FROM g""")
def w09_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last mark holds until an event that breaks the island."""
    g = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.sum(F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).over(until_now()).alias("island"), F.when(F.col("value") > 60, F.col("event_type")).alias("mark"))
    w = Window.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("event_id", F.last("mark", ignorenulls=True).over(w).alias("scope"))


@query("""WITH c AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
SELECT user_id, count(*) FILTER (used <= 500) AS admitted, count(*) FILTER (used > 500) AS denied, round(max(CASE WHEN used <= 500 THEN used END), 4) AS committed FROM c GROUP BY user_id""")
def w04_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running budget that stops at the first event beyond it (values are never negative)."""
    c = table(spark, sf_dir, "events").select("user_id", F.sum("value").over(until_now()).alias("used"))
    return c.groupBy("user_id").agg(F.count_if(F.col("used") <= 500).alias("admitted"), F.count_if(F.col("used") > 500).alias("denied"), F.round(F.max(F.when(F.col("used") <= 500, F.col("used"))), 4).alias("committed"))


@query("""SELECT user_id, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens, count(*) = count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS complete FROM events GROUP BY user_id""")
def u24_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported usage alone is summed; complete if all reported it."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("tokens"), (F.count("*") == F.count(k)).alias("complete"))
