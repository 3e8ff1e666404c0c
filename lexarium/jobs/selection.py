"""Stateful selectors over the given tables."""

from __future__ import annotations

from itertools import chain, tee

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.text import latin_terms
from lexarium.jobs.registry import query
from lexarium.operators import selection as s
from lexarium.operators.segments import stalled
from lexarium.sources.tables import chunks, table


@query()
def x09_image_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's even lines are its hits, odd ones images; suppliers are sources; five places."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("long").alias("id"), (F.col("l_suppkey") % 4).alias("source")).alias("hit"))
    cases = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("hit")).alias("all"))
    kept = s.with_images(F.filter("all", lambda h: h["id"] % 2 == 0), F.filter("all", lambda h: h["id"] % 2 == 1), 5)
    return cases.select("l_orderkey", F.posexplode(kept).alias("at", "hit")).select("l_orderkey", (F.col("at") + 1).cast("long").alias("place"), F.col("hit.id").alias("line"), "hit.source")


@query()
def x11_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders, by priority as the check that returned them; four places."""

    def work(rows):
        first = next(rows)
        hits = ((r.o_orderpriority, r.o_orderkey, r.o_orderstatus) for r in chain([first], rows))
        return [(first.o_custkey, place, key) for place, (key, _) in enumerate(s.round_robin_of(hits, 4), 1)]

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (-F.col("o_totalprice")).alias("less"), "o_orderstatus")
    return s.per_case(rows, "o_custkey", ["o_orderpriority", "less", "o_orderkey"], work, "o_custkey long, place long, o_orderkey long")


@query()
def x17_context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line of a document is a hit; a budget of 120 terms."""
    rows = chunks(table(spark, sf_dir, "documents")).select("doc_id", "n", F.size(latin_terms(F.lower("content"))).alias("cost"))
    cases = s.around_hits(rows, "doc_id", "n", "cost", F.col("n") % 4 == 2)
    taken = cases.select("doc_id", F.posexplode(s.within_budget(F.col("wanted"), 120)).alias("at", "x"))
    return taken.select("doc_id", (F.col("at") + 1).cast("long").alias("place"), F.col("x.place").alias("n"), "x.role")


@query()
def s11_snapshot_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host by url, up to 12 and 60 kB: a page that is too large is passed over. The caps are the operator's."""

    def work(rows):
        first = next(rows)
        return [(first.host, page) for page in s.greedy_cap(((r.page_id, r.size) for r in chain([first], rows)), 12, 60_000)]

    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "url", "page_id", F.length("html").alias("size")).where("size <= 60000")
    return s.per_case(rows, "host", ["url", "page_id"], work, "host string, page_id long")


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS i, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, max(CASE WHEN best IS NULL OR value > best THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM o)
SELECT user_id, event_id FROM p WHERE i - coalesce(last, 0) = 10""")
def w08_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without progress for ten events, told once until the next progress; runs are cut by day, what days carry over is a few numbers."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return stalled(events, "user_id", ["ts", "event_id"], F.col("value"), F.date_trunc("day", "ts"), 10).select("user_id", "event_id")


@query()
def w12_budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a run against limits of two dimensions; what is denied uses nothing."""

    def work(rows):
        rows, asked = tee(rows)
        denied = s.reserving(({"calls": 1, "value": r.value} for r in asked), {"calls": 30, "value": 900.0})
        return ((r.user_id, r.event_id, d) for r, d in zip(rows, denied))

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return s.per_case(events, "user_id", ["ts", "event_id"], work, "user_id long, event_id long, denied_by string")
