"""Metrics over cases: an order is a case, its lines are ranked hits, suppliers the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.operators import evaluation as e
from lexarium.sources.tables import dealt, table

HITS_SQL = """raw AS (SELECT l_orderkey AS case_id, l_suppkey AS doc, l_discount AS score, l_returnflag AS flag, l_linestatus AS version, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, doc ORDER BY rank) AS d FROM raw WHERE score > 0) WHERE d = 1),
hits AS (SELECT case_id, doc, version, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rank FROM pos),
req AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS doc FROM lineitem WHERE l_returnflag = 'R'),
need AS (SELECT case_id, count(*) AS required FROM req GROUP BY ALL),
fnd AS (SELECT case_id, count(*) AS found, sum(1.0 / rank) AS rr_sum, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM hits JOIN req USING (case_id, doc) WHERE rank <= 3 GROUP BY ALL),
pc AS (SELECT case_id, required, coalesce(found, 0) AS found, coalesce(found, 0) = required AS complete, coalesce(rr_sum, 0) / required AS rr_all, coalesce(1.0 / first, 0) AS rr_first,
       coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(required, 3)), lambda r: 1 / log2(r + 1.0))) AS ndcg FROM need LEFT JOIN fnd USING (case_id))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    raw = line.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("doc"), F.col("l_discount").alias("score"), F.col("l_linestatus").alias("version"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("rank"),
    )
    return e.positive_hits(raw, "case_id", "doc")


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("doc")).distinct()


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.per_case(_hits(spark, sf_dir), _required(spark, sf_dir), "case_id", "doc", 3)


@query("WITH " + HITS_SQL + " SELECT case_id, required, found, complete, round(rr_all, 6) AS rr_all, round(rr_first, 6) AS rr_first, round(ndcg, 6) AS ndcg FROM pc")
def a06_case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("case_id", "required", "found", "complete", *[F.round(c, 6).alias(c) for c in ("rr_all", "rr_first", "ndcg")])


@query("WITH " + HITS_SQL + """ SELECT o_orderpriority AS category, GROUPING(o_orderpriority) AS is_total, count(*) AS cases, round(sum(found) / sum(required), 6) AS recall, round(avg(CASE WHEN complete THEN 1.0 ELSE 0.0 END), 6) AS complete_rate,
round(avg(rr_first), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM pc JOIN orders ON o_orderkey = case_id GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def a07_metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"))
    return e.overall_and_by(
        _cases(spark, sf_dir).join(kinds, "case_id"), "category", F.count("*").alias("cases"), F.round(F.sum("found") / F.sum("required"), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("complete"), 1.0).otherwise(0.0)), 6).alias("complete_rate"), F.round(F.avg("rr_first"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"),
    )


@query("WITH " + HITS_SQL + """ SELECT k, count(DISTINCT case_id) AS cases, count(*) FILTER (version = 'O' AND rank <= k) AS wrong_hits, count(DISTINCT CASE WHEN version = 'O' AND rank <= k THEN case_id END) AS wrong_cases
FROM hits, (VALUES (1), (3), (5)) v(k) GROUP BY k""")
def a08_wrong_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the wrong version counted per hit and per case, at several depths."""
    rows = _hits(spark, sf_dir).select("case_id", "version", "rank", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("k"))
    bad = (F.col("version") == "O") & (F.col("rank") <= F.col("k"))
    by_case = rows.groupBy("k", "case_id").agg(F.count_if(bad).alias("wrong"))
    return by_case.groupBy("k").agg(F.count("*").alias("cases"), F.sum("wrong").alias("wrong_hits"), F.count_if(F.col("wrong") > 0).alias("wrong_cases"))


@query("""WITH h AS (SELECT l_orderkey AS case_id, l_discount AS score, l_suppkey AS doc, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM lineitem),
c AS (SELECT case_id, doc, count(*) AS n FROM h GROUP BY ALL),
d AS (SELECT case_id, max(n) AS top FROM c GROUP BY ALL),
p AS (SELECT case_id, count(*) FILTER (nxt - page = 1) AS adjacent FROM (SELECT *, lead(page) OVER (PARTITION BY case_id, doc ORDER BY page) AS nxt FROM h) GROUP BY ALL),
s AS (SELECT case_id, count(*) AS n, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2, avg(score) FILTER (rank <= 3) AS top3_mean, count(DISTINCT doc) AS docs FROM h GROUP BY ALL)
SELECT case_id, n, top1, round(top1 - top2, 6) AS margin, round(top3_mean, 6) AS top3_mean, docs, round(top / n, 6) AS dominant_ratio, adjacent FROM s JOIN d USING (case_id) JOIN p USING (case_id)""")
def a04_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    h = line.select(F.col("l_orderkey").alias("case_id"), F.col("l_discount").alias("score"), F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"))
    # one shuffle by case serves both sorts, and one sort all that is told of a document
    ranked = Window.partitionBy("case_id").orderBy(F.desc("score"), "page")
    pages = Window.partitionBy("case_id", "doc").orderBy("page")
    h = dealt(h, "case_id").select(
        "*", F.row_number().over(pages).alias("nth"), F.lead("page").over(pages).alias("nxt"), F.count("*").over(pages.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("same"),
    ).withColumn("rank", F.row_number().over(ranked))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return h.groupBy("case_id").agg(
        F.count("*").alias("n"), at(1).alias("top1"), F.round(at(1) - at(2), 6).alias("margin"), F.round(F.avg(F.when(F.col("rank") <= 3, F.col("score"))), 6).alias("top3_mean"),
        F.count_if((F.col("nth") == 1) & F.col("doc").isNotNull()).alias("docs"), F.round(F.max("same") / F.count("*"), 6).alias("dominant_ratio"), F.count_if(F.col("nxt") - F.col("page") == 1).alias("adjacent"),
    )


@query("""WITH h AS (SELECT l_orderkey AS case_id, l_discount * 10 AS score, l_suppkey AS doc, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM lineitem),
c AS (SELECT case_id, doc, count(*) AS n FROM h GROUP BY ALL), d AS (SELECT case_id, max(n) AS top FROM c GROUP BY ALL),
p AS (SELECT case_id, count(*) FILTER (nxt - page = 1) AS adjacent FROM (SELECT *, lead(page) OVER (PARTITION BY case_id, doc ORDER BY page) AS nxt FROM h) GROUP BY ALL),
s AS (SELECT case_id, count(*) AS n, max(score) FILTER (rank = 1) AS top1, avg(score) FILTER (rank <= 3) AS m3 FROM h GROUP BY ALL)
SELECT case_id, CASE WHEN o_orderstatus = 'P' THEN 'REJECT' WHEN o_orderpriority = '1-URGENT' THEN 'UNCERTAIN' WHEN round(top1, 6) >= 0.75 AND round(m3, 6) >= 0.70 AND (top / n >= 0.60 OR adjacent > 0) THEN 'ANSWER' ELSE 'UNCERTAIN' END AS decision,
 CASE WHEN o_orderstatus = 'P' THEN 'INVALID_STATE' WHEN o_orderpriority = '1-URGENT' THEN 'VERSION_AMBIGUITY' WHEN round(top1, 6) >= 0.75 AND round(m3, 6) >= 0.70 AND (top / n >= 0.60 OR adjacent > 0) THEN NULL WHEN round(top1, 6) < 0.50 THEN 'WEAK_RETRIEVAL_SIGNAL' ELSE 'AMBIGUOUS_RETRIEVAL_SIGNAL' END AS reason
FROM s JOIN d USING (case_id) JOIN p USING (case_id) JOIN orders ON o_orderkey = case_id""")
def d01_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection before uncertainty before scores; thresholds .75 (best), .70 (mean of three), .50 (weak), .60 (concentration)."""
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", "o_orderpriority")
    s = _signals(spark, sf_dir).join(state, "case_id")
    top1, mean = F.round(F.col("top1") * 10, 6), F.round(F.col("top3_mean") * 10, 5)
    strong = (top1 >= 0.75) & (mean >= 0.70) & ((F.col("dominant_ratio") >= 0.60) | (F.col("adjacent") > 0))
    invalid, ambiguous = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"
    return s.select(
        "case_id", F.when(invalid, "REJECT").when(ambiguous, "UNCERTAIN").when(strong, "ANSWER").otherwise("UNCERTAIN").alias("decision"),
        F.when(invalid, "INVALID_STATE").when(ambiguous, "VERSION_AMBIGUITY").when(strong, None).when(top1 < 0.50, "WEAK_RETRIEVAL_SIGNAL").otherwise("AMBIGUOUS_RETRIEVAL_SIGNAL").alias("reason"),
    )


@query("""SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90, round(quantile_cont(value, 0.95), 5) AS p95, min(value) AS low, max(value) AS high, round(stddev_pop(value), 5) AS std FROM events GROUP BY event_type""")
def a20_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.stddev_pop("value"), 5).alias("std"),
    )


@query("""SELECT user_id, round(quantile_cont(value, 0.95), 6) AS linear, quantile_disc(value, 0.95) AS nearest FROM events GROUP BY user_id""")
def a21_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles, which differ on small groups."""
    exact = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("linear"), exact.alias("nearest"))


@query("""WITH a AS (SELECT l_orderkey AS case_id, l_partkey % 20 AS src, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), b AS (SELECT l_orderkey AS case_id, l_partkey % 20 AS src, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
m AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.n, 0) AS cited, coalesce(b.n, 0) AS wanted FROM a FULL JOIN b ON a.case_id = b.case_id AND a.src = b.src)
SELECT case_id, sum(least(cited, wanted)) AS matched, sum(cited) AS cited, sum(wanted) AS wanted, CASE WHEN sum(cited) > 0 THEN round(sum(least(cited, wanted)) / sum(cited), 6) END AS precision_, CASE WHEN sum(wanted) > 0 THEN round(sum(least(cited, wanted)) / sum(wanted), 6) END AS recall FROM m GROUP BY case_id""")
def a14_multiset_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited against wanted sources as multisets, by one grouping of both sides."""
    line = table(spark, sf_dir, "lineitem")
    counts = line.groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 20).alias("src")).agg(F.count_if(F.col("l_linenumber") % 2 == 1).alias("cited"), F.count_if(F.col("l_linenumber") <= 3).alias("wanted"))
    both = F.sum(F.least("cited", "wanted"))
    rows = counts.where("cited > 0 or wanted > 0").groupBy("case_id").agg(both.alias("matched"), F.sum("cited").alias("cited"), F.sum("wanted").alias("wanted"))
    return rows.select("case_id", "matched", "cited", "wanted", F.round(F.try_divide("matched", "cited"), 6).alias("precision_"), F.round(F.try_divide("matched", "wanted"), 6).alias("recall"))


@query("WITH " + HITS_SQL + """, base AS (SELECT case_id, rr_first AS x FROM pc), cand AS (SELECT case_id, CASE WHEN case_id % 31 = 0 THEN rr_first / 2 WHEN case_id % 5 = 0 THEN least(1, rr_first + 0.25) ELSE rr_first END AS x FROM pc),
j AS (SELECT b.x AS b, c.x AS c FROM base b JOIN cand c USING (case_id))
SELECT count(*) AS cases, count(*) FILTER (c < b) AS regressed, round(avg(c) - avg(b), 6) AS gain, CASE WHEN count(*) FILTER (c < b) > 0 AND avg(c) <= avg(b) THEN 'CASE_REGRESSION,NO_GAIN' WHEN count(*) FILTER (c < b) > 0 THEN 'CASE_REGRESSION' WHEN avg(c) <= avg(b) THEN 'NO_GAIN' ELSE '' END AS reasons FROM j""")
def a18_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate paired with its baseline by case: no case may get worse, and the mean must rise."""
    i, x = F.col("case_id"), F.col("rr_first")
    paired = _cases(spark, sf_dir).select(x.alias("b"), F.when(i % 31 == 0, x / 2).when(i % 5 == 0, F.least(F.lit(1.0), x + 0.25)).otherwise(x).alias("c"))
    s = paired.agg(F.count("*").alias("cases"), F.count_if(F.col("c") < F.col("b")).alias("regressed"), (F.avg("c") - F.avg("b")).alias("gain"))
    reasons = F.array_join(F.filter(F.array(F.when(F.col("regressed") > 0, "CASE_REGRESSION"), F.when(F.col("gain") <= 0, "NO_GAIN")), lambda r: r.isNotNull()), ",")
    return s.select("cases", "regressed", F.round("gain", 6).alias("gain"), reasons.alias("reasons"))


@query("""SELECT case_id, CASE WHEN u IS NULL THEN 'NOT_REVIEWED' WHEN q = 1 AND u = 0 THEN 'SUPPORTED' WHEN q = 0 AND u = 1 THEN 'REJECTED' ELSE 'PARTIAL' END AS status, lang FROM (SELECT d.doc_id AS case_id, d.lang, max(quality) AS q, max(toxic) AS u FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)""")
def a25_requirement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status per document from its reviews, any of which may count."""
    reviews = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("u"))
    status = F.when(F.col("u").isNull(), "NOT_REVIEWED").when((F.col("q") == 1) & (F.col("u") == 0), "SUPPORTED").when((F.col("q") == 0) & (F.col("u") == 1), "REJECTED").otherwise("PARTIAL")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(reviews, "doc_id", "left").select(F.col("doc_id").alias("case_id"), status.alias("status"), "lang")


@query("""WITH s AS (SELECT DISTINCT o_orderkey % 50 AS risk, o_orderstatus AS st FROM orders) SELECT risk, count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders) AS complete, string_agg(st, ',' ORDER BY st) AS statuses FROM s GROUP BY risk""")
def a24_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups have every status there is (relational division)."""
    orders = table(spark, sf_dir, "orders")
    every = orders.agg(F.collect_set("o_orderstatus").alias("every"))
    own = orders.groupBy((F.col("o_orderkey") % 50).alias("risk")).agg(F.collect_set("o_orderstatus").alias("own"))
    return own.join(F.broadcast(every)).select("risk", (F.size(F.array_except("every", "own")) == 0).alias("complete"), F.array_join(F.array_sort("own"), ",").alias("statuses"))
