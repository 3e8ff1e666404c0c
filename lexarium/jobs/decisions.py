"""Decision shells: validity, enforcement, integrity and contract checks as column logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.sources.tables import CHUNKS_SQL, chunks, table

AUDIT_SQL = """claims AS (SELECT l_orderkey AS answer, l_suppkey AS cited, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 4),
hits AS (SELECT DISTINCT l_orderkey AS answer, l_suppkey AS cited FROM lineitem WHERE l_returnflag <> 'R'),
audit AS (SELECT c.answer, count(*) AS claimed, count(h.cited) AS valid, o_orderstatus = 'P' AS malformed FROM claims c LEFT JOIN hits h ON h.answer = c.answer AND h.cited = c.cited JOIN orders ON o_orderkey = c.answer GROUP BY ALL)"""
AUDIT_STATE = "CASE WHEN malformed THEN 'MALFORMED' WHEN valid = 0 THEN 'NONE_VALID' WHEN valid < claimed THEN 'PARTLY_VALID' ELSE 'VALID' END"


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    claims = line.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("cited"))
    hits = line.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("cited")).distinct().withColumn("known", F.lit(True))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer"), (F.col("o_orderstatus") == "P").alias("malformed"))
    rows = claims.join(hits, ["answer", "cited"], "left").groupBy("answer").agg(F.count("*").alias("claimed"), F.count("known").alias("valid")).join(state, "answer")
    kind = F.when(F.col("malformed"), "MALFORMED").when(F.col("valid") == 0, "NONE_VALID").when(F.col("valid") < F.col("claimed"), "PARTLY_VALID").otherwise("VALID")
    return rows.withColumn("state", kind)


@query("WITH " + AUDIT_SQL + f" SELECT answer, claimed, valid, {AUDIT_STATE} AS state FROM audit")
def d02_citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each answer against what was retrieved."""
    return _audit(spark, sf_dir).select("answer", "claimed", "valid", "state")


@query("WITH " + AUDIT_SQL + f""", s AS (SELECT answer, {AUDIT_STATE} AS state FROM audit), m AS (SELECT unnest(['SHADOW', 'ENFORCE']) AS mode)
SELECT mode, CASE WHEN state = 'VALID' THEN 'PASS' WHEN state = 'NONE_VALID' THEN 'VALID_ABSTENTION' ELSE 'FAIL_CLOSED' END AS decision, mode = 'ENFORCE' AND state NOT IN ('VALID', 'NONE_VALID') AS mutated, count(*) AS n FROM s, m GROUP BY ALL""")
def d03_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two modes do with each state: only enforcement changes an answer."""
    s = _audit(spark, sf_dir).select("state", F.explode(F.array(F.lit("SHADOW"), F.lit("ENFORCE"))).alias("mode"))
    decision = F.when(F.col("state") == "VALID", "PASS").when(F.col("state") == "NONE_VALID", "VALID_ABSTENTION").otherwise("FAIL_CLOSED")
    mutated = (F.col("mode") == "ENFORCE") & ~F.col("state").isin("VALID", "NONE_VALID")
    return s.groupBy("mode", decision.alias("decision"), mutated.alias("mutated")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY ALL)
SELECT lang, count(*) FILTER (q = 1 AND t = 0) AS supported, count(*) FILTER (q = 0) AS unsupported, count(*) FILTER (q = 1 AND t = 1) AS conflicting, count(*) FILTER (q IS NULL) AS unjudged FROM documents LEFT JOIN v USING (doc_id) GROUP BY lang""")
def d04_claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims parted by an outside table of verdicts."""
    v = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    q, t = F.col("q"), F.col("t")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(v, "doc_id", "left").groupBy("lang").agg(
        F.count_if((q == 1) & (t == 0)).alias("supported"), F.count_if(q == 0).alias("unsupported"), F.count_if((q == 1) & (t == 1)).alias("conflicting"), F.count_if(q.isNull()).alias("unjudged"),
    )


@query("""SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'BLANK' WHEN p_size <= 0 THEN 'BAD_SIZE' WHEN p_retailprice > 1500 THEN 'TOO_DEAR' WHEN p_brand NOT LIKE 'Brand#%' THEN 'BAD_BRAND' ELSE 'PASS' END AS reason FROM part""")
def d06_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each patch, in a fixed order."""
    reason = F.when(F.col("p_name").isNull() | (F.trim("p_name") == ""), "BLANK").when(F.col("p_size") <= 0, "BAD_SIZE").when(F.col("p_retailprice") > 1500, "TOO_DEAR").when(~F.col("p_brand").like("Brand#%"), "BAD_BRAND").otherwise("PASS")
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'MISSING' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'NOT_A_NUMBER' ELSE 'VALID' END AS state FROM events""")
def d12_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared field parsed from JSON and classed."""
    k = F.get_json_object("props", "$.k")
    number = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "MISSING").when(number.isNull(), "NOT_A_NUMBER").otherwise("VALID").alias("state"))


@query("""SELECT page_id, regexp_replace(url, '^([a-z]+://)[^/?#]*(.*)$', '\\1host\\2') AS masked, sha256(url) AS fingerprint, regexp_matches(url, '[?&](ref|token|key)=') AS sensitive FROM pages""")
def d13_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts masked, the address kept as a hash alone, sensitive parameters flagged."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "^([a-z]+://)[^/?#]*(.*)$", "$1host$2").alias("masked"), F.sha2(F.col("url").cast("binary"), 256).alias("fingerprint"), F.rlike("url", F.lit("[?&](ref|token|key)=")).alias("sensitive"),
    )


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey, count(*) AS hits, count(s_suppkey) AS trusted FROM lineitem LEFT JOIN r ON s_suppkey = l_suppkey AND l_extendedprice > s_acctbal GROUP BY l_orderkey""")
def u01_official_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that equal a registered source under further conditions."""
    r = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    met = line.join(r, (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("l_extendedprice") > F.col("s_acctbal")), "left")
    return met.groupBy("l_orderkey").agg(F.count("*").alias("hits"), F.count("s_suppkey").alias("trusted"))


@query("""WITH g AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type, floor(value / 10) ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, count(*) FILTER (k = 1) AS gaps, count(*) FILTER (k > 1) AS dropped FROM g GROUP BY ALL""")
def u02_gap_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps once per check, language and query, the first of each."""
    w = Window.partitionBy("user_id", "event_type", F.floor(F.col("value") / 10)).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).groupBy("user_id", "event_type").agg(F.count_if(F.col("k") == 1).alias("gaps"), F.count_if(F.col("k") > 1).alias("dropped"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, coalesce(o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW', false) AS good FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7, good ORDER BY o_orderkey) AS k FROM g)
SELECT o_custkey, count(*) FILTER (good AND k = 1) AS kept, count(*) FILTER (NOT good) AS rejected, CASE WHEN count(*) FILTER (good AND k = 1) = 0 THEN 'ABSTAINED' WHEN count(*) FILTER (NOT good) > 0 THEN 'NO_SUMMARY' ELSE 'OK' END AS status FROM a GROUP BY o_custkey""")
def u05_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice rows kept, rejected (counted) or repeated (not counted; only a good row makes later ones repeats); any rejected row removes the summary."""
    good = F.coalesce((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") != "5-LOW"), F.lit(False))
    w = Window.partitionBy("o_custkey", F.col("o_orderkey") % 7, "good").orderBy("o_orderkey")
    a = table(spark, sf_dir, "orders").withColumn("good", good).select("o_custkey", F.row_number().over(w).alias("k"), "good")
    s = a.groupBy("o_custkey").agg(F.count_if(F.col("good") & (F.col("k") == 1)).alias("kept"), F.count_if(~F.col("good")).alias("rejected"))
    return s.select("*", F.when(F.col("kept") == 0, "ABSTAINED").when(F.col("rejected") > 0, "NO_SUMMARY").otherwise("OK").alias("status"))


@query("WITH " + CHUNKS_SQL + """, e AS (SELECT doc_id, doc_id % 30 AS lo, doc_id % 30 + 3 AS hi FROM documents), s AS (SELECT doc_id, floor(n / 10) AS part, min(n) AS lo, max(n) AS hi FROM chunks GROUP BY ALL)
SELECT e.doc_id, part FROM e JOIN s ON s.doc_id = e.doc_id AND s.lo <= e.lo AND e.hi <= s.hi""")
def u08_registered_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that lies wholly inside a registered chunk of its document."""
    docs = table(spark, sf_dir, "documents")
    s = chunks(docs).groupBy("doc_id", F.floor(F.col("n") / 10).cast("double").alias("part")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    e = docs.select("doc_id", (F.col("doc_id") % 30).alias("from"), (F.col("doc_id") % 30 + 3).alias("to"))
    return e.join(s, "doc_id").where((F.col("lo") <= F.col("from")) & (F.col("to") <= F.col("hi"))).select("doc_id", "part")


@query("""WITH t AS (SELECT n_nationkey AS sec, r AS field FROM nation, (VALUES ('scope'), ('risk'), ('test')) v(r)), used AS (SELECT c_nationkey AS sec, CASE c_nationkey % 3 WHEN 0 THEN 'scope' WHEN 1 THEN 'risk' ELSE 'test' END AS field FROM customer GROUP BY ALL)
SELECT sec, field FROM t WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.sec = t.sec AND used.field = t.field)""")
def u12_plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section by field, less what has been asked."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sec"), F.explode(F.array(*map(F.lit, ("scope", "risk", "test")))).alias("field"))
    field = F.when(F.col("c_nationkey") % 3 == 0, "scope").when(F.col("c_nationkey") % 3 == 1, "risk").otherwise("test")
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sec"), field.alias("field")).distinct()
    return t.join(used, ["sec", "field"], "left_anti")


@query("""SELECT o_custkey, count(*) AS sections, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'REVIEW_REQUIRED' WHEN bool_or(o_orderstatus = 'F') THEN 'APPLY_READY' ELSE 'FAILED' END AS task FROM orders GROUP BY o_custkey""")
def u19_task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("sections"), F.when(F.bool_or(s == "P"), "REVIEW_REQUIRED").when(F.bool_or(s == "F"), "APPLY_READY").otherwise("FAILED").alias("task"))


@query("""WITH u AS (SELECT user_id, event_type AS dim, sum(value) AS used FROM events GROUP BY ALL)
SELECT user_id, round(sum(greatest(0, 400 - used)), 4) AS remaining, coalesce(string_agg(dim, ',' ORDER BY dim) FILTER (used >= 400), '') AS exhausted FROM u GROUP BY user_id""")
def u21_budget_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains, and the exhausted dimensions by name.

    Sums of doubles depend on the order of rows in their last places; to nine places they don't, so a sum of exactly 400 is always exhausted.
    """
    u = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("dim")).agg(F.round(F.sum("value"), 9).alias("used"))
    gone = F.array_sort(F.collect_list(F.when(F.col("used") >= 400, F.col("dim"))))
    return u.groupBy("user_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), 400 - F.col("used"))), 4).alias("remaining"), F.array_join(gone, ",").alias("exhausted"))


@query("""WITH v AS (SELECT c_custkey, list_distinct(list(o_orderpriority)) AS asked FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, len(list_filter(asked, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) > 0 AS clarify FROM v""")
def u25_clarification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested versions that no selected one covers."""
    chosen = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("asked"))
    known = table(spark, sf_dir, "customer").select("c_custkey")
    return v.join(known, "c_custkey", "left_semi").select("c_custkey", (F.size(F.array_except("asked", chosen)) > 0).alias("clarify"))


@query("WITH " + CHUNKS_SQL + " SELECT doc_id, arg_min(content, n) AS heading, count(*) AS n_chunks, sum(length(content)) AS chars FROM chunks GROUP BY doc_id")
def u26_catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.min_by("content", "n").alias("heading"), F.count("*").alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("""WITH v AS (SELECT source, list(lang ORDER BY lang) AS ls FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source) SELECT source, array_to_string(list_concat(list_filter(ls, lambda l: l = 'fr'), list_filter(ls, lambda l: l <> 'fr')), ',') AS versions FROM v""")
def u27_available_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order, the current one first."""
    ls = F.array_sort(F.collect_set("lang"))
    v = table(spark, sf_dir, "documents").groupBy("source").agg(ls.alias("ls"))
    return v.select("source", F.array_join(F.concat(F.filter("ls", lambda x: x == "fr"), F.filter("ls", lambda x: x != "fr")), ",").alias("versions"))


@query("""SELECT l_orderkey, count(*) = count(DISTINCT l_partkey) AND count(*) FILTER (l_linestatus = 'O') = count(*) AS accepted FROM lineitem GROUP BY l_orderkey""")
def u29_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request stands only if its ids are unique and all in the target version."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count("*") == F.countDistinct("l_partkey")) & F.bool_and(F.col("l_linestatus") == "O")).alias("accepted"))


@query("""WITH r AS (SELECT * FROM (VALUES ('F', 'regression'), ('F', 'smoke'), ('O', 'smoke'), ('P', 'manual')) t(status, chk)) SELECT o_custkey, string_agg(DISTINCT chk, ',' ORDER BY chk) AS checks FROM orders JOIN r ON status = o_orderstatus GROUP BY o_custkey""")
def u32_regression_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings to required checks by a short fixed rule table."""
    checks = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("regression"), F.lit("smoke"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("smoke"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("manual")))
    return table(spark, sf_dir, "orders").where(checks.isNotNull()).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(checks)))), ",").alias("checks"))


@query("""WITH v AS (SELECT label, vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm, len(embedding) AS dim FROM embeddings)
SELECT label, count(*) AS n, min(dim) = max(dim) AS one_dimension, bool_and(abs(norm - 1) <= 1e-4) AS unit FROM v GROUP BY label""")
def u36_store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension and unit norms per store."""
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("label", F.sqrt(sq).alias("norm"), F.size("embedding").alias("dim"))
    return v.groupBy("label").agg(F.count("*").alias("n"), (F.min("dim") == F.max("dim")).alias("one_dimension"), F.bool_and(F.abs(F.col("norm") - 1) <= 1e-4).alias("unit"))


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS k, count(*) AS n, CASE WHEN o_orderkey % 100 = 0 THEN -1.0 ELSE sum(l_quantity) END AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT k, 'recomputed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, 'saved' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u42_saved_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved metrics against recomputed ones, both ways; nothing is left where they are equal."""
    line = table(spark, sf_dir, "lineitem")
    a = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = a.join(orders, "k").select("k", "n", F.when(F.col("k") % 100 == 0, -1.0).otherwise(F.col("q")).alias("q"))
    return a.exceptAll(b).select("k", F.lit("recomputed").alias("side")).union(b.exceptAll(a).select("k", F.lit("saved").alias("side")))


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS sev, o_orderstatus <> 'P' AS evaluated, o_totalprice > 150000 AS hit FROM orders)
SELECT sev, count(*) AS cases, count(*) FILTER (evaluated) AS evaluated, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS over_all, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (evaluated), 6) AS over_evaluated FROM c GROUP BY sev""")
def u49_two_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, hit = F.col("o_orderstatus") != "P", F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sev")).agg(
        F.count("*").alias("cases"), F.count_if(ok).alias("evaluated"), F.round(F.avg(hit), 6).alias("over_all"), F.round(F.avg(F.when(ok, hit)), 6).alias("over_evaluated"),
    )
