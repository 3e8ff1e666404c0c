"""Smaller rules and checks: scope helpers, job transitions, windows, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.chunking import cut
from lexarium.jobs.evaluation import HITS_SQL, _cases, _hits, _required
from lexarium.jobs.lifecycle import VERSIONS_SQL, _versions
from lexarium.jobs.registry import query
from lexarium.sources.tables import CHUNKS_SQL, chunks, table


@query("WITH " + VERSIONS_SQL + ", " + CHUNKS_SQL + " SELECT chunk_id, coalesce(version_id, 'unknown') AS version_id, coalesce(status, 'UNKNOWN') AS status FROM chunks LEFT JOIN (SELECT * FROM versions WHERE status = 'ACTIVE' AND document_id % 12 <> 5) v ON document_id = doc_id")
def f02_enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog columns on every chunk, with a default where the catalog has none."""
    v = _versions(spark, sf_dir).where("status = 'ACTIVE' and document_id % 12 <> 5").select(F.col("document_id").alias("doc_id"), "version_id", "status")
    return chunks(table(spark, sf_dir, "documents")).select("chunk_id", "doc_id").join(v, "doc_id", "left").select("chunk_id", F.coalesce("version_id", F.lit("unknown")).alias("version_id"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


@query("WITH " + VERSIONS_SQL + """, w AS (SELECT unnest(['current', 'all', 'v1']) AS wanted)
SELECT wanted, count(*) AS n FROM versions, w WHERE wanted = 'all' OR (wanted = 'current' AND status = 'ACTIVE') OR version_id LIKE '%:' || wanted GROUP BY wanted""")
def f03_version_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.explode(F.array(*map(F.lit, ("current", "all", "v1")))).alias("wanted")
    rows = _versions(spark, sf_dir).select("version_id", "status", wanted)
    w = F.col("wanted")
    return rows.where((w == "all") | ((w == "current") & (F.col("status") == "ACTIVE")) | F.endswith("version_id", F.concat(F.lit(":"), w))).groupBy("wanted").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id // 2 AS fig FROM pages)
SELECT host, fig, arg_max(page_id, (lang = 'de', page_id)) AS page_id FROM f GROUP BY host, fig""")
def f05_preferred_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per figure of a host: the last one in the preferred language, else the last."""
    f = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.floor(F.col("page_id") / 2).alias("fig"))
    return f.groupBy("host", "fig").agg(F.max_by("page_id", F.struct(F.col("lang") == "de", "page_id")).alias("page_id"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#33') AND p_size IN (1, 5, 9, 13, 20) ")
def f07_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#33") & F.col("p_size").isin(1, 5, 9, 13, 20)).select("p_partkey")


@query("""SELECT CASE WHEN contains(url, 'test') THEN 'TEST' WHEN regexp_matches(url, '[.](html|php)$') THEN 'ENTRY' WHEN contains(url, '?') THEN 'QUERY' WHEN url LIKE 'https://m.%' THEN 'MOBILE' ELSE 'OTHER' END AS role, count(*) AS n FROM pages GROUP BY ALL""")
def f11_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    role = F.when(u.contains("test"), "TEST").when(u.rlike("[.](html|php)$"), "ENTRY").when(u.contains("?"), "QUERY").when(u.like("https://m.%"), "MOBILE").otherwise("OTHER")
    return table(spark, sf_dir, "pages").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, bool_and(split_part(CAST(l_suppkey AS VARCHAR), '0', 1) <> CAST(l_orderkey % 10 AS VARCHAR)) AS conflict, count(*) FILTER (l_suppkey % 10 = l_orderkey % 10) AS applies FROM lineitem GROUP BY l_orderkey""")
def f21_scope_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim conflicts if every cited row belongs to another family."""
    family = F.split_part(F.col("l_suppkey").cast("string"), F.lit("0"), F.lit(1))
    own = F.col("l_orderkey") % 10
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(family != own.cast("string")).alias("conflict"), F.count_if(F.col("l_suppkey") % 10 == own).alias("applies"))


@query("""WITH s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
a AS (SELECT DISTINCT event_type AS was, event_type AS now FROM events UNION SELECT min(event_type), max(event_type) FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (s.was IS NOT NULL AND a.was IS NULL) AS refused FROM s LEFT JOIN a ON a.was = s.was AND a.now = s.event_type GROUP BY user_id""")
def q05_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions against the table of allowed ones."""
    e = table(spark, sf_dir, "events")
    s = e.select("user_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("was"), F.col("event_type").alias("now"))
    ends = e.agg(F.min("event_type").alias("was"), F.max("event_type").alias("now"))
    allowed = e.select(F.col("event_type").alias("was"), F.col("event_type").alias("now")).distinct().union(ends).distinct().withColumn("ok", F.lit(True))
    return s.join(F.broadcast(allowed), ["was", "now"], "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("was").isNotNull() & F.col("ok").isNull()).alias("refused"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS final_event, count(*) FILTER (value > 90) > 0 AS failed FROM events GROUP BY user_id")
def q04_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("final_event"), (F.count_if(F.col("value") > 90) > 0).alias("failed"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = (SELECT max(event_type) FROM events)")
def q08_audit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.broadcast(e.agg(F.max("event_type").alias("event_type")))
    return e.join(kind, "event_type").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("position"))


@query("WITH " + CHUNKS_SQL + " SELECT doc_id, n, lag(n) OVER w AS before, lead(n) OVER w AS after, first_value(n) OVER (PARTITION BY doc_id ORDER BY n) AS anchor FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY n)")
def w03_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n")
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"), F.first("n").over(w).alias("anchor"))


@query("WITH " + HITS_SQL + " SELECT case_id, round(sum(CASE WHEN req.doc IS NOT NULL THEN 1 / log2(rank + 1.0) ELSE 0 END), 6) AS dcg FROM hits LEFT JOIN req USING (case_id, doc) GROUP BY case_id")
def w11_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted gains of ranked hits."""
    good = _required(spark, sf_dir).withColumn("rel", F.lit(1.0))
    rows = _hits(spark, sf_dir).join(good, ["case_id", "doc"], "left")
    return rows.groupBy("case_id").agg(F.round(F.sum(F.coalesce("rel", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)), 6).alias("dcg"))


@query("WITH " + HITS_SQL + " SELECT count(*) AS cases, round(avg(CASE WHEN rr_first = 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0 END), 6) AS hit3, round(avg(rr_first), 6) AS mrr, round(quantile_cont(ndcg, 0.5), 6) AS ndcg_p50, round(quantile_cont(ndcg, 0.95), 6) AS ndcg_p95 FROM pc")
def a09_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("ndcg", F.lit(q)), 6)
    return _cases(spark, sf_dir).agg(
        F.count("*").alias("cases"), F.round(F.avg(F.when(F.col("rr_first") == 1, 1.0).otherwise(0.0)), 6).alias("hit1"), F.round(F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)), 6).alias("hit3"),
        F.round(F.avg("rr_first"), 6).alias("mrr"), p(0.5).alias("ndcg_p50"), p(0.95).alias("ndcg_p95"),
    )


@query("WITH " + HITS_SQL + " SELECT CASE WHEN sum(found) / sum(required) >= 0.5 AND avg(rr_first) >= 0.3 THEN 'ALLOWED' WHEN sum(found) / sum(required) >= 0.5 THEN 'LOW_RANK' ELSE 'LOW_RECALL' END AS verdict FROM pc")
def a19_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _cases(spark, sf_dir).agg((F.sum("found") / F.sum("required")).alias("recall"), F.avg("rr_first").alias("mrr"))
    return s.select(F.when((F.col("recall") >= 0.5) & (F.col("mrr") >= 0.3), "ALLOWED").when(F.col("recall") >= 0.5, "LOW_RANK").otherwise("LOW_RECALL").alias("verdict"))


@query("""SELECT l_orderkey, bool_and(l_returnflag <> 'R') AND count(*) >= 2 AS retired, count(*) AS refs FROM lineitem GROUP BY l_orderkey""")
def a26_retired_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap is retired only if all its references are supported."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.bool_and(F.col("l_returnflag") != "R") & (F.count("*") >= 2)).alias("retired"), F.count("*").alias("refs"))


@query("""WITH c AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0)) AS first, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 1)) AS second FROM orders GROUP BY ALL)
SELECT o_custkey, CASE WHEN len(list_filter(coalesce(first, []), lambda x: NOT list_contains(coalesce(second, []), x))) = 0 AND len(coalesce(second, [])) > len(coalesce(first, [])) THEN 'second' ELSE 'first' END AS chosen FROM c""")
def x20_choose_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second answer is taken only if it covers all of the first and more."""
    kinds = lambda odd: F.collect_set(F.when(F.col("o_orderkey") % 2 == odd, F.col("o_orderpriority")))
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(kinds(0).alias("first"), kinds(1).alias("second"))
    better = (F.size(F.array_except("first", "second")) == 0) & (F.size("second") > F.size("first"))
    return c.select("o_custkey", F.when(better, "second").otherwise("first").alias("chosen"))


@query("""SELECT 'label without document' AS rule, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def u13_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that must exist, counted where they don't."""
    t = lambda name: table(spark, sf_dir, name)

    def lost(rows, key, known, other, rule):
        return rows.join(known.select(F.col(other).alias(key)), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    return (
        lost(t("labels"), "doc_id", t("documents"), "doc_id", "label without document")
        .union(lost(t("orders"), "o_custkey", t("customer"), "c_custkey", "order without customer")).union(lost(t("lineitem"), "l_partkey", t("part"), "p_partkey", "line without part"))
    )


@query("""WITH s AS (SELECT o_custkey, count(*) AS sections, count(DISTINCT o_orderpriority) AS fields, bool_and(o_orderstatus <> 'P') AS approved FROM orders GROUP BY ALL)
SELECT o_custkey, CASE WHEN fields < 3 THEN 'FIELDS_DIFFER' WHEN sections < 5 THEN 'SECTIONS_DIFFER' WHEN NOT approved THEN 'NOT_APPROVED' ELSE 'OK' END AS code FROM s""")
def u15_draft_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of each draft."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("sections"), F.countDistinct("o_orderpriority").alias("fields"), F.bool_and(F.col("o_orderstatus") != "P").alias("approved"))
    return s.select("o_custkey", F.when(F.col("fields") < 3, "FIELDS_DIFFER").when(F.col("sections") < 5, "SECTIONS_DIFFER").when(~F.col("approved"), "NOT_APPROVED").otherwise("OK").alias("code"))


@query("""SELECT conv_id, count(*) AS sections, count(*) FILTER (length(text) >= 200) AS completed, CASE WHEN bool_or(length(text) < 20) THEN 'REJECTED' WHEN bool_and(length(text) >= 200) THEN 'APPROVED' ELSE 'OPEN' END AS state FROM conversations GROUP BY conv_id""")
def u16_section_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("sections"), F.count_if(n >= 200).alias("completed"), F.when(F.bool_or(n < 20), "REJECTED").when(F.bool_and(n >= 200), "APPROVED").otherwise("OPEN").alias("state"))


@query("WITH " + VERSIONS_SQL + ", " + CHUNKS_SQL + " SELECT version_id, count(*) AS n, min(chunk_id) AS first FROM chunks JOIN versions ON document_id = doc_id AND status = 'ACTIVE' GROUP BY version_id")
def u37_active_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the active versions bring to the index."""
    v = _versions(spark, sf_dir).where("status = 'ACTIVE'").select(F.col("document_id").alias("doc_id"), "version_id")
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_id").join(v, "doc_id").groupBy("version_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


@query("""SELECT doc_id, doc_id || ':v1' AS version_id, 'ACTIVE' AS status, coalesce(nullif(trim(regexp_extract(text, '^[^\\n]*')), ''), source) AS title FROM documents""")
def u38_from_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from flat rows: one active version each, titles with a fallback."""
    first = F.trim(F.substring_index("text", "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":v1")).alias("version_id"), F.lit("ACTIVE").alias("status"), F.when(first != "", first).otherwise(F.col("source")).alias("title"))


@query("""WITH r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC) AS k, value FROM events)
SELECT user_id, count(*) FILTER (k = 1) AS latest, bool_and(value <= 95) FILTER (k = 1) AS passed FROM r GROUP BY user_id""")
def u43_record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run's records, all ties kept, decide."""
    k = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.date_trunc("day", "ts"))))
    latest = table(spark, sf_dir, "events").select("user_id", "value", k.alias("k")).where("k = 1")
    return latest.groupBy("user_id").agg(F.count("*").alias("latest"), F.bool_and(F.col("value") <= 95).alias("passed"))


@query("""SELECT source, CASE WHEN bool_or(n_chars < 15) THEN 'unknown' ELSE sha256(string_agg(sha256(coalesce(text, '')), ',' ORDER BY doc_id)) END AS identity FROM documents GROUP BY source""")
def u44_build_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over named parts that is unknown if one of them is missing (here: too short)."""
    part = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["h"]), ",")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(F.bool_or(F.col("n_chars") < 15), "unknown").otherwise(F.sha2(listed.cast("binary"), 256)).alias("identity"))


@query()
def t03_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in headed parts of at most 1,250 characters."""
    return cut(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "part", F.array_join("headings", " / ").alias("path"), "content")


@query("WITH " + CHUNKS_SQL + """, w AS (SELECT doc_id, n, lo, substr(content, CAST(lo AS BIGINT) + 1, 240) AS piece, content FROM (SELECT doc_id, n, content, unnest(generate_series(0, CAST(floor((length(content) - 1) / 200) AS BIGINT) * 200, 200)) AS lo FROM chunks))
SELECT doc_id, count(*) AS views, count(*) FILTER (substr(content, CAST(lo AS BIGINT) + 1, length(piece)) <> piece) AS broken, max(lo + length(piece)) AS reach FROM w GROUP BY doc_id""")
def t09_view_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window must be what its parent has at its place."""
    from lexarium.jobs.retrieval import t10_windows

    parents = chunks(table(spark, sf_dir, "documents")).select("doc_id", "n", "content")
    views = t10_windows(spark, sf_dir).join(parents, ["doc_id", "n"])
    same = F.substr("content", F.col("lo").cast("int") + 1, F.length("piece")) == F.col("piece")
    return views.groupBy("doc_id").agg(F.count("*").alias("views"), F.count_if(~same).alias("broken"), F.max(F.col("lo") + F.length("piece")).alias("reach"))
