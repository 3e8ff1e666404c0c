"""Support of answers by what they cite, freshness and versions of evidence, and orders with one row per place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.text import latin_terms
from lexarium.jobs.evidence import TERMS_SQL
from lexarium.jobs.registry import query
from lexarium.sources.tables import dealt, table

OPENINGS_SQL = f"o AS (SELECT conv_id, list_distinct({TERMS_SQL.format('text')}) AS asked FROM conversations WHERE turn = 0)"


def openings(conversations: DataFrame) -> DataFrame:
    """The distinct terms of each conversation's first turn: (conv_id, asked)."""
    return conversations.where("turn = 0").select("conv_id", F.array_distinct(latin_terms(F.lower("text"))).alias("asked"))


@query(f"""WITH {OPENINGS_SQL}, s AS (SELECT b.conv_id, b.turn, len(list_intersect(o.asked, {TERMS_SQL.format('b.text')})) AS shared FROM conversations b JOIN o ON o.conv_id = b.conv_id
 WHERE b.turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = b.conv_id AND a.turn < b.turn AND contains(a.text, b.text)))
SELECT conv_id, turn, shared FROM s WHERE shared >= 2""")
def x22_new_relevant_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that no earlier turn contains and that share two terms with the conversation's requirement, its first turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    shared = F.size(F.array_intersect("asked", latin_terms(F.lower("text"))))
    near = c.where("turn > 0").join(openings(c), "conv_id").select("conv_id", "turn", "text", shared.alias("shared")).where("shared >= 2")
    b, a = near.alias("b"), c.alias("a")
    seen = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")) & F.contains(F.col("a.text"), F.col("b.text"))
    return b.join(a, seen, "left_anti").select("conv_id", "turn", "shared")


@query(f"""WITH d AS (SELECT doc_id, lang, list_distinct({TERMS_SQL.format("split_part(coalesce(text, ''), chr(10), 1)")}) AS asked, {TERMS_SQL.format("substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 1)")} AS cited FROM documents),
m AS (SELECT doc_id, lang, len(list_intersect(asked, cited)) AS matched, len(asked) AS total FROM d),
t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT m.doc_id, matched, total, CASE WHEN total > 0 AND matched * 5 >= total * 4 AND lang IS NOT DISTINCT FROM 'en' AND coalesce(toxic, 0) = 0 THEN 'strong'
 WHEN total > 0 AND matched * 20 >= total * 9 AND coalesce(toxic, 0) = 0 THEN 'partial' ELSE 'limited' END AS level FROM m LEFT JOIN t ON t.doc_id = m.doc_id""")
def r18_answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well what is cited covers the terms of the question.

    A document's first line asks, the rest is cited; a language other than
    English is a caution (not strong), a toxic label a known difference
    (limited). A question without terms has limited support.
    """
    text = F.coalesce("text", F.lit(""))
    ask = F.split_part(text, F.lit("\n"), F.lit(1))
    asked, cited = F.array_distinct(latin_terms(F.lower(ask))), latin_terms(F.lower(F.substr(text, F.length(ask) + 1)))
    told = table(spark, sf_dir, "documents").select("doc_id", "lang", F.size(F.array_intersect(asked, cited)).alias("matched"), F.size(asked).alias("total"))
    differs = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    agreed = F.coalesce("toxic", F.lit(0)) == 0
    strong = F.expr("total > 0 and matched * 5 >= total * 4") & F.col("lang").eqNullSafe("en") & agreed
    partial = F.expr("total > 0 and matched * 20 >= total * 9") & agreed
    return told.join(differs, "doc_id", "left").select("doc_id", "matched", "total", F.when(strong, "strong").when(partial, "partial").otherwise("limited").alias("level"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host, CAST(regexp_extract(url, '/([0-9]{1,9})(?:[?#]|$)', 1) AS BIGINT) AS n FROM pages WHERE regexp_matches(url, '/[0-9]{1,9}(?:[?#]|$)')),
l AS (SELECT host, lead(n) OVER (PARTITION BY host ORDER BY n) - n AS gap FROM p)
SELECT host, count(*) AS pages, count(*) FILTER (gap = 1) AS pairs FROM l GROUP BY host""")
def a05_adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive distinct page numbers of each host; the number is the last part of the path."""
    numbered = table(spark, sf_dir, "pages").where(F.col("url").rlike("/[0-9]{1,9}(?:[?#]|$)"))
    once = numbered.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]{1,9})(?:[?#]|$)", 1).cast("long").alias("n")).distinct()
    # a successor is found by the pair itself, so a host's pages need not meet in one task
    after = once.select("host", (F.col("n") - 1).alias("n"), F.lit(1).alias("next"))
    return once.join(after, ["host", "n"], "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("next").alias("pairs"))


@query(f"""WITH {OPENINGS_SQL}, f AS (SELECT conv_id, list_filter(asked, lambda x: length(x) >= 6) AS facts FROM o),
h AS (SELECT f.conv_id, c.turn, unnest(list_intersect(f.facts, {TERMS_SQL.format('c.text')})) AS fact FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn > 0),
r AS (SELECT conv_id, fact, min(turn) AS best FROM h GROUP BY ALL), g AS (SELECT conv_id, count(*) AS matched, min(best) AS best FROM r GROUP BY ALL)
SELECT f.conv_id, len(facts) AS required, coalesce(matched, 0) AS matched, coalesce(matched, 0) / len(facts) AS fact_recall, coalesce(matched, 0) = len(facts) AS complete, coalesce(1 / best, 0) AS reciprocal_rank
FROM f LEFT JOIN g ON g.conv_id = f.conv_id WHERE len(facts) > 0""")
def a12_fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case the facts that some hit states, and the best rank of any of them.

    A conversation is a case: the longer terms (six characters or more) of its
    first turn are the facts, later turns the hits in order.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    facts = openings(c).select("conv_id", F.filter("asked", lambda x: F.length(x) >= 6).alias("facts")).where("size(facts) > 0")
    hits = c.where("turn > 0").join(facts, "conv_id").select("conv_id", "turn", F.explode(F.array_intersect("facts", latin_terms(F.lower("text")))).alias("fact"))
    found = hits.groupBy("conv_id", "fact").agg(F.min("turn").alias("best")).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("best").alias("best"))
    matched, required = F.coalesce("n", F.lit(0)), F.size("facts")
    return facts.join(found, "conv_id", "left").select(
        "conv_id", required.alias("required"), matched.alias("matched"), (matched / required).alias("fact_recall"), (matched == required).alias("complete"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"),
    )


@query("""SELECT coalesce(d.source, '') AS source, count(*) AS cases, avg(CASE WHEN (quality <= 1) = (toxic = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (n_chars <= 4000) AS within_budget, count(*) FILTER (lang NOT IN ('en', 'de')) AS out_of_scope
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL""")
def a15_evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: accuracy of a rule (low quality tells toxic), documents within a budget of characters, documents out of scope."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.coalesce("source", F.lit("")).alias("source"))
    right = F.when((F.col("quality") <= 1) == (F.col("toxic") == 1), 1.0).otherwise(0.0)
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.count("*").alias("cases"), F.avg(right).alias("accuracy"), F.count_if(F.col("n_chars") <= 4000).alias("within_budget"), F.count_if(~F.col("lang").isin("en", "de")).alias("out_of_scope"),
    )


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 10")
def w01_total_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 1 to 10 of each user's events by value, ties by id; each task cuts its own rows at ten before the shuffle."""
    line = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(line).alias("place")).where("place <= 10")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id) AS k FROM events) WHERE k = 1")
def w10_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type; a minimum that combines before the shuffle instead of a window."""
    first = F.min(F.struct("ts", "event_id", "value")).alias("f")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "f.event_id", "f.value")


@query("""WITH v AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT d.doc_id, v.doc_id IS NULL AS unversioned FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id WHERE v.doc_id IS NULL OR CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN quality = 0 THEN 'STALE' ELSE 'CURRENT' END NOT IN ('STALE', 'UNKNOWN')""")
def f09_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that is neither stale nor unknown, or has no version; a document's label is its version, quality 0 is stale."""
    versions = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("version")).agg(F.max("quality").alias("quality"))
    freshness = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("quality") == 0, "STALE").otherwise("CURRENT")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(versions, F.col("doc_id") == F.col("version"), "left")
    return rows.where(F.col("version").isNull() | ~freshness.isin("STALE", "UNKNOWN")).select("doc_id", F.col("version").isNull().alias("unversioned"))


@query(r"""WITH p AS (SELECT p_partkey, regexp_extract(p_brand, '(\d)\d$', 1) || '.' || regexp_extract(p_brand, '(\d)$', 1) AS version, CASE WHEN p_size % 3 = 0 THEN (p_size % 5 + 1) || '.x' END AS family FROM part),
w AS (SELECT unnest(['v1.2', '2.4', NULL]) AS wanted)
SELECT coalesce(wanted, 'any') AS wanted, count(*) AS parts, count(family) AS examples FROM p JOIN w ON CASE WHEN family IS NOT NULL THEN wanted IS NOT NULL AND version = ltrim(wanted, 'v') AND split_part(ltrim(wanted, 'v'), '.', 1) = split_part(family, '.', 1)
 ELSE wanted IS NULL OR version = ltrim(wanted, 'v') END GROUP BY ALL""")
def f20_version_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that apply to a wanted version: the same version, and for examples of a family also its major number.

    The two digits of a brand are the version, a size divisible by three makes an
    example. No wanted version admits whatever is no example. The three wanted
    versions are tested in one pass.
    """
    brand = F.col("p_brand")
    version = F.concat(F.regexp_extract(brand, r"(\d)\d$", 1), F.lit("."), F.regexp_extract(brand, r"(\d)$", 1))
    family = F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit(".x")))

    def applies(wanted: str | None):
        if wanted is None:
            return F.col("family").isNull()
        bare = wanted.lstrip("v")
        same = F.col("version") == bare
        return F.when(F.col("family").isNull(), same).otherwise(same & (F.split_part("family", F.lit("."), F.lit(1)) == bare.split(".")[0]))

    rows = table(spark, sf_dir, "part").select(version.alias("version"), family.alias("family"))
    wanted = F.array_compact(F.array(*[F.when(applies(w), w or "any") for w in ("v1.2", "2.4", None)]))
    return rows.select("family", F.explode(wanted).alias("wanted")).groupBy("wanted").agg(F.count("*").alias("parts"), F.count("family").alias("examples"))


@query("""WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), e AS (SELECT *, l_partkey % n + 1 AS given FROM l),
v AS (SELECT l_orderkey, count(DISTINCT given) = max(n) AS valid FROM e GROUP BY l_orderkey)
SELECT e.l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY e.l_orderkey ORDER BY CASE WHEN valid THEN given ELSE l_linenumber END, l_linenumber, l_partkey, l_suppkey) AS place, CASE WHEN valid THEN 'accepted' ELSE 'fallback' END AS status
FROM e JOIN v ON v.l_orderkey = e.l_orderkey""")
def u28_order_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order from outside counts only if it names each candidate once; else the candidates' own order stands.

    Lines of an order are the candidates, part numbers modulo their count the
    order from outside. All windows share one partitioning.
    """
    own = Window.partitionBy("l_orderkey")
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").select("*", F.count("*").over(own).alias("n"))
    given = lines.withColumn("given", F.col("l_partkey") % F.col("n") + 1)
    # ranks lie in 1..n, so n distinct ones name each place once
    first = F.when(F.row_number().over(Window.partitionBy("l_orderkey", "given").orderBy("l_linenumber")) == 1, 1)
    valid = given.withColumn("new", first).withColumn("valid", F.count("new").over(own) == F.col("n"))
    line = own.orderBy(F.when(F.col("valid"), F.col("given")).otherwise(F.col("l_linenumber")), "l_linenumber", "l_partkey", "l_suppkey")
    return valid.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(line).alias("place"), F.when(F.col("valid"), "accepted").otherwise("fallback").alias("status"))
