"""Versions, scopes and joins over sections that are derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.operators import lifecycle as v
from lexarium.operators.retrieval import small
from lexarium.sources.tables import CHUNKS_SQL, SECTIONS_SQL, chunks, sections, table

HASH_SQL = "sha256(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g')))"
DIFF_SQL = f"""diff AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.key, b.key) AS key,
 CASE WHEN a.key IS NULL THEN 'ADDED' WHEN b.key IS NULL THEN 'REMOVED' WHEN {HASH_SQL.format('a.content')} <> {HASH_SQL.format('b.content')} THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change
 FROM v1 a FULL JOIN v2 b ON a.doc_id = b.doc_id AND a.key = b.key)"""

#: Version rows from documents: v1 of all, v2 of those that v2 keeps, ACTIVE is the latest.
VERSIONS_SQL = """versions AS (SELECT doc_id AS document_id, doc_id || ':v1' AS version_id, 1 AS created_at, CASE WHEN doc_id % 10 = 0 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 2 END AS superseded_at FROM documents
 UNION ALL SELECT doc_id, doc_id || ':v2', 2, 'ACTIVE', NULL FROM documents WHERE doc_id % 10 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    gone = F.col("document_id") % 10 == 0
    first = docs.select("document_id", F.concat(F.col("document_id").cast("string"), F.lit(":v1")).alias("version_id"), F.lit(1).alias("created_at"), F.when(gone, "ACTIVE").otherwise("SUPERSEDED").alias("status"), F.when(~gone, 2).alias("superseded_at"))
    second = docs.where(~gone).select("document_id", F.concat(F.col("document_id").cast("string"), F.lit(":v2")).alias("version_id"), F.lit(2).alias("created_at"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("int").alias("superseded_at"))
    return first.union(second)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return v.compare(sections(docs, 1), sections(docs, 2), ["doc_id", "key"], "content")


@query("WITH " + SECTIONS_SQL + ", " + DIFF_SQL + " SELECT * FROM diff")
def j02_section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("doc_id", "key", "change")


@query("WITH " + SECTIONS_SQL + ", " + DIFF_SQL + " SELECT doc_id, count(*) FILTER (change = 'ADDED') AS added, count(*) FILTER (change = 'REMOVED') AS removed, count(*) FILTER (change = 'MODIFIED') AS modified, count(*) FILTER (change = 'UNCHANGED') AS unchanged FROM diff GROUP BY doc_id")
def u39_version_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.change_counts(_diff(spark, sf_dir), "doc_id")


@query("WITH " + SECTIONS_SQL + f""", o AS (SELECT DISTINCT {HASH_SQL.format('content')} AS h FROM v1), n AS (SELECT {HASH_SQL.format('content')} AS h, doc_id || '/' || key AS place FROM v2)
SELECT h AS content_hash, min(place) AS place, count(*) AS uses FROM n WHERE h NOT IN (SELECT h FROM o) GROUP BY h""")
def j11_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cached = sections(docs, 1).select(v.content_hash(F.col("content")).alias("content_hash"))
    wanted = sections(docs, 2).withColumn("place", F.concat_ws("/", F.col("doc_id").cast("string"), "key"))
    return v.missing_embeddings(wanted, cached, "content", "place").select("content_hash", "place", "uses")


@query("WITH " + SECTIONS_SQL + f""", o AS (SELECT DISTINCT {HASH_SQL.format('content')} AS h FROM v1), n AS (SELECT doc_id, {HASH_SQL.format('content')} AS h FROM v2)
SELECT doc_id, count(*) AS active, count(*) FILTER (h IN (SELECT h FROM o)) AS reused, count(*) FILTER (h NOT IN (SELECT h FROM o)) AS new FROM n GROUP BY doc_id""")
def a28_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors reused and new, per document."""
    docs = table(spark, sf_dir, "documents")
    cached = sections(docs, 1).select(v.content_hash(F.col("content")).alias("content_hash")).distinct().withColumn("there", F.lit(True))
    rows = sections(docs, 2).withColumn("content_hash", v.content_hash(F.col("content"))).join(cached, "content_hash", "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("active"), F.count("there").alias("reused"), F.count_if(F.col("there").isNull()).alias("new"))


@query("WITH " + VERSIONS_SQL + " SELECT document_id, max(CASE WHEN status = 'ACTIVE' THEN version_id END) AS active_version, count(*) AS n_versions, string_agg(version_id, ',' ORDER BY created_at, version_id) AS versions FROM versions GROUP BY document_id")
def a02_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.catalog_rows(_versions(spark, sf_dir))


@query("WITH " + VERSIONS_SQL + """, c AS (SELECT document_id, document_id || ':v1' AS chosen_id FROM (SELECT DISTINCT document_id FROM versions) WHERE document_id % 4 = 1)
SELECT document_id, version_id, CASE WHEN chosen_id IS NULL THEN status WHEN version_id = chosen_id THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status,
 CASE WHEN chosen_id IS NULL THEN superseded_at WHEN version_id = chosen_id THEN NULL ELSE 9 END AS superseded_at FROM versions LEFT JOIN c USING (document_id)""")
def d09_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 is activated again for a quarter of the documents."""
    versions = _versions(spark, sf_dir)
    chosen = versions.select("document_id").distinct().where("document_id % 4 = 1").withColumn("chosen_id", F.concat(F.col("document_id").cast("string"), F.lit(":v1")))
    return v.activate(versions, chosen, F.lit(9))


@query("WITH " + VERSIONS_SQL + ", " + CHUNKS_SQL + " SELECT chunk_id, lang FROM chunks JOIN versions ON document_id = doc_id AND status = 'ACTIVE' WHERE version_id LIKE '%:v2' AND lang IN ('en', 'fr')")
def f01_version_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _versions(spark, sf_dir).where("status = 'ACTIVE' and version_id like '%:v2'").select(F.col("document_id").alias("doc_id"))
    return chunks(table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr"))).join(active, "doc_id", "left_semi").select("chunk_id", "lang")


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ['*'] WHEN p_size % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand] END AS facet FROM part), w AS (SELECT unnest(['Brand#11', 'Brand#23', NULL]) AS wanted)
SELECT wanted, count(*) AS n, sum(p_partkey) AS s FROM f, w WHERE wanted IS NULL OR list_contains(facet, '*') OR list_contains(facet, wanted) GROUP BY wanted""")
def f04_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wishes, one of them none, against facet lists, some for all and some empty."""
    facet = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("*"))).when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", facet.alias("facet"), F.explode(F.array(F.lit("Brand#11"), F.lit("Brand#23"), F.lit(None).cast("string"))).alias("wanted"))
    return rows.where(v.has_facet(F.col("facet"), F.col("wanted"))).groupBy("wanted").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM conversations)
SELECT version, coalesce(version IN ('v2'), false) AS catalog_passes, coalesce(version IN ('v2'), true) AS agent_passes, count(*) AS n FROM c GROUP BY ALL""")
def f08_null_version_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scopes that differ in what an unknown version means."""
    rows = table(spark, sf_dir, "conversations").withColumn("version", F.when(F.col("conv_id") % 4 == 0, None).when(F.col("conv_id") % 3 == 0, "v2").otherwise("v1"))
    scope = lambda passes: v.in_scope(F.col("version"), ["v2"], null_passes=passes)
    return rows.groupBy("version", scope(False).alias("catalog_passes"), scope(True).alias("agent_passes")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN url LIKE '%/docs/%' THEN 'documentation' WHEN url LIKE '%page=%' THEN 'listing' WHEN regexp_matches(url, '^https?://m[.]') THEN 'mobile' WHEN url LIKE '%#%' THEN 'anchor' ELSE 'page' END AS module, count(*) AS n FROM pages GROUP BY ALL""")
def f10_module_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules: the first that holds names the module."""
    url = F.col("url")
    module = F.when(url.contains("/docs/"), "documentation").when(url.contains("page="), "listing").when(url.rlike("^https?://m[.]"), "mobile").when(url.contains("#"), "anchor").otherwise("page")
    return table(spark, sf_dir, "pages").groupBy(module.alias("module")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT * FROM (VALUES ('size', 0, 'th'), ('size', 0, 'on'), ('form', 1, 'er'), ('form', 1, 'in'), ('rest', 2, 'the')) t(cat, ord, word)),
h AS (SELECT item_id, cat, ord, count(*) AS hits FROM benchmark JOIN k ON contains(lower(text), word) GROUP BY ALL)
SELECT item_id, arg_max(cat, (hits, -ord)) AS change_type FROM h GROUP BY item_id""")
def f16_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with most keyword hits, the earlier one on ties. Keywords are a short fixed list."""
    words = {("size", 0): ["th", "on"], ("form", 1): ["er", "in"], ("rest", 2): ["the"]}
    hits = F.array(*[F.struct(sum(F.when(F.contains(F.lower("text"), F.lit(w)), 1).otherwise(0) for w in ws).alias("hits"), F.lit(-o).alias("o"), F.lit(c).alias("cat")) for (c, o), ws in words.items()])
    best = F.array_max(F.filter(hits, lambda h: h["hits"] > 0))
    return table(spark, sf_dir, "benchmark").select("item_id", best["cat"].alias("change_type")).where("change_type is not null")


@query("WITH " + CHUNKS_SQL + """
SELECT x.lang, count(*) AS pairs, sum(x.n) AS s FROM chunks x JOIN chunks y ON x.lang = y.lang AND x.source = y.source AND x.n = y.n AND x.doc_id < y.doc_id AND x.content <> y.content GROUP BY x.lang""")
def j14_consistency_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sections (lines) under one heading, the line's number, in different documents of one source whose texts differ.

    No pair is made: twice the pairs of a place are N^2 less those of one document,
    less those of one text, plus those of both (counts squared, summed over each).
    Texts are told apart by their SHA-256, which is what is shuffled.
    """
    rows = chunks(table(spark, sf_dir, "documents")).where("doc_id is not null and lang is not null and source is not null")
    place = ["lang", "source", "n"]
    counts = rows.select("doc_id", "n", "source", "lang", F.unhex(F.sha2("content", 256)).alias("text")).groupBy(*place, "text", "doc_id").agg(F.count("*").alias("c"))
    sets = [place, [*place, "doc_id"], [*place, "text"]]
    both = F.sum(F.col("c").cast("decimal(14,0)") * F.col("c").cast("decimal(14,0)"))
    sums = counts.groupingSets(sets, *place, "text", "doc_id").agg(F.sum("c").cast("decimal(18,0)").alias("c"), both.alias("both"), (F.grouping("text") + F.grouping("doc_id")).alias("wide"))
    twice = F.when(F.col("wide") == 1, -F.col("c") * F.col("c")).otherwise(F.col("c") * F.col("c") + F.col("both"))
    told = sums.select("lang", "n", twice.alias("twice")).groupBy("lang", "n").agg((F.sum("twice") / 2).cast("long").alias("pairs"))
    return told.groupBy("lang").agg(F.sum("pairs").alias("pairs"), F.sum(F.col("n") * F.col("pairs")).alias("s")).where("pairs > 0")


@query("""WITH c AS (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'assistant')
SELECT c.conv_id, c.turn, count(e.turn) AS evidence, min(e.turn) AS first_cited FROM c LEFT JOIN e ON e.conv_id = c.conv_id AND e.turn < c.turn GROUP BY ALL""")
def j10_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are claims, earlier turns of others their evidence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    mine = F.col("role") == "assistant"
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    marked = turns.select("conv_id", "turn", mine.alias("claim"), F.sum(F.when(~mine, 1).otherwise(0)).over(earlier).alias("n"), F.min(F.when(~mine, F.col("turn"))).over(earlier).alias("first_cited"))
    return marked.where("claim").select("conv_id", "turn", F.coalesce("n", F.lit(0)).alias("evidence"), "first_cited")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500)")
def j09_citation_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that cite a document of the retrieved scope."""
    there = table(spark, sf_dir, "documents").where("lang = 'en' and n_chars > 500").select("doc_id")
    return table(spark, sf_dir, "labels").join(there, "doc_id", "left_semi").select("doc_id", "quality")


@query("WITH " + CHUNKS_SQL + """, s AS (SELECT doc_id, n, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(content) - 1 AS lo, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS hi FROM chunks),
f AS (SELECT doc_id, CAST(doc_id % 200 AS BIGINT) AS at FROM documents)
SELECT f.doc_id, f.at, n AS line FROM f JOIN s ON f.doc_id = s.doc_id AND f.at >= lo AND f.at < hi""")
def j15_range_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line whose character range holds a finding's offset."""
    docs = table(spark, sf_dir, "documents")
    upto = F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id").orderBy("n"))
    spans = chunks(docs).select("doc_id", "n", (upto - F.length("content") - 1).alias("lo"), (upto - 1).alias("hi"))
    found = docs.select("doc_id", (F.col("doc_id") % 200).alias("at"))
    return found.join(spans, "doc_id").where("at >= lo and at < hi").select("doc_id", "at", F.col("n").alias("line"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate AS lo, l_shipdate + INTERVAL 10 DAY AS hi FROM lineitem)
SELECT a.l_orderkey, count(*) AS overlaps FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.lo < b.hi AND a.hi > b.lo GROUP BY ALL""")
def j17_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping ten-day windows within an order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("lo"), (F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("hi"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("a.hi") > F.col("b.lo")))
    return met.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("overlaps"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS kind, arg_max(o_orderstatus, (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END, o_orderkey)) AS outcome FROM orders GROUP BY ALL),
r AS (SELECT DISTINCT o_orderpriority AS kind FROM orders)
SELECT c_custkey, r.kind, coalesce(outcome, 'NOT_RUN') AS outcome FROM customer CROSS JOIN r LEFT JOIN o ON o_custkey = c_custkey AND o.kind = r.kind""")
def j18_latest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required checks of each customer with the worst outcome so far, or NOT_RUN. Kinds are the few values of one column."""
    orders = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    done = orders.groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(F.max_by("o_orderstatus", F.struct(rank, "o_orderkey")).alias("outcome"))
    kinds = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"))
    required = table(spark, sf_dir, "customer").select("c_custkey").join(F.broadcast(kinds)).select("c_custkey", F.explode("kinds").alias("kind"))
    return required.join(done, (F.col("c_custkey") == F.col("o_custkey")) & (required["kind"] == done["kind"]), "left").select("c_custkey", required["kind"], F.coalesce("outcome", F.lit("NOT_RUN")).alias("outcome"))


@query("WITH " + VERSIONS_SQL + """, e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id || ':v1' ELSE doc_id || ':v2' END AS cited FROM documents)
SELECT e.doc_id, e.cited, CASE WHEN e.doc_id % 11 = 0 THEN 'FRESH' WHEN cited IS NULL OR status IS NULL THEN 'UNKNOWN' WHEN status = 'ACTIVE' THEN 'FRESH' ELSE 'STALE' END AS freshness FROM e LEFT JOIN versions ON version_id = cited""")
def j21_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited versions against active ones; the declared historical ones (doc_id % 11 = 0) are always fresh."""
    i = F.col("doc_id").cast("string")
    cited = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 2 == 0, F.concat(i, F.lit(":v1"))).otherwise(F.concat(i, F.lit(":v2"))).alias("cited"))
    known = _versions(spark, sf_dir).select(F.col("version_id").alias("cited"), "status")
    fresh = F.when(F.col("doc_id") % 11 == 0, "FRESH").when(F.col("cited").isNull() | F.col("status").isNull(), "UNKNOWN").when(F.col("status") == "ACTIVE", "FRESH").otherwise("STALE")
    return cited.join(known, "cited", "left").select("doc_id", "cited", fresh.alias("freshness"))


@query("""WITH k AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY ALL), c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY ALL)
SELECT n_name, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers, CASE WHEN suppliers IS NULL OR customers IS NULL THEN 'missing' ELSE 'available' END AS state FROM nation LEFT JOIN k ON k.nation = n_nationkey LEFT JOIN c ON c.nation = n_nationkey""")
def j19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required families (nations) and what each side has of them."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    state = F.when(F.col("suppliers").isNull() | F.col("customers").isNull(), "missing").otherwise("available")
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"), state.alias("state"))


@query("""WITH i AS (SELECT unnest(regexp_extract_all(url, '[a-z]+[.]example[.][a-z]+')) AS id, page_id FROM pages), k AS (SELECT DISTINCT id FROM i)
SELECT id, count(DISTINCT page_id) AS pages, sha256('host|' || id) AS item_id FROM i GROUP BY id""")
def t16_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found in urls, one item each with a stable id."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("([a-z]+[.]example[.][a-z]+)"), F.lit(1))).alias("id"))
    return found.groupBy("id").agg(F.countDistinct("page_id").alias("pages")).select("id", "pages", F.sha2(F.concat(F.lit("host|"), F.col("id")).cast("binary"), 256).alias("item_id"))


@query("WITH " + CHUNKS_SQL + """, f AS (SELECT doc_id, sha256(string_agg(n || ':' || sha256(content), ',' ORDER BY n)) AS identity, count(*) AS n FROM chunks GROUP BY doc_id) SELECT * FROM f""")
def s18_tree_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the sorted parts of each document."""
    part = F.concat_ws(":", F.col("n").cast("string"), F.sha2(F.col("content").cast("binary"), 256))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"])
    return chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("identity"), F.count("*").alias("n"))
