"""Compositions: hybrid ranking, role seats, traces, enclosing scopes, fact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.jobs.retrieval import BM25_SQL, _bm25
from lexarium.operators import retrieval as r
from lexarium.sources.tables import CHUNKS_SQL, chunks, table


@query("WITH " + BM25_SQL + """, asked AS (SELECT item_id, v.embedding AS q FROM benchmark JOIN embeddings v ON vec_id = item_id),
dn AS (SELECT item_id, vec_id AS doc_id, list_dot_product(CAST(q AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM asked, embeddings e),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dn),
l AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM dr WHERE rank <= 50),
f AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS s FROM l GROUP BY ALL)
SELECT item_id, doc_id, rank, round(s, 6) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def x03_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and dense rankings of 50 each, fused; vec_id stands for doc_id and item_id."""
    bm = _bm25(spark, sf_dir, 50).select("item_id", F.lit(0).alias("list_id"), "doc_id", "rank")
    vectors = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select("item_id").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("q"))
    dense = r.dense_search(vectors, asked, 50).select(F.col("qid").alias("item_id"), F.lit(1).alias("list_id"), F.col("vec_id").alias("doc_id"), "rank")
    fused = r.reciprocal_rank_fusion(bm.union(dense), "item_id", "doc_id")
    return r.top_k(fused, "item_id", 10, *r.best_first("doc_id", "rrf_score")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("rrf_score", 6).alias("rrf_score"))


@query("WITH " + BM25_SQL + """, t AS (SELECT bm.item_id, bm.doc_id, bm.rank, lang AS role FROM bm JOIN documents USING (doc_id) WHERE rank <= 30),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id, role ORDER BY rank) AS seat FROM t)
SELECT item_id, doc_id, role, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN seat = 1 THEN 0 ELSE 1 END, rank) AS place FROM s) WHERE place <= 6""")
def r05_role_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each role (language) sits first, the rest by rank."""
    best = _bm25(spark, sf_dir, 30, carry={"role": F.col("lang")})
    seat = F.row_number().over(Window.partitionBy("item_id", "role").orderBy("rank"))
    placed = best.withColumn("seat", seat).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.when(F.col("seat") == 1, 0).otherwise(1), "rank")))
    return placed.where("place <= 6").select("item_id", "doc_id", "role", F.col("place").cast("long").alias("place"))


@query("WITH " + CHUNKS_SQL + """, s AS (SELECT doc_id, min(n) AS lo, max(n) AS hi, 'document' AS name FROM chunks GROUP BY doc_id UNION ALL SELECT doc_id, min(n), max(n), 'block ' || CAST(floor(n / 8) AS BIGINT) FROM chunks GROUP BY doc_id, floor(n / 8)),
f AS (SELECT doc_id, n AS line FROM chunks)
SELECT f.doc_id, line, arg_min(name, (hi - lo, name)) AS scope FROM f JOIN s ON s.doc_id = f.doc_id AND line BETWEEN lo AND hi GROUP BY ALL""")
def j16_enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of nested scopes that hold a line."""
    lines = chunks(table(spark, sf_dir, "documents")).select("doc_id", "n")
    whole = lines.groupBy("doc_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("name", F.lit("document"))
    block = lines.groupBy("doc_id", F.floor(F.col("n") / 8).alias("b")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("doc_id", "lo", "hi", F.concat(F.lit("block "), F.col("b").cast("string")).alias("name"))
    found = lines.select("doc_id", F.col("n").alias("line")).join(whole.union(block), "doc_id").where("line between lo and hi")
    return found.groupBy("doc_id", "line").agg(F.min_by("name", F.struct(F.col("hi") - F.col("lo"), "name")).alias("scope"))


@query("""WITH w AS (SELECT o_custkey, o_orderpriority AS rule, min(o_totalprice) AS v, bool_or(o_orderstatus = 'P') AS unsure FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), n AS (SELECT o_custkey, o_orderpriority AS rule, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)
SELECT coalesce(w.o_custkey, n.o_custkey) AS o_custkey, coalesce(w.rule, n.rule) AS rule, CASE WHEN w.rule IS NULL THEN 'NEW' WHEN n.rule IS NOT NULL THEN 'PERSISTS' WHEN unsure THEN 'UNRESOLVED' ELSE 'NOT_OBSERVED_NOW' END AS state
FROM w FULL JOIN n ON w.o_custkey = n.o_custkey AND w.rule = n.rule""")
def j04_review_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two reviews by rule and path; what is gone is unresolved where the first review was unsure."""
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey", F.col("o_orderpriority").alias("rule")).agg(
        F.bool_or(F.col("o_orderkey") % 2 == 0).alias("was"), F.bool_or(F.col("o_orderkey") % 3 != 0).alias("now"), F.bool_or((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderstatus") == "P")).alias("unsure"),
    )
    state = F.when(~F.col("was"), "NEW").when(F.col("now"), "PERSISTS").when(F.col("unsure"), "UNRESOLVED").otherwise("NOT_OBSERVED_NOW")
    return n.where("was or now").select("o_custkey", "rule", state.alias("state"))


@query("""WITH e AS (SELECT page_id AS src, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS target FROM pages), k AS (SELECT DISTINCT lower(p_brand) AS name FROM part),
d AS (SELECT DISTINCT src, lower(target) AS target FROM e),
s AS (SELECT src, target, CASE WHEN target IN (SELECT name FROM k) THEN 'indexed' WHEN contains(target, '.') THEN 'external' ELSE 'not_indexed' END AS state, row_number() OVER (PARTITION BY src ORDER BY target) AS n, count(*) OVER (PARTITION BY src) AS total FROM d)
SELECT src, target, state, total > 5 AS truncated FROM s WHERE n <= 5""")
def j23_configuration_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page and whether they are known; at most five per root, and whether more were cut (the operator's cap)."""
    e = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("target"))
    d = e.select("src", F.lower("target").alias("target")).distinct()
    known = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("target")).distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known"), "indexed").when(F.contains("target", F.lit(".")), "external").otherwise("not_indexed")
    w = Window.partitionBy("src")
    s = d.join(known, "target", "left").select("src", "target", state.alias("state"), F.row_number().over(w.orderBy("target")).alias("n"), F.count("*").over(w).alias("total"))
    return s.where("n <= 5").select("src", "target", "state", (F.col("total") > 5).alias("truncated"))


@query("""WITH f AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 8))) AS fact FROM benchmark),
h AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS fact FROM documents),
m AS (SELECT item_id, fact, count(doc_id) FILTER (lang = 'en') AS hits, count(doc_id) FILTER (lang <> 'en') AS forbidden FROM f LEFT JOIN h USING (fact) GROUP BY ALL)
SELECT item_id, count(*) AS facts, count(*) FILTER (hits > 0 AND forbidden = 0) AS covered FROM m GROUP BY item_id""")
def a11_fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (long words) of each item that English documents hold and others don't."""
    words = lambda: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    f = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.filter(words(), lambda t: F.length(t) >= 8)).alias("fact"))
    held = table(spark, sf_dir, "documents").select("lang", F.explode(words()).alias("fact")).where("length(fact) >= 8").join(r.small(f.select("fact").distinct()), "fact", "left_semi")
    by_fact = held.groupBy("fact").agg(F.count_if(F.col("lang") == "en").alias("hits"), F.count_if(F.col("lang") != "en").alias("forbidden"))
    m = f.join(by_fact, "fact", "left")
    return m.groupBy("item_id").agg(F.count("*").alias("facts"), F.count_if((F.coalesce("hits", F.lit(0)) > 0) & (F.coalesce("forbidden", F.lit(0)) == 0)).alias("covered"))


@query("""WITH c AS (SELECT o_orderpriority AS label, o_totalprice AS v, o_orderkey AS id FROM orders)
SELECT label, count(*) AS n, round(median(v), 4) AS median, max(v) AS most, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (v > 390000) AS violations FROM c GROUP BY label""")
def a16_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, median and maximum per label, and the ids beyond a limit."""
    bad = F.array_sort(F.collect_list(F.when(F.col("o_totalprice") > 390000, F.col("o_orderkey"))))
    listed = F.array_join(F.transform(bad, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(
        F.count("*").alias("n"), F.round(F.median("o_totalprice"), 4).alias("median"), F.max("o_totalprice").alias("most"), F.when(F.size(bad) > 0, listed).alias("violations"),
    )


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + n_regionkey) % 25 AS b FROM nation), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(node, hops) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION SELECT b, hops + 1 FROM walk JOIN s ON a = node WHERE hops < 8)
SELECT node, min(hops) AS hops FROM walk WHERE node <> 1 GROUP BY node""")
def u33_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected neighbourhood of one node up to eight hops."""
    from lexarium.operators.graph import reach

    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).cast("long").alias("dst"))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, e.where("src = 1").select(F.col("src").alias("seed")).distinct()).select("node", "hops")
