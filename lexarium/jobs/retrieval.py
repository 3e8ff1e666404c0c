"""Retrieval over the given tables: benchmark items are queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.text import facets, folded, hex_bucket, index_terms, readable, search_terms
from lexarium.jobs.registry import query
from lexarium.operators import retrieval as r
from lexarium.operators.scoring import Field, Formula, best_rows
from lexarium.sources.tables import CHUNKS_SQL, chunks, spread, table

TERM_SQL = "'[a-z][a-z0-9_.-]*|[0-9]+'"
POSTINGS_SQL = f"""post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), {TERM_SQL})) AS term FROM documents) GROUP BY ALL),
lens AS (SELECT doc_id, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), {TERM_SQL})) AS len FROM documents),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), {TERM_SQL})) AS term FROM benchmark) GROUP BY ALL)"""
BM25_SQL = POSTINGS_SQL + """,
scored AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score, count(*) AS n_terms
           FROM post JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


def _corpus(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where(where).select("doc_id", "text"))


def _bm25(spark: SparkSession, sf_dir: str, k: int, where: str = "true", carry: dict | None = None, formula: Formula | None = None, least_terms: int = 1) -> DataFrame:
    """The first ``k`` documents of each item, with their rank and the columns of ``carry``: no document leaves its task that isn't among its first k."""
    terms = r.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    carry = carry or {}
    corpus = spread(table(spark, sf_dir, "documents").where(where).select("doc_id", "text", *[c.alias(n) for n, c in carry.items()]))
    found = best_rows(r.hits(corpus, ["doc_id", *carry], "text", terms), terms, "doc_id", "item_id", k, formula, carry=list(carry), least_terms=least_terms)
    return r.top_k(found, "item_id", k, *r.best_first("doc_id"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), {TERM_SQL})) AS term FROM documents) GROUP BY ALL")
def t01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.postings(_corpus(spark, sf_dir), "doc_id", "text")


@query("""SELECT conv_id, turn, list_aggregate(flatten(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z][a-z0-9_.-]*|[0-9]+'),
 lambda t: list_concat([t], list_filter(string_split_regex(t, '[_.]+'), lambda p: length(p) >= 2 AND p <> t)))), 'string_agg', ' ') AS terms FROM conversations""")
def t02_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_join(search_terms(folded(F.col("text"))), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(found != "", found).alias("terms"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def t08_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readable(F.col("html")).alias("body"))


@query("""WITH p AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[;；\\n]+'), lambda p: trim(regexp_replace(trim(p), '^([-*•]|[0-9]+[.)、])[ ]*', ''))), lambda p: p <> '') AS ps FROM benchmark)
SELECT item_id, unnest(CASE WHEN len(ps) <= 1 THEN [text] WHEN len(ps) > 4 THEN list_concat(ps[1:3], [array_to_string(ps[4:], '；')]) ELSE ps END) AS facet FROM p""")
def t12_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(facets(F.col("text"))).alias("facet"))


@query(CHUNKS_SQL.join(("WITH ", """, u AS (SELECT doc_id, n, unnest(generate_series(0, CAST(floor((length(content) - 1) / 200) AS BIGINT) * 200, 200)) AS lo, content FROM chunks)
SELECT doc_id, n, lo, substr(content, CAST(lo AS BIGINT) + 1, 240) AS piece FROM u""")))
def t10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 240 characters every 200 of each line."""
    lines = chunks(table(spark, sf_dir, "documents"))
    at = F.sequence(F.lit(0), (F.floor((F.length("content") - 1) / 200) * 200).cast("int"), F.lit(200))
    return lines.select("doc_id", "n", F.explode(at).alias("lo"), "content").select("doc_id", "n", F.col("lo").cast("long").alias("lo"), F.substr("content", F.col("lo") + 1, F.lit(240)).alias("piece"))


@query("WITH " + POSTINGS_SQL + " SELECT term, df, sum(tf) AS cf FROM df JOIN post USING (term) GROUP BY ALL")
def a01_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.term_statistics(_corpus(spark, sf_dir), "doc_id", "text")


@query("WITH " + BM25_SQL + " SELECT item_id, doc_id, rank, round(score, 5) AS score FROM bm WHERE rank <= 5")
def r01_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _bm25(spark, sf_dir, 5)
    return best.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("WITH " + POSTINGS_SQL + """,
f AS (SELECT doc_id, 4.0 AS weight, regexp_extract(text, '^[^\\n]*') AS body FROM documents UNION ALL SELECT doc_id, 1.0, text FROM documents),
fp AS (SELECT doc_id, weight, term, count(*) AS tf FROM (SELECT doc_id, weight, unnest(regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[a-z][a-z0-9_.-]*|[0-9]+')) AS term FROM f) GROUP BY ALL),
fl AS (SELECT doc_id, weight, len(regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[a-z][a-z0-9_.-]*|[0-9]+')) AS len FROM f),
fa AS (SELECT weight, greatest(avg(len), 1) AS avg_len FROM fl GROUP BY weight),
s AS (SELECT item_id, doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / fa.avg_len))) AS score
      FROM fp JOIN qt USING (term) JOIN df USING (term) JOIN fl USING (doc_id, weight) JOIN fa USING (weight), stats GROUP BY ALL)
SELECT item_id, doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def r02_bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line at weight 4 and whole text at weight 1, each with its own lengths; document frequencies shared."""
    terms = r.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    corpus = _corpus(spark, sf_dir)
    headed = corpus.select("doc_id", "text", index_terms(folded(F.substring_index("text", "\n", 1))).alias("head")).withColumn("head_len", F.size("head").cast("long"))
    found = r.hits(headed, ["doc_id", "head", "head_len"], "text", terms)
    both = best_rows(found, terms, "doc_id", "item_id", 5, fields=[Field(), Field("head", "head_len", 4.0)])
    return r.top_k(both, "item_id", 5, *r.best_first("doc_id")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("WITH " + POSTINGS_SQL + """,
s AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
      FROM post JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL)
SELECT item_id, doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def r03_bm25_query_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _bm25(spark, sf_dir, 5, formula=Formula(k=1.5, numerator=2.5, multiplicity=True))
    return best.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("WITH d AS (SELECT * FROM documents WHERE lang = 'en'), " + POSTINGS_SQL.replace("FROM documents", "FROM d") + """,
s AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score, count(*) AS k
      FROM post JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL HAVING count(*) >= 2)
SELECT item_id, doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def r04_bm25_scoped_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the scoped rows alone, and at least two matching terms."""
    best = _bm25(spark, sf_dir, 3, "lang = 'en'", formula=Formula(k=1.5, numerator=2.5, multiplicity=True), least_terms=2)
    return best.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def _grams(width: int):
    return F.transform(F.sequence(F.lit(1), F.length("s") - (width - 1)), lambda i: F.substr("s", i, F.lit(width)))


@query("""WITH t AS (SELECT item_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[ \\t\\r\\n]+', '', 'g') AS s FROM benchmark),
g AS (SELECT item_id, substr(s, i, w) AS g FROM (SELECT item_id, s, w, unnest(generate_series(1, length(s) - w + 1)) AS i FROM t, (VALUES (1), (2), (3)) v(w) WHERE length(s) >= w)),
c AS (SELECT item_id, CAST('0x' || substr(sha256(g), 1, 8) AS BIGINT) % 512 AS dim, count(*) AS n FROM g GROUP BY ALL)
SELECT item_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def r06_hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse form of the 512 buckets of character 1- to 3-grams, unit length."""
    bare = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(folded(F.col("text")), "[ \\t\\r\\n]+", "").alias("s"))
    grams = None
    for w in (1, 2, 3):
        own = bare.where(F.length("s") >= w).select("item_id", F.explode(_grams(w)).alias("g"))
        grams = own if grams is None else grams.union(own)
    counts = grams.groupBy("item_id", hex_bucket(F.col("g"), 512).alias("dim")).agg(F.count("*").alias("n"))
    return counts.select("item_id", "dim", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("item_id"))), 6).alias("value"))


DENSE_SQL = """dn AS (SELECT q.vec_id AS qid, v.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dn)"""


def _dense(spark: SparkSession, sf_dir: str, k: int, scope: str = "true") -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(scope)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return r.dense_search(vectors, asked, k)


@query("WITH " + DENSE_SQL + " SELECT qid, vec_id, rank, round(score, 5) AS score FROM dense WHERE rank <= 5")
def r08_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 5).select("qid", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("WITH " + DENSE_SQL.replace("AND", "AND").replace("WHERE q.vec_id % 20 = 0", "WHERE q.vec_id % 20 = 0 AND v.label % 2 = 0") + " SELECT qid, vec_id, rank, round(score, 5) AS score FROM dense WHERE rank <= 5")
def r09_dense_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope before ranking: only vectors of even label."""
    return _dense(spark, sf_dir, 5, "label % 2 = 0").select("qid", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("SELECT vec_id, len(embedding) AS dim, coalesce(list_bool_and(list_transform(embedding, lambda x: NOT isnan(x))), true) AS finite, abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) <= 1e-4 AS unit FROM embeddings")
def r14_vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("dim"), F.forall(e, lambda x: ~F.isnan(x)).alias("finite"), (F.abs(F.sqrt(r.inner_product(e, e)) - 1) <= 1e-4).alias("unit"),
    )


@query("""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z][a-z0-9_.-]*|[0-9]+')) AS ts FROM benchmark),
w AS (SELECT item_id, unnest(ts) AS term FROM q), p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z][a-z0-9_.-]*|[0-9]+')) AS term FROM documents))
SELECT item_id, doc_id, count(*) AS matched, round(count(*) / any_value(n), 6) AS ratio, CASE WHEN count(*) / any_value(n) >= 0.8 THEN 'strong' WHEN count(*) / any_value(n) >= 0.45 THEN 'partial' ELSE 'limited' END AS support
FROM w JOIN p USING (term) JOIN (SELECT item_id, len(ts) AS n FROM q) USING (item_id) GROUP BY item_id, doc_id HAVING count(*) / any_value(n) >= 0.45""")
def r17_query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a query's distinct terms that a document has, and what that says of its support; those of at least .45."""
    wanted = r.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = r.hits(_corpus(spark, sf_dir), ["doc_id"], "text", wanted)
    met = best_rows(found, wanted, "doc_id", "item_id", None, Formula(counts=True), least_share=0.45).withColumnRenamed("n_terms", "matched")
    met = met.join(r.small(wanted.groupBy("item_id").agg(F.count("*").alias("n"))), "item_id")
    ratio = F.col("matched") / F.col("n")
    return met.where(ratio >= 0.45).select("item_id", "doc_id", "matched", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 0.8, "strong").when(ratio >= 0.45, "partial").otherwise("limited").alias("support"))


LISTS_SQL = BM25_SQL + """,
tfs AS (SELECT item_id, doc_id, sum(tf * qf) AS score FROM post JOIN qt USING (term) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM tfs),
lists AS (SELECT item_id, 0 AS list_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT item_id, 1, doc_id, rank FROM tr WHERE rank <= 50),
fused AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS rrf_score, string_agg(DISTINCT CAST(list_id AS VARCHAR), ',' ORDER BY CAST(list_id AS VARCHAR)) AS lists FROM lists GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each item: BM25 (list 0) and shared term counts (list 1), 50 rows each."""
    terms = r.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = r.hits(_corpus(spark, sf_dir), ["doc_id"], "text", terms)
    bm, by_count = (
        r.top_k(best_rows(found, terms, "doc_id", "item_id", 50, formula), "item_id", 50, *r.best_first("doc_id"))
        for formula in (Formula(), Formula(counts=True, multiplicity=True))
    )
    return bm.select("item_id", F.lit(0).alias("list_id"), "doc_id", "rank").union(by_count.select("item_id", F.lit(1).alias("list_id"), "doc_id", "rank"))


@query("WITH " + LISTS_SQL + " SELECT item_id, doc_id, rank, round(rrf_score, 6) AS rrf_score, lists FROM fr WHERE rank <= 20")
def x01_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = r.top_k(r.reciprocal_rank_fusion(_lists(spark, sf_dir), "item_id", "doc_id"), "item_id", 20, *r.best_first("doc_id", "rrf_score"))
    return fused.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("rrf_score", 6).alias("rrf_score"), F.array_join(F.transform("lists", lambda x: x.cast("string")), ",").alias("lists"))


@query("WITH " + LISTS_SQL + """, again AS (SELECT * FROM lists UNION ALL SELECT item_id, list_id, doc_id, rank + 3 FROM lists WHERE rank % 5 = 0),
once AS (SELECT item_id, list_id, doc_id, min(rank) AS rank FROM again GROUP BY ALL)
SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM once GROUP BY ALL""")
def x02_rrf_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with repeated rows, each counted once at its first rank."""
    lists = _lists(spark, sf_dir)
    again = lists.union(lists.where("rank % 5 = 0").select("item_id", "list_id", "doc_id", F.col("rank") + 3))
    return r.reciprocal_rank_fusion(again, "item_id", "doc_id", once=True).select("item_id", "doc_id", F.round("rrf_score", 6).alias("rrf_score"))


@query("WITH " + BM25_SQL + """, t AS (SELECT bm.*, source FROM bm JOIN documents USING (doc_id) WHERE rank <= 40),
k AS (SELECT *, CASE WHEN rank <= 2 THEN 0 WHEN row_number() OVER (PARTITION BY item_id, source ORDER BY rank) = 1 THEN 1 ELSE 2 END AS kind FROM t)
SELECT item_id, doc_id, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kind, rank) AS new_rank FROM k) WHERE new_rank <= 10""")
def x04_source_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sourced = _bm25(spark, sf_dir, 40, carry={"source": F.col("source")})
    return r.one_per_source(sourced, "item_id", "source", 2).where("new_rank <= 10").select("item_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))


@query("WITH " + LISTS_SQL + """, a AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 5),
p AS (SELECT f.item_id, f.doc_id, coalesce(a.rank, 1000000 + f.rank) AS o FROM fr f LEFT JOIN a USING (item_id, doc_id))
SELECT item_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o) AS place FROM p) WHERE place <= 15""")
def x06_anchor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of BM25, then the fused order."""
    lists = _lists(spark, sf_dir)
    fused = r.top_k(r.reciprocal_rank_fusion(lists, "item_id", "doc_id"), "item_id", 100, *r.best_first("doc_id", "rrf_score")).withColumnRenamed("rank", "fused_rank")
    anchors = lists.where("list_id = 0 and rank <= 5").select("item_id", "doc_id", "rank")
    pool = fused.join(anchors, ["item_id", "doc_id"], "left").withColumn("o", F.coalesce("rank", F.col("fused_rank") + 1_000_000)).drop("rank")
    return r.top_k(pool, "item_id", 15, F.asc("o")).select("item_id", "doc_id", F.col("rank").cast("long").alias("place"))


@query("WITH " + BM25_SQL + """, c AS (SELECT item_id, doc_id, rank, length(text) AS chars FROM bm JOIN documents USING (doc_id) WHERE rank <= 8),
b AS (SELECT *, least(1200, CAST(floor(4000 / count(*) OVER (PARTITION BY item_id)) AS BIGINT), chars) AS base FROM c),
w AS (SELECT *, least(1200, chars) - base AS want FROM b),
l AS (SELECT *, 4000 - sum(base) OVER (PARTITION BY item_id) - coalesce(sum(want) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w)
SELECT item_id, doc_id, CAST(base + greatest(0, least(want, rest)) AS BIGINT) AS budget FROM l""")
def x07_excerpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bm25(spark, sf_dir, 8, carry={"chars": F.length("text")})
    return r.excerpt_budgets(rows, "item_id", "chars", 1200, 4000).select("item_id", "doc_id", "budget")


@query("WITH " + BM25_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_id, rank) AS own FROM bm WHERE rank <= 20),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS seat FROM o WHERE own = 1),
p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN seat = 1 THEN 0 ELSE 1 END, CASE WHEN seat = 1 THEN item_id END NULLS FIRST, rank, doc_id) AS place FROM s WHERE seat <= 60)
SELECT item_id, doc_id, place FROM p WHERE place <= 60""")
def x08_coverage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = _bm25(spark, sf_dir, 20)
    return r.coverage_order(searches, "doc_id", "item_id", 60).select("item_id", "doc_id", F.col("place").cast("long").alias("place"))


@query("WITH " + CHUNKS_SQL + """, p AS (SELECT doc_id, n, content, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, n) AS o FROM chunks),
k AS (SELECT DISTINCT doc_id, n, content FROM p WHERE o <= 3)
SELECT doc_id, count(*) AS windows, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lines, sum(length(content)) AS chars FROM k GROUP BY doc_id""")
def x18_materialized_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three windows (the longest lines) of each parent, put together in order."""
    lines = chunks(table(spark, sf_dir, "documents"))
    best = r.top_k(lines.select("doc_id", "n", "content"), "doc_id", 3, F.desc(F.length("content")), F.asc("n"))
    return best.groupBy("doc_id").agg(
        F.count("*").alias("windows"), F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x.cast("string")), ",").alias("lines"), F.sum(F.length("content")).cast("long").alias("chars"),
    )


@query("""WITH r AS (SELECT source, lang, avg(n_chars) AS gain, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, arg_max(source, (round(gain, 6), n, source)) AS chosen FROM r WHERE n >= 2 GROUP BY lang""")
def x23_select_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source per language under a gate, by a chain of criteria."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("gain"), F.count("*").alias("n")).where("n >= 2")
    return rows.groupBy("lang").agg(F.max_by("source", F.struct(F.round("gain", 6), "n", "source")).alias("chosen"))
