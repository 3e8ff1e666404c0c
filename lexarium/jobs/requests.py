"""Requests of several queries each, answered together: benchmark items are the requests, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.text import latin_terms
from lexarium.jobs.registry import query
from lexarium.jobs.retrieval import BM25_SQL, TERM_SQL
from lexarium.operators import evidence_search as e
from lexarium.operators.containment import with_held
from lexarium.sources.tables import spread, table

#: Words of a clause, and clauses of a request.
CLAUSE, CLAUSES = 12, 8

CLAUSES_SQL = f"""rq AS (SELECT item_id, CAST(0 AS BIGINT) AS query_no, text AS query, NULL AS symbol FROM benchmark WHERE text <> ''
 UNION ALL SELECT item_id, c, array_to_string(w[(c - 1) * {CLAUSE} + 1 : c * {CLAUSE}], ' '), NULL FROM (SELECT item_id, w, unnest(generate_series(1, least({CLAUSES}, CAST(ceil(len(w) / {CLAUSE}.0) AS BIGINT)))) AS c FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text <> ''))),
rd AS (SELECT item_id, query, min(query_no) AS first, max(query_no) > 0 AS requirement FROM rq GROUP BY ALL),
queries AS (SELECT item_id, query, requirement, row_number() OVER (PARTITION BY item_id ORDER BY first) - 1 AS query_no,
  coalesce(list_max(list_transform(regexp_extract_all(lower(query), {TERM_SQL}), lambda t: struct_pack(l := length(t), t := t))).t, '') AS symbol FROM rd)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a request: its whole text, and as requirements its clauses of twelve words with their longest term as symbol."""
    words = F.split("text", " ", -1)
    clause = F.transform(F.sequence(F.lit(1), F.least(F.lit(CLAUSES), F.ceil(F.size(words) / CLAUSE).cast("int"))), lambda c: F.array_join(F.slice(words, (c - 1) * CLAUSE + 1, F.lit(CLAUSE)), " "))
    longest = lambda t: F.coalesce(F.array_max(F.transform(latin_terms(F.lower(t)), lambda x: F.struct(F.length(x).alias("l"), x.alias("t"))))["t"], F.lit(""))
    one = lambda q, requirement: F.struct(q.alias("query"), F.lit(requirement).alias("requirement"), F.array(longest(q)).alias("symbols"))
    items = table(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").alias("request_id"), "text")
    return e.queries_of(items.select("request_id", F.concat(F.array(one(F.col("text"), False)), F.transform(clause, lambda q: one(q, True))).alias("queries")))


#: BM25 of every query of every request.
POOLS_SQL = CLAUSES_SQL + ", " + BM25_SQL.replace(
    "SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), " + TERM_SQL + ")) AS term FROM benchmark) GROUP BY ALL",
    "SELECT item_id * 100 + query_no AS item_id, term, count(*) AS qf FROM (SELECT item_id, query_no, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'), " + TERM_SQL + ")) AS term FROM queries) GROUP BY ALL",
) + """,
pool AS (SELECT CAST(floor(item_id / 100) AS BIGINT) AS request_id, item_id % 100 AS query_no, doc_id, rank, source, text FROM bm JOIN documents USING (doc_id) WHERE rank <= 40)"""


@query("WITH " + POOLS_SQL + """,
fz AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(weight, 12) DESC, doc_id) AS place FROM (SELECT request_id, doc_id, any_value(source) AS source, sum(1.0 / (60 + rank)) AS weight FROM pool GROUP BY request_id, doc_id)),
cand AS (SELECT * FROM fz WHERE place <= 40),
best AS (SELECT p.request_id, p.query_no, p.doc_id, p.source FROM pool p JOIN cand c ON c.request_id = p.request_id AND c.doc_id = p.doc_id JOIN queries q ON q.item_id = p.request_id AND q.query_no = p.query_no
         WHERE q.requirement AND contains(lower(p.text), q.symbol) QUALIFY row_number() OVER (PARTITION BY p.request_id, p.query_no ORDER BY p.rank) = 1),
par AS (SELECT *, dense_rank() OVER (PARTITION BY request_id ORDER BY first) AS parents FROM (SELECT *, min(query_no) OVER (PARTITION BY request_id, source) AS first FROM best)),
seat AS (SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY query_no) AS seat FROM (SELECT request_id, doc_id, min(query_no) AS query_no FROM par WHERE parents <= 5 GROUP BY ALL)),
o AS (SELECT c.*, seat, coalesce(seat, place + 9) AS o FROM cand c LEFT JOIN seat USING (request_id, doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id, source ORDER BY o) AS nth, min(o) OVER (PARTITION BY request_id, source) AS first FROM o),
k AS (SELECT *, dense_rank() OVER (PARTITION BY request_id ORDER BY first) AS rank FROM n QUALIFY rank <= 5 AND nth <= 4)
SELECT request_id, rank, source, round(max(weight), 6) AS score, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY o) AS views, count(seat) AS seated FROM k GROUP BY request_id, rank, source""")
def x12_evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to nine queries a request, pools of 40, fused; clauses get seats; five sources of at most four documents stay."""
    views = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    queries = _requests(spark, sf_dir)
    held = F.forall("symbols", lambda s: F.array_contains("said", s))
    # a symbol may stand inside a longer term, so the symbols that a text holds are found in the pass itself
    wanted = [x["s"] for x in queries.where("requirement").select(F.explode("symbols").alias("s")).distinct().collect()]
    views = with_held(views, "text", wanted, "said", lower=True)
    found = e.search(views, queries, "doc_id", "source", "text", top_k=5, budget=40, per_parent=4, held=held, carry={"said": F.col("said")})
    return found.select("request_id", "rank", "source", F.round("score", 6).alias("score"), F.array_join(F.transform("views", lambda v: v.cast("string")), ",").alias("views"), "seated")


@query("WITH " + BM25_SQL + """, s AS (SELECT CAST(floor(item_id / 4) AS BIGINT) AS request_id, item_id % 4 AS check_no, doc_id, rank FROM bm WHERE rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(weight, 12) DESC, doc_id) AS fused FROM (SELECT request_id, doc_id, sum(1.0 / (60 + rank)) AS weight, min(check_no) AS check_no, string_agg(DISTINCT CAST(check_no AS VARCHAR), ',' ORDER BY CAST(check_no AS VARCHAR)) AS checks FROM s GROUP BY request_id, doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id, check_no ORDER BY fused) = 1 AS seat FROM f)
SELECT request_id, place, doc_id, check_no, checks FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN seat THEN 0 ELSE 1 END, CASE WHEN seat THEN check_no END NULLS FIRST, fused) AS place FROM t) WHERE place <= 8""")
def x24_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items make a request, each item one of its checks: five hits a check, fused, one seat a check, eight in all."""
    checks = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("request_id"), (F.col("item_id") % 4).alias("query_no"), F.col("text").alias("query"))
    views = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = e.pools(views, checks, "doc_id", "text", 5).withColumnRenamed("query_no", "check_no")
    found = e.batch_search(hits, "doc_id")
    return found.select("request_id", F.col("place").cast("long").alias("place"), "doc_id", "check_no", F.array_join(F.transform("checks", lambda c: c.cast("string")), ",").alias("checks"))
