"""Structural chunks, windows and evidence texts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.jobs.registry import query
from lexarium.operators import structure as s
from lexarium.sources.tables import CHUNKS_SQL, chunks, spread, table

TOKENS, CHARS = 128, 384

#: Documents as Markdown: of nine lines that aren't blank, the first gets a heading above it, the fourth to sixth stand in a fence.
MARKDOWN_SQL = CHUNKS_SQL + """,
m AS (SELECT *, r // 9 AS g, r % 9 AS p, 1 + CAST(r % 9 IN (0, 3, 5) AS INTEGER) AS k FROM (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS r FROM chunks)),
c AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY r) AS upto FROM m),
u AS (SELECT doc_id, '## part ' || g AS head, p // 3 AS s, min(upto - k) + 1 AS lo, max(upto) AS hi, sum(length(content)) + count(*) - 1 AS body, bool_or(p = 5) AS closed FROM c GROUP BY doc_id, g, p // 3),
b AS (SELECT doc_id, 'section' AS kind, lo, hi, length(head) + 1 + body AS chars FROM u WHERE s = 0 AND length(head) + body <= 1800
 UNION ALL SELECT doc_id, 'heading', lo, lo, length(head) FROM u WHERE s = 0 AND length(head) + body > 1800
 UNION ALL SELECT doc_id, 'paragraph', lo + 1, hi, body FROM u WHERE s = 0 AND length(head) + body > 1800
 UNION ALL SELECT doc_id, 'code_fence', lo, hi, body + 4 + CASE WHEN closed THEN 4 ELSE 0 END FROM u WHERE s = 1
 UNION ALL SELECT doc_id, 'paragraph', lo, hi, body FROM u WHERE s = 2)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunks(table(spark, sf_dir, "documents")).select("doc_id", "content", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).alias("r"))
    p = F.col("r") % 9
    written = F.when(p == 0, F.concat(F.lit("## part "), F.floor(F.col("r") / 9).cast("string"), F.lit("\n"), "content")).when(p == 3, F.concat(F.lit("```\n"), "content")).when(p == 5, F.concat("content", F.lit("\n```"))).otherwise(F.col("content"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", written.alias("w")))), lambda x: x["w"]), "\n").alias("text"))  # the lines of one document


@query("WITH " + MARKDOWN_SQL + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS part, kind, lo AS line_start, hi AS line_end, chars FROM b")
def t05_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown, fences whole, prose packed to 1,800 characters under its heading."""
    found = s.structural_chunks(_markdown(spark, sf_dir), ["doc_id"], "text")
    return found.select("doc_id", "part", "kind", "line_start", "line_end", F.length("content").alias("chars"))


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).withColumn("first", F.lit(1))
    return docs, s.token_views(docs, ["doc_id"], "source", "lang", "text", "first", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, TOKENS)


@query()
def t06_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 128 tokens of a public vocabulary, source and language as their context."""
    return _windows(spark, sf_dir)[1].select("doc_id", "char_start", "char_end", "line_start", "line_end", "tokens", "retrieval_text")


@query("SELECT doc_id, length(text) AS chars, length(text) AS reach, 0 AS broken, 0 AS over FROM documents WHERE text <> ''")
def t09_token_window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows cover their text once, are what it has there, and keep the budget."""
    docs, views = _windows(spark, sf_dir)
    return s.broken(views, docs, ["doc_id"], "text", TOKENS).drop("views")


def _structure_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html", "url")).withColumn("first", F.lit(1)).withColumn("heading", F.lit(None).cast("string"))
    return pages, s.structure_views(pages, ["page_id"], "url", "heading", "html", "first", CHARS)


@query()
def t07_structure_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, fences and paragraphs of pages as views of at most 384 readable characters."""
    return _structure_views(spark, sf_dir)[1].select("page_id", "char_start", "char_end", "line_start", "line_end", "context_chars", "retrieval_text")


@query("SELECT page_id, length(regexp_replace(html, '\\s', '', 'g')) AS covered, 0 AS broken FROM pages WHERE trim(html) <> ''")
def t09_structure_view_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure views are what the page has there, and hold all of it but white space."""
    pages, views = _structure_views(spark, sf_dir)
    checked = s.broken(views, pages, ["page_id"], "html", 1 << 30, exact=False).select("page_id", "broken")
    return views.groupBy("page_id").agg(F.sum(F.length(F.regexp_replace("content", "\\s", ""))).alias("covered")).join(checked, "page_id")


@query("""WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, n, ls[n] AS content, len(ls) AS lines FROM (SELECT *, unnest(generate_series(1, len(ls))) AS n FROM x)),
o AS (SELECT *, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(content) - 1 AS lo FROM l),
q AS (SELECT *, lo + length(content) + CASE WHEN n < lines THEN 1 ELSE 0 END AS hi, min(lo) OVER w AS wide_lo FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS wide_hi FROM q),
r AS (SELECT doc_id, lo AS s_lo, lo + length(content) AS s_hi, CASE WHEN wide_hi - wide_lo > 6000 THEN lo ELSE wide_lo END AS lo, CASE WHEN wide_hi - wide_lo > 6000 THEN lo + length(content) ELSE wide_hi END AS hi FROM v WHERE n % 7 = 3 AND content <> ''),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r)),
j AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY doc_id, island),
t AS (SELECT doc_id, string_agg(substr(text, CAST(lo AS BIGINT) + 1, CAST(hi - lo AS BIGINT)), chr(10) ORDER BY lo) AS joined, count(*) AS pieces FROM j JOIN x USING (doc_id) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(substr(text, CAST(s_lo AS BIGINT) + 1, CAST(s_hi - s_lo AS BIGINT)), chr(10) ORDER BY s_lo) AS alone FROM r JOIN x USING (doc_id) GROUP BY doc_id),
z AS (SELECT doc_id, pieces, substr(CASE WHEN length(joined) > 6000 THEN alone ELSE joined END, 1, 6000) AS value FROM t JOIN a USING (doc_id))
SELECT doc_id, pieces, length(value) AS chars, sha256(value) AS value_sha256 FROM z""")
def x19_generation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence texts of documents of which every seventh line is a hit."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text <> ''"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
    at = F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id").orderBy("p")) - F.length("content") - 1
    hits = lines.withColumn("lo", at.cast("int")).where((F.col("p") % 7 == 2) & (F.col("content") != ""))
    span = F.struct(F.col("lo").alias("char_start"), (F.col("lo") + F.length("content")).alias("char_end"))
    spans = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # the lines of one document
    found = s.generation_text(docs.join(spans, "doc_id"), ["doc_id"], "text", "spans")
    return found.select("doc_id", F.size("pieces").alias("pieces"), F.length("value").alias("chars"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"))
