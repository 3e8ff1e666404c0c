"""Strict reads, inherited settings, compound terms and request evidence over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.semistructured import count_or_null, fields, merged, sha256_or_null, strict_json
from lexarium.functions.text import dimensions, latin_terms
from lexarium.jobs.registry import query
from lexarium.jobs.retrieval import TERM_SQL
from lexarium.jobs.stores import shared
from lexarium.jobs.structures import MARKDOWN_SQL, _markdown
from lexarium.operators import evidence_search, inheritance, selection, structure
from lexarium.operators.aliases import STOP_TERMS, compound_aliases
from lexarium.sources import artifact
from lexarium.sources.tables import spread, table


@query("WITH " + MARKDOWN_SQL + " SELECT doc_id AS source_id, count(*) AS chunks, count(*) FILTER (kind = 'code_fence') AS fences, sum(hi - lo + 1) AS covered, 512 AS dimensions FROM b GROUP BY doc_id")
def s02_build_structural_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents as Markdown whose chunks are structural, built, verified and read back."""
    sources, root = _markdown(spark, sf_dir).withColumnRenamed("doc_id", "source_id"), shared(spark, "structural")
    artifact.build(sources, root, lambda rows: structure.structural_chunks(rows, ["source_id"], "text"))
    index = artifact.load(spark, root)
    return index.chunks.join(index.stored.select("chunk_id", dimensions(index.stored).alias("dimensions")), "chunk_id").groupBy("source_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("kind") == "code_fence").alias("fences"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("covered"), F.max("dimensions").alias("dimensions"))


#: Properties as they might arrive: a key twice in every 13th, an end cut off every 17th, forty lists around every 19th.
REASON_SQL = "CASE WHEN props IS NULL THEN 'MISSING' WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'INVALID' WHEN event_id % 19 = 0 THEN 'TOO_DEEP' END"


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda n: F.col("event_id") % n == 0
    twice = F.when(every(13), F.replace("props", F.lit("}"), F.lit(', "k": 1}'))).otherwise(F.col("props"))
    wrapped = F.when(every(19), F.concat(F.lit("[" * 40), twice, F.lit("]" * 40))).otherwise(twice)
    text = F.when(every(17), F.substr(wrapped, F.lit(1), F.length(wrapped) - 1)).otherwise(wrapped)
    return table(spark, sf_dir, "events").select("*", strict_json(text).alias("read"))


@query(f"SELECT event_id, {REASON_SQL} AS reason, CASE WHEN {REASON_SQL} IS NULL THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def s12_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties, or why they were put aside."""
    return _arrived(spark, sf_dir).select("event_id", "read.reason", F.try_variant_get("read.value", "$.k", "long").alias("k"))


@query(f"""SELECT user_id, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) < 10) AS stale, max(ts) AS newest
FROM events WHERE {REASON_SQL} IS NULL GROUP BY user_id""")
def u17_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per workflow (user) its completed, failed and stale sections; records that can't be read are skipped."""
    rows = _arrived(spark, sf_dir).where("read.reason IS NULL")
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.count_if(F.try_variant_get("read.value", "$.k", "long") < 10).alias("stale"), F.max("ts").alias("newest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 2 THEN sha256(CAST(event_id AS VARCHAR)) END AS output_hash FROM events""")
def u20_progress_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output summaries in one map, the output's values counting; only valid hashes and counts stay."""
    kind = F.col("event_id") % 4
    digest = F.upper(F.sha2(F.col("event_id").cast("string").cast("binary"), 256))
    output = F.when(kind == 0, '{"k": -1}').when(kind == 1, '{"k": true}').when(kind == 2, F.concat(F.lit('{"output_hash": "'), digest, F.lit('"}'))).otherwise(F.lit("{}"))
    both = merged(fields(F.try_parse_json("props")), fields(F.try_parse_json(output)))
    return table(spark, sf_dir, "events").select("event_id", both.alias("m")).select("event_id", count_or_null(F.col("m")["k"]).alias("k"), sha256_or_null(F.col("m")["output_hash"]).alias("output_hash"))


@query("""WITH RECURSIVE s AS (SELECT page_id, unnest(regexp_extract_all(url, '[?&]([a-z]+)=([^&#]*)', 1)) AS key, unnest(regexp_extract_all(url, '[?&]([a-z]+)=([^&#]*)', 2)) AS value, unnest(generate_series(1, len(regexp_extract_all(url, '[?&]([a-z]+)=([^&#]*)', 1)))) AS n FROM pages),
own AS (SELECT page_id, key, arg_max(value, n) AS value FROM s GROUP BY ALL),
b AS (SELECT page_id, CAST(floor(page_id / 3) AS BIGINT) AS base, 1 AS back FROM pages UNION ALL SELECT page_id, CAST(floor(page_id / 2) AS BIGINT), 0 FROM pages),
w(page_id, ancestor, path) AS (SELECT page_id, base, [back] FROM b WHERE page_id <> base
 UNION ALL SELECT w.page_id, base, list_append(path, back) FROM w JOIN b ON b.page_id = w.ancestor WHERE base <> w.ancestor AND len(path) < 8),
v AS (SELECT page_id, key, value, page_id AS source, CAST([] AS INTEGER[]) AS path FROM own UNION ALL SELECT w.page_id, key, value, ancestor, path FROM w JOIN own ON own.page_id = ancestor)
SELECT page_id, key, value, source FROM v QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY path, source) = 1""")
def t17_inherited_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings (query parameters of a page's address) that pages have or inherit; a page's bases are the pages of a third and of half its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pattern = F.lit("[?&]([a-z]+)=([^&#]*)")
    said = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("url", pattern, F.lit(1)).alias("k"), F.regexp_extract_all("url", pattern, F.lit(2)).alias("v"))).alias("n", "s"))
    own = said.groupBy(F.col("page_id").alias("node"), F.col("s.k").alias("key")).agg(F.max_by("s.v", "n").alias("value"))
    bases = pages.select(F.col("page_id").alias("node"), F.posexplode(F.array(F.floor(F.col("page_id") / 3), F.floor(F.col("page_id") / 2))).alias("at", "base"))
    return inheritance.effective(own, bases).select(F.col("node").alias("page_id"), "key", "value", "source")


@query(f"""WITH RECURSIVE first AS (SELECT regexp_extract_all(lower(regexp_extract(text, '^[^\\n]*')), {TERM_SQL}) AS ts FROM documents),
vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {TERM_SQL})) AS term FROM documents UNION SELECT unnest(list_transform(ts[1:len(ts) - 1], lambda t, i: t || '-' || ts[i + 1])) FROM first),
q AS (SELECT item_id, list_transform(ts, lambda t, i: CASE WHEN i % 4 = 1 AND i < len(ts) THEN t || '-' || ts[i + 1] ELSE t END) AS ts FROM (SELECT item_id, regexp_extract_all(lower(text), {TERM_SQL}) AS ts FROM benchmark)),
t AS (SELECT item_id, i, ts[i] AS t, list_filter(string_split(ts[i], '-'), lambda p: p <> '') AS ps FROM (SELECT item_id, ts, unnest(generate_series(1, len(ts))) AS i FROM q)),
k AS (SELECT item_id, i, count(*) AS parts, count(term) AS found FROM (SELECT item_id, i, unnest(ps) AS p FROM t) LEFT JOIN vocab ON term = p GROUP BY ALL),
sp AS (SELECT t.item_id, t.i, CASE WHEN contains(t, '-') AND vocab.term IS NULL AND parts > 1 AND found = parts THEN ps ELSE [t] END AS ps FROM t LEFT JOIN k ON k.item_id = t.item_id AND k.i = t.i LEFT JOIN vocab ON vocab.term = t.t),
l AS (SELECT item_id, flatten(list(ps ORDER BY i)) AS ts FROM sp GROUP BY item_id),
pairs AS (SELECT DISTINCT item_id, ts[i] || '-' || ts[i + 1] AS c FROM (SELECT item_id, ts, unnest(generate_series(1, len(ts) - 1)) AS i FROM l) WHERE ts[i] NOT IN ({", ".join(f"'{x}'" for x in STOP_TERMS)}) AND ts[i + 1] NOT IN ({", ".join(f"'{x}'" for x in STOP_TERMS)})),
good AS (SELECT item_id, list(c) AS cs FROM pairs JOIN vocab ON term = c GROUP BY item_id),
g(item_id, ts, cs, i, done) AS (SELECT item_id, ts, coalesce(cs, CAST([] AS VARCHAR[])), CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM l LEFT JOIN good USING (item_id)
 UNION ALL SELECT item_id, ts, cs, CASE WHEN i < len(ts) AND list_contains(cs, ts[i] || '-' || ts[i + 1]) THEN i + 2 ELSE i + 1 END,
   list_append(done, CASE WHEN i < len(ts) AND list_contains(cs, ts[i] || '-' || ts[i + 1]) THEN ts[i] || '-' || ts[i + 1] ELSE ts[i] END) FROM g WHERE i <= len(ts))
SELECT item_id, array_to_string(done, ' ') AS aliased FROM g WHERE i > len(ts)""")
def t20_compound_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, every fourth term joined to the next, against terms of documents and neighbours in their first lines."""
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    first = docs.select(latin_terms(F.lower(F.substring_index("text", "\n", 1))).alias("ts"))
    pairs = F.transform(F.slice("ts", 1, F.greatest(F.size("ts") - 1, F.lit(0))), lambda t, i: F.concat_ws("-", t, F.get("ts", i + 1)))
    vocabulary = docs.select(F.explode(F.array_distinct(latin_terms(F.lower("text")))).alias("term")).union(first.select(F.explode(pairs)))
    items = table(spark, sf_dir, "benchmark").select("item_id", latin_terms(F.lower("text")).alias("ts")).where(F.size("ts") > 0)
    joined = F.transform("ts", lambda t, i: F.when((i % 4 == 0) & (i + 1 < F.size("ts")), F.concat_ws("-", t, F.get("ts", i + 1))).otherwise(t))
    return compound_aliases(items.select("item_id", joined.alias("terms")), "item_id", "terms", vocabulary).select("item_id", F.array_join("aliased", " ").alias("aliased"))


@query()
def x10_request_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items make a request, each a trace with its six best documents: eight chosen in three passes, a document's source standing for what it belongs to."""
    checks = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("request_id"), (F.col("item_id") % 4).alias("query_no"), F.col("text").alias("query"))
    views = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    head = latin_terms(F.lower(F.substring_index("text", "\n", 1)))
    hits = evidence_search.pools(views, checks, "doc_id", "text", 6, {"source": F.col("source"), "head": F.array_distinct(head)})
    rows = hits.join(checks, ["request_id", "query_no"]).withColumn("overlap", F.size(F.array_intersect("head", latin_terms(F.lower("query")))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), F.col("source").alias("document"), "overlap"))), lambda r: F.struct(r["id"].alias("id"), r["document"].alias("document"), r["overlap"].alias("overlap")))
    traces = rows.groupBy("request_id", "query_no").agg(listed.alias("rows"))  # six rows
    language = F.when(F.col("query_no") % 2 == 0, "even").otherwise("odd")
    requests = traces.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_no", language.alias("language"), "rows"))), lambda t: F.struct(t["language"].alias("language"), t["rows"].alias("rows"))).alias("traces"))
    return selection.three_passes(requests, "traces").select("request_id", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"))
