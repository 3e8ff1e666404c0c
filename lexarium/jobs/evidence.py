"""Evidence rules, reviews and impact joins over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.text import latin_terms
from lexarium.jobs.registry import query
from lexarium.operators.containment import holders
from lexarium.operators.lifecycle import first_per
from lexarium.operators.retrieval import small
from lexarium.sources.tables import CHUNKS_SQL, chunks, spread, table

TERMS_SQL = "regexp_extract_all(lower({}), '[a-z][a-z0-9_.-]*|[0-9]+')"


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), url) AS title FROM pages")
def t04_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first top heading, else a fallback."""
    found = F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.when(found != "", found).otherwise(F.col("url")).alias("title"))


@query("WITH " + CHUNKS_SQL + " SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(content, '^[^a-zA-Z]*$') OR len(string_split(trim(content), ' ')) < 3) AS layout FROM chunks GROUP BY doc_id")
def t11_layout_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a readable body."""
    bare = F.col("content").rlike("^[^a-zA-Z]*$") | (F.size(F.split(F.trim("content"), " ")) < 3)
    return chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(bare).alias("layout"))


@query("SELECT doc_id, upper(id) AS id, min(k) AS first FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+[.][0-9]+(?:[.][0-9]+)*') AS ids FROM documents)) GROUP BY ALL")
def t15_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All identifiers of a pattern with the order in which they first stand."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+[.][0-9]+(?:[.][0-9]+)*)"), F.lit(1))).alias("p", "id"))
    return rows.groupBy("doc_id", F.upper("id").alias("id")).agg((F.min("p") + 1).cast("long").alias("first"))


@query("""WITH a AS (SELECT * FROM (VALUES ('the', 'article'), ('ing', 'progressive'), ('tion', 'noun'), ('er', 'agent')) t(phrase, term))
SELECT item_id, string_agg(term, ' ' ORDER BY term) AS expansion FROM benchmark JOIN a ON contains(lower(text), phrase) GROUP BY item_id""")
def t19_alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short fixed dictionary of phrases against queries."""
    known = {"the": "article", "ing": "progressive", "tion": "noun", "er": "agent"}
    terms = F.array_sort(F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p)), F.lit(t)) for p, t in known.items()]), lambda x: x.isNotNull()))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(terms, " ").alias("expansion")).where("expansion <> ''")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 0 AND NOT isnan(value) GROUP BY event_type")
def f06_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("value") > 0) & ~F.isnan("value")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[?]') THEN 'QUESTION' WHEN regexp_matches(lower(text), 'compare|versus') THEN 'COMPARE' WHEN length(text) < 40 THEN 'DIRECT_LOOKUP' ELSE 'GENERAL' END AS route FROM conversations""")
def f12_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t.rlike("[?]"), "QUESTION").when(F.lower(t).rlike("compare|versus"), "COMPARE").when(F.length(t) < 40, "DIRECT_LOOKUP").otherwise("GENERAL").alias("route"))


@query("""SELECT url, len(list_distinct(regexp_extract_all(url, '[0-9]+'))) AS numbers FROM pages""")
def f15_explicit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.size(F.array_distinct(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)))).cast("long").alias("numbers"))


@query("SELECT lang, count(*) FILTER (regexp_matches(lower(text), '\\bthe\\b')) AS as_word, count(*) FILTER (contains(lower(text), 'the')) AS anywhere FROM documents GROUP BY lang")
def f17_contains_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII terms by word border, against plain containment."""
    t = F.lower("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(t.rlike("\\bthe\\b")).alias("as_word"), F.count_if(F.contains(t, F.lit("the"))).alias("anywhere"))


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS given, list(o_orderkey ORDER BY o_orderkey) AS known FROM orders GROUP BY ALL),
a AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN given[2:] WHEN o_custkey % 3 = 1 THEN list_append(given, given[1]) ELSE given END AS answer, known FROM o)
SELECT o_custkey, len(answer) = len(known) AND list_sort(answer) = known AS accepted FROM a""")
def f22_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside order is taken only if it is a permutation of the known ids."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("given"), F.array_sort(F.collect_list("o_orderkey")).alias("known"),
    )
    k = F.col("o_custkey") % 3
    answer = F.when(k == 0, F.slice("given", 2, 2**30)).when(k == 1, F.concat("given", F.slice("given", 1, 1))).otherwise(F.col("given"))
    return o.select("o_custkey", (F.array_sort(answer) == F.col("known")).alias("accepted"))


@query(f"""WITH q AS (SELECT page_id, list_filter(list_distinct({TERMS_SQL.format("regexp_extract(html, '<title>([^<]*)', 1)")}), lambda t: length(t) > 2) AS ts, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS src FROM pages)
SELECT page_id, len(list_filter(ts, lambda t: contains(src, t))) AS overlap FROM q""")
def r16_path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title terms that stand in the squashed address."""
    ts = F.filter(F.array_distinct(latin_terms(F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)))), lambda t: F.length(t) > 2)
    rows = table(spark, sf_dir, "pages").select("page_id", ts.alias("ts"), F.regexp_replace(F.lower("url"), "[^a-z0-9]", "").alias("src"))
    return rows.select("page_id", F.size(F.filter("ts", lambda t: F.contains(F.col("src"), t))).cast("long").alias("overlap"))


@query("""WITH w AS (SELECT user_id AS q, event_type AS parent, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS o FROM events),
p AS (SELECT q, parent, min(o) AS first FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first) AS place FROM p),
c AS (SELECT w.*, place, row_number() OVER (PARTITION BY w.q, w.parent ORDER BY o) AS n FROM w JOIN k ON k.q = w.q AND k.parent = w.parent WHERE place <= 3)
SELECT q, parent, event_id, place FROM c WHERE n <= 2""")
def x13_context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three parents in order of their best window, two windows of each."""
    e = table(spark, sf_dir, "events")
    w = e.select(F.col("user_id").alias("q"), F.col("event_type").alias("parent"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("o"))
    w = w.withColumn("first", F.min("o").over(Window.partitionBy("q", "parent"))).withColumn("place", F.dense_rank().over(Window.partitionBy("q").orderBy("first")))
    n = F.row_number().over(Window.partitionBy("q", "parent").orderBy("o"))
    return w.where("place <= 3").withColumn("n", n).where("n <= 2").select("q", "parent", "event_id", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem WHERE l_returnflag <> 'A'),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS place FROM c WHERE k = 1)
SELECT l_orderkey, count(*) AS selected, count(*) FILTER (l_linestatus = 'F') AS required FROM d WHERE place <= 3 GROUP BY l_orderkey""")
def x16_evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, keep first on a key of three parts, required ones first, cut at three."""
    fresh = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    once = first_per(fresh, ["l_orderkey", "l_partkey", "l_suppkey"], F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice"))
    w = Window.partitionBy("l_orderkey").orderBy(F.when(F.col("l_linestatus") == "F", 0).otherwise(1), "l_linenumber", "l_partkey", "l_suppkey")
    return once.withColumn("place", F.row_number().over(w)).where("place <= 3").groupBy("l_orderkey").agg(F.count("*").alias("selected"), F.count_if(F.col("l_linestatus") == "F").alias("required"))


@query("""SELECT DISTINCT b.conv_id, b.turn FROM conversations b WHERE b.turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = b.conv_id AND a.turn < b.turn AND contains(a.text, b.text))""")
def x21_new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose whole text no earlier turn of the conversation contains; a turn without text is new."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b, a = c.where("turn > 0").alias("b"), c.alias("a")
    seen = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")) & F.contains(F.col("a.text"), F.col("b.text"))
    return b.join(a, seen, "left_anti").select("conv_id", "turn").distinct()


@query("""WITH a AS (SELECT upper(p_brand) AS id, sum(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT upper(p_brand) AS id, sum(p_size) AS v FROM part WHERE p_partkey % 3 <> 0 AND p_brand <> 'Brand#11' GROUP BY ALL)
SELECT coalesce(a.id, b.id) AS id, a.v AS was, b.v AS now, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' WHEN a.v <> b.v THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def j03_item_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("id", F.upper("p_brand"))
    a = p.where("p_partkey % 2 = 0").groupBy("id").agg(F.sum("p_size").alias("was"))
    b = p.where("p_partkey % 3 <> 0 and p_brand <> 'Brand#11'").groupBy("id").agg(F.sum("p_size").alias("now"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "MODIFIED").otherwise("UNCHANGED")
    return a.join(b, "id", "full_outer").select("id", "was", "now", change.alias("change"))


@query("""WITH a AS (SELECT l_suppkey, l_partkey % 50 AS site, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey % 50 AS site, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS rule, coalesce(a.site, b.site) AS site, CASE WHEN coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 THEN 'UNRESOLVED' WHEN a.n IS NULL THEN 'NEW' WHEN b.n IS NULL THEN 'NOT_OBSERVED_NOW' ELSE 'PERSISTS' END AS state
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.site = b.site""")
def j05_compare_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two runs by rule and site; more than one on a side can't be told apart. One grouping serves both sides."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rule"), (F.col("l_partkey") % 50).alias("site")).agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("b"))
    state = F.when((F.col("a") > 1) | (F.col("b") > 1), "UNRESOLVED").when(F.col("a") == 0, "NEW").when(F.col("b") == 0, "NOT_OBSERVED_NOW").otherwise("PERSISTS")
    return n.where("a + b > 0").select("rule", "site", state.alias("state"))


@query("""WITH r AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 97 = s_suppkey % 97 AND c_nationkey <> s_nationkey),
e AS (SELECT a AS n, b AS other FROM r UNION SELECT b, a FROM r)
SELECT n_nationkey, count(other) AS relations, min(other) AS first FROM nation LEFT JOIN e ON n = n_nationkey GROUP BY n_nationkey""")
def j06_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in which a row is source or target."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("k"), F.col("c_nationkey").alias("a")).distinct()
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97).alias("k"), F.col("s_nationkey").alias("b")).distinct()
    r = c.join(s, "k").where("a <> b").select("a", "b").distinct()
    e = r.select(F.col("a").alias("n_nationkey"), F.col("b").alias("other")).union(r.select(F.col("b").alias("n_nationkey"), F.col("a").alias("other"))).distinct()
    return table(spark, sf_dir, "nation").join(e, "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("other").alias("relations"), F.min("other").alias("first"))


@query(f"""WITH i AS (SELECT DISTINCT term FROM (SELECT unnest({TERMS_SQL.format('text')}) AS term FROM benchmark) WHERE length(term) >= 7),
h AS (SELECT doc_id, term FROM (SELECT DISTINCT doc_id, unnest({TERMS_SQL.format('text')}) AS term FROM documents) JOIN i USING (term))
SELECT doc_id, count(*) AS items, min(term) AS first FROM h GROUP BY doc_id""")
def j12_identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known identifiers contained in texts, found by their terms and not by trying each on each."""
    ids = table(spark, sf_dir, "benchmark").select(F.explode(latin_terms(F.lower("text"))).alias("term")).where("length(term) >= 7").distinct()
    seen = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(latin_terms(F.lower("text")))).alias("term"))
    return seen.join(small(ids), "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("items"), F.min("term").alias("first"))


@query("""WITH e AS (SELECT o_custkey AS src, l_partkey AS dst, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS confirmed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT src, dst, CASE WHEN confirmed = 1 THEN 'CONFIRMED' ELSE 'SUGGESTED' END AS kind FROM e""")
def j13_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop of confirmed links, then suggestions that no confirmed link covers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), "o_orderstatus")
    links = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst")), F.col("o_orderkey") == F.col("l_orderkey"))
    sure = links.where("o_orderstatus = 'F'").select("src", "dst").distinct()
    maybe = links.select("src", "dst").distinct().join(sure, ["src", "dst"], "left_anti")
    return sure.withColumn("kind", F.lit("CONFIRMED")).unionByName(maybe.withColumn("kind", F.lit("SUGGESTED")))


@query("""WITH c AS (SELECT doc_id, max(quality) AS claimed FROM labels GROUP BY ALL), e AS (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS shown FROM documents)
SELECT doc_id, CASE WHEN claimed IS NULL THEN 'NO_CLAIM' WHEN doc_id % 13 = 0 THEN 'SCOPE_MISMATCH' WHEN claimed = shown THEN 'CONSISTENT' ELSE 'CONTRADICTED' END AS verdict FROM e LEFT JOIN c USING (doc_id)""")
def j20_mechanical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("claimed"))
    shown = F.when(F.col("n_chars") >= 1000, 1).otherwise(0)
    verdict = F.when(F.col("claimed").isNull(), "NO_CLAIM").when(F.col("doc_id") % 13 == 0, "SCOPE_MISMATCH").when(F.col("claimed") == shown, "CONSISTENT").otherwise("CONTRADICTED")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(c, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM s) AS invalidated FROM orders""")
def j22_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that touch evidence of a stale source."""
    stale = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    hit = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(stale, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(hit, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("invalidated"))


@query("""SELECT 'document' AS domain, CAST(doc_id AS VARCHAR) AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), NULL, url FROM pages""")
def j24_two_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("domain"), F.col("doc_id").cast("string").alias("id"), "lang")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("domain"), F.col("page_id").cast("string").alias("id"), "url")
    return d.unionByName(p, allowMissingColumns=True)


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 3000) AS long FROM documents GROUP BY ALL")
def a03_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 3000).alias("long"))


@query("""WITH h AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))
SELECT item_id, count(doc_id) AS holders, coalesce(count(doc_id) > 0, false) AS answerable FROM benchmark LEFT JOIN h USING (item_id) GROUP BY item_id""")
def a10_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items have a document that holds their whole text, wherever its words begin and end."""
    items = table(spark, sf_dir, "benchmark")
    found = holders(spread(table(spark, sf_dir, "documents").select("text")), "text", items, "item_id", "text")
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("holders", F.lit(0)).alias("holders"), (F.coalesce("holders", F.lit(0)) > 0).alias("answerable"))


@query("""WITH e AS (SELECT o_orderkey AS case_id, list_distinct(list(l_suppkey % 6)) AS said FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT case_id, len(list_intersect(said, [0, 1, 2])) AS tp, 3 - len(list_intersect(said, [0, 1, 2])) AS fn, len(said) - len(list_intersect(said, [0, 1, 2])) AS fp FROM e""")
def a13_set_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false finds against a gold set, by set algebra."""
    gold = F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)])
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set((F.col("l_suppkey") % 6).cast("long")).alias("said"))
    real = said.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id")), "case_id", "left_semi")
    return real.select("case_id", F.size(F.array_intersect("said", gold)).cast("long").alias("tp"), F.size(F.array_except(gold, "said")).cast("long").alias("fn"), F.size(F.array_except("said", gold)).cast("long").alias("fp"))


@query("""WITH c AS (SELECT DISTINCT o_orderpriority AS chk FROM orders), l AS (SELECT DISTINCT o_orderstatus AS lang FROM orders), n AS (SELECT o_custkey, o_orderpriority AS chk, o_orderstatus AS lang, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, count(*) AS cells, count(*) = (SELECT count(*) FROM c) * (SELECT count(*) FROM l) AS complete FROM n GROUP BY o_custkey""")
def a22_review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every cell of check by language has a result."""
    orders = table(spark, sf_dir, "orders")
    all_cells = orders.agg((F.countDistinct("o_orderpriority") * F.countDistinct("o_orderstatus")).alias("want"))
    have = orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority", "o_orderstatus").alias("cells"))
    return have.join(F.broadcast(all_cells)).select("o_custkey", "cells", (F.col("cells") == F.col("want")).alias("complete"))


@query("""WITH g AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey % 5 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 5 AS VARCHAR)) AS evidence, min(l_returnflag) AS status FROM lineitem GROUP BY ALL)
SELECT status, evidence, count(*) AS findings, count(DISTINCT l_orderkey % 100) AS locations FROM g GROUP BY ALL""")
def a23_finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings grouped by a key that holds their evidence set."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set((F.col("l_suppkey") % 5).cast("string"))), ",").alias("evidence"), F.min("l_returnflag").alias("status"))
    return g.groupBy("status", "evidence").agg(F.count("*").alias("findings"), F.countDistinct(F.col("l_orderkey") % 100).alias("locations"))


@query("""SELECT CASE WHEN d.doc_id % 10 = 0 THEN 'SOURCE' WHEN n_chars < 200 THEN 'CANDIDATE' WHEN quality IS NULL THEN 'CONTEXT' WHEN quality = 0 THEN 'GENERATION' ELSE 'NONE' END AS stage, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) l USING (doc_id) GROUP BY ALL""")
def a27_first_failing_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    stage = F.when(F.col("doc_id") % 10 == 0, "SOURCE").when(F.col("n_chars") < 200, "CANDIDATE").when(F.col("quality").isNull(), "CONTEXT").when(F.col("quality") == 0, "GENERATION").otherwise("NONE")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS answers, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS chars FROM conversations GROUP BY ALL)
SELECT conv_id, CASE WHEN answers = 0 THEN 'MISSING' WHEN chars < 400 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS decision FROM p""")
def d05_field_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.when(F.col("role") == "assistant", F.length("text"))
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers"), F.coalesce(F.sum(mine), F.lit(0)).alias("chars"))
    return p.select("conv_id", F.when(F.col("answers") == 0, "MISSING").when(F.col("chars") < 400, "INSUFFICIENT").otherwise("SUFFICIENT").alias("decision"))


@query("""WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL), m AS (SELECT min(event_type) AS ok, max(event_type) AS bad FROM events)
SELECT user_id, CASE WHEN last = bad THEN 'REJECTED' WHEN last = ok AND kinds >= 3 THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS state FROM a, m""")
def d07_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last action decides, approval only if enough was seen."""
    e = table(spark, sf_dir, "events")
    ends = e.agg(F.min("event_type").alias("ok"), F.max("event_type").alias("bad"))
    a = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.countDistinct("event_type").alias("kinds"))
    state = F.when(F.col("last") == F.col("bad"), "REJECTED").when((F.col("last") == F.col("ok")) & (F.col("kinds") >= 3), "APPROVED").otherwise("REVIEW_REQUIRED")
    return a.join(F.broadcast(ends)).select("user_id", state.alias("state"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(trim(text), '[ \\t\\r\\n]+', ' ', 'g') AS s FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, s, min(turn) AS turn FROM t GROUP BY ALL)
SELECT conv_id, left(string_agg(s, '；' ORDER BY turn), 500) AS draft FROM f GROUP BY conv_id""")
def d15_extractive_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence texts in order, joined and cut at 500 characters (the operator's own bound)."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.regexp_replace(F.trim("text"), "[ \\t\\r\\n]+", " ").alias("s"))
    f = t.groupBy("conv_id", "s").agg(F.min("turn").alias("turn"))
    return f.groupBy("conv_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "；"), 1, 500).alias("draft"))


@query("""WITH b AS (SELECT doc_id, 'DUPLICATE_ID' AS rule FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'LENGTH_MISMATCH' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'NO_LANGUAGE' FROM documents WHERE lang IS NULL
UNION ALL SELECT DISTINCT doc_id, 'UNKNOWN_DOCUMENT' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT rule, count(*) AS n FROM b GROUP BY rule""")
def f23_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints over the corpus; a sound one has no rows."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bad = lambda rows, rule: rows.select("doc_id", F.lit(rule).alias("rule"))
    twice = d.groupBy("doc_id").count().where("count > 1")
    unknown = l.select("doc_id").distinct().join(d.select("doc_id"), "doc_id", "left_anti")
    found = bad(twice, "DUPLICATE_ID").union(bad(d.where(F.col("n_chars") != F.length("text")), "LENGTH_MISMATCH")).union(bad(d.where("lang is null"), "NO_LANGUAGE")).union(bad(unknown, "UNKNOWN_DOCUMENT"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (turn - was <> 1) AS gaps, count(*) FILTER (role = before) AS repeats FROM (SELECT conv_id, turn, role, lag(turn) OVER w AS was, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def u09_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the turns of a conversation make an unbroken chain."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(w).alias("was"), F.lag("role").over(w).alias("before"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("turn") - F.col("was") != 1).alias("gaps"), F.count_if(F.col("role") == F.col("before")).alias("repeats"))


@query("""SELECT lang, count(DISTINCT source) > 1 AS leaks, count(DISTINCT source) AS sources, count(*) - count(DISTINCT text) AS repeated FROM documents GROUP BY lang""")
def u47_dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that stand in several splits, and texts that repeat; by hashes of texts."""
    d = table(spark, sf_dir, "documents").select("lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupBy("lang").agg((F.countDistinct("source") > 1).alias("leaks"), F.countDistinct("source").alias("sources"), (F.count("*") - F.countDistinct("h")).alias("repeated"))


@query("""WITH h AS (SELECT doc_id, lang, length(text) AS n FROM documents), c AS (SELECT lang, avg(CASE WHEN n > 2000 THEN 1.0 ELSE 0.0 END) AS macro, sum(CASE WHEN n > 2000 THEN n ELSE 0 END) / sum(n) AS micro FROM h GROUP BY lang)
SELECT lang, round(macro, 6) AS macro, round(micro, 6) AS micro FROM c""")
def u48_macro_and_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.when(n > 2000, 1.0).otherwise(0.0)), 6).alias("macro"), F.round(F.sum(F.when(n > 2000, n).otherwise(0)) / F.sum(n), 6).alias("micro"))
