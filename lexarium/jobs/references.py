"""Link targets of pages as an inventory of figures: who refers to what, and what that bears out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.jobs.registry import query
from lexarium.operators import figures as g
from lexarium.sources.tables import spread, table

LINKS_SQL = """p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>(.*?)</a>', 2) AS ts FROM pages),
f AS (SELECT page_id, host, i - 1 AS pos, hs[i] AS target, ts[i] AS alt FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM p)),
a AS (SELECT *, regexp_replace(regexp_replace(target, '[?#].*$', ''), '^/', '') AS asset_path FROM f WHERE target LIKE '/%' AND target NOT LIKE '//%')"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"), "html"), "host", "page_id", "path", g.links(F.col("html"))


@query("WITH " + LINKS_SQL + " SELECT host, asset_path, substr(sha256(host || ':' || asset_path), 1, 16) AS figure_id, count(*) AS n_references, min(page_id) AS first, arg_min(alt, (page_id, pos)) AS alt FROM a WHERE asset_path <> '' GROUP BY host, asset_path")
def s10_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("references", F.lit(0))
    return g.inventory(*_texts(spark, sf_dir))[0].select("host", "asset_path", "figure_id", "n_references", first["key"].alias("first"), first["alt"].alias("alt"))


@query("WITH " + LINKS_SQL + """, own AS (SELECT DISTINCT page_id, substr(sha256(host || ':' || asset_path), 1, 16) AS figure_id FROM a WHERE asset_path <> ''),
said AS (SELECT o.page_id + d AS page_id, o.figure_id FROM own o, (VALUES (0), (1)) v(d) WHERE o.page_id % 3 = 0)
SELECT DISTINCT said.page_id, said.figure_id FROM said JOIN own ON own.page_id = said.page_id AND own.figure_id = said.figure_id""")
def j07_borne_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a page shows a target, those of every third page for itself and for the next page; only those that a reference bears out stay."""
    found = g.references(*_texts(spark, sf_dir))
    own = found.select("figure_id", F.col("key").alias("page_id")).distinct().where("page_id % 3 = 0")
    said = own.union(own.select("figure_id", F.col("page_id") + 1)).distinct()
    return g.borne_out(said, found, "page_id").select("page_id", "figure_id")


@query("WITH " + LINKS_SQL + """, r AS (SELECT page_id, pos, substr(sha256(host || ':' || asset_path), 1, 16) AS figure_id, alt FROM a WHERE asset_path <> '' AND trim(alt) <> '')
SELECT page_id, figure_id, alt AS content, min(pos) AS pos, substr(sha256(page_id || ':' || figure_id || ':' || alt), 1, 24) AS chunk_id FROM r GROUP BY page_id, figure_id, alt""")
def j08_reviewed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each target, page and wording of a link, the first of equal ones."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    return g.reviewed_chunks(g.references(*_texts(spark, sf_dir)), pages, "page_id", F.col("alt")).select("page_id", "figure_id", "content", F.col("at").cast("long").alias("pos"), "chunk_id")
