"""What texts refer to: an inventory of targets with all their references, and rows about a target that its references bear out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Images in Markdown (alt, target) and the attributes of images in HTML.
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)"
HTML_IMAGE = r"(?i)<img\b[^>]*>"
SOURCE, ALT = r"""(?i)\bsrc\s*=\s*["']([^"']*)["']""", r"""(?i)\balt\s*=\s*["']([^"']*)["']"""


def images(text: Column) -> Column:
    """Array of (target, alt): images of Markdown first, then those of HTML, in their order."""
    marked = F.arrays_zip(F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), F.lit(2)).alias("target"), F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), F.lit(1)).alias("alt"))
    tags = F.transform(F.regexp_extract_all(text, F.lit(HTML_IMAGE), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, SOURCE, 1).alias("target"), F.regexp_extract(t, ALT, 1).alias("alt")))
    return F.filter(F.concat(marked, tags), lambda x: x["target"] != "")


def links(html: Column) -> Column:
    """The same for links of HTML."""
    pattern = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("target"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("alt"))


def resolved(document_path: Column, target: Column) -> Column:
    """The path that a relative or rooted target means; null if it names a host or scheme, is empty, or leaves the root."""
    bare = F.regexp_replace(F.url_decode(F.regexp_replace(target, r"%(?![0-9A-Fa-f]{2})", "%25")), r"[?#].*$", "")
    folder = F.when(F.startswith(bare, F.lit("/")), "").otherwise(F.regexp_replace(document_path, r"[^/]*$", ""))
    steps = F.filter(F.split(F.concat(folder, bare), "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside"))

    def step(state: Column, s: Column) -> Column:
        up, n = s == "..", F.size(state["path"])
        return F.struct(F.when(up, F.slice(state["path"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(state["path"], F.array(s))).alias("path"), (state["inside"] & (~up | (n > 0))).alias("inside"))

    end = lambda s: F.when(s["inside"] & (F.size(s["path"]) > 0), F.array_join(s["path"], "/"))
    return F.when(~target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)") & (bare != ""), F.aggregate(steps, start, step, end))


def _targets(texts: DataFrame, root: str, key: str, path: str, found: Column) -> DataFrame:
    """(root, key, at, alt, target, asset_path) of every target of ``texts``; asset_path is null where it doesn't resolve."""
    each = texts.select(root, F.col(key).alias("key"), path, F.posexplode(found).alias("at", "f"))
    return each.select(root, "key", "at", F.col("f.alt").alias("alt"), F.col("f.target").alias("target"), resolved(F.col(path), F.col("f.target")).alias("asset_path"))


def _figure_id(root: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", root, "asset_path"), 256), 1, 16)


def references(texts: DataFrame, root: str, key: str, path: str, found: Column) -> DataFrame:
    """(figure_id, asset_path, key, at, alt): all references that resolve, one a row, however many a target has."""
    known = _targets(texts, root, key, path, found).where("asset_path IS NOT NULL")
    return known.select(_figure_id(root).alias("figure_id"), "asset_path", "key", "at", "alt")


def inventory(texts: DataFrame, root: str, key: str, path: str, found: Column) -> tuple[DataFrame, DataFrame]:
    """((root, asset_path, figure_id, references), (root, external, unresolved)) of ``texts`` (root, key, path): ``found`` is its array of (target, alt).

    References of a target are counted and kept as (key, at, alt) in order of key and place; the first
    ``1000`` by that order are listed, ``n_references`` counts all; ``references`` has all as rows.
    """
    refs = _targets(texts, root, key, path, found)
    outside = F.col("target").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)")
    counts = refs.where("asset_path IS NULL").groupBy(root).agg(F.count_if(outside).alias("external"), F.count_if(~outside).alias("unresolved"))
    place = F.row_number().over(Window.partitionBy(root, "asset_path").orderBy("key", "at"))
    known = refs.where("asset_path IS NOT NULL")
    totals = known.groupBy(root, "asset_path").agg(F.count("*").alias("n_references"))
    listed = known.withColumn("place", place).where("place <= 1000").groupBy(root, "asset_path").agg(F.array_sort(F.collect_list(F.struct("key", "at", "alt"))).alias("references"))
    return totals.join(listed, [root, "asset_path"]).withColumn("figure_id", _figure_id(root)), counts


def _rows_of(figures: DataFrame) -> DataFrame:
    """Rows of ``references`` as they are, or the listed ones of an inventory."""
    if "references" not in figures.columns:
        return figures
    return figures.select("figure_id", "asset_path", F.explode("references").alias("r")).select("figure_id", "asset_path", "r.key", "r.at", "r.alt")


def borne_out(rows: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """Rows (figure_id, key ...) about a figure that a reference of it, by the same key, bears out. ``figures`` are all ``references``, or an inventory with those it lists."""
    return rows.join(_rows_of(figures).select("figure_id", F.col("key").alias(key)).distinct(), ["figure_id", key], "left_semi")


def reviewed_chunks(figures: DataFrame, sources: DataFrame, key: str, content: Column) -> DataFrame:
    """One row a figure and source (key ...) that refers to it, with a chunk_id by hash; the first reference of equal ids stays. ``figures`` as for ``borne_out``."""
    each = _rows_of(figures).withColumnRenamed("key", key)
    met = each.join(sources, key).withColumn("content", content).where(F.trim("content") != "")
    named = met.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "figure_id", "content"), 256), 1, 24))
    return named.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy(key, "at"))).where("k = 1").drop("k")
