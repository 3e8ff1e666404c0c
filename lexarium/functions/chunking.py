"""Cutting Markdown texts into headed parts of a bounded size, with DataFrame functions.

A text is an array of lines. Headings are marked by place; how deep each stands
and what stands above it are running values over the headings before it. The
lines between two headings are a body, whose paragraphs are packed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A heading is one to six # marks, white space and a title; blank lines part paragraphs.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
LEVELS = 6


def bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body, headings, content): the stripped text between headings, numbered in order, if there is any."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, LINE_END)).alias("line", "content"))
    level = F.length(F.regexp_extract("content", HEADING, 1))
    title = F.regexp_extract("content", HEADING, 2)
    order = Window.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select("*", level.alias("level"), title.alias("title"), F.sum(F.when(level > 0, 1).otherwise(0)).over(upto).alias("body"))
    # a heading of level n leaves n - 1 above it: each stands one deeper than the one before at most, and at most n deep
    depth = F.col("body") + F.least(F.lit(0), F.min(F.when(F.col("level") > 0, F.col("level") - F.col("body"))).over(upto))
    told = told.withColumn("depth", F.when(F.col("body") > 0, depth).otherwise(0))
    above = [F.last(F.when((F.col("level") > 0) & (F.col("depth") == d), F.col("title")), ignorenulls=True).over(upto) for d in range(1, LEVELS + 1)]
    told = told.withColumn("headings", F.slice(F.array(*above), 1, F.col("depth").cast("int")))
    return (
        told.groupBy(key, "body").agg(
            F.max("headings").alias("headings"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "content")))), lambda x: x["content"]), "\n").alias("content"),
        ).withColumn("content", stripped(F.col("content"))).where("content <> ''")
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def packed(content: Column, most: int) -> Column:
    """Array of parts: paragraphs joined while their characters (blank lines between them not counted twice) fit; a longer one is sliced."""
    def slices(p: Column) -> Column:
        own = F.when(F.length(p) <= most, F.array(F.struct(p.alias("text"), F.lit(True).alias("joins"))))
        return own.otherwise(F.transform(F.sequence(F.lit(1), F.length(p), F.lit(most)), lambda at: F.struct(F.substr(p, at, F.lit(most)).alias("text"), F.lit(False).alias("joins"))))

    pieces = F.flatten(F.transform(F.split(content, r"\n\s*\n"), slices))

    def step(parts: Column, piece: Column) -> Column:
        last = F.element_at(parts, -1)
        fits = piece["joins"] & (F.size(parts) > 0) & (F.length(last) + F.length(piece["text"]) <= most)
        joined = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", last, piece["text"])))
        return F.when(fits, joined).otherwise(F.concat(parts, F.array(piece["text"])))

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def cut(docs: DataFrame, key: str, text: str, most: int = 1250) -> DataFrame:
    """(key, part, headings, content): parts of each text, counted from 1. Texts of one key are one text only if the key is unique."""
    pieces = bodies(docs, key, text).select(key, "body", "headings", F.posexplode(packed(F.col("content"), most)).alias("at", "content"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("body", "at"))
    return pieces.select(key, place.alias("part"), "headings", stripped(F.col("content")).alias("content"))
