"""Compound terms of queries, written as the vocabulary has them: hyphens taken apart or neighbours joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that no compound is made of.
STOP_TERMS = (
    "what is the a an of for to does do how which in on from and or can could would with "
    "如何 怎么 什么 哪些 是否 可以 通过 并通 过命 令行 行参 数启 用或 或禁 用模 请问 请 吗 的 与 和 从 到 中 里 了 吗？ 呢"
).split()


def _known(queries: DataFrame, key: str, wanted: Column, vocabulary: DataFrame) -> DataFrame:
    """``queries`` with ``known``: those of the wanted terms that the vocabulary (term) has. The vocabulary is met once, by a semi-join from its side."""
    asked = queries.select(key, F.explode(F.array_distinct(wanted)).alias("term"))
    there = vocabulary.select("term").join(asked.select("term").distinct(), "term", "left_semi").distinct()
    found = asked.join(there, "term").groupBy(key).agg(F.collect_set("term").alias("known"))  # terms of one query
    return queries.join(found, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def compound_aliases(queries: DataFrame, key: str, terms: str, vocabulary: DataFrame) -> DataFrame:
    """``queries`` with ``aliased``: a hyphened term that the vocabulary lacks becomes its parts if it has all of them; then,
    from left to right, two neighbours become a compound if it has that and neither is a stop term. Keys must be unique.
    """
    parts = lambda t: F.filter(F.split(t, "-"), lambda p: p != "")
    hyphened = F.filter(terms, lambda t: F.contains(t, F.lit("-")))
    rows = _known(queries, key, F.concat(hyphened, F.flatten(F.transform(hyphened, parts))), vocabulary)

    def apart(t: Column) -> Column:
        lacks = F.contains(t, F.lit("-")) & ~F.array_contains("known", t)
        return F.when(lacks & (F.size(parts(t)) > 1) & F.forall(parts(t), lambda p: F.array_contains("known", p)), parts(t)).otherwise(F.array(t))

    rows = rows.withColumn("split", F.flatten(F.transform(terms, apart))).drop("known")
    usual = lambda t: ~t.isin(STOP_TERMS)
    pairs = F.zip_with(F.slice("split", 1, F.greatest(F.size("split") - 1, F.lit(0))), F.slice("split", 2, F.greatest(F.size("split") - 1, F.lit(0))), lambda a, b: F.when(usual(a) & usual(b), F.concat_ws("-", a, b)))
    rows = _known(rows, key, F.array_compact(pairs), vocabulary)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, t: Column) -> Column:
        both = F.concat_ws("-", state["open"], t)
        joins = state["open"].isNotNull() & usual(state["open"]) & usual(t) & F.array_contains("known", both)
        done = F.when(joins, F.concat(state["done"], F.array(both))).when(state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(~joins, t).alias("open"))

    end = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return rows.withColumn("aliased", F.aggregate("split", start, step, end)).drop("known", "split")
