"""Retrieval quality from ranked hits, and gates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positive_hits(hits: DataFrame, case: str, document: str) -> DataFrame:
    """Finite positive scores, the first hit of each document, ranks anew from 1."""
    good = hits.where((F.col("score") > 0) & ~F.isnan("score"))
    first = good.withColumn("__d", F.row_number().over(Window.partitionBy(case, document).orderBy("rank"))).where("__d = 1").drop("__d")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("rank")))


def per_case(hits: DataFrame, required: DataFrame, case: str, document: str, k: int) -> DataFrame:
    """Per case: required sources, found at k, complete, reciprocal ranks by two definitions, nDCG.

    ``hits``: (case, document, rank) as from positive_hits; ``required``: (case, document), distinct.
    """
    need = required.groupBy(case).agg(F.count("*").alias("required"))
    met = hits.where(F.col("rank") <= k).join(required, [case, document])
    found = met.groupBy(case).agg(
        F.count("*").alias("found"), F.sum(1 / F.col("rank")).alias("rr_sum"), F.min("rank").alias("first"),
        F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("required"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return need.join(found, case, "left").select(
        case, "required", zero("found").alias("found"), (zero("found") == F.col("required")).alias("complete"),
        (F.coalesce("rr_sum", F.lit(0.0)) / F.col("required")).alias("rr_all"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr_first"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def overall_and_by(rows: DataFrame, category: str, *aggregates: Column) -> DataFrame:
    """The same aggregates by category and over all (category null)."""
    grouped = rows.rollup(category).agg(F.grouping(category).alias("is_total"), *aggregates)
    return grouped


def nearest_rank(values: Column, share: float) -> Column:
    """The value at ceil(n * share), as against the interpolated percentile."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.greatest(F.ceil(F.size(ordered) * share), F.lit(1)).cast("int"))
