"""Running state over long cases, cut into segments: what a segment needs to know of earlier ones is carried as a few numbers, so no case is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stalled(rows: DataFrame, case: str, order: list[str], value: Column, segment: Column, window: int) -> DataFrame:
    """Rows of ``rows`` at which ``window`` rows of their case have brought no value above all before; told once until the next such value.

    ``segment`` must not fall along ``order``. A case's segments, of which only counts and greatest values are kept, are
    put in order in one task; its rows never are. Null and NaN bring nothing. Order must be total within a case.
    """
    own = Window.partitionBy(case, "__segment").orderBy(*order)
    earlier = Window.partitionBy(case).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    cut = rows.withColumn("__segment", segment).withColumn("__v", number).withColumn("__i", F.row_number().over(own)).withColumn("__best", F.max("__v").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    totals = cut.groupBy(case, "__segment").agg(F.count("*").alias("n"), F.max("__v").alias("m"))
    carried = totals.select(case, "__segment", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), F.max("m").over(earlier).alias("__top"))
    known = cut.join(carried, [case, "__segment"]).withColumn("__at", F.col("__before") + F.col("__i"))
    bar = F.greatest("__best", "__top")
    known = known.withColumn("__progress", F.when(F.col("__v").isNotNull() & (bar.isNull() | (F.col("__v") > bar)), F.col("__at")))
    last = known.groupBy(case, "__segment").agg(F.max("__progress").alias("p"))
    before = last.select(case, "__segment", F.max("p").over(earlier).alias("__last"))
    here = F.max("__progress").over(own.rowsBetween(Window.unboundedPreceding, 0))
    told = known.withColumn("__here", here).join(before, [case, "__segment"])
    return told.where(F.col("__at") - F.coalesce("__here", "__last", F.lit(0)) == window).select(*rows.columns)
