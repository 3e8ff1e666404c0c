"""Evidence for requests that ask several things at once: all queries of all requests are answered by one pass over the corpus.

A request has queries (``query_no`` from 0: the first is the request itself),
some of which are requirements: clauses that want a witness of their own. Each
query's best views form a pool; pools are fused, requirements get seats, and the
context keeps few sources and few views of each. After the pass a request has at most
queries times budget rows, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.operators import retrieval as r
from lexarium.operators.scoring import Formula, best_rows

MAX_QUERIES = 9
RRF = 60


def queries_of(requests: DataFrame) -> DataFrame:
    """(request_id, query_no, query, requirement, symbols) from ``requests`` (request_id, queries: array of (query, requirement, symbols)): the first of equal texts, at most MAX_QUERIES a request."""
    rows = requests.select("request_id", F.posexplode("queries").alias("at", "q")).select("request_id", "at", "q.query", "q.requirement", "q.symbols")
    same = Window.partitionBy("request_id", "query")
    merged = rows.withColumn("first", F.min("at").over(same)).groupBy("request_id", "query", "first").agg(F.max("requirement").alias("requirement"), F.max_by("symbols", F.struct("requirement", -F.col("at"))).alias("symbols"))
    numbered = merged.withColumn("query_no", F.row_number().over(Window.partitionBy("request_id").orderBy("first")) - 1)
    return numbered.where(F.col("query_no") < MAX_QUERIES).select("request_id", "query_no", "query", "requirement", "symbols")


def pools(views: DataFrame, queries: DataFrame, view: str, text: str, budget: int, carry: dict[str, Column] | None = None, formula: Formula | None = None) -> DataFrame:
    """(request_id, query_no, view, rank, score, carry): the best ``budget`` views of each query."""
    carry = carry or {}
    named = queries.select(F.struct("request_id", "query_no").alias("q"), "query")
    numbered = r.durable(named.select(F.monotonically_increasing_id().alias("qid"), "q", "query"))  # ids must not change between reads
    terms = r.query_terms(numbered, "qid", "query")
    rows = views.select(view, text, *[c.alias(n) for n, c in carry.items()])
    found = best_rows(r.hits(rows, [view, *carry], text, terms), terms, view, "qid", budget, formula, carry=list(carry))
    best = r.top_k(found, "qid", budget, *r.best_first(view))
    return best.join(r.small(numbered.select("qid", "q")), "qid").select("q.request_id", "q.query_no", view, "rank", "score", *carry)


def fused(pooled: DataFrame, view: str, budget: int) -> DataFrame:
    """(request_id, view, weight, place) by reciprocal rank fusion; a request of one query keeps that query's order."""
    rows = pooled.groupBy("request_id", view).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("weight"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.round("weight", 12)), view))
    return rows.withColumn("place", place).where(F.col("place") <= budget)


def seats(pooled: DataFrame, candidates: DataFrame, queries: DataFrame, view: str, parent: str, held: Column, top_k: int) -> DataFrame:
    """(request_id, view, seat): each requirement's best candidate that holds its symbols, in the order of requirements.

    Seats are for at most ``top_k`` parents: a witness of a further parent gets none.
    ``held`` says, of the pooled row and ``symbols``, whether the row has them all.
    """
    asked = queries.where("requirement").select("request_id", "query_no", "symbols")
    met = pooled.join(asked, ["request_id", "query_no"]).join(candidates.select("request_id", view), ["request_id", view], "left_semi").where(held)
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("request_id", "query_no").orderBy("rank"))).where("k = 1")
    first = F.min("query_no").over(Window.partitionBy("request_id", parent))
    best = best.withColumn("first", first).withColumn("parents", F.dense_rank().over(Window.partitionBy("request_id").orderBy("first"))).where(F.col("parents") <= top_k)
    once = best.groupBy("request_id", view).agg(F.min("query_no").alias("query_no"))
    return once.select("request_id", view, F.row_number().over(Window.partitionBy("request_id").orderBy("query_no")).alias("seat"))


def source_bounded(ordered: DataFrame, view: str, parent: str, top_k: int, per_parent: int) -> DataFrame:
    """The first ``per_parent`` views of each of the first ``top_k`` parents of ``ordered`` (request_id, view, parent, o), with rank, the parent's place."""
    by_parent = Window.partitionBy("request_id", parent)
    rows = ordered.withColumn("nth", F.row_number().over(by_parent.orderBy("o"))).withColumn("first", F.min("o").over(by_parent))
    return rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("request_id").orderBy("first"))).where((F.col("rank") <= top_k) & (F.col("nth") <= per_parent)).drop("first", "nth")


def search(views: DataFrame, queries: DataFrame, view: str, parent: str, text: str, top_k: int = 5, budget: int = 80, per_parent: int = 4, held: Column | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """(request_id, rank, parent, score, views, seated): evidence of each request, one row a parent, its views in order.

    Seated views come first, then the fused order.
    """
    carry = {parent: F.col(parent), **(carry or {})}
    pooled = r.durable(pools(views, queries, view, text, budget, carry))
    candidates = fused(pooled, view, budget)
    seated = seats(pooled, candidates, queries, view, parent, F.lit(True) if held is None else held, top_k)
    known = pooled.groupBy("request_id", view).agg(F.first(parent).alias(parent))
    ordered = candidates.join(known, ["request_id", view]).join(seated, ["request_id", view], "left").withColumn("o", F.coalesce(F.col("seat"), F.col("place") + MAX_QUERIES))
    chosen = source_bounded(ordered, view, parent, top_k, per_parent)
    return chosen.groupBy("request_id", "rank", parent).agg(
        F.max("weight").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("o", view))), lambda x: x[view]).alias("views"), F.count("seat").alias("seated"))  # at most per_parent views


def batch_search(pooled: DataFrame, view: str, limit: int = 40, most: int = 8) -> DataFrame:
    """(request_id, place, view, check_no, checks): hits of a request's checks (request_id, check_no, view, rank) put together.

    Checks are fused to ``limit`` hits. A hit belongs to the first check that has it. Each check, in order, gives its
    best own hit by the fused order, then the fused order fills up to ``most``. A request of one check keeps its order.
    """
    fused_hits = pooled.groupBy("request_id", view).agg(
        F.sum(1.0 / (RRF + F.col("rank"))).alias("weight"), F.array_sort(F.collect_set("check_no")).alias("checks"), F.min("check_no").alias("check_no"))
    by_request = Window.partitionBy("request_id")
    listed = fused_hits.withColumn("fused", F.row_number().over(by_request.orderBy(F.desc(F.round("weight", 12)), view)))
    inside = F.when(F.col("fused") <= limit, F.col("fused"))  # hits beyond have no rank but may still be a check's own best
    seat = F.row_number().over(Window.partitionBy("request_id", "check_no").orderBy(F.coalesce(inside, F.lit(limit)), view)) == 1
    rows = listed.withColumn("seat", seat).where((F.col("fused") <= limit) | F.col("seat"))
    place = F.row_number().over(by_request.orderBy(F.when(F.col("seat"), 0).otherwise(1), F.when(F.col("seat"), F.col("check_no")), "fused"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("request_id", "place", view, "check_no", "checks")
