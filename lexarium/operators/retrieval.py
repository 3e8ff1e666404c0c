"""Lexical, dense and fused retrieval for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.functions.text import folded, index_terms
from lexarium.operators.graph import durable

#: Query terms are broadcast up to this many rows; beyond it the join is left to a shuffle.
BROADCAST_TERMS = 200_000


#: Query terms that are written into the plan as a set; more are joined.
LITERAL_TERMS = 20_000


def with_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, terms): the terms of each text in order."""
    return rows.select(*keys, folded(F.col(text)).alias("folded")).select(*keys, index_terms(F.col("folded")).alias("terms"))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return with_terms(rows, [key], text).select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_statistics(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, cf) without postings: both are summed by term before anything is shuffled."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    said = F.concat(
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), one.alias("df"), none.alias("cf"))),
        F.transform("terms", lambda t: F.struct(t.alias("term"), none.alias("df"), one.alias("cf"))),
    )
    return with_terms(rows, [key], text).select(F.inline(said)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, qf): distinct terms and how often each stands in the query."""
    return postings(queries, key, text).withColumnRenamed("tf", "qf")


def small(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``most`` rows; else leave the join to Spark. For query sides, which are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hits(rows: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(keys, len, hits) of each row: how many terms it has, and those that some query of ``terms`` has, repeats included.

    The corpus is read and cut once; all that a batch of queries needs is written and read again.
    """
    cut = with_terms(rows, keys, text)
    size = F.size("terms").cast("long").alias("len")
    wanted = terms.select("term").distinct()
    known = [r["term"] for r in wanted.limit(LITERAL_TERMS + 1).collect()]
    if len(known) <= LITERAL_TERMS:
        return durable(cut.select(*keys, size, F.filter("terms", lambda t: t.isin(known)).alias("hits")))
    cut = durable(cut)
    met = cut.select(*keys, F.explode("terms").alias("term")).join(small(wanted), "term", "left_semi").groupBy(*keys).agg(F.collect_list("term").alias("hits"))
    return durable(cut.select(*keys, size).join(met, keys, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>"))))


def frequencies(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, len, term, tf) of ``hits``."""
    return found.select(*keys, "len", F.explode("hits").alias("term")).groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))


def bm25(found: DataFrame, terms: DataFrame, key: str, query: str, k: float = 1.2, b: float = 0.75, numerator: float = 2.2, multiplicity: bool = False) -> DataFrame:
    """(query, key, score, n_terms) of ``hits``: BM25 with statistics of all rows, those without a hit included."""
    stats = found.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = frequencies(found, [key])
    wanted = terms.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
    met = tf.join(wanted, "term").join(F.broadcast(stats))
    part = bm25_part(k, b, numerator)
    if multiplicity:
        part = part * F.col("qf")
    return met.groupBy(query, key).agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))


def bm25_part(k: float = 1.2, b: float = 0.75, numerator: float = 2.2) -> Column:
    """What a term adds, of n, df, tf, len and avg_len."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * numerator / (F.col("tf") + k * ((1 - b) + b * F.col("len") / F.col("avg_len")))


def top_k(scored: DataFrame, query: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query in a total order, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def best_first(key: str, score: str = "score") -> tuple[Column, Column]:
    """By score, equal ones (to nine places) by key."""
    return F.desc(F.round(F.col(score), 9)), F.asc(key)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that every task gets at once; more are dealt with the vectors.
QUERY_BLOCK = 4096
#: Vectors that a task holds while queries stream past them.
TILE_ROWS = 32_768


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner products of ``queries`` (qid, q) with all ``vectors`` (vec_id, embedding).

    Up to QUERY_BLOCK queries are broadcast and vectors stay where they are read. More
    queries are dealt to tiles of about TILE_ROWS vectors, each of which a task
    holds while all queries stream past it; none of them goes through the driver. Scores are never all kept:
    a task sends on its best k of each query.
    """
    few = queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    found = _dense_block(vectors, queries.orderBy("qid").collect(), k) if few else _dense_tiles(vectors, queries, k)
    return top_k(found, "qid", k, *best_first("vec_id"))


def _nearest(q_ids, q, v_ids, v, k: int):
    import numpy as np
    import pandas as pd

    score = q @ v.T
    order = np.lexsort((np.broadcast_to(v_ids, score.shape), -np.round(score, 9)))[:, :k]
    return pd.DataFrame({"qid": np.repeat(q_ids, order.shape[1]), "vec_id": v_ids[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})


def _dense_block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    import numpy as np

    ids = np.array([r["qid"] for r in rows], dtype=np.int64)
    wanted = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r["q"] for r in rows], dtype=np.float64)))

    def best(batches):
        ids, q = wanted.value
        for pdf in batches:
            if not pdf.empty and len(ids):
                yield _nearest(ids, q, pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(np.float64), k)

    return vectors.select("vec_id", "embedding").mapInPandas(best, "qid long, vec_id long, score double")


def _dense_tiles(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    import numpy as np

    tiles = max(1, -(-vectors.count() // TILE_ROWS))
    held = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), F.lit(1).alias("kind"), F.col("qid").alias("id"), F.col("q").cast("array<double>").alias("v"))

    def best(batches):
        tile, ids, parts = None, [], []
        for pdf in batches:
            for (own, kind), rows in pdf.groupby(["tile", "kind"], sort=True):
                if own != tile:
                    tile, ids, parts = own, [], []
                v = np.stack(rows["v"].to_numpy())
                if kind == 0:
                    ids.append(rows["id"].to_numpy())
                    parts.append(v)
                    continue
                if not parts:
                    continue
                ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                for at in range(0, len(v), 64):  # so many rows of scores at once
                    yield _nearest(rows["id"].to_numpy()[at:at + 64], v[at:at + 64], ids[0], parts[0], k)

    return held.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "kind").mapInPandas(best, "qid long, vec_id long, score double")


def reciprocal_rank_fusion(rankings: DataFrame, query: str, key: str, k: int = 60, once: bool = False) -> DataFrame:
    """``rankings``: (query, list_id, key, rank). (query, key, rrf_score, lists).

    With ``once`` a repeat of a key in one list doesn't count again.
    """
    rows = rankings
    if once:
        rows = rankings.groupBy(query, "list_id", key).agg(F.min("rank").alias("rank"))
    return rows.groupBy(query, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.array_sort(F.collect_set("list_id")).alias("lists"))


def one_per_source(ranked: DataFrame, query: str, source: str, first: int) -> DataFrame:
    """New ranks: the first ``first`` stay, then the best row of each source not seen yet, then the rest."""
    seen = Window.partitionBy(query, source).orderBy("rank")
    kind = F.when(F.col("rank") <= first, 0).when(F.row_number().over(seen) == 1, 1).otherwise(2)
    return ranked.withColumn("kind", kind).withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy("kind", "rank"))).drop("kind")


def excerpt_budgets(candidates: DataFrame, query: str, chars: str, per_item: int, total: int) -> DataFrame:
    """Characters for each candidate: an equal share at first, what that leaves handed out in order."""
    own = Window.partitionBy(query)
    line = own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    base = F.least(F.lit(per_item), F.floor(F.lit(total) / F.count("*").over(own)), F.col(chars))
    rows = candidates.withColumn("base", base).withColumn("want", F.least(F.lit(per_item), F.col(chars)) - F.col("base"))
    left = F.lit(total) - F.sum("base").over(own) - F.coalesce(F.sum("want").over(line), F.lit(0))
    return rows.withColumn("budget", (F.col("base") + F.greatest(F.lit(0), F.least("want", left))).cast("long")).drop("base", "want")


def first_owner(searches: DataFrame, key: str, check: str) -> DataFrame:
    """Each key belongs to the first check that returned it."""
    w = Window.partitionBy(key).orderBy(check, "rank")
    return searches.withColumn("own", F.row_number().over(w)).where("own = 1").drop("own")


def coverage_order(searches: DataFrame, key: str, check: str, k: int) -> DataFrame:
    """One hit per check in check order, then all others by their global rank; the first ``k``."""
    owned = first_owner(searches, key, check)
    seat = F.row_number().over(Window.partitionBy(check).orderBy("rank"))
    order = Window.orderBy(F.when(F.col("seat") == 1, 0).otherwise(1), F.when(F.col("seat") == 1, F.col(check)), "rank", key)
    # at most k rows of each check can stay, so few rows meet in the last window
    return owned.withColumn("seat", seat).where(F.col("seat") <= k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
