"""Scores of a batch of queries, made where the corpus is read: a task emits its best rows of each query and nothing else.

``retrieval.hits`` keeps of each row its length and the terms that some query
has. From those, document frequencies are summed by term; the terms' weights
then go to the tasks, which score each row in place and keep the first ``k`` rows
of each query. What is shuffled afterwards is at most k rows a query and task,
however many rows share a term with it. Queries go in blocks of at most about
``BLOCK_TERMS`` (query, term) rows, one pass a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: (query, term) rows that every task gets at once.
BLOCK_TERMS = 200_000
#: Scores, and contributions to scores, that a task makes at once.
AT_ONCE = 500_000
#: Rows of a batch that a task looks through at once.
ROWS_AT_ONCE = 1_000
_NULL = -(1 << 63)


@dataclass
class Field:
    """One field of the rows: the columns of its hits and its length, and what it weighs."""

    hits: str = "hits"
    length: str = "len"
    weight: float = 1.0
    average: float = 1.0


@dataclass
class Formula:
    """A term adds weight * idf * tf * numerator / (tf + k (1 - b + b len / average)), or tf alone if ``counts``; ``multiplicity`` times its count in the query."""

    k: float = 1.2
    b: float = 0.75
    numerator: float = 2.2
    multiplicity: bool = False
    counts: bool = False

    def part(self, tf: np.ndarray, length: np.ndarray, field: Field) -> np.ndarray:
        if self.counts:
            return tf * field.weight
        return field.weight * tf * self.numerator / (tf + self.k * (1 - self.b + self.b * length / field.average))


@dataclass
class Block:
    """Queries of a block: terms, and for each the queries that have it with what it weighs there."""

    queries: list
    terms: list[str]
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    least: np.ndarray  # terms that a row must have, by query


def best_rows(found: DataFrame, terms: DataFrame, key: str, query: str, k: int | None, formula: Formula | None = None, fields: list[Field] | None = None, frequency_of: str | None = None, carry: list[str] | None = None, least_terms: int = 1, least_share: float = 0.0) -> DataFrame:
    """(query, key, score, n_terms, carry): rows of ``found`` for the queries of ``terms`` (query, term, qf), by falling score (to nine places) and rising key.

    At most ``k`` rows a query and task (all, if None) that have at least ``least_terms`` of its terms
    and ``least_share`` of them. Document frequencies are those of the field ``frequency_of`` (else
    the first). Keys are numbers or texts; of numbers, null comes first.
    """
    formula, fields, carry = formula or Formula(), fields or [Field()], carry or []
    counted = frequency_of or fields[0].hits
    about = found.agg(F.count("*").alias("n"), *[F.avg(f.length).alias(f"a{i}") for i, f in enumerate(fields)]).first()
    fields = [Field(f.hits, f.length, f.weight, max(about[f"a{i}"] or 1.0, 1.0) if len(fields) > 1 else about[f"a{i}"] or 1.0) for i, f in enumerate(fields)]
    df = found.select(F.explode(F.array_distinct(counted)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block).withColumn("all", F.count("*").over(_by(query)))
        rows = own.join(df, "term").select(query, "term", "qf", "df", "all").orderBy(query, "term").collect()
        part = _pass(found, _block(rows, about["n"], formula, least_terms, least_share), key, terms.schema[query], k, formula, fields, carry)
        out = part if out is None else out.union(part)
    return out


def _by(query: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(query)


def _block(rows: list, n: int, formula: Formula, least_terms: int, least_share: float) -> Block:
    queries = list(dict.fromkeys(r[0] for r in rows))
    of = {q: i for i, q in enumerate(queries)}
    terms = sorted({r["term"] for r in rows})
    at = {t: i for i, t in enumerate(terms)}
    rows = sorted(rows, key=lambda r: at[r["term"]])
    idf = np.log(1 + (n - np.array([r["df"] for r in rows]) + 0.5) / (np.array([r["df"] for r in rows]) + 0.5)) if rows and not formula.counts else np.ones(len(rows))
    weight = idf * (np.array([r["qf"] for r in rows], float) if formula.multiplicity else 1.0)
    place = np.array([at[r["term"]] for r in rows], np.int64)
    least = np.full(len(queries), least_terms, np.int64)
    for r in rows:
        least[of[r[0]]] = max(least_terms, int(np.ceil(least_share * r["all"] - 1e-9)))
    return Block(queries, terms, np.searchsorted(place, np.arange(len(terms) + 1)), np.array([of[r[0]] for r in rows], np.int64), weight, least)


def _pass(found: DataFrame, block: Block, key: str, query: StructField, k: int | None, formula: Formula, fields: list[Field], carry: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([query, found.schema[key], StructField("score", DoubleType()), StructField("n_terms", LongType()), *[found.schema[c] for c in carry]])
    arrow = to_arrow_schema(schema)
    shared = found.sparkSession.sparkContext.broadcast(block)
    names = list(dict.fromkeys([key, *carry, *[c for f in fields for c in (f.hits, f.length)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        task = _Task(own, k, key, carry)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                yield from task.add(b.slice(lo, ROWS_AT_ONCE), formula, fields, arrow)
        yield from task.rest(arrow)

    return found.select(*names).mapInArrow(run, schema)


class _Task:
    """What one task holds: its best rows so far."""

    def __init__(self, block: Block, k: int | None, key: str, carry: list[str]):
        self.block, self.k, self.key, self.carry = block, k, key, carry
        self.terms = pa.array(block.terms, pa.string())
        self.bar = np.full(len(block.queries), -np.inf)  # a row below this is not among the first k
        self.held: list[tuple] = []
        self.size = 0

    def matches(self, batch: pa.RecordBatch, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of a field, by row and term."""
        hits = batch.column(field.hits)
        row = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
        term = pc.fill_null(pc.index_in(hits.flatten().cast(pa.string()), value_set=self.terms), -1).to_numpy()
        there = term >= 0
        pair, tf = np.unique(row[there] * len(self.terms) + term[there], return_counts=True)
        return pair // max(len(self.terms), 1), pair % max(len(self.terms), 1), tf.astype(float)

    def add(self, batch: pa.RecordBatch, formula: Formula, fields: list[Field], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.block.queries or not batch.num_rows:
            return
        n_queries, uses = len(self.block.queries), np.diff(self.block.start)
        parts = [(*self.matches(batch, f), f) for f in fields]
        load = sum(np.bincount(row, uses[term], minlength=batch.num_rows) for row, term, _, _ in parts) + n_queries
        edges = np.searchsorted(np.cumsum(load), np.arange(AT_ONCE, load.sum() + AT_ONCE, AT_ONCE), "left") + 1
        lo = 0
        for hi in np.unique(np.minimum(edges, batch.num_rows)).tolist():
            if hi <= lo:
                continue
            size = (hi - lo) * n_queries
            score, count = np.zeros(size), np.zeros(size, np.int64)
            for i, (row, term, tf, field) in enumerate(parts):
                a, b = np.searchsorted(row, (lo, hi))
                r, t = row[a:b], term[a:b]
                length = batch.column(field.length).to_numpy(zero_copy_only=False)[r].astype(float)
                repeat = uses[t]
                flat = np.repeat(self.block.start[t], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                cell = np.repeat((r - lo) * n_queries, repeat) + self.block.query[flat]
                score += np.bincount(cell, np.repeat(formula.part(tf[a:b], length, field), repeat) * self.block.weight[flat], minlength=size)
                if i == 0 or len(fields) == 1:
                    count += np.bincount(cell, minlength=size)
                else:
                    count = np.maximum(count, np.bincount(cell, minlength=size))
            yield from self.offer(batch, lo, score.reshape(hi - lo, n_queries), count.reshape(hi - lo, n_queries), schema)
            lo = hi

    def offer(self, batch: pa.RecordBatch, lo: int, score: np.ndarray, count: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        row, query = np.nonzero((count >= self.block.least) & (count > 0) & (np.round(score, 9) >= self.bar))
        if not len(row):
            return
        at = pa.array(row + lo)
        self.held.append((query, score[row, query], count[row, query], batch.column(self.key).take(at), [batch.column(c).take(at) for c in self.carry]))
        self.size += len(row)
        if self.k is None:
            yield from self.rest(schema)
        elif self.size > 4 * self.k * len(self.block.queries) + AT_ONCE // 20:
            self.prune()

    def prune(self) -> None:
        query, score, count = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        key = pa.chunked_array([h[3] for h in self.held]).combine_chunks()
        carry = [pa.chunked_array([h[4][i] for h in self.held]).combine_chunks() for i in range(len(self.carry))]
        order = pc.fill_null(key, _NULL) if pa.types.is_integer(key.type) else key
        by = np.lexsort((order.to_numpy(zero_copy_only=False), -np.round(score, 9), query))
        first = np.flatnonzero(np.r_[True, query[by][1:] != query[by][:-1]]) if len(by) else np.empty(0, np.int64)
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        kept = by[place < self.k]
        last = by[place == self.k - 1]
        self.bar[query[last]] = np.round(score[last], 9)
        at = pa.array(kept)
        self.held, self.size = [(query[kept], score[kept], count[kept], key.take(at), [c.take(at) for c in carry])], len(kept)

    def rest(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.held and self.k is not None:
            self.prune()
        for query, score, count, key, carry in self.held:
            queries = pa.array([self.block.queries[q] for q in query.tolist()], schema.field(0).type)
            columns = [queries, key.cast(schema.field(1).type), pa.array(score), pa.array(count), *[c.cast(schema.field(4 + i).type) for i, c in enumerate(carry)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        self.held, self.size = [], 0
