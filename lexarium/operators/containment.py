"""Which texts hold which wanted texts whole, in one pass over the texts for a block of wanted ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of wanted texts that every task gets at once; more mean more passes.
BLOCK_CHARS = 4_000_000


def holders(texts: DataFrame, text: str, wanted: DataFrame, key: str, want: str) -> DataFrame:
    """(key, holders): how many rows of ``texts`` contain the wanted text, for those that any row contains.

    ``key`` is a long. Every text holds the empty one; null holds nothing and is held by nothing.
    """
    asked = wanted.where(F.col(want).isNotNull()).select(F.col(key).alias("key"), F.col(want).alias("want"))
    blocks = max(1, -(-(asked.agg(F.sum(F.length("want"))).first()[0] or 0) // BLOCK_CHARS))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("want"), F.lit(blocks)) == block).groupBy("want").agg(F.collect_list("key").alias("keys")).collect()
        part = _block(texts.select(F.col(text).alias("text")), [(r["want"], r["keys"]) for r in own])
        found = part if found is None else found.union(part)
    return found.groupBy("key").agg(F.sum("n").alias("holders")).withColumnRenamed("key", key)


def _block(texts: DataFrame, wanted: list[tuple[str, list[int]]]) -> DataFrame:
    import ahocorasick

    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, everywhere, counts = ahocorasick.Automaton(), [], Counter()
        for i, (w, _) in enumerate(shared.value):
            if w:
                machine.add_word(w, i)
            else:
                everywhere = [i]
        if len(machine):
            machine.make_automaton()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t is not None:
                    counts.update(everywhere)
                    if len(machine):
                        counts.update({i for _, i in machine.iter(t)})
        rows = [(key, n) for i, n in counts.items() for key in shared.value[i][1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["key", "n"])

    return texts.mapInArrow(count, "key long, n long")


def with_held(rows: DataFrame, text: str, wanted: list[str], name: str, lower: bool = False) -> DataFrame:
    """``rows`` with ``name``: which of the wanted texts (a batch's, so few) each text holds, in their order; found in one reading of it."""
    import ahocorasick
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StringType

    names = [c for c in rows.columns if c != name]
    schema = rows.select(*names).schema.add(name, ArrayType(StringType()))
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(sorted({w for w in wanted if w}))
    always = [""] if "" in wanted else []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            machine.add_word(w, i)
        if len(machine):
            machine.make_automaton()
        for b in batches:
            out = []
            for cell in b.column(names.index(text)):
                t = cell.as_py()
                t = t.lower() if lower and t else t
                found = sorted({i for _, i in machine.iter(t)}) if t and len(machine) else []
                out.append(None if t is None else always + [shared.value[i] for i in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow.field(len(names)).type)], schema=arrow)

    return rows.select(*names).mapInArrow(find, schema)
