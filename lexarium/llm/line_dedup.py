"""Line dedup by pairwise alignment: documents that share a rare line or a run of lines are aligned by patience diff.

Lines are compared after lower-casing and with white space collapsed; blank
lines take no part. Runs are the shortest stretches of at least ``BLOCK_WORDS``
words from each line on and up to each line; a line of so many words is a run
of its own, shorter ones are too common alone. A run that several documents hold makes a pair of
its first holder (least doc_id) with each later one, so a run held by n
documents makes n - 1 pairs, not n squared.

Each pair is aligned by patience diff: lines that occur once on both sides, in
the longest chain that keeps their order, grown over equal neighbours; between
them the same again. Aligned blocks of at least ``BLOCK_WORDS`` words are deleted
from the later document, and so are blocks of that size that were moved, which
alignment leaves. Each line of a common block lies in a run within the block,
and that run's first holder makes a pair, so every line of a block that any
earlier document holds goes, whichever other documents there are.

Within one document nothing is deleted for repeating itself. A null text is an
empty one; an empty table gives an empty one; very long texts are read whole,
and take time and memory in proportion to their lines. Rows without doc_id are kept as
they are. Rows of the same doc_id and text are one document; rows of one doc_id
with other texts come in the order of a hash of the text. Further columns are
kept, whatever their names. Joins by a very common line are left to Spark's
splitting of skewed partitions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import durable, spread, table, text_or_empty

BLOCK_WORDS = 10


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """(line number, hash, words) of the lines that aren't blank."""
    at, hashes, sizes = [], [], []
    for i, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(words)) >> 1)
            sizes.append(len(words))
    return at, hashes, sizes


def runs_of(hashes: list[int], sizes: list[int], least: int = BLOCK_WORDS) -> list[tuple[int, int, int]]:
    """(run hash, first line, line after the last) of the shortest stretches with enough words from each line on and up to each line."""
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    bounds = set()
    for i in range(len(hashes)):
        if (j := bisect_left(upto, upto[i] + least, i + 1)) < len(upto):
            bounds.add((i, j))
        if upto[i + 1] >= least:
            k = bisect_left(upto, upto[i + 1] - least + 1) - 1
            bounds.add((k, i + 1))
    packed = np.array(hashes, dtype=np.int64)
    return [(xxhash.xxh3_64_intdigest(packed[i:j].tobytes()) >> 1, i, j) for i, j in sorted(bounds)]


def anchors_of(hashes: list[int], sizes: list[int], block: int = BLOCK_WORDS) -> list[int]:
    """Hashes of the runs by which a document is paired."""
    return sorted({key for key, _, _ in runs_of(hashes, sizes, block)})


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first, whose second increases; of equally long ones that which ends last."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        before.append(ends[i - 1] if i else -1)
        if i == len(tails):
            tails.append(b)
            ends.append(k)
        else:
            tails[i], ends[i] = b, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines that patience diff aligns, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        times_a, times_b = Counter(a[a_lo:a_hi]), Counter(b[b_lo:b_hi])
        place = {h: i for i, h in enumerate(b[b_lo:b_hi], b_lo) if times_b[h] == 1}
        chain = _increasing([(i, place[h]) for i, h in enumerate(a[a_lo:a_hi], a_lo) if times_a[h] == 1 and h in place])
        if not chain:
            continue
        # an anchor opens the stretch behind it, which grows from there
        for (i, j), (i_next, j_next) in zip([(a_lo, b_lo), *chain], [*chain, (a_hi, b_hi)]):
            todo.append((i, i_next, j, j_next))
    return sorted(out)


def common_lines(early: tuple[list[int], list[int]], late: tuple[list[int], list[int]], block: int = BLOCK_WORDS) -> list[int]:
    """Places in ``late`` that go: aligned and moved blocks of at least ``block`` words. Each side: hashes, sizes."""
    hashes, sizes = late
    gone: set[int] = set()
    own: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(early[0], hashes), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if sum(sizes[k] for k in own) >= block:
                gone.update(own)
            own = []
        own.append(j)
        last = (i, j)
    there = {key for key, _, _ in runs_of(*early, block)}
    for key, i, j in runs_of(hashes, sizes, block):
        if key in there:
            gone.update(range(i, j))
    return sorted(gone)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int64()))])
    for rows in batches:
        cells: list[list] = [[], [], [], []]
        for text in rows.column(2).to_pylist():
            at, hashes, sizes = line_hashes(text)
            for cell, value in zip(cells, (at, hashes, sizes, anchors_of(hashes, sizes))):
                cell.append(value)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, f.type) for c, f in zip(cells, list(schema)[2:]))], schema=schema)


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("gone", pa.list_(pa.int32()))])
    for rows in batches:
        gone = []
        for at, hashes, sizes, early_hashes, early_sizes in zip(*(rows.column(i).to_pylist() for i in range(2, 7))):
            gone.append([at[i] for i in common_lines((early_hashes, early_sizes), (hashes, sizes))])
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(gone, schema.field(2).type)], schema=schema)


def _mark(text: str = "text") -> Column:
    """Tells rows of one doc_id apart: equal texts are equal."""
    return F.xxhash64(text_or_empty(text))


def deleted_lines(docs: DataFrame) -> DataFrame:
    """(doc, mark, gone): numbers of the lines that go from each later document, in order."""
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), _mark().alias("mark"), text_or_empty().alias("text"))
    lines = durable(keyed.mapInArrow(_line_rows, "doc long, mark long, at array<int>, hashes array<long>, sizes array<int>, anchors array<long>"))
    held = lines.select(F.struct("doc", "mark").alias("who"), F.explode("anchors").alias("anchor"))
    firsts = held.groupBy("anchor").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first <> last").select("anchor", "first")
    pairs = held.join(firsts, "anchor").where("first < who").select("who", "first").distinct()
    sides = lines.select(F.struct("doc", "mark").alias("who"), "at", "hashes", "sizes").where(F.size("hashes") > 0).dropDuplicates(["who"])
    early = sides.select(F.col("who").alias("first"), F.col("hashes").alias("early_hashes"), F.col("sizes").alias("early_sizes"))
    both = pairs.join(sides, "who").join(early, "first").select("who.doc", "who.mark", "at", "hashes", "sizes", "early_hashes", "early_sizes")
    parts = both.mapInArrow(_align_rows, "doc long, mark long, gone array<int>")
    return parts.where(F.size("gone") > 0).groupBy("doc", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def aligned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``__lines`` (array of its lines) and ``__gone`` (numbers of those to delete, null if none)."""
    gone = deleted_lines(docs).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__mark", _mark())
    return rows.join(gone, ["__doc", "__mark"], "left").drop("__doc", "__mark").withColumn("__lines", F.split(text_or_empty(), "\n", -1))


def _kept() -> Column:
    """The lines between those that go."""
    lines, gone = F.col("__lines"), F.col("__gone")
    before, behind = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(before, behind, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the aligned blocks taken from the text; documents of which nothing but blanks is left go.

    Documents without a deletion keep their text as it was, null and empty included.
    """
    # under names of their own, columns that are called like the operator's stay what they were
    own = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], "doc_id", "text")
    out = aligned(own).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_kept()))
    left = out.where(F.col("__gone").isNull() | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return left.select(*[F.col("text" if c.lower() == "text" else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.when(F.col("__gone").isNull(), text_or_empty()).otherwise(_kept())
    return aligned(docs).select(
        "doc_id", F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.array_join(F.coalesce("__gone", F.array().cast("array<int>")), ",").alias("deleted_lines"),
        F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


#: DuckDB: lines of runs of ten words that an earlier document holds too.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(lower(ls[i]), '\\s+', ' ', 'g')) AS s FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
n AS (SELECT doc_id, pos, s, len(string_split(s, ' ')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l WHERE s <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM n),
m AS (SELECT a.doc_id, a.p AS lo, b.p AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.upto + a.w >= 10),
r AS (SELECT doc_id, lo, min(hi) AS hi FROM m GROUP BY doc_id, lo UNION SELECT doc_id, max(lo), hi FROM m GROUP BY doc_id, hi),
k AS (SELECT r.doc_id, lo, hi, md5(string_agg(c.s, chr(10) ORDER BY c.p)) AS key FROM r JOIN c ON c.doc_id = r.doc_id AND c.p BETWEEN lo AND hi GROUP BY ALL),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM k JOIN f USING (key) JOIN c ON c.doc_id = k.doc_id AND c.p BETWEEN k.lo AND k.hi WHERE f.first < k.doc_id),
o AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS gone FROM g GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(string_agg(ls[i], chr(10) ORDER BY i), '') AS kept FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d) d
      LEFT JOIN g ON g.doc_id = d.doc_id AND g.pos = i - 1 WHERE g.pos IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted, coalesce(gone, '') AS deleted_lines,
       CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""
