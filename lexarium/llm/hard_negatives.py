"""Hard negatives: for each anchor and positive, the best rows of other labels that score at most as high as the positive.

1. Candidates are sorted along a Hilbert curve (range partitions, ties parted by
   id) and written as Parquet in blocks of ``BLOCK_ROWS`` rows. The first row of a
   block carries its zone map: least and greatest entry by dimension, and the
   labels that occur. An anchor carries the score of its last wanted positive
   within its own block, which bounds what any other block must reach.
2. Zone maps meet the anchors in pages. Interval arithmetic gives the least and
   greatest score that a block's box allows; a block is read for an anchor only
   if they meet one of the anchor's windows (first: at least the bound of its
   positives; then: the score windows of its negatives) and a wanted label occurs.
3. What is chosen is written, one row for an anchor and a run of up to 63
   blocks with a bit for each block. Tiles of one run and at most about
   ``ANCHORS_A_TILE`` anchors go to tasks, which hold the run's chosen blocks as a
   matrix and stream the anchors past it. Scores are exact integers.

Bounds cannot exclude much among vectors without structure, then most blocks are read.

Rows with a null id, label or vector, an empty vector, or a null or non-finite
entry take no part. Vectors of different lengths do not meet. Rows of the
anchor's own id are never its positives or negatives; other repeated rows count as rows of
their own, in no stated order among equal ids. An anchor repeated with label and
vector is mined once. Anchors with fewer positives or negatives get what there
is; a positive below 0 has an empty window. Scores beyond 2**56 raise ValueError.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.llm._shared import shared_folder, spread, table

SCALE = 256
BLOCK_ROWS = 512
#: Blocks of a run; one bit of a long for each.
RUN_BLOCKS = 63
#: Anchors that meet a run in one task, about.
ANCHORS_A_TILE = 100_000
#: Zone maps that a task holds at a time, about.
PAGE_BLOCKS = 4096
#: Anchors of one matrix product.
BATCH = 128
#: Bits of an entry that enter the curve.
BITS = 4
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
FAR = 1 << 62


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds floor(256 x)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = spread(rows.select("vec_id", "label", vector)).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def hilbert(points: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each point (unsigned entries of ``bits`` bits) on the Hilbert curve, as bytes that sort alike."""
    x = [c.copy() for c in points.T]
    for level in range(bits - 1, 0, -1):  # undo the rotations of each finer cube
        bit, below = 1 << level, (1 << level) - 1
        for c in x:
            on = (c & bit) > 0
            swap = np.where(on, 0, (x[0] ^ c) & below)
            c ^= swap
            x[0] ^= np.where(on, below, swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0).astype(turn.dtype)
    code = np.stack(x, axis=1) ^ turn[:, None]
    levels = np.stack([(code >> level) & 1 for level in range(bits - 1, -1, -1)], axis=1).astype(np.uint8)
    return [r.tobytes() for r in np.packbits(levels.reshape(len(points), -1), axis=1)]


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors in an Arrow column."""
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)


def keyed(rows: DataFrame, least: int, greatest: int) -> DataFrame:
    """``rows`` with ``key``: length, then place on the curve."""
    step = max(1, -(-(greatest - least + 1) // (1 << BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[bytes] = [b""] * b.num_rows
            for at, m in by_length(b.column("v")):
                for i, k in zip(at.tolist(), hilbert((m - least) // step)):
                    keys[i] = m.shape[1].to_bytes(4, "big") + k
            yield b.append_column("key", pa.array(keys, pa.binary()))

    return rows.mapInArrow(run, "vec_id long, label int, v array<long>, anchor boolean, key binary")


BLOCKS = "run long, bit int, rid long, vec_id long, label int, v array<long>, anchor boolean, home long, lo array<long>, hi array<long>, labels array<int>"


def lists(m: np.ndarray, kind=None) -> pa.ListArray:
    flat = pa.array(m.ravel()) if kind is None else pa.array(m.ravel(), kind)
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), flat)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then rising id."""
    at = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def in_blocks(rows: DataFrame, exact, positives: int) -> DataFrame:
    """Sorted rows with their run, block, row id and, in each block's first row, its zone map."""

    def block(run: int, bit: int, first: int, ids, labels, m, anchor) -> pa.RecordBatch:
        n = len(ids)
        home: list[int | None] = [None] * n
        wide = m.astype(exact)
        for i in np.flatnonzero(anchor).tolist():
            scores = (wide @ wide[i])[(labels == labels[i]) & (ids != ids[i])]
            if len(scores) >= positives:
                home[i] = int(np.partition(scores, len(scores) - positives)[len(scores) - positives])
        head = [[x] + [None] * (n - 1) for x in (m.min(axis=0), m.max(axis=0), np.unique(labels))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, run)), pa.array(np.full(n, bit, np.int32)), pa.array(np.arange(first, first + n)), pa.array(ids), pa.array(labels, pa.int32()), lists(m), pa.array(anchor), pa.array(home, pa.int64()),
             pa.array(head[0], pa.list_(pa.int64())), pa.array(head[1], pa.list_(pa.int64())), pa.array(head[2], pa.list_(pa.int32()))],
            names=[c.split()[0] for c in BLOCKS.split(", ")],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        run, bit, made, held = base, 0, 0, None
        for b in batches:
            for at, m in by_length(b.column("v")):  # sorted by length
                own = [b.column(c).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in ("vec_id", "label")] + [m, b.column("anchor").take(pa.array(at)).to_numpy(zero_copy_only=False)]
                if held and held[2].shape[1] != m.shape[1]:
                    yield block(run, bit, base + made, *held)
                    run, bit, made, held = run + 1, 0, made + len(held[0]), None
                held = [np.concatenate(p) for p in zip(held, own)] if held else own
                while len(held[0]) >= BLOCK_ROWS:
                    yield block(run, bit, base + made, *[c[:BLOCK_ROWS] for c in held])
                    made, held = made + BLOCK_ROWS, [c[BLOCK_ROWS:] for c in held]
                    run, bit = (run + 1, 0) if bit + 1 == RUN_BLOCKS else (run, bit + 1)
        if held and len(held[0]):
            yield block(run, bit, base + made, *held)

    return rows.mapInArrow(work, BLOCKS)


def spans(lows: pa.Array, highs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows of anchors as two matrices, filled up with windows that nothing meets."""
    counts = np.diff(lows.offsets.to_numpy())
    lo, hi = np.full((len(lows), max(counts.max(initial=0), 1)), FAR), np.full((len(lows), max(counts.max(initial=0), 1)), -FAR)
    there = np.arange(lo.shape[1]) < counts[:, None]
    lo[there], hi[there] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
    return lo, hi


ANCHOR = "rid long, vec_id long, label int, v array<long>, lows array<long>, highs array<long>"


def streamed(first: DataFrame, second: DataFrame, by: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(rows of first, batches of second)`` for each value of ``by``: first is held by the task, second streams past it."""
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                cols = [b.column(c).to_numpy(zero_copy_only=False) for c in (*by, "kind")]
                cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else []
                for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                    if hi > lo:
                        yield tuple(int(c[lo]) for c in cols), b.slice(lo, hi - lo)

        for _, own in groupby(pieces(), key=lambda p: p[0][:-1]):
            held: list[pa.RecordBatch] = []
            ready = None
            for key, piece in own:
                if key[-1] == 0:
                    held.append(piece)
                elif held:
                    ready = ready or work(pa.Table.from_batches(held).combine_chunks())
                    yield from ready(piece)

    return both.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, "kind", *order).mapInArrow(run, schema)


def choose(zones: DataFrame, anchors: DataFrame, pages: int, same: bool, exact) -> DataFrame:
    """(run, mask, anchor) for the blocks that each anchor must read; ``same``: rows of its own label are wanted, else of others."""

    def work(held: pa.Table):
        groups = []
        for at, lo in by_length(held.column("lo").combine_chunks()):
            zone = held.take(pa.array(at))
            run, bit = (zone.column(c).to_numpy() for c in ("run", "bit"))
            order = np.lexsort((bit, run))
            labels = [set(zone.column("labels")[i].as_py()) for i in order.tolist()]
            hi = next(by_length(zone.column("hi").combine_chunks()))[1]
            groups.append((lo[order].astype(exact), hi[order].astype(exact), run[order], np.left_shift(np.int64(1), bit[order].astype(np.int64)), labels, {}))

        def wanted(labels, known, label: int) -> np.ndarray:
            if label not in known:
                known[label] = np.array([label in x if same else x != {label} for x in labels])
            return known[label]

        def go(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, m in by_length(rows.column("v")):
                for lo, hi, run, bit, labels, known in groups:
                    if lo.shape[1] != m.shape[1]:
                        continue
                    for a in range(0, len(at), BATCH):
                        own = rows.take(pa.array(at[a:a + BATCH]))
                        up, down = np.maximum(m[a:a + BATCH], 0).astype(exact), np.minimum(m[a:a + BATCH], 0).astype(exact)
                        most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                        lows, highs = spans(own.column("lows"), own.column("highs"))
                        need = np.zeros(most.shape, bool)
                        for j in range(lows.shape[1]):
                            need |= (most >= lows[:, j, None]) & (least <= highs[:, j, None])
                        need &= np.stack([wanted(labels, known, x) for x in own.column("label").to_pylist()])
                        i, b = np.nonzero(need)
                        if len(i):
                            starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (run[b][1:] != run[b][:-1])])
                            out = own.take(pa.array(i[starts])).select([c.split()[0] for c in ANCHOR.split(", ")])
                            yield out.append_column("run", pa.array(run[b][starts])).append_column("mask", pa.array(np.add.reduceat(bit[b], starts)))

        return go

    paged = zones.withColumn("page", F.pmod(F.xxhash64("run"), F.lit(pages)))
    everywhere = anchors.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    return streamed(paged, everywhere, ["page"], ["rid"], work, ANCHOR + ", run long, mask long")


def scored(blocks: DataFrame, chosen: DataFrame, found: Callable, tiles: int, exact, schema: str) -> DataFrame:
    """Rows of ``found(scores, candidate ids, candidate labels, anchor)`` over the chosen blocks of each tile."""
    chosen = chosen.withColumn("tile", F.pmod(F.xxhash64("rid"), F.lit(tiles)))
    needed = chosen.groupBy("run", "tile").agg(F.bit_or("mask").alias("needed"))
    candidates = (
        blocks.select("run", "bit", F.col("rid").alias("at"), F.col("vec_id").alias("id"), F.col("label").alias("of"), F.col("v").alias("w")).join(needed, "run")
        .where(F.expr("shiftright(needed, bit) & 1 = 1")).drop("needed")
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def work(held: pa.Table):
        w = held.column("w").combine_chunks()
        m = w.flatten().to_numpy().reshape(len(w), -1)
        ids, labels = held.column("id").to_numpy(), held.column("of").to_numpy()
        m = m.astype(exact).T

        def go(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a in range(0, rows.num_rows, BATCH):
                own = rows.slice(a, BATCH)
                scores = own.column("v").flatten().to_numpy().reshape(own.num_rows, -1).astype(exact) @ m
                out: list[tuple] = []
                anchors = zip(*(own.column(c).to_pylist() for c in ("rid", "vec_id", "label", "lows", "highs")))
                for s, anchor in zip(scores, anchors):
                    out += found(s.astype(np.int64), ids, labels, *anchor)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        return go

    return streamed(candidates, chosen, ["run", "tile"], ["at", "rid"], work, schema)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (vec_id, label, v of integers).

    A negative's score is from low to high percent of its positive's.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = rows.select("vec_id", "label", "v", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    n, n_anchors, least, greatest, d = rows.agg(F.count("*"), F.count_if("anchor"), F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    if not n_anchors:
        n_anchors, least, greatest, d = 0, least or 0, greatest or 0, d or 1
    largest = d * max(abs(least), abs(greatest)) ** 2
    if largest >= 1 << 56:
        raise ValueError(f"scores may reach {largest}, beyond 2**56")
    exact = np.float64 if largest < 1 << 52 else np.int64
    parts = max(1, -(-n // (BLOCK_ROWS * RUN_BLOCKS)), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)))
    along = keyed(rows, least, greatest).repartitionByRange(parts, "key", "vec_id", "label").sortWithinPartitions("key", "vec_id", "label").drop("key")
    blocks = kept(in_blocks(along, exact, positives), "blocks")
    zones = blocks.where("lo IS NOT NULL").select("run", "bit", "lo", "hi", "labels")
    pages, tiles = -(-zones.count() // PAGE_BLOCKS) or 1, -(-n_anchors // ANCHORS_A_TILE) or 1
    anchors = kept(blocks.where("anchor").select("rid", "vec_id", "label", "v", "home").dropDuplicates(["vec_id", "label", "v"]), "anchors")

    everything = anchors.select("rid", "vec_id", "label", "v", F.array(F.coalesce("home", F.lit(-FAR))).alias("lows"), F.array(F.lit(FAR)).alias("highs"))

    def nearest(scores, ids, labels, rid, vec_id, label, lows, highs) -> list[tuple]:
        at = np.flatnonzero((labels == label) & (ids != vec_id) & (scores >= lows[0]))
        return [(rid, int(ids[i]), int(scores[i])) for i in at[best(scores[at], ids[at], positives)].tolist()]

    hits = scored(blocks, kept(choose(zones, everything, pages, True, exact), "for_positives"), nearest, tiles, exact, "rid long, positive_id long, positive_score long")
    by_score = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    found = kept(hits.withColumn("j", F.row_number().over(by_score)).where(F.col("j") <= positives), "positives")

    window = found.where("positive_score >= 0").select("rid", "j", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"{high} * positive_score div 100").alias("high"))
    windows = window.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("j", "low", "high"))).alias("w"))  # at most ``positives`` entries
    wanted = anchors.join(windows, "rid").select("rid", "vec_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))

    def below(scores, ids, labels, rid, vec_id, label, lows, highs) -> list[tuple]:
        at = np.flatnonzero((labels != label) & (ids != vec_id) & (scores >= min(lows)) & (scores <= max(highs)))
        at = at[np.lexsort((ids[at], -scores[at]))]
        falling, out = -scores[at], []
        for j, (lo, hi) in enumerate(zip(lows, highs), 1):
            start, end = np.searchsorted(falling, -hi, "left"), np.searchsorted(falling, -lo, "right")
            out += [(rid, j, int(ids[i]), int(scores[i])) for i in at[start:min(end, start + negatives)].tolist()]
        return out

    misses = scored(blocks, kept(choose(zones, wanted, pages, False, exact), "for_negatives"), below, tiles, exact, "rid long, j long, negative_id long, negative_score long")
    ranked = misses.withColumn("rank", F.row_number().over(Window.partitionBy("rid", "j").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= negatives)
    # row numbers of the windows with a score of 0 or more are those of the positives, which fall
    return (
        ranked.join(found.withColumn("j", F.col("j").cast("long")), ["rid", "j"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


#: DuckDB: all scores of the anchors, ranked twice.
ORACLE = """
WITH e AS (SELECT vec_id, label, i, floor(256 * x) AS x FROM (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0)),
r AS (SELECT vec_id, label, list(x ORDER BY i) AS v FROM e GROUP BY ALL HAVING bool_and(x IS NOT NULL AND isfinite(x))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
