"""Embedding whitening with distributed block matrices.

Entries become integers, x = floor(1024 c) + 100000, so that the sums of the fit
list are exact. Centred rows are cut into blocks inside the tasks that read
them and written once; a ``BlockMatrix`` over them is multiplied by its own
transpose for the scatter matrix, which alone (its size is that of a vector,
squared) comes to the driver for ``eigh``. For the projection the same blocks
are laid out as a square grid and multiplied by a block-diagonal matrix that
holds the whitening matrix once a grid column: MLlib deals a product's blocks
over the two sides of its grid, so a single column of blocks would go to few tasks.

Rows that take no part: null vectors, empty ones, and vectors with an entry that
is null, not finite or of magnitude 2**38 or more (its x has no exact sums).
A BlockMatrix has one number of columns: vectors of another length than the commonest
(of two equally common, the longer) take no part either. Repeated rows and
repeated or null ids count as rows of their own. Components without
variance (fewer rows than dimensions, constant entries) have ``whitened`` 0 and
do not enter the identity error. A deviation beyond 64 bits is null in
``deviation`` and exact in ``deviation_exact``. An empty table gives no rows.
Of further columns only the id and the vector are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lexarium.llm._shared import shared_folder, spread, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bytes of a block of centred rows; a task of a product holds some blocks at a time.
BLOCK_BYTES = 1 << 22
#: Blocks that one task of the scatter product multiplies.
BLOCKS_A_TASK = 8
#: Entries of this magnitude or more have no exact sums.
LARGEST = float(1 << 38)
EXACT = DecimalType(38, 0)


@dataclass
class Fit:
    """What the fit list determines; vectors are of length d."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors in columns
    explained: np.ndarray

    def whitening(self, k: int) -> np.ndarray:
        """d x k; zero columns for components without variance."""
        e = self.values[:k]
        own = e > max(self.values[0], 0.0) * len(self.sums) * 1e-12
        return self.vectors[:, :k] * np.where(own, 1 / np.sqrt(np.where(own, e, 1.0)), 0.0)


def usable(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(key, v) of the rows that take part, v as doubles."""
    v = F.col(f"`{column}`").cast("array<double>")
    rows = spread(rows.select(F.col(f"`{key}`").alias("key"), v.alias("v")))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))


def integers(column: pa.Array) -> np.ndarray:
    """x of the vectors of an Arrow column, all of one length: rows x length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and sums by dimension of the vectors of the commonest length; (0, []) if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            lengths = np.diff(b.column(0).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                x = integers(b.column(0).filter(pa.array(lengths == d)))
                n, sums = found.get(d, (0, 0))
                found[d] = (n + len(x), sums + x.sum(axis=0).astype(object))
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))], names=["d", "n", "sums"]
            )

    parts = rows.select("v").mapInArrow(run, "d int, n long, sums array<decimal(38,0)>")
    by_place = (
        parts.select("d", "n", F.posexplode("sums").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast(EXACT).alias("s"))
        .groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))  # d entries of one length
    )
    best = by_place.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return (best[0]["n"], [int(p["s"]) for p in best[0]["sums"]]) if best else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """Centred rows, and the exact sums over dimensions of (n x - S)^2."""
    wide = n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 61 or max(map(abs, sums)) >= 1 << 61
    y = x.astype(object) * n - np.array(sums, dtype=object) if wide else x * n - np.array(sums, dtype=np.int64)
    most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
    squares = y * y if most * most * y.shape[1] < 1 << 63 else y.astype(object) ** 2
    return y.astype(np.float64) / n, [int(s) for s in squares.sum(axis=1)]


def matrix(values: np.ndarray) -> dict:
    """A dense matrix as Spark stores it, row after row."""
    return {"type": 1, "numRows": values.shape[0], "numCols": values.shape[1], "colPtrs": None, "rowIndices": None, "values": values.ravel(), "isTransposed": True}


def write_blocks(rows: DataFrame, n: int, sums: list[int], folder: str) -> DataFrame:
    """Centred rows in blocks, written once: (block, keys, deviations, matrix), blocks numbered from 0 without gaps."""
    d = len(sums)
    height = max(1, BLOCK_BYTES // (8 * d))
    schema = StructType([
        StructField("part", LongType()), StructField("k", LongType()), StructField("keys", ArrayType(rows.schema["key"].dataType)),
        StructField("deviations", ArrayType(EXACT)), StructField("matrix", MatrixUDT()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, keys, held = TaskContext.get().partitionId(), 0, [], np.empty((0, d), np.int64)

        def block(size: int) -> pa.RecordBatch:
            centred, deviation = deviations(held[:size], n, sums)
            own = ([part], [k], [keys[:size]], [[Decimal(s) for s in deviation]], [matrix(centred)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, arrow)], schema=arrow)

        for b in batches:
            held = np.concatenate([held, integers(b.column(1))])
            keys += b.column(0).to_pylist()
            while len(keys) >= height:
                yield block(height)
                keys, held, k = keys[height:], held[height:], k + 1
        if keys:
            yield block(len(keys))

    rows.where(F.size("v") == d).select("key", "v").mapInArrow(run, schema).write.parquet(folder)
    blocks = rows.sparkSession.read.parquet(folder)
    by_part = blocks.groupBy("part").agg(F.count("*").alias("n"))  # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(offsets, "part").select((F.col("offset") + F.col("k")).alias("block"), "keys", "deviations", "matrix")


def block_matrix(blocks: DataFrame, row, column, height: int, width: int, rows: int, columns: int) -> BlockMatrix:
    placed = blocks.select(F.struct(row.cast("long"), column.cast("long")), "matrix")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", placed, height, width, rows, columns), height, width)


def fit(blocks: DataFrame, n: int, sums: list[int], n_blocks: int) -> Fit:
    """Eigenvalues and eigenvectors of the covariance of the blocks' rows."""
    d = len(sums)
    height = max(1, BLOCK_BYTES // (8 * d))
    a = block_matrix(blocks, F.col("block"), F.lit(0), height, d, n_blocks * height, d)._java_matrix_wrapper._java_model
    product = a.transpose().multiply(a, -(-n_blocks // BLOCKS_A_TASK))  # the second argument parts the common side among tasks
    scatter = BlockMatrix(product, d, d).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(scatter)) / n
    return Fit(n, sums, values, vectors, np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(d))


def project(blocks: DataFrame, w: np.ndarray, n_blocks: int) -> DataFrame:
    """(key, deviation_exact, whitened) of each row: its centred vector times ``w``."""
    spark = blocks.sparkSession
    d, k = w.shape
    height, side = max(1, BLOCK_BYTES // (8 * d)), int(np.ceil(np.sqrt(n_blocks)))
    one = StructType([StructField("id", LongType()), StructField("matrix", MatrixUDT())])
    arrow = to_arrow_schema(one)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([matrix(w)], arrow.field(1).type)], schema=arrow)

    diagonal = spark.range(0, side, 1, min(side, spark.sparkContext.defaultParallelism)).mapInArrow(copies, one)
    a = block_matrix(blocks, F.floor(F.col("block") / side), F.col("block") % side, height, d, -(-n_blocks // side) * height, side * d)
    product = a.multiply(block_matrix(diagonal, F.col("id"), F.col("id"), d, k, side * d, side * k))
    made = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("at", "product").select((F.col("at._1").cast("long") * side + F.col("at._2")).alias("block"), "product")
    key = blocks.schema["keys"].dataType.elementType
    schema = StructType([StructField("key", key), StructField("deviation_exact", EXACT), StructField("whitened", ArrayType(DoubleType()))])
    out = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = b.column(2)[i]
                z = np.array(m["values"].values, dtype=np.float64)
                z = z.reshape(-1, k) if m["isTransposed"].as_py() else z.reshape(k, -1).T
                whitened = pa.ListArray.from_arrays(np.arange(0, z.size + 1, k, dtype=np.int32), z.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values.cast(out.field(0).type), b.column(1)[i].values.cast(out.field(1).type), whitened.cast(out.field(2).type)], schema=out)

    return blocks.select("block", "keys", "deviations").join(made, "block").select("keys", "deviations", "product").mapInArrow(rows, schema)


def identity_error(whitened: DataFrame, n: int, own: list[int]) -> float:
    """Largest absolute entry of the covariance of the components ``own`` of ``whitened`` minus the identity."""
    if not own:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                z = np.column_stack([np.ones(b.num_rows), b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)[:, own]])
                total = total + z.T @ z
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], names=["i", "s"])

    sums = whitened.select("whitened").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # (components + 1)^2 numbers
    z = np.array([r["s"] for r in sums]).reshape(len(own) + 1, -1) / n
    return float(np.abs(z[1:, 1:] - np.outer(z[1:, 0], z[0, 1:]) - np.eye(len(own))).max())


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> tuple[DataFrame, Fit | None, float]:
    """((key, deviation_exact, whitened) of each row that takes part, the fit, the identity error); no fit without rows."""
    spark = rows.sparkSession
    rows = usable(rows, column, key)
    n, sums = totals(rows)
    if not n:
        schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("deviation_exact", EXACT), StructField("whitened", ArrayType(DoubleType()))])
        return spark.createDataFrame([], schema), None, 0.0
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    blocks = write_blocks(rows, n, sums, f"{folder}/blocks")
    n_blocks = blocks.count()
    found = fit(blocks, n, sums, n_blocks)
    w = found.whitening(min(components, len(sums)))
    project(blocks, w, n_blocks).write.parquet(f"{folder}/rows")
    done = spark.read.parquet(f"{folder}/rows")
    return done, found, identity_error(done, n, np.flatnonzero(w.any(axis=0)).tolist())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, found, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = [float(x) for x in found.explained[:COMPONENTS]] if found else []
    fits = F.col("deviation_exact") <= F.lit(Decimal((1 << 63) - 1)).cast(EXACT)
    return done.select(
        F.col("key").alias("vec_id"), "deviation_exact", F.when(fits, F.col("deviation_exact")).cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id", (F.col("at") + 1).cast(IntegerType()).alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.lit(explained).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
