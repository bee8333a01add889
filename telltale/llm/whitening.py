"""Whitening of embeddings: rows as a distributed block matrix, its scatter, and the projection on its scaled components.

Rows are cut into matrix blocks inside the tasks that read them, so that one written table of blocks is the matrix. MLlib multiplies it by
its own transpose, the eigenvectors of that small product are found on the driver, and a second product projects the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions.numbers import is_finite
from telltale.llm.rows import small
from telltale.session import materialise, scratch_scope

BLOCK_VALUES = 1 << 16
LARGEST_ENTRY = 2.0**40
_MATRIX = MatrixUDT()
_SQL_MATRIX = MatrixUDT.sqlType()
_BLOCK = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("deviations", T.ArrayType(T.LongType())),
        T.StructField("matrix", _SQL_MATRIX),
    ]
)


def steps(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fine: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x``: every entry ``c`` as the whole number ``floor(fine c) + shift``. Rows without a usable vector are left out.

    Usable is a vector without null and non-finite entries; entries beyond 2^40, whose steps a double can't tell apart, count as non-finite.
    """
    entry = lambda c: F.coalesce(is_finite(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST_ENTRY), F.lit(False))
    usable = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull() & F.forall("vector", entry))
    return usable.select("vec_id", F.transform("vector", lambda c: F.floor(c.cast("double") * fine).cast("long") + F.lit(shift).cast("long")).alias("x"))


def whiten(
    vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", fine: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    The mean, the covariance and so the components are those of the *fit list*, which holds each distinct vector of ``steps`` once (``n`` of them); all rows are projected on them.
    ``deviation`` is the sum over dimensions of ``(n x - S)²``, with S the fit list's sums, null where a long can't hold it. ``whitened`` is the centred row's component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` how far the whitened fit list's covariance is from the identity at most.

    Vectors that are null, or hold null or non-finite entries, are left out, and so are those of another width than most rows have (the larger of two equally frequent ones). Components
    without variance can't be whitened and give no rows: one distinct vector, or empty vectors, give an empty result, as does an empty table. Repeated ids and null ids keep a row each; only the named columns are read.
    """
    spark = vectors.sparkSession
    rows = steps(vectors, id_col, vector_col, fine, shift)
    fields = [rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    nothing = spark.createDataFrame([], schema)
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.col("count").desc(), F.col("width").desc()).first()
    if common is None or common["width"] == 0:
        return nothing
    width = common["width"]
    rows = rows.where(F.size("x") == width)
    with scratch_scope(spark):
        fit = materialise(rows.select("x").distinct(), "fit-list")
        n, sums = _sums(fit, width)
        blocks, count = _blocks(fit.select(F.lit(None).cast("int").alias("vec_id"), "x"), n, sums)
        scatter = _product(_matrix(blocks, width, count), width, count)
    covariance = scatter / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > values[0] * width * np.finfo(float).eps if values[0] > 0 else np.zeros(width, bool)
    wanted = int(real[:components].sum())
    if not wanted:
        return nothing
    weights = axes[:, :wanted] / np.sqrt(values[:wanted])
    error = float(np.abs(weights.T @ covariance @ weights - np.eye(wanted)).max())
    blocks, count = _blocks(rows, n, sums)
    projected = _projected(spark, _matrix(blocks, width, count), weights)
    joined = blocks.select("block", "ids", "deviations").join(projected, "block").drop("block")
    return joined.mapInArrow(_unfold(n, (values / np.trace(covariance))[:wanted], error, schema), schema)


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of vectors and their sum, exact; each task sends one row."""

    def run(batches):
        n, total = 0, np.zeros(width, np.int64)
        for batch in small(batches):
            n += batch.num_rows
            total += _values(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "total"])

    parts = fit.mapInArrow(run, "n long, total array<long>").select("n", F.posexplode("total").alias("at", "sum"))
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).orderBy("at").collect()
    return found[0]["n"], np.array([r["sum"] for r in found], np.int64)


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(rows: DataFrame, n: int, sums: np.ndarray) -> tuple[DataFrame, int]:
    """``rows`` (``vec_id, x``) as a written table of matrix blocks of centred rows, with ``block``: the number of each, from 0 without gaps; and their count.

    A task's last block is filled up with rows of zeros, which add nothing to a product, so no row leaves the task that reads it.
    """
    width = len(sums)
    height = block_height(width)
    fields = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), *_BLOCK.fields])
    types = pa.struct([pa.field(f.name, kind) for f, kind in zip(_SQL_MATRIX.fields, (pa.int8(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.bool_()), strict=True)])
    largest = float(np.abs(sums).max(initial=0))

    def block(part, place, ids, x):
        if float(np.abs(x).max(initial=0)) * n + largest < 2**62:
            far = x * n - sums
        else:
            far = x.astype(object) * n - sums.astype(object)
        if float(np.abs(far).max(initial=0)) ** 2 * width < 2**62:
            deviations = (far * far).sum(axis=1).tolist()
        else:
            deviations = [d if d < 2**63 else None for d in (sum(v * v for v in row) for row in far.astype(object).tolist())]
        centred = np.zeros((height, width))
        centred[: len(x)] = far.astype(float) / n
        arrays = [pa.array([1], pa.int8()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
        arrays += [pa.ListArray.from_arrays(pa.array([0, height * width], pa.int32()), pa.array(centred.ravel())), pa.array([True])]
        matrix = pa.StructArray.from_arrays(arrays, fields=list(types))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([len(x)], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([deviations], pa.list_(pa.int64())), matrix], names=fields.names)

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        ids, x, held = [], [], 0
        for batch in small(batches):
            start = 0
            values = _values(batch.column(1), width)
            while start < batch.num_rows:
                taken = min(height - held, batch.num_rows - start)
                ids.append(batch.column(0).slice(start, taken)), x.append(values[start : start + taken])
                start, held = start + taken, held + taken
                if held == height:
                    yield block(part, place, pa.concat_arrays(ids), np.concatenate(x))
                    place, ids, x, held = place + 1, [], [], 0
        if held:
            yield block(part, place, pa.concat_arrays(ids), np.concatenate(x))

    plain = rows.mapInArrow(run, fields)
    typed = T.StructType([T.StructField("matrix", _MATRIX) if f.name == "matrix" else f for f in fields])
    stored = materialise(plain, "blocks", typed)
    # One row per task, so the window and the broadcast are bounded by their number.
    before = F.sum("blocks").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = stored.groupBy("part").agg(F.count(F.lit(1)).alias("blocks")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(offsets), "part").withColumn("block", F.col("offset") + F.col("place")).drop("part", "place", "offset"), stored.count()


def block_height(width: int) -> int:
    """Rows of a block: about 512 kB of numbers."""
    return max(16, min(1024, BLOCK_VALUES // width))


def _matrix(blocks: DataFrame, width: int, count: int):
    """MLlib's block matrix of a table of blocks."""
    place = F.struct(F.col("block").cast("long").alias("blockRowIndex"), F.lit(0).cast("long").alias("blockColIndex"))
    height = block_height(width)
    return callMLlibFunc("createBlockMatrix", blocks.select(place.alias("blockid"), F.col("matrix").alias("subMatrix")), height, width, count * height, width)


def _product(matrix, width: int, blocks: int) -> np.ndarray:
    """Transpose times matrix. The long side is split, so that a task holds few blocks and only its sum of products moves on."""
    splits = max(1, min(blocks, max(-(-blocks // 64), 32)))
    return BlockMatrix(matrix.transpose().multiply(matrix, splits), width, width, width, width).toLocalMatrix().toArray()


def _projected(spark: SparkSession, matrix, weights: np.ndarray) -> DataFrame:
    """``block, values, by_rows``: each block times ``weights``."""
    table = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*weights.shape, weights.ravel("F").tolist()))], 1)
    right = BlockMatrix(table, *weights.shape, *weights.shape)._java_matrix_wrapper._java_model
    product = callMLlibFunc("getMatrixBlocks", matrix.multiply(right)).toDF("blockid", "matrix")
    stored = materialise(product, "projected", T.StructType([product.schema["blockid"], T.StructField("matrix", _SQL_MATRIX)]))
    block = F.col("blockid")[product.schema["blockid"].dataType.names[0]]
    return stored.select(block.alias("block"), F.col("matrix")["values"].alias("values"), F.col("matrix")["isTransposed"].alias("by_rows"))


def _unfold(n: int, shares: np.ndarray, error: float, fields: T.StructType):
    """The rows of a projected block: every id with each of its components."""
    wanted = len(shares)

    def run(batches):
        for batch in small(batches):
            for row in range(batch.num_rows):
                ids, deviations = batch.column(0)[row].values, batch.column(1)[row].values
                values = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                table = values.reshape(-1, wanted) if batch.column(3)[row].as_py() else values.reshape(wanted, -1).T
                count = len(ids)
                copies = pa.array(np.repeat(np.arange(count), wanted))
                columns = [ids.take(copies), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), count)), pa.array(np.full(count * wanted, n)), deviations.take(copies)]
                columns += [pa.array(table[:count].ravel()), pa.array(np.tile(shares, count)), pa.array(np.full(count * wanted, error))]
                yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return run
