"""Whitening of embeddings by products of distributed block matrices.

Entries are quantised to whole numbers, so repeated vectors are equal exactly
and sums are exact. The fit list holds each distinct vector once. Its centred
rows are indexed into a MLlib ``BlockMatrix``, whose transpose multiplied by it
is the scatter matrix; the eigenvectors of that small matrix are found on the
driver, and a second product, of all centred rows with the whitening matrix,
projects every row.

What grows stays with the tasks: a product's long middle dimension is cut into
``MOST_SPLITS`` parts at most, each summed in a task of its own. The driver gets
matrices of the vectors' dimension and, inside MLlib, one pair of numbers for
each block; rows to a block follow the row count so that there are at most
``MOST_BLOCKS`` of them.

Defined results: null vectors and those with null or non-finite entries are
dropped, and so are vectors without entries, which have no component. Vectors of
different dimensions cannot be whitened together and raise a ``ValueError``.
Values beyond a long are its largest or smallest. A component whose eigenvalue is zero
to double precision (copies of one vector, or fewer directions than components)
has no ``whitened`` value (null) and stays out of ``identity_error``; without
any spread ``explained`` is null too. A ``deviation`` beyond a long is null. An
empty table gives an empty result; repeated rows and ids come out as often as
they come in; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import map_batches, with_columns
from histmerge.operators.ids import SLOT, numbered
from histmerge.workspace import Workspace

#: Steps of the quantisation to one unit, and components that are returned.
STEPS, COMPONENTS = 256, 4
#: Least rows and columns of a block, most blocks, and most parts of a product.
LEAST_ROWS, MOST_COLUMNS = 1024, 1024
MOST_BLOCKS, MOST_SPLITS = 1 << 18, 1 << 13


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of every row whose vector is whole."""
    plain = with_columns(embeddings, {"vec_id": "long", "embedding": "array<double>"})
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = plain.where(F.forall("embedding", finite) & (F.size("embedding") > 0))
    # Spark's cast to a long stops at the ends of its range.
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c * STEPS)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    lists = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), -1)


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """How many rows the fit list has, and the exact sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, None
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            # Halves of a long cannot overflow when a batch of them is added up.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            part = [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
            rows += len(x)
        if sums is not None:
            at, texts = range(len(sums)), [str(s) for s in sums]
            yield pa.record_batch(
                [pa.array(at, pa.int32()), pa.array([rows] * len(sums), pa.int64()), pa.array(texts)],
                ["at", "rows", "part"],
            )

    parts = map_batches(fit.select("x"), work, "at int, rows long, part string")
    summed = parts.groupBy("at").agg(
        F.sum("rows").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")
    )
    found = summed.orderBy("at").collect()  # one row for each dimension
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def with_deviation(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``index, vec_id, deviation``: the exact sum of ``(n * x - S) ** 2``."""
    total = np.array(sums, object)
    widest, longest = max(abs(s) for s in sums), (1 << 63) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            # Exact in longs where no sum can leave them, else in whole numbers of any size.
            if len(x) and (n * int(np.abs(x).max()) + widest) ** 2 * len(sums) > longest or (x == -longest - 1).any():
                out = ((n * x.astype(object) - total) ** 2).sum(1)
                out = [int(v) if v <= longest else None for v in out]
            else:
                out = ((n * x - total.astype(np.int64)) ** 2).sum(1)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(out, pa.int64())],
                ["index", "vec_id", "deviation"],
            )

    rows = rows.select("index", "vec_id", "x")
    return map_batches(rows, work, "index long, vec_id long, deviation long")


def block_matrix(rows: DataFrame, n: int, mean: list[float]) -> BlockMatrix:
    """The centred rows of ``index, x`` (indices 0 to ``n`` - 1) in blocks."""
    middle = F.array(*map(F.lit, mean))
    centred = F.transform("x", lambda v, i: v.cast("double") - middle[i])
    vectors = rows.select("index", array_to_vector(centred).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, len(mean))
    height = max(LEAST_ROWS, -(-n // MOST_BLOCKS))
    return indexed.toBlockMatrix(height, min(len(mean), MOST_COLUMNS))


def scatter(centred: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself, its rows cut into parts for many tasks."""
    splits = min(MOST_SPLITS, -(-centred.numRows() // centred.rowsPerBlock))
    turned = centred.transpose()
    # The product with a number of parts is not in the Python class.
    model = turned._java_matrix_wrapper.call(
        "multiply", centred._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(model, turned.rowsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()


def eigen(scattered: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and the trace,
    of the covariance. Values that are zero to double precision are zero.

    Of either sign the one is taken whose largest entry is positive.
    """
    covariance = (scattered + scattered.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    least = len(values) * np.finfo(float).eps * max(values[0], 0)
    values = np.where(values > least, values, 0.0)
    largest = np.abs(vectors).argmax(0)
    signs = np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors * signs, float(np.trace(covariance))


def projected(centred: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """``index, y``: each row times the whitening matrix."""
    height, width = whitening.shape
    step = centred.colsPerBlock
    blocks = [
        ((k, 0), Matrices.dense(len(part), width, part.T.ravel().tolist()))
        for k, part in enumerate(whitening[at : at + step] for at in range(0, height, step))
    ]
    context = centred.blocks.ctx
    small = BlockMatrix(context.parallelize(blocks, 1), step, width, height, width)
    rows = centred.multiply(small).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    plain = MLUtils.convertVectorColumnsToML(found, "vector")
    return plain.select("index", vector_to_array("vector").alias("y"))


def identity_error(fitted: DataFrame, kept: int) -> float:
    """Largest entry of the covariance of ``y`` minus the identity."""
    y = [F.col("y")[k] for k in range(kept)]
    means = fitted.agg(*[F.avg(c) for c in y]).first()
    pairs = [(a, b) for a in range(kept) for b in range(a, kept)]
    products = [F.avg((y[a] - float(means[a])) * (y[b] - float(means[b]))) for a, b in pairs]
    found = fitted.agg(*products).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))


def whiten(embeddings: DataFrame, work: Workspace, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double,"
        " explained double, identity_error double"
    )
    # The slots of a written table number its rows without a sort.
    row = F.monotonically_increasing_id()
    held = work.keep(quantised(embeddings).withColumn(SLOT, row), "quantised")
    sizes = held.agg(F.min(F.size("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not sizes[2]:
        return work.spark.createDataFrame([], schema)
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries")
    firsts = held.groupBy("x").agg(F.min(SLOT).alias("first"))
    fit = work.keep(firsts.withColumn(SLOT, row), "fit")
    n, sums = sums_of(fit)
    mean = [s / n for s in sums]
    values, vectors, trace = eigen(scatter(block_matrix(numbered(fit, -1, "index"), n, mean)), n)
    shown = min(components, len(mean))
    kept = int(np.count_nonzero(values[:shown]))
    rows = numbered(held.withColumn("first", F.col(SLOT)), -1, "index")
    measured = with_deviation(rows, n, sums)
    if kept:
        whitening = vectors[:, :kept] / np.sqrt(values[:kept])
        places = projected(block_matrix(rows, sizes[2], mean), whitening)
        fitted = fit.select("first", F.lit(True).alias("fits"))
        whole = rows.select("index", "first").join(fitted, "first", "left").drop("first")
        found = work.keep(places.join(measured, "index").join(whole, "index"), "projected")
        error = identity_error(found.where("fits"), kept)
    else:
        found, error = measured.withColumn("y", F.lit(None).cast("array<double>")), None
    shares = [float(v) / trace if trace > 0 else None for v in values[:shown]]
    lines = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                (F.col("y")[k] if k < kept else F.lit(None).cast("double")).alias("whitened"),
                F.lit(shares[k]).cast("double").alias("explained"),
            )
            for k in range(shown)
        ]
    )
    return found.select("vec_id", "deviation", F.explode(lines).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened",
        "c.explained", F.lit(error).cast("double").alias("identity_error"),
    )
