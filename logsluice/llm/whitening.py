"""Whitening of embeddings with MLlib's block matrices.

Vectors become rows of whole numbers, kept in blocks in the shared folder. Centred blocks of the
distinct rows form a BlockMatrix; its transpose times itself is the scatter, which is decomposed on
the driver (dimension x dimension). A second BlockMatrix of all rows times the whitening matrix
gives the projections, joined back to the ids of their block. Only blocks of bounded size and
sums of the dimension's size travel; nothing on the driver grows with the rows but block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.llm.common import column, written

COMPONENTS = 4
SCALE = 256.0
#: Entries of a block: 4 MB as doubles.
ENTRIES = 1 << 19
#: Blocks that are multiplied in one task of the scatter.
TOGETHER = 8
#: An eigenvalue below this share of the trace is rounding, not variance.
NOTHING = 1e-13

_KINDS = (np.int8, np.int16, np.int32, np.int64)
_BLOCK = "pid long, seq long, ids array<long>, dim long, width long, kind int, data binary"
_ARROW = pa.schema([("pid", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("dim", pa.int64()), ("width", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_PLACED = T.StructType([T.StructField("at", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])), T.StructField("block", MatrixUDT())])
_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as long; beyond 64 bits, the nearest long that a double can hold."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def kind_of(x: np.ndarray) -> int:
    """Number of the smallest type that holds all entries."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(i for i, t in enumerate(_KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def pack(x: np.ndarray) -> tuple[int, int, bytes]:
    """(width, kind, bytes) of a matrix of long."""
    kind = kind_of(x)
    return x.shape[1], kind, x.astype(_KINDS[kind]).tobytes()


def unpack(width: int, kind: int, data: bytes, rows: int, dim: int) -> np.ndarray:
    """The matrix again, with zeros up to dim columns."""
    out = np.zeros((rows, dim), np.int64)
    out[:, :width] = np.frombuffer(data, _KINDS[kind]).reshape(rows, width)
    return out


def usable(vectors: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(indices, vectors as double) of the rows without null, null entry or entry that is not finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(there & (odd[ends] == odd[ends - lengths]))
    return at, [flat[ends[i] - lengths[i] : ends[i]] for i in at.tolist()]


class _Blocks:
    """Gathers rows of long into numbered blocks of a task."""

    def __init__(self) -> None:
        self.pid, self.seq = TaskContext.get().partitionId(), 0
        self.ids: list = []
        self.rows: list[np.ndarray] = []
        self.held = self.dim = 0

    def add(self, rows: list[np.ndarray], ids: list, dim: int) -> Iterator[pa.RecordBatch]:
        for i, row in enumerate(rows):
            self.rows.append(row)
            self.held = max(self.held, len(row))
            self.dim = max(self.dim, dim)
            self.ids.extend(ids[i : i + 1])
            if len(self.rows) * max(self.held, 64) >= ENTRIES:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            x = np.zeros((len(self.rows), self.held), np.int64)
            for i, row in enumerate(self.rows):
                x[i, : len(row)] = row
            width, kind, data = pack(x)
            own = {"pid": self.pid, "seq": self.seq, "ids": self.ids or [None] * len(self.rows), "dim": self.dim, "width": width, "kind": kind, "data": data}
            yield pa.RecordBatch.from_pylist([own], schema=_ARROW)
            self.seq, self.ids, self.rows, self.held, self.dim = self.seq + 1, [], [], 0, 0


def row_blocks(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Blocks of whole-number rows with their ids, from the vectors that can be used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            at, vectors = usable(batch.column(1))
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            for one, own in zip(vectors, ids, strict=True):
                yield from blocks.add([whole(one)], [own], len(one))
        yield from blocks.close()

    return rows.select(F.col(id_column).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(task, _BLOCK)


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for ids, width, kind, data in zip(*(column(batch, c) for c in ("ids", "width", "kind", "data")), strict=True):
        yield unpack(width, kind, data, len(ids), dim)


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of each distinct row once. A row is shuffled in its smallest form: type and entries
    without trailing zeros, which are the same for equal rows."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, x in zip(column(batch, "width"), matrices(batch, 0 if not batch.num_rows else max(column(batch, "width"))), strict=True):
                out = []
                for row in x[:, :width]:
                    kept = row[: len(row) - int(np.argmax(row[::-1] != 0))] if row.any() else row[:0]
                    _, kind, data = pack(kept[None, :])
                    out.append(bytes([kind]) + data)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            for x in column(batch, "x"):
                yield from blocks.add([np.frombuffer(x, _KINDS[x[0]], offset=1).astype(np.int64)], [], 0)
        yield from blocks.close()

    return blocks.mapInArrow(single, "x binary").distinct().mapInArrow(together, _BLOCK)


@dataclass(frozen=True)
class Fit:
    """Count and exact column sums of the distinct rows."""

    n: int
    sums: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: long where it fits, else Python's integers."""
        most = max((abs(int(x.min())), abs(int(x.max())), 1)) if x.size else 1
        fits = self.n * most + max(map(abs, self.sums), default=0) < 1 << 62
        kind = np.int64 if fits else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of squares, exact; the largest long where they pass 64 bits."""
        d = self.numerators(x)
        most = max((abs(int(d.min())), abs(int(d.max())))) if d.size else 0
        d = d if most * most * max(1, self.dim) < 1 << 62 else d.astype(object)
        return [min(int(s), (1 << 63) - 1) for s in (d * d).sum(axis=1)] if self.dim else [0] * len(x)


def column_sums(blocks: DataFrame, dim: int) -> Fit:
    """Rows and exact sums of each column: one row a dimension leaves each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            for x in matrices(batch, dim):
                n += len(x)
                # Halves of 32 bits: their sums over a block can't pass 64 bits.
                total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            sums = pa.array([n, *map(int, total)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int64()), sums], names=["at", "total"])

    rows = blocks.mapInArrow(task, "at long, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in rows}
    return Fit(found.get(-1, 0), tuple(found.get(i, 0) for i in range(dim)))


def block_matrix(blocks: DataFrame, fit: Fit, stride: int, tasks: int) -> BlockMatrix:
    """The centred rows as a BlockMatrix of one column of blocks; block (pid, seq) is number pid * stride + seq."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, seq, x in zip(column(batch, "pid"), column(batch, "seq"), matrices(batch, fit.dim), strict=True):
                at = pa.array([{"i": pid * stride + seq, "j": 0}], pa.struct([("i", pa.int64()), ("j", pa.int64())]))
                values = {"type": 1, "numRows": len(x), "numCols": fit.dim, "colPtrs": None, "rowIndices": None, "values": fit.centred(x).reshape(-1), "isTransposed": True}
                yield pa.RecordBatch.from_arrays([at, pa.array([values], _MATRIX)], names=["at", "block"])

    # Blocks may hold fewer rows than this; products only need their own sizes to agree.
    rows = max(1, ENTRIES // max(fit.dim, 64))
    java = callMLlibFunc("createBlockMatrix", blocks.mapInArrow(task, _PLACED), rows, fit.dim, rows * stride * tasks, fit.dim)
    return BlockMatrix(java, rows, fit.dim)


def splits_for(blocks: int, stride: int) -> int:
    """A prime number of parts of the scatter's middle dimension that spreads block numbers evenly."""
    p = max(2, -(-blocks // TOGETHER))
    while stride % p == 0 or any(p % k == 0 for k in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def scatter(centred: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix. Partial products of each part are summed as they are shuffled."""
    other = centred._java_matrix_wrapper._java_model
    product = BlockMatrix(centred.transpose()._java_matrix_wrapper.call("multiply", other, splits), centred.colsPerBlock, centred.colsPerBlock)
    return np.asarray(product.toLocalMatrix().toArray(), np.float64)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues of the first components, shares of the trace, whitening matrix).

    A component without variance has eigenvalue 0 and projects everything to 0.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:COMPONENTS]
    trace = float(np.trace(covariance))
    e = np.where(values[order] > NOTHING * trace, values[order], 0.0)
    safe = np.where(e > 0, e, 1.0)
    return e, e / trace if trace > 0 else np.zeros(len(e)), np.where(e > 0, vectors[:, order] / np.sqrt(safe), 0.0)


def identity_error(blocks: DataFrame, fit: Fit, matrix: np.ndarray, e: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    k = matrix.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in matrices(batch, fit.dim):
                z = fit.centred(x) @ matrix
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.reshape(-1))], names=["at", "total"])

    rows = blocks.mapInArrow(task, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["at"]] = r["total"]
    total = total.reshape(k + 1, k) / fit.n
    known = np.flatnonzero(e > 0)
    off = (total[:k] - np.outer(total[k], total[k]) - np.eye(k))[np.ix_(known, known)]
    return float(np.abs(off).max()) if off.size else 0.0


_OUT = "{0} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and each of the first four components.

    Vectors that are null or hold null or non-finite entries are dropped. Shorter vectors count as
    filled with zeros to the longest one's dimension; with fewer than four dimensions there are as
    many components as dimensions, without any, no rows. Equal vectors are one of the fit list but
    rows of their own, and so are rows that share an id; null ids stay null. A component without
    variance has whitened and explained 0 and is left out of identity_error. A deviation beyond 64
    bits is the largest long.
    """
    spark = rows.sparkSession
    out = _OUT.format(f"`{id_column}`")
    blocks = written(row_blocks(rows, id_column, vector), "vectors")
    size = blocks.agg(F.max("dim").alias("dim"), F.max("seq").alias("seq"), F.max("pid").alias("pid")).first()
    if not size["dim"]:
        return spark.createDataFrame([], out)
    dim = size["dim"]
    distinct = written(distinct_blocks(blocks), "fit")
    fit = column_sums(distinct, dim)
    own = distinct.agg(F.max("seq").alias("seq"), F.max("pid").alias("pid"), F.count(F.lit(1)).alias("blocks")).first()
    stride = own["seq"] + 1
    covariance = scatter(block_matrix(distinct, fit, stride, own["pid"] + 1), splits_for(own["blocks"], stride)) / fit.n
    e, explained, matrix = eigen(covariance)
    error = identity_error(distinct, fit, matrix, e)

    stride = size["seq"] + 1
    right = [((0, 0), Matrices.dense(dim, matrix.shape[1], matrix.T.reshape(-1).tolist()))]
    weights = BlockMatrix(spark.sparkContext.parallelize(right, 1), dim, matrix.shape[1])
    product = block_matrix(blocks, fit, stride, size["pid"] + 1).multiply(weights)
    projected = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    projected = projected.select(F.col("_1._1").cast("long").alias("block"), F.col("_2").alias("projected"))
    joined = projected.join(blocks.withColumn("block", F.col("pid") * stride + F.col("seq")), "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for one, ids, x in zip(column(batch, "projected"), column(batch, "ids"), matrices(batch, dim), strict=True):
                z = np.array(one["values"]).reshape(one["numRows"], k, order="C" if one["isTransposed"] else "F")
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in ids for _ in range(k)], pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fit.n, np.int64)),
                        pa.array(np.repeat(np.array(fit.deviations(x), np.int64), k)),
                        pa.array(z.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return joined.select("projected", "ids", "width", "kind", "data").mapInArrow(task, out)
