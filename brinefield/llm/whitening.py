"""Embedding whitening from a covariance weighted by multiplicity.

1. Every entry becomes a whole number; a vector that holds a null or non-finite entry goes.
   Whole-number vectors have a digest of 128 bits, and identical ones are one row with their
   count (the group-by combines before it shuffles, so a vector that a third of all rows
   hold is a few rows).
2. The fit weighs each distinct vector by one or by its count. Sums are exact; the
   covariance is a weighted product of centred blocks, one partial matrix a task, added up
   row by row of the matrix.
3. The eigenvectors are found on the driver: a matrix of the vectors' dimension, whatever
   the number of rows.
4. Each distinct vector is whitened once and joined back to its rows by digest. Both sides
   are written tables, so adaptive execution can split the rows of a frequent vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import ship
from brinefield.runtime import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Whole numbers beyond this have no exact long after the offset.
LARGEST = float(1 << 62)
#: Components whose variance is this small a part of the largest are rounding noise.
FLAT = 1e-12


# ---- vectors -----------------------------------------------------------------

def packed(x: np.ndarray) -> bytes:
    """A vector less the offset, in two bytes an entry where they do and eight otherwise."""
    rest = x - OFFSET
    small = rest.size and np.abs(rest).max() < 1 << 15
    return rest.astype("<i2" if small else "<i8").tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for k, raw in enumerate(rows):
        out[k] = np.frombuffer(raw, "<i2" if len(raw) == 2 * dim else "<i8")
    return out + OFFSET


CLEAN = "vec_id long, key binary, dim int, x binary"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        owner = np.repeat(np.arange(batch.num_rows), lengths)
        scaled = np.floor(SCALE * values)
        with np.errstate(invalid="ignore"):
            wrong = ~(np.abs(scaled) < LARGEST)
        good = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
        good[owner[wrong]] = False
        x = np.where(wrong, 0, scaled).astype(np.int64) + OFFSET
        stops = np.cumsum(lengths)
        kept = np.flatnonzero(good)
        keys, rows = [], []
        for k in kept.tolist():
            v = x[stops[k] - lengths[k]:stops[k]]
            keys.append(hashlib.blake2b(v.astype("<i8").tobytes(), digest_size=16).digest())
            rows.append(packed(v))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(keys, pa.binary()), pa.array(lengths[kept].astype(np.int32)), pa.array(rows, pa.binary())],
                                         names=["vec_id", "key", "dim", "x"])


def whole_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, key, dim, x)`` of the rows that remain; ``key`` is the digest of the whole numbers."""
    ship(vectors.sparkSession)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_clean, CLEAN)


# ---- sums over all rows --------------------------------------------------------

def _sums(dim: int):
    """Exact sums of a task's rows as (i, high, low) with 32 low bits apart, and its weight at i = -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, weight = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dim)
            w = batch.column(1).to_numpy()
            high += ((x >> 32) * w[:, None]).sum(axis=0)
            low += ((x & 0xFFFFFFFF) * w[:, None]).sum(axis=0)
            weight += int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array(np.append(0, high)), pa.array(np.append(weight, low))], names=["i", "high", "low"])
    return run


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Total weight and the sum of each dimension of ``(x, w)``, as whole numbers of any size."""
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = {r["i"]: int(r["high"] or Decimal(0)) * (1 << 32) + int(r["low"] or Decimal(0))
            for r in fit.select("x", "w").mapInArrow(_sums(dim), "i int, high long, low long").groupBy("i").agg(*wide).collect()}
    return rows.get(-1, 0), [rows.get(i, 0) for i in range(dim)]


def _add_rows(dim: int):
    """Rows (i, values) arrive by i; values of one i are added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(raw, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["i", "values"])
    return run


def _matrix(partial: DataFrame, dim: int) -> np.ndarray:
    """The sum of partial matrices given as rows (i, values): ``dim`` rows reach the driver."""
    out = np.zeros((dim, dim))
    for r in partial.repartition("i").mapInArrow(_add_rows(dim), "i int, values binary").collect():
        out[r["i"]] = np.frombuffer(bytes(r["values"]), "<f8")
    return out


def _products(rows_of, centre: np.ndarray):
    """A task's weighted product of centred rows with themselves."""
    dim = centre.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            y = rows_of(batch.column(0), dim) - centre
            total += (y * batch.column(1).to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "values"])
    return run


def _x_rows(column: pa.Array, dim: int) -> np.ndarray:
    return unpacked(column.to_pylist(), dim).astype(np.float64)


def _white_rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def covariance(fit: DataFrame, dim: int, rows_of, centre: np.ndarray, weight: int) -> np.ndarray:
    """Covariance of the first column of ``fit``, weighted by the second, centred before multiplying."""
    v = _matrix(fit.mapInArrow(_products(rows_of, centre), "i int, values binary"), dim) / weight
    return (v + v.T) / 2


def _white_sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            total += (_white_rows(batch.column(0), dim) * batch.column(1).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "values"])
    return run


# ---- whitening -----------------------------------------------------------------

def principal(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive. Flat components are left out."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    real = values > max(FLAT * values.max(initial=0.0), 0.0)
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(values.size)]) if values.size else np.zeros(0)
    return values, vectors * signs


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n*x - S)**2 of each row, exact; None where it is no 64-bit number."""
    if not len(x):
        return []
    most = max(max(abs(n * int(top) - s), abs(n * int(bottom) - s)) for top, bottom, s in zip(x.max(axis=0), x.min(axis=0), sums))
    if most * most * len(sums) < 1 << 63 and n * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 63:
        return (((n * x) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def _whiten(n: int, sums: list[int], centre: np.ndarray, values: np.ndarray, vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist(), centre.size)
            white = (x - centre) @ vectors / np.sqrt(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(deviations(x, n, sums), pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, values.size, dtype=np.int32)), pa.array(white.ravel()))],
                                             names=["key", "w", "deviation", "white"])
    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS, by_count: bool = False) -> DataFrame:
    """One row per remaining row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row goes where its vector is null, empty, or holds an entry that is null, non-finite or
    beyond 64-bit whole numbers, and where its dimension is not the most frequent one (of
    equally frequent ones the largest). The fit weighs each distinct vector by one, or with
    ``by_count`` by its rows; ``n`` is the total weight. Components without variance are left
    out, so identical vectors alone, a single vector and an empty table give no rows.
    ``deviation`` is null where it exceeds 64 bits. Null ids stay; repeated rows stay, each
    with the same result. Other columns are not looked at.
    """
    spark = ship(vectors.sparkSession)
    rows = cut(whole_vectors(vectors, vector, key))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dim = common["dim"]
    rows = rows.filter(F.col("dim") == dim)
    weight = F.count("*") if by_count else F.lit(1).cast("long")
    distinct = cut(rows.groupBy("key").agg(F.first("x").alias("x"), weight.alias("w")))
    fit = distinct.select("x", "w")
    n, sums = exact_sums(fit, dim)
    centre = np.array([s / n for s in sums])
    v = covariance(fit, dim, _x_rows, centre, n)
    values, axes = principal(v, most)
    k = values.size
    if not k:
        return spark.createDataFrame([], RESULT)
    white = cut(distinct.select("key", "x", "w").mapInArrow(_whiten(n, sums, centre, values, axes), "key binary, w long, deviation long, white array<double>"))
    own = white.select("white", "w")
    mean = np.frombuffer(bytes(own.mapInArrow(_white_sums(k), "i int, values binary").repartition("i").mapInArrow(_add_rows(k), "i int, values binary").filter("i = 0").first()["values"]), "<f8") / n
    error = float(np.abs(covariance(own, k, _white_rows, mean, n) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    back = rows.select("vec_id", "key").join(white.select("key", "deviation", "white"), "key")
    return back.select("vec_id", "deviation", F.posexplode("white").alias("_p", "whitened")).select(
        "vec_id", (F.col("_p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_p")).alias("explained"), F.lit(error).alias("identity_error"))
