"""Whitening of vectors from an exact bit-sliced scatter (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import drop, keep, pieces
from scalarlake.llm.vectors import matrix, scaled

MOST = (1 << 63) - 1
#: Sums of a task are cut into so many bits, so that they add up in 64.
LIMB = 16
#: Rows that are packed at a time: words of 64 rows.
ROWS = 8192

_RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double, deviation_digits string")


def whole(entries: list[bytes], dims: int) -> np.ndarray:
    """Entries as 64-bit integers; beyond their range they are held at its ends."""
    x = matrix(entries, dims)
    inside = np.clip(x, -(2.0 ** 63), np.nextafter(2.0 ** 63, 0)).astype(np.int64)
    return np.where(x >= 2.0 ** 63, MOST, inside)


def opened(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)


def planes(u: np.ndarray) -> np.ndarray:
    """Bit planes of a matrix of unsigned values, packed across rows: planes[dimension, bit] has a bit for each row."""
    bits = max(1, int(u.max(initial=0)).bit_length())
    rows = np.zeros((-(-len(u) // 64) * 64, u.shape[1]), np.uint64)
    rows[:len(u)] = u
    sliced = (rows.T[:, None, :] >> np.arange(bits, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(sliced.astype(np.uint8), axis=2, bitorder="little")).view(np.uint64)


def cross(u: np.ndarray) -> dict[int, np.ndarray]:
    """By weight w, how often bits b and c with b + c = w are set together in two dimensions: the sum of
    count * 2^w over w is the scatter of u.  Words are ANDed and their set bits counted."""
    cut = planes(u)
    dims, bits, words = cut.shape
    out = {w: np.zeros((dims, dims), np.int64) for w in range(2 * bits - 1)}
    for b, c in product(range(bits), repeat=2):
        left, right = cut[:, b], cut[:, c]
        for i in range(dims):
            out[b + c][i, i:] += np.bitwise_count(left[i] & right[i:]).sum(axis=1, dtype=np.int64)
    return out


def _longs(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            x = whole(batch.column("entries").to_pylist(), dims)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "x"])

    return run


def _extents(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            x = opened(batch.column("x"), dims)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(x.min(axis=0)),
                                              pa.array([str(sum(map(int, v))) for v in x.T]), pa.array([len(x)] * dims, pa.int64())],
                                             ["i", "least", "total", "n"])

    return run


def _scatter(dims: int, least: list[int]):
    low = np.array(least, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in pieces(batches, ROWS):
            shifted = opened(batch.column("x"), dims).view(np.uint64) - low  # modulo 2^64, so right for any two longs
            for w, count in cross(shifted).items():
                limb = total.setdefault(w // LIMB, np.zeros((dims, dims), np.int64))
                limb += count << (w % LIMB)
        for limb, count in total.items():
            i, j = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array([limb] * len(i), pa.int32()), pa.array(count[i, j])], ["i", "j", "limb", "count"])

    return run


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S, and n^2 times the covariance, all exact, of distinct vectors (x).

    Tasks count bits of values shifted by the least of their dimension; what meets is a number for each pair of
    dimensions and limb, whatever the number of rows, and a covariance does not see the shift.
    """
    exact = "decimal(38,0)"
    extents = fit.mapInArrow(_extents(dims), "i int, least bigint, total string, n bigint").groupBy("i").agg(
        F.min("least").alias("least"), F.sum(F.col("total").cast(exact)).alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    n, least, total = extents[0].n, [r.least for r in extents], [int(r.total) for r in extents]
    limbs = fit.mapInArrow(_scatter(dims, least), "i int, j int, limb int, count bigint").groupBy("i", "j", "limb").agg(
        F.sum(F.col("count").cast(exact)).alias("s")).collect()
    scatter = [[0] * dims for _ in range(dims)]
    for r in limbs:
        scatter[r.i][r.j] += int(r.s) << (LIMB * r.limb)
    shifted = [t - n * m for t, m in zip(total, least)]
    centred = [[n * scatter[min(i, j)][max(i, j)] - shifted[i] * shifted[j] for j in range(dims)] for i in range(dims)]
    return n, total, centred


def components(n: int, centred: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors of the covariance by falling eigenvalue, as far as there is variance, and its trace."""
    v = np.array([[c / (n * n) for c in row] for row in centred])
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    there = int((value > len(v) * 2.0 ** -50 * value[0]).sum()) if value[0] > 0 else 0
    trace = sum(centred[i][i] for i in range(len(v))) / (n * n)
    return value[:min(most, there)], vector[:, :min(most, there)], trace


class Whitener:
    """Deviations and whitened values of rows."""

    def __init__(self, n: int, total: list[int], value: np.ndarray, vector: np.ndarray) -> None:
        self.n, self.total, self.axes = n, total, vector / np.sqrt(value)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, self.total))
        if most * most * len(self.total) < MOST:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def values(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.axes


def _identity(dims: int, whitener: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            w = whitener.values(whitener.centred(opened(batch.column("x"), dims)))
            w = np.column_stack([w, np.ones(len(w))])
            i, j = np.indices((w.shape[1], w.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array((w.T @ w).ravel())], ["i", "j", "s"])

    return run


def identity_error(fit: DataFrame, dims: int, whitener: Whitener) -> float:
    """Greatest absolute entry of the covariance of the whitened fit list, less the identity."""
    m = whitener.axes.shape[1]
    second = np.zeros((m + 1, m + 1))
    for r in fit.mapInArrow(_identity(dims, whitener), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        second[r.i, r.j] = r.s / whitener.n
    mean = second[m, :m]
    return float(np.abs(second[:m, :m] - np.outer(mean, mean) - np.eye(m)).max())


def _whitened(dims: int, whitener: Whitener, n: int, explained: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(explained)
        for batch in pieces(batches, ROWS):
            centred = whitener.centred(opened(batch.column("x"), dims))
            far = [int(v) for v in np.square(centred).sum(axis=1)]
            k = len(far)
            each = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(list(range(1, m + 1)) * k, pa.int32()), pa.array([n] * (k * m), pa.int64()),
                 pa.array([far[i] if far[i] <= MOST else None for i in each], pa.int64()), pa.array(whitener.values(centred).ravel()),
                 pa.array(explained * k), pa.array([error] * (k * m)), pa.array([str(far[i]) for i in each])],
                [f.split()[0] for f in _RESULT.split(", ")])

    return run


def whiten(rows: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and each of the first `most` components: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_digits (the deviation as a numeral, of any size).

    Entries become long x = floor(scale * c).  The fit list holds each distinct vector once: n of them, with sums S.  Its
    scatter is counted from bit planes (cross), added up over tasks as integers, centred as integers and only then rounded
    for eigh; the dims x dims sums are all that the driver gets.  Then all rows are projected in one pass.

    Rows with a null vector, or null or non-finite entries, take no part (an entry that the scale carries out of the range of
    doubles counts as non-finite); entries beyond long are held at its ends, shorter vectors end in zeros.  Null and
    repeated ids are rows like others.  A deviation beyond long is null, its numeral is not.  Components without variance
    are not returned, so that one vector alone, or none, gives no rows.
    """
    spark = rows.sparkSession
    vectors = keep(scaled(rows, scale, F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")), "vectors")
    dims = (vectors.agg(F.max(F.octet_length("entries"))).first()[0] or 0) // 8
    none = spark.createDataFrame([], _RESULT)
    if not dims:
        drop(vectors)
        return none
    longs = keep(vectors.select("vec_id", "entries").mapInArrow(_longs(dims), "vec_id bigint, x binary"), "longs")
    fit = keep(longs.select("x").distinct(), "fit")
    n, total, centred = moments(fit, dims)
    value, vector, trace = components(n, centred, most)
    if not len(value):
        for table in (vectors, longs, fit):
            drop(table)
        return none
    whitener = Whitener(n, total, value, vector)
    error = identity_error(fit, dims, whitener)
    drop(vectors)
    drop(fit)
    return longs.mapInArrow(_whitened(dims, whitener, n, [float(e / trace) for e in value], error), _RESULT)
