"""What the vector operators share: whole-number entries, packed blocks of rows, and blocks of queries meeting blocks of candidates.

Entries are floor(scale * x) and are kept as doubles, which hold them exactly (scale is a power of two).  A shelf is a packed
block of candidates, a slice one of queries.  Slices are numbered 0 .. n - 1, so that a shelf finds its slices by a sequence
of numbers and an equi-join; every task has one shelf and one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import numbered, pieces

SHELF_ROWS = 4096
SLICE_ROWS = 1024
#: Keys hold a score and a place among so many bits' worth of candidates.
PLACE_BITS = 13
#: Products of lengths below this give scores that doubles and keys hold exactly.
NARROW = float(1 << 48)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Key of what is no candidate; scores are held at LEAST, so no key is as small.
NOTHING = -(1 << 62)
NOTHING_WIDE = -(1 << 90)

PACKED = "ids array<bigint>, labels array<bigint>, matrix binary, more binary, longest double"
_PACKED = [("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("matrix", pa.binary()),
           ("more", pa.binary()), ("longest", pa.float64())]


def scaled(rows: DataFrame, scale: int, id_col: Column, vector: Column, label: Column | None = None) -> DataFrame:
    """(vec_id, label, entries, length) of the rows whose vector is whole: not null and without null or non-finite entries.

    entries holds floor(scale * x) as little-endian doubles, never -0; an entry that scale carries out of the range of
    doubles counts as non-finite.
    """
    label = F.lit(None) if label is None else label
    slim = rows.select(id_col.cast("bigint"), label.cast("bigint"), vector.cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            column = batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale) + 0.0
                square = np.cumsum(np.concatenate([[0.0], np.square(x)]))
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            end = np.cumsum(size)
            start = end - size
            whole = column.is_valid().to_numpy(zero_copy_only=False) & (odd[end] == odd[start])
            at = np.flatnonzero(whole)
            entries = [x[start[i]:end[i]] for i in at]
            with np.errstate(over="ignore"):
                length = [float(np.sqrt(v @ v)) for v in entries]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                 pa.array([v.astype("<f8").tobytes() for v in entries], pa.binary()), pa.array(length, pa.float64())],
                ["vec_id", "label", "entries", "length"])

    return numbered(slim).mapInArrow(run, "vec_id bigint, label bigint, entries binary, length double")


def matrix(entries: list[bytes], dims: int) -> np.ndarray:
    """Rows of entries; shorter vectors end in zeros."""
    if all(len(e) == 8 * dims for e in entries):
        return np.frombuffer(b"".join(entries), "<f8").reshape(len(entries), dims)
    out = np.zeros((len(entries), dims))
    for row, e in zip(out, entries):
        row[:len(e) // 8] = np.frombuffer(e, "<f8")
    return out


def packed(table: pa.Table | pa.RecordBatch, dims: int, more: Callable[[np.ndarray], np.ndarray]) -> list[pa.Array]:
    """One row of PACKED for rows (vec_id, label, entries, length)."""
    x = matrix(table.column("entries").to_pylist(), dims)
    small = np.abs(x).max(initial=0) < 1 << 31
    longest = float(np.max(table.column("length").to_numpy(), initial=0))
    values = [table.column("vec_id").to_pylist()], [table.column("label").to_pylist()], [
        x.astype("<i4" if small else "<f8").tobytes()], [more(x).astype("<f8").tobytes()], [longest]
    return [pa.array(v, kind) for v, (_, kind) in zip(values, _PACKED)]


def shelves(rows: DataFrame, order: list[Column], dims: int, more, n: int, size: int = SHELF_ROWS) -> DataFrame:
    """Packed blocks of candidates of at most `size` rows: range-partitioned and sorted by `order`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, count = TaskContext.get().partitionId(), 0, [], 0

        def shelf(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + k], pa.int64()), *packed(pa.Table.from_batches(rows), dims, more)],
                                              ["shelf", *[name for name, _ in _PACKED]])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                held, count, batch = [*held, part], count + part.num_rows, batch.slice(part.num_rows)
                if count == size:
                    yield shelf(held)
                    k, held, count = k + 1, [], 0
        if held:
            yield shelf(held)

    dealt = rows.repartitionByRange(-(-n // size) or 1, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"shelf bigint, {PACKED}")


def slices(rows: DataFrame, dims: int, more, n: int, size: int = SLICE_ROWS) -> DataFrame:
    """Packed blocks of about `size` queries, numbered from 0; rows must be read from a written table."""
    count = -(-n // size) or 1

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table.column("slice").slice(0, 1), *packed(table, dims, more)], ["slice", *[name for name, _ in _PACKED]])

    dealt = rows.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    return dealt.groupBy("slice").applyInArrow(run, f"slice bigint, {PACKED}")


def pairs(shelf: DataFrame, slice_: DataFrame, n: int, size: int = SLICE_ROWS) -> DataFrame:
    """(slice, shelf, and the other small columns) of all slices for each shelf."""
    numbers = F.sequence(F.lit(0), F.lit((-(-n // size) or 1) - 1)).cast("array<bigint>")
    return shelf.withColumn("slice", F.explode(numbers)).join(slice_, "slice")


def meet(which: DataFrame, shelf: DataFrame, slice_: DataFrame, fn, schema: str) -> DataFrame:
    """fn(slice row, shelf row) -> arrays of `schema`, for each (slice, shelf) of `which`."""
    keys = ["slice", "shelf"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(fn(left.to_pylist()[0], right.to_pylist()[0]), names)

    left = which.select(*keys).join(slice_, "slice")
    right = which.select(F.col("slice").alias("at_slice"), F.col("shelf").alias("at_shelf")).join(shelf, F.col("at_shelf") == F.col("shelf"))
    return left.groupBy(*keys).cogroup(right.groupBy("at_slice", "at_shelf")).applyInArrow(run, schema)


class Block:
    """A packed row, opened."""

    def __init__(self, row: dict, dims: int) -> None:
        self.ids, n = row["ids"], len(row["ids"])
        kind = "<i4" if len(row["matrix"]) == 4 * n * dims else "<f8"
        self.x = np.frombuffer(row["matrix"], kind).reshape(n, dims).astype(np.float64)
        self.more = np.frombuffer(row["more"], "<f8").reshape(n, -1) if n else np.zeros((0, 0))
        self.labels = np.array(row["labels"], object)
        with np.errstate(over="ignore"):
            self.length = np.sqrt(np.square(self.x).sum(1))
        self.longest = float(self.length.max(initial=0))
        known = np.array([i is not None for i in self.ids], bool)
        number = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        #: Place by falling preference among equal scores: smaller ids first, null ids last.
        self.place = np.empty(n, np.int64)
        self.place[np.lexsort((number, ~known))] = np.arange(n)
        self.by_place = np.argsort(self.place)


def wide(a: Block, b: Block) -> bool:
    """Whether scores may be too great for doubles and 64-bit keys."""
    return not a.longest * b.longest < NARROW


def scores(a: np.ndarray, b: np.ndarray, is_wide: bool) -> np.ndarray:
    """Exact inner products of all rows; beyond the range of long they are held at its ends."""
    if not is_wide:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    held = np.minimum(np.maximum(whole[0] @ whole[1].T, LEAST), MOST) if a.shape[1] else np.zeros((len(a), len(b)))
    return held.astype(object)


class Best:
    """The best `k` candidates of each query so far, as keys: score first, then smaller id."""

    def __init__(self, queries: int, k: int, is_wide: bool) -> None:
        self.wide, self.k = is_wide, k
        self.none = NOTHING_WIDE if is_wide else NOTHING
        self.keys = np.full((queries, k), self.none, object if is_wide else np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, place: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates of these queries: their scores and places, where allowed."""
        keys = np.where(allowed, score * (1 << PLACE_BITS) - place[None, :], self.none)
        both = np.concatenate([self.keys[rows], keys], axis=1)
        if self.wide:
            self.keys[rows] = np.sort(both, axis=1)[:, -self.k:]
        else:
            self.keys[rows] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]

    def least(self) -> np.ndarray:
        """Score of the last of the k best, -inf where there are fewer."""
        last = self.keys.min(axis=1)
        found = np.full(len(last), -np.inf)
        full = np.flatnonzero(last != self.none)
        found[full] = self._score(last[full]).astype(np.float64)
        return np.where(found <= LEAST, -np.inf, found)

    def _score(self, keys: np.ndarray) -> np.ndarray:
        return -((-keys) >> PLACE_BITS)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, place) of all that were found."""
        query, at = np.nonzero(self.keys != self.none)
        keys = self.keys[query, at]
        score = self._score(keys) if len(keys) else keys
        return query, score, (score * (1 << PLACE_BITS) - keys).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def upper(length_a: np.ndarray, length_b: float) -> np.ndarray:
    """Cauchy-Schwarz bound with room for rounding."""
    return length_a * length_b * (1 + 1e-9)
