"""Line differences of text pairs.

The pairs are rows and are spread over tasks; the longest common subsequence of one pair is a small helper on its
lines.  A pair of long texts is first cut into boxes: it is swept from either end, which
leaves the lengths of common subsequences at every so many lines; where both together reach the greatest length, the
difference can pass, and the one way that diff_sequences() would take is followed from stretch to stretch.  Corners
on that way make the boxes independent: inside a box the same choices are made as in the whole.

A sweep costs the product of the lines.  Where that is small, the task that has the pair cuts it, and no text is
written anywhere.  A pair of very long texts is dealt: two tasks sweep it, one from either end, and the boxes are rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH_LINES = 20_000
#: Pairs that a worker has as Python objects at a time.
_PAIRS = 64
#: Texts of more lines are cut; boxes have at most so many lines on either side.
BOX_LINES = 16_384
#: Lines of one text times lines of the other up to which a pair is cut by the task that has it.
HELD_CELLS = BOX_LINES * BOX_LINES
#: Columns that a sweep works on at a time, so that its bit sets stay small.
_STRIPE = 16_384
_SWEPT = pa.list_(pa.struct([("i", pa.int64()), ("bits", pa.binary())]))


def diff_lines(a: str, b: str) -> Iterator[tuple[str, str]]:
    """(op, line) rows, op one of ``' '``, ``'-'``, ``'+'``; deletions first on ties."""
    return diff_sequences(a.split("\n"), b.split("\n"))


def diff_sequences(x: Sequence[str], y: Sequence[str]) -> Iterator[tuple[str, str]]:
    """The same for two lists of lines.

    Row i of the LCS table (over suffixes of ``x``) is kept as one integer whose bit
    j says whether a common line is gained at line j of ``y``.  Only every c-th row
    is stored, the others are computed again when the walk reaches them.
    """
    common = 0
    while common < len(x) and common < len(y) and x[common] == y[common]:
        yield " ", x[common]
        common += 1
    x, y = x[common:], y[common:]
    n, m = len(x), len(y)
    full = (1 << m) - 1
    # bit m-1-j stands for line j, so that carries run towards the front of ``y``
    places: dict[str, int] = {}
    for j, line in enumerate(y):
        places[line] = places.get(line, 0) | (1 << (m - 1 - j))

    def above(row: int, i: int) -> int:
        hit = row & places.get(x[i], 0)
        return ((row + hit) | (row - hit)) & full

    every = isqrt(n) + 1
    stored = {n: full}
    row = full
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % every == 0:
            stored[i] = row
    block: dict[int, int] = {}

    def table(i: int) -> int:
        if i in stored:
            return stored[i]
        if i not in block:
            block.clear()
            top = min(n, (i // every + 1) * every)
            row = stored[top]
            for t in range(top - 1, i - i % every, -1):
                row = above(row, t)
                block[t] = row
        return block[i]

    def length(i: int, j: int) -> int:
        """Common lines of x[i:] and y[j:]: cleared bits below position m - j."""
        width = m - j
        return width - (table(i) & ((1 << width) - 1)).bit_count()

    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            yield " ", x[i]
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            yield "-", x[i]
            i += 1
        else:
            yield "+", y[j]
            j += 1
    for line in x[i:]:
        yield "-", line
    for line in y[j:]:
        yield "+", line


# --- cutting a pair of long texts ----------------------------------------------

def sweep(x: Sequence[str], y: Sequence[str], every: int, stripe: int = _STRIPE) -> dict[int, np.ndarray]:
    """For i = every, 2 * every, ... below len(x): where in y common lines of x[i:] and y[j:] are gained (bit j), packed.

    The length of a common subsequence of x[i:] and y[j:] is the number of bits from j on.  Columns are worked on
    in stripes from the end; a stripe takes one carry for each line of x from the stripe behind it.
    """
    n, m = len(x), len(y)
    carry = bytearray(n)
    parts: dict[int, list[np.ndarray]] = {i: [] for i in range(every, n, every)}
    for end in range(m, 0, -stripe):
        begin = max(0, end - stripe)
        width = end - begin
        places: dict[str, int] = {}
        for j in range(begin, end):
            places[y[j]] = places.get(y[j], 0) | (1 << (end - 1 - j))
        full = row = (1 << width) - 1
        for i in range(n - 1, -1, -1):
            hit = places.get(x[i], 0) & row
            if hit or carry[i]:
                total = row + hit + carry[i]
                carry[i] = total >> width
                row = (total | (row - hit)) & full
            if i in parts:
                bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-width // 8), "big"), np.uint8))
                parts[i].append(1 - bits[-width:])
    return {i: np.packbits(np.concatenate(p[::-1])) if p else np.zeros(0, np.uint8) for i, p in parts.items()}


def _from_end(packed: np.ndarray, m: int) -> np.ndarray:
    """Number of bits from each position on."""
    out = np.zeros(m + 1, np.int64)
    out[:m] = np.cumsum(np.unpackbits(packed, count=m)[::-1], dtype=np.int64)[::-1]
    return out


def _crossing(x: Sequence[str], y: Sequence[str], below: np.ndarray, swapped: bool) -> int:
    """Where the way from the first cell of a stretch enters the row below it.

    ``below`` are the lengths at that row for each place in y.  Rows of the table are computed from there upwards,
    and every cell takes over the entry of the cell that the way goes to next.
    """
    codes = {line: k for k, line in enumerate(dict.fromkeys(y))}
    column = np.array([codes[line] for line in y], np.int64)
    at = np.arange(len(y) + 1)
    lengths, entry = below, at
    for line in reversed(x):
        same = np.append(column == codes.get(line, -1), False)
        gained = np.where(same[:-1], lengths[1:] + 1, 0)
        here = np.maximum.accumulate(np.maximum(lengths, np.append(gained, 0))[::-1])[::-1]
        if swapped:  # the other text's lines go first
            along = ~same & (np.append(here[1:], -1) == here)
        else:
            along = ~same & (lengths != here)
        source = np.where(same, np.append(entry[1:], 0), entry)
        stop = np.minimum.accumulate(np.where(along, len(y), at)[::-1])[::-1]
        lengths, entry = here, source[stop]
    return int(entry[0])


def corners(x: Sequence[str], y: Sequence[str], ahead: dict[int, np.ndarray], behind: dict[int, np.ndarray],
            every: int, swapped: bool = False) -> Iterator[tuple[int, int, int]]:
    """(i, j, common lines before) where the difference of x and y enters the rows i = 0, every, 2 * every, ...

    ``behind`` is the sweep of both texts, ``ahead`` that of both texts read backwards, by the rows' places from the
    end.  ``swapped`` says that x is the second text of the pair, so that on ties lines of y are taken first.
    """
    n, m = len(x), len(y)
    j = common = 0
    yield 0, 0, 0
    for i in range(every, n, every):
        after = _from_end(behind[i], m)
        before = _from_end(ahead[i], m)[::-1]
        passes = np.flatnonzero(before + after == (before + after).max())
        passes = passes[passes >= j]
        if len(passes) == 1:
            j = int(passes[0])
        else:
            last = int(passes[-1])
            stretch = x[i - every:i]
            straight = after[j] + common == (before + after).max() and j < m and y[j] not in stretch
            if swapped or not straight:
                j += _crossing(stretch, y[j:last], after[j:last + 1], swapped)
        common = int(before[j])
        yield i, j, common


def _ahead(x: Sequence[str], y: Sequence[str], every: int) -> dict[int, np.ndarray]:
    """sweep() from the front: both texts backwards, rows counted from the front again."""
    first = len(x) % every or every
    return {len(x) - i: v for i, v in _offset_sweep(x[::-1], y[::-1], first, every).items()}


def _stretches(x: Sequence[str], y: Sequence[str], ahead: dict[int, np.ndarray], behind: dict[int, np.ndarray],
               every: int, swapped: bool) -> Iterator[tuple[slice, slice, int]]:
    """(lines of x, lines of y, lines of the difference before) of each box."""
    met = [*corners(x, y, ahead, behind, every, swapped), (len(x), len(y), 0)]
    for (i, j, common), (i2, j2, _) in zip(met, met[1:]):
        yield slice(i, i2), slice(j, j2), i + j - common


def boxes_of(a: Sequence[str], b: Sequence[str], *sizes: int) -> Iterator[tuple[int, Sequence[str], Sequence[str]]]:
    """(lines of the difference before, lines of a, lines of b) of the boxes of a pair, cut on both sides.

    A box has at most as many lines of either text as the first size says, is cut again by the next one, and so on.
    """
    if not sizes:
        yield 0, a, b
        return
    every, *less = sizes

    def cut(x, y, swapped):
        long = len(x) > every
        return _stretches(x, y, _ahead(x, y, every) if long else {}, sweep(x, y, every) if long else {}, every, swapped)

    for i, j, first in cut(a, b, False):
        x, y = a[i], b[j]
        for k, l, no in cut(y, x, True):
            for before, u, v in boxes_of(x[l], y[k], *less):
                yield first + no + before, u, v


def _cut(pairs: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Boxes (keys, line_no, a, b) of at most ``every`` lines of the first text.

    One chain of stages: a task for each side of a pair sweeps it, then both sides meet at the pair.  The texts go with
    one side, the other has a number for each different line.
    """
    # A struct is never null, and pairs that have the same keys stay apart; ``times`` they have the same texts as well.
    pair = F.struct(*keys, F.xxhash64("text_a", "text_b").alias("_texts")).alias("_pair")
    todo = pairs.select(pair, *(F.split(f"text_{s}", "\n", -1).alias(s) for s in ("a", "b")))
    texts = list(todo.schema.fields)
    numbers = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("x", "y")]
    dealt = T.StructType([*texts, T.StructField("side", T.IntegerType()), *numbers])
    found = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("bits", T.BinaryType())]))
    swept = T.StructType([*texts, T.StructField("side", T.IntegerType()), T.StructField("swept", found)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            with_texts, with_numbers = pa.array([0, None]), pa.array([None, 0])
            out = [batch.column("_pair").take(pa.array([0, 0])), *(batch.column(c).take(with_texts) for c in ("a", "b")), pa.array([0, 1], pa.int32())]
            yield pa.RecordBatch.from_arrays([*out, *(c.take(with_numbers) for c in _numbered(batch))], names=dealt.names)

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            front = batch.column("side")[0].as_py() == 1
            x, y = (batch.column(c)[0].as_py() for c in ("xy" if front else "ab"))
            bits = (_ahead if front else sweep)(x, y, every) if len(x) > every else {}
            bits = pa.array([[{"i": i, "bits": v.tobytes()} for i, v in bits.items()]], _SWEPT)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_pair", "a", "b", "side")), bits], names=swept.names)

    sides = todo.mapInArrow(deal, dealt).repartition(F.xxhash64("_pair", "side")).mapInArrow(sweeps, swept)
    whole = sides.groupBy("_pair").agg(
        F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"), F.count_if(F.col("side") == 0).alias("times"),
        F.flatten(F.collect_list(F.transform("swept", lambda s: F.struct(F.col("side").alias("side"), s["i"].alias("i"), s["bits"].alias("bits"))))).alias("swept"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            x, y = (c[0].as_py() for c in _numbered(batch))
            bits = batch.column("swept")[0].as_py()
            behind, ahead = ({b["i"]: np.frombuffer(b["bits"], np.uint8) for b in bits if b["side"] == side} for side in (0, 1))
            boxes = list(_stretches(x, y, ahead, behind, every, False))
            out = [batch.column("_pair").take(pa.array([0] * len(boxes))), pa.array([no for *_, no in boxes], pa.int64())]
            for c, k in (("a", 0), ("b", 1)):
                ends = [0, *(box[k].stop for box in boxes)]
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column(c)[0].values))
            for _ in range(batch.column("times")[0].as_py()):
                yield pa.RecordBatch.from_arrays(out, names=["_pair", "line_no", "a", "b"])

    box = T.StructType([texts[0], T.StructField("line_no", T.LongType()), *texts[1:]])
    boxes = whole.mapInArrow(cut, box).repartition(F.xxhash64("_pair", "line_no"))
    return boxes.select(*(F.col("_pair")[k].alias(k) for k in keys), "line_no", "a", "b")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of one row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def _numbered(batch: pa.RecordBatch) -> list[pa.ListArray]:
    """``a`` and ``b`` of the one row, each different line a number."""
    a, b = (batch.column(c)[0].values for c in ("a", "b"))
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (codes[:len(a)], codes[len(a):])]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few pairs, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, _PAIRS):
            yield batch.slice(k, _PAIRS)


def _offset_sweep(x: Sequence[str], y: Sequence[str], first: int, every: int) -> dict[int, np.ndarray]:
    """sweep() at i = first, first + every, ...: rows ``first`` lines later than multiples of ``every``."""
    pad = every - first
    return {i - pad: bits for i, bits in sweep([None] * pad + list(x), y, every).items() if i > pad}


# --- DataFrames ------------------------------------------------------------------

def line_diff(pairs: DataFrame, keys: list[str], box_lines: int = BOX_LINES) -> DataFrame:
    """Rows (keys, line_no, op, line) for each pair's ``text_a`` and ``text_b``; ``keys`` name one pair.

    Equal texts never leave the JVM.  Texts of more than ``box_lines`` lines are cut first; the rows are the same.
    Pairs are compared where they are, so that their texts are not shuffled; only those too long for one task are dealt.
    """
    # The branches below ask for the same rows of a join and for nothing of one text alone, nor for equality (which would be
    # a key of that join): so they have its shuffles of texts in common.
    known = pairs.filter(F.col("text_a").isNotNull() & F.col("text_b").isNotNull())
    equal = F.col("text_a").between(F.col("text_b"), F.col("text_b"))
    split = lambda c: F.split(c, "\n", -1)
    same = known.filter(equal).select(*keys, F.posexplode(split("text_a")).alias("line_no", "line"))
    same = same.select(*keys, F.col("line_no").cast("long").alias("line_no"), F.lit(" ").alias("op"), "line")
    side = max(box_lines, isqrt(HELD_CELLS))
    bytes_, lines = ([f(F.col(c)).cast("long") + 1 for c in ("text_a", "text_b")] for f in (F.octet_length, lambda c: F.regexp_count(c, F.lit("\n"))))
    long = (bytes_[0] * bytes_[1] > side * side) & (lines[0] * lines[1] > side * side)  # most are short enough by their bytes
    fields = sorted((f for f in pairs.schema.fields if f.name in keys), key=lambda f: keys.index(f.name))
    schema = T.StructType(fields + [
        T.StructField("line_no", T.LongType()), T.StructField("op", T.StringType()), T.StructField("line", T.StringType()),
    ])
    held = known.filter(~equal & ~long).select(*keys, F.lit(0).cast("long").alias("line_no"), split("text_a").alias("a"), split("text_b").alias("b"))
    boxes = (held, _cut(known.filter(~equal & long), keys, side))
    return reduce(DataFrame.unionByName, (b.mapInArrow(_differ(keys, side, box_lines), schema) for b in boxes), same)


def _differ(keys: list[str], *sizes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = ([], [], [], [])  # pair, line number, op, line

            def rows():
                taken = pa.array(out[0], pa.int64())
                found = [pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.string(), pa.string()))]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keys), *found], names=[*keys, "line_no", "op", "line"])

            for k, (first, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("line_no", "a", "b")))):
                for before, x, y in boxes_of(a, b, *sizes):
                    for no, (op, line) in enumerate(diff_sequences(x, y), first + before):
                        for c, v in zip(out, (k, no, op, line)):
                            c.append(v)
                        if len(out[0]) >= _BATCH_LINES:
                            yield rows()
            if out[0]:
                yield rows()

    return run


def diff_summary(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Lines added and removed per pair."""
    added, removed = F.count_if(F.col("op") == "+"), F.count_if(F.col("op") == "-")
    return diff.groupBy(*keys).agg(
        added.alias("added"), removed.alias("removed"), ((added + removed) == 0).alias("identical")
    )
