"""Largest-triangle-three-buckets downsampling of many series at once.

The triangle area is, for a fixed previous pick and a fixed far vertex, the
absolute value of a linear function of the candidate point.  Its maximum over a
bucket is therefore reached at a corner of the bucket's convex hull.  So:

1. every row gets its index, bucket number and series length (block-wise, see
   ``ordered``);
2. tasks reduce sorted stretches of a bucket to their hull corners plus partial
   sums, while streaming; a bucket of any size may be spread over any number of
   tasks, and a block of four million rows leaves a few dozen corners;
3. the pick, which is sequential over buckets, runs per series on these corners,
   merging those of one bucket first.

The pick sees every point that can win, so nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null
from ..schemas import SERIES
from .ordered import STEP_LEVELS, with_position, with_step_levels

_CORNERS = (
    "run_id string, tag string, b long, step long, wall_time double, value float, n long, "
    "cnt long, sum_x double, sum_y double"
)
_PICKS = "run_id string, tag string, step long, wall_time double, value float, n long"
_BUFFER_ROWS = 200_000


def bucket_number(k: Column, n: Column, max_points: int) -> Column:
    """Bucket of index ``k``: -1 for the first point, ``max_points - 2`` for the last.

    Inner bucket j holds indices e(j) <= k < e(j+1) with
    e(j) = floor(j * (n-2)/(max_points-2) + 1); the guess is off by at most one.
    """
    width = (n - 2).cast("double") / F.lit(float(max_points - 2))
    top = F.lit(max_points - 3).cast("long")

    def edge(j):
        return F.floor(j.cast("double") * width + 1)

    guess = F.least(F.greatest(F.floor((k - 1).cast("double") / width), F.lit(0).cast("long")), top)
    inner = (
        F.when(edge(guess) > k, guess - 1)
        .when((guess < top) & (edge(guess + 1) <= k), guess + 1)
        .otherwise(guess)
    )
    return F.when(k == 0, -1).when(k == n - 1, max_points - 2).otherwise(inner)


def lttb(points: DataFrame, max_points: int, counted: DataFrame | None = None) -> DataFrame:
    """Series of at most ``max_points`` points, keeping each series' shape.

    ``points`` is deduplicated (one row per run, tag and step).  Adds ``n``, the
    number of points before downsampling.  Series that are short enough, and all
    series when ``max_points`` < 3, are returned whole.  Non-finite values count
    as 0 in areas and are returned as they are.  ``counted``: see ``stats.positions``.
    """
    if counted is not None:
        counted = counted.select(*SERIES, *STEP_LEVELS, F.col("points").alias("_c"))
    rows = with_position(with_step_levels(points), SERIES, STEP_LEVELS, ["step"], counted)
    if max_points < 3:
        return rows.select(*SERIES, "step", "wall_time", "value", "n")
    k, n = F.col("k"), F.col("n")
    # One pass for all series; each point of a short series is a bucket of its own.
    corners = (
        rows.withColumn("b", F.when(n <= max_points, k).otherwise(bucket_number(k, n, max_points)).cast("long"))
        .sortWithinPartitions(*SERIES, *STEP_LEVELS, "step")
        .select(*SERIES, "b", "step", "wall_time", "value", "n",
                F.lit(1).cast("long").alias("cnt"), F.col("step").cast("double").alias("sum_x"),
                F.coalesce(finite_or_null(F.col("value")), F.lit(0.0)).cast("double").alias("sum_y"))
        .mapInArrow(_hull_corners, _CORNERS)
    )
    return (
        corners.repartition(*SERIES)
        .sortWithinPartitions(*SERIES, "b", "step")
        .mapInPandas(_picker(max_points), _PICKS)
    )


def _segments(batch: pd.DataFrame, *columns: str) -> np.ndarray:
    """Number of the stretch of equal ``columns`` each row belongs to."""
    new = np.zeros(len(batch), dtype=bool)
    for c in columns:
        v = batch[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _hull_corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce sorted stretches to hull corners; sums move to a stretch's first row.

    The stretch that is open at the end of a batch is carried into the next one.
    Names stay in Arrow, where comparing and selecting them is cheap.
    """
    open_rows = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_rows is not None:
            batch = pa.concat_batches([open_rows, batch])
        seg = stretch_numbers(batch, "run_id", "tag", "b")
        x, y, cnt, sum_x, sum_y = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("step", "value", "cnt", "sum_x", "sum_y"))
        keep, sums = _thin(seg, x, y, cnt, sum_x, sum_y)
        if len(keep) < batch.num_rows:
            batch = batch.take(pa.array(keep))
            for c, v in zip(("cnt", "sum_x", "sum_y"), sums):
                i = batch.schema.get_field_index(c)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(v))
        cut = int(np.searchsorted(seg[keep], seg[-1]))
        open_rows = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if open_rows is not None:
        yield open_rows


def stretch_numbers(batch: pa.RecordBatch, *columns: str) -> np.ndarray:
    """Number of the stretch of equal ``columns`` each row of an Arrow batch belongs to."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in columns:
        v = batch.column(c)
        new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _thin(seg, x, y, cnt, sum_x, sum_y) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows to keep, and their counts and sums."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    y = np.where(np.isfinite(y), y, 0.0)
    if seg[-1] + 1 == len(seg):
        return np.arange(len(seg)), [cnt, sum_x, sum_y]
    keep = np.union1d(_chain(x, y, seg, 1.0), _chain(x, y, seg, -1.0))
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    first = np.searchsorted(keep, starts)  # the first row of a stretch is always kept
    sums = []
    for c in (cnt, sum_x, sum_y):
        total = np.add.reduceat(c, starts)
        v = np.zeros(len(keep), dtype=total.dtype)
        v[first] = total
        sums.append(v)
    return keep, sums


def _reduce(batch: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    seg = _segments(batch, "run_id", "tag", "b")
    names = ("step", "value", "cnt", "sum_x", "sum_y")
    keep, sums = _thin(seg, *(batch[c].to_numpy() for c in names))
    if len(keep) == len(batch):
        return batch, seg
    out = batch.iloc[keep].reset_index(drop=True)
    for c, v in zip(names[2:], sums):
        out[c] = v
    return out, seg[keep]


def _xy(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    y = batch["value"].to_numpy().astype(np.float64)
    return batch["step"].to_numpy().astype(np.float64), np.where(np.isfinite(y), y, 0.0)


def _chain(x: np.ndarray, y: np.ndarray, seg: np.ndarray, side: float) -> np.ndarray:
    """Indices on the upper (side 1) or lower (side -1) hull of each stretch.

    A point on or below the chord of two other points of its stretch is no corner,
    so whole arrays are thinned at once; the few passes that do not converge are
    finished by the usual stack scan.
    """
    idx = np.arange(len(x))
    for _ in range(12):
        if len(idx) < 3:
            return idx
        a, p, c = idx[:-2], idx[1:-1], idx[2:]
        turn = (y[p] - y[a]) * (x[c] - x[a]) - (y[c] - y[a]) * (x[p] - x[a])
        drop = (side * turn <= 0) & (seg[a] == seg[c])
        if not drop.any():
            return idx
        idx = idx[np.r_[True, ~drop, True]]
    xs, ys, ss = x[idx].tolist(), (side * y[idx]).tolist(), seg[idx].tolist()
    stack: list[int] = []
    base = 0
    for i in range(len(xs)):
        if i and ss[i] != ss[i - 1]:
            base = len(stack)
        while len(stack) - base >= 2:
            a, p = stack[-2], stack[-1]
            if (ys[p] - ys[a]) * (xs[i] - xs[a]) - (ys[i] - ys[a]) * (xs[p] - xs[a]) > 0:
                break
            stack.pop()
        stack.append(i)
    return idx[stack]


def _picker(max_points: int):
    """Pick per series from its sorted corners; a long series is thinned while it streams in."""

    def finish(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        short = rows["n"].to_numpy() <= max_points
        if short.all():
            return rows[_OUT]
        reduced, _ = _reduce(rows[~short].reset_index(drop=True))
        seg = _segments(reduced, "run_id", "tag")
        cuts = np.r_[np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]), len(seg)]
        b, cnt, sum_x, sum_y = (reduced[c].to_numpy() for c in ("b", "cnt", "sum_x", "sum_y"))
        x, y = _xy(reduced)
        chosen: list[int] = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            s = slice(lo, hi)
            chosen += [lo + i for i in _pick(b[s], x[s], y[s], cnt[s], sum_x[s], sum_y[s])]
        return pd.concat([rows[short][_OUT], reduced.iloc[chosen][_OUT]], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        held, limit = 0, _BUFFER_ROWS
        for batch in batches:
            if batch.empty:
                continue
            # Everything before the batch's last series is complete.
            seg = _segments(batch, "run_id", "tag")
            cut = int(np.searchsorted(seg, seg[-1]))
            if parts and not _same_series(parts[-1], batch):
                yield finish(parts)
                parts, held, limit = [], 0, _BUFFER_ROWS
            if cut:
                yield finish([*parts, batch.iloc[:cut]])
                parts, held, limit = [], 0, _BUFFER_ROWS
                batch = batch.iloc[cut:]
            parts.append(batch)
            held += len(batch)
            if held > limit:
                reduced, _ = _reduce(pd.concat(parts, ignore_index=True))
                parts, held = [reduced], len(reduced)
                limit = _BUFFER_ROWS + 2 * held
        if parts:
            yield finish(parts)

    return run


_OUT = ["run_id", "tag", "step", "wall_time", "value", "n"]


def _same_series(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return a["tag"].iloc[-1] == b["tag"].iloc[0] and a["run_id"].iloc[-1] == b["run_id"].iloc[0]


def _pick(b, x, y, cnt, sum_x, sum_y) -> list[int]:
    """Positions of one series' picks; rows are sorted, buckets -1, 0, 1, ... all present."""
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    count = np.add.reduceat(cnt, start)
    far_x = (np.add.reduceat(sum_x, start) / count).tolist()
    far_y = (np.add.reduceat(sum_y, start) / count).tolist()
    start = [*start.tolist(), len(b)]
    xs, ys = x.tolist(), y.tolist()
    at = 0
    chosen = [0]
    for j in range(1, len(start) - 2):
        lo, hi = start[j], start[j + 1]
        if hi - lo > 1:
            ax, ay, fx, fy = xs[at], ys[at], far_x[j + 1], far_y[j + 1]
            best, at = -1.0, lo
            for i in range(lo, hi):
                area = abs((ax - fx) * (ys[i] - ay) - (ax - xs[i]) * (fy - ay))
                if area > best:
                    best, at = area, i
        else:
            at = lo
        chosen.append(at)
    chosen.append(len(b) - 1)
    return chosen
