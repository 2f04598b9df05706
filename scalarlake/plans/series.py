"""Reading series: the main read path and what is derived from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null, is_finite
from ..operators.dedup import latest
from ..operators.downsample import lttb
from ..operators.gaps import gap_markers, gaps_in_window
from ..operators.ordered import STEP_LEVELS, running, with_first, with_step_levels
from ..operators.quantiles import outlier_range
from ..operators.select import in_request_order, restrict, with_display_name
from ..operators.smooth import ema
from ..operators.stats import single_points
from ..schemas import SERIES

#: Points per part of a nested series: a row holds at most so many, longer series have several parts.
NESTED_PART = 100_000


def check_max_points(max_points: int) -> None:
    if max_points < 0:
        raise ValueError("max_points must not be negative")


def _placed(runs):
    if runs is None or isinstance(runs, DataFrame) and "place" not in runs.columns:
        raise ValueError("order needs a list of runs, or a table (run_id, place)")
    return runs


@dataclass
class SeriesResult:
    """Long rows of downsampled points, and of the breaks in the full series."""

    points: DataFrame
    full: DataFrame
    runs: Sequence[str] | DataFrame | None = None
    counted: DataFrame | None = None

    @cached_property
    def gaps(self) -> DataFrame:
        return gap_markers(self.full, counted=self.counted)

    @cached_property
    def in_order(self) -> DataFrame:
        """Points with ``place``, the position of their run in the request, sorted by place, tag and step."""
        return in_request_order(self.points, _placed(self.runs))


def get_series(
    scalars: DataFrame,
    runs: Sequence[str] | DataFrame | None = None,
    tags: Sequence[str] | DataFrame | None = None,
    max_points: int = 1500,
    names: DataFrame | None = None,
    deduplicated: bool = False,
    counted: DataFrame | None = None,
) -> SeriesResult:
    """Downsampled series of the runs x tags that exist.

    ``points``: run_id, tag, step, wall_time, value (null where not finite), count
    (points before downsampling) and, with ``names``, display_name.

    ``counted`` is the position index of the same rows (``stats.positions``), which must be deduplicated:
    the points are then read in one scan.
    """
    check_max_points(max_points)
    chosen = restrict(scalars, runs, tags)
    rows = chosen.select(*SERIES, "step", "wall_time", "value") if deduplicated else latest(chosen)
    if counted is not None:
        counted = restrict(counted, runs, tags)
    points = lttb(rows, max_points, counted).select(
        *SERIES, "step", "wall_time",
        finite_or_null(F.col("value").cast("double")).alias("value"),
        F.col("n").alias("count"),
    )
    if names is not None:
        points = with_display_name(points, names)
    return SeriesResult(points, rows, runs, counted)


def nested(points: DataFrame) -> DataFrame:
    """One row per series with its points as an array.

    A series longer than 100,000 points (only possible without downsampling) is
    split into several rows, numbered by ``part``.
    """
    levelled = with_step_levels(points)
    block = [*SERIES, *STEP_LEVELS]
    carry = running(levelled.groupBy(*block).agg(F.count(F.lit(1)).alias("c")), SERIES, STEP_LEVELS, sums=["c"])
    local = F.row_number().over(Window.partitionBy(*block).orderBy("step")) - 1
    part = F.floor((F.col("c_before") + F.col("_r")) / NESTED_PART)
    return (
        levelled.withColumn("_r", local).join(carry, block)
        .groupBy(*SERIES, part.alias("part"))
        .agg(F.max("count").alias("count"),
             F.array_sort(F.collect_list(F.struct("step", "value", "wall_time"))).alias("points"))
    )


def step_window(points: DataFrame, lo: int, hi: int) -> DataFrame:
    return points.filter(F.col("step").between(lo, hi))


def relative_minutes(points: DataFrame, out: str = "minutes") -> DataFrame:
    """Minutes since the first visible point of the series."""
    started = with_first(points, SERIES, "wall_time", "_w0")
    return started.withColumn(out, (F.col("wall_time") - F.col("_w0")) / 60.0).drop("_w0")


@dataclass
class View:
    """What a chart of some series shows; each part is planned when it is asked for."""

    visible: DataFrame
    series: SeriesResult
    window: tuple[int, int] | None
    x: str
    smooth: float | None
    clip: tuple[float, float] | None
    logy: bool

    @cached_property
    def points(self) -> DataFrame:
        out = self.visible if self.smooth is None else ema(self.visible, self.smooth)
        return relative_minutes(out) if self.x == "wall_time" else out

    @cached_property
    def in_order(self) -> DataFrame:
        """Points in the order of the request's runs, see SeriesResult."""
        return in_request_order(self.points, _placed(self.series.runs))

    @cached_property
    def gaps(self) -> DataFrame:
        """Markers inside the window; ``minutes`` counts from the first visible point."""
        out = self.series.gaps
        if self.window:
            out = gaps_in_window(out, *self.window)
        if self.x == "wall_time":
            starts = self.visible.groupBy(*SERIES).agg(F.min_by("wall_time", "step").alias("_w0"))
            minutes = (F.col("wall_time") - F.col("_w0")) / 60.0
            out = out.join(starts, SERIES, "left").withColumn("minutes", minutes).drop("_w0")
        return out

    @cached_property
    def ranges(self) -> DataFrame | None:
        return outlier_range(self.visible, *self.clip, logy=self.logy) if self.clip else None

    @cached_property
    def dots(self) -> DataFrame:
        return single_points(self.visible)


def series_view(
    scalars: DataFrame,
    runs=None,
    tags=None,
    max_points: int = 1500,
    window: tuple[int, int] | None = None,
    x: str = "step",
    smooth: float | None = None,
    clip: tuple[float, float] | None = None,
    logy: bool = False,
    window_first: bool = False,
    names: DataFrame | None = None,
) -> View:
    """Series under view options, in the order dedup, gaps, downsampling, window, rest.

    So smoothing and percentiles see the downsampled points of the window, and
    depend on ``max_points``; ``max_points=0`` is full resolution.  With
    ``window_first`` the window is applied before downsampling instead and is
    pushed into the scan.
    """
    if x not in ("step", "wall_time"):
        raise ValueError("x must be 'step' or 'wall_time'")
    if window and window_first:
        scalars = step_window(scalars, *window)
    result = get_series(scalars, runs, tags, max_points, names)
    visible = step_window(result.points, *window) if window else result.points
    return View(visible, result, window, x, smooth, clip, logy)


@dataclass
class Overlay:
    points: DataFrame
    ranges: DataFrame


def overlay(
    scalars: DataFrame, tag_a: str, tag_b: str, runs=None, max_points: int = 1500,
    window: tuple[int, int] | None = None, smooth: float | None = None,
    q_low: float = 0.01, q_high: float = 0.99, logy: bool = False,
) -> Overlay:
    """Two tags over the same runs, labelled A and B, with a y-range per side.

    Both tags are read in one pass; the same tag may be picked on both sides.
    """
    points = get_series(scalars, runs, [tag_a, tag_b], max_points).points
    if window:
        points = step_window(points, *window)
    if smooth is not None:
        points = ema(points, smooth)
    sides = F.filter(
        F.array(F.struct(F.lit("A").alias("side"), F.lit(tag_a).alias("t")),
                F.struct(F.lit("B").alias("side"), F.lit(tag_b).alias("t"))),
        lambda s: s["t"] == F.col("tag"),
    )
    labelled = points.withColumn("side", F.explode(F.transform(sides, lambda s: s["side"])))
    return Overlay(labelled, outlier_range(labelled, q_low, q_high, logy, by=["side"]))


def positive_only(points: DataFrame, value: str = "value") -> DataFrame:
    """Points that a log axis can show."""
    v = F.col(value).cast("double")
    return points.filter(is_finite(v) & (v > 0))
