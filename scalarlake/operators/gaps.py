"""Where and why a series breaks: its NaN and infinite points."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite, non_finite_kind
from ..schemas import SERIES
from .ordered import STEP_LEVELS, running, with_step_levels


def gap_markers(points: DataFrame, limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """One row per non-finite point of the full series; the earliest ``limit`` per series, if one is given.

    ``y`` anchors the marker to the previous finite value, else to the series'
    first finite value, else to 0.  Positions come from block offsets, so no series is
    gathered to apply a limit.  ``counted``: see ``stats.positions``.
    """
    rows = with_step_levels(points.select(*SERIES, "step", "wall_time", F.col("value").cast("double")))
    rows = rows.withColumn("_f", F.when(is_finite(F.col("value")), F.col("value")))
    block = [*SERIES, *STEP_LEVELS]
    bad = F.col("_f").isNull()
    finite_step = F.when(~bad, F.col("step"))
    blocks = counted.select(*block, "bad", "fin", "fin_head") if counted is not None else rows.groupBy(*block).agg(
        F.count_if(bad).alias("bad"),
        F.max_by("_f", finite_step).alias("fin"),
        F.min_by("_f", finite_step).alias("fin_head"),
    )
    carry = running(blocks, SERIES, STEP_LEVELS, sums=["bad"], lasts=["fin"])
    # Only blocks with something to report are expanded again.
    carry = carry.join(blocks.filter("bad > 0").select(*block), block, "left_semi")
    if limit is not None:
        carry = carry.filter(F.col("bad_before") < limit)
    so_far = Window.partitionBy(*block).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(carry, block)
        .withColumn("_prev", F.last("_f", ignorenulls=True).over(so_far))
        .withColumn("_nth", F.count_if(bad).over(so_far) + F.col("bad_before"))
        .filter(bad if limit is None else bad & (F.col("_nth") <= limit))
        .select(
            *SERIES, "step", "wall_time",
            non_finite_kind(F.col("value")).alias("kind"),
            F.coalesce("_prev", "fin_before", "fin_first", F.lit(0.0)).alias("y"),
        )
    )


def gaps_in_window(gaps: DataFrame, lo: int | None = None, hi: int | None = None, kind: str | None = None) -> DataFrame:
    """Gap markers inside a step window, optionally of one kind."""
    if lo is not None and hi is not None:
        gaps = gaps.filter(F.col("step").between(lo, hi))
    if kind is not None:
        gaps = gaps.filter(F.col("kind") == kind)
    return gaps
