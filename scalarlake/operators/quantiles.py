"""Exact percentile y-range per tag, over all runs.

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here
equal values are counted first (on the map side already), a coarse histogram
finds the cells that hold the wanted ranks, and only those cells are ordered.
A cell spans a 128th of a power of two; values are single-precision, so a tag has
at most about 71,000 cells and a cell about 92,000 distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite, log10_floor

MIN_VALUES = 5  # fixed value: fewer values give no range
_PER_OCTAVE = 128
_OFFSET = 1100.0
_UNUSED = -(2**40)


def _cell(v: Column) -> Column:
    """Non-decreasing integer function of ``v``."""
    size = F.floor((F.log2(F.abs(v)) + _OFFSET) * _PER_OCTAVE)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * size)


def quantile_bounds(
    points: DataFrame, q_low: float, q_high: float, by: list[str], value: str = "value", positive: bool = False
) -> DataFrame:
    """``n``, ``q_lo`` and ``q_hi`` per group: linear interpolation between ranks.

    ``n`` counts the finite (with ``positive``: the positive) values; groups without
    any are kept, with null bounds.
    """
    v = F.col(value).cast("double")
    wanted = is_finite(v) & (v > 0) if positive else is_finite(v)
    # Values that do not count are one null cell, so that every group has a row;
    # adding 0.0 makes -0.0 and 0.0 one value.
    cells = (
        points.select(*by, F.when(wanted, v + 0.0).alias("v"))
        .withColumn("cell", F.coalesce(_cell(F.col("v")), F.lit(_UNUSED)))
        .groupBy(*by, "cell", "v").agg(F.count("v").alias("c"))
    )
    per_group = Window.partitionBy(*by)
    upto = per_group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = (
        cells.groupBy(*by, "cell").agg(F.sum("c").alias("cc"))
        .withColumn("n", F.sum("cc").over(per_group))
        .withColumn("before", F.sum("cc").over(upto) - F.col("cc"))
    )
    ranks = []
    for name, q in (("lo", q_low), ("hi", q_high)):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        ranks += [(f"{name}_a", F.floor(pos)), (f"{name}_b", F.ceil(pos))]
    hits = [(F.col("before") <= r) & (r < F.col("before") + F.col("cc")) for _, r in ranks]
    needed = coarse.filter(hits[0] | hits[1] | hits[2] | hits[3] | (F.col("cell") == _UNUSED)).select(
        *by, "cell", "n", "before"
    )
    in_cell = Window.partitionBy(*by, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = (
        cells.join(needed, [*by, "cell"])
        .withColumn("end", F.col("before") + F.sum("c").over(in_cell))
        .withColumn("start", F.col("end") - F.col("c"))
    )
    at_rank = [F.max(F.when((F.col("start") <= r) & (r < F.col("end")), F.col("v"))).alias(name) for name, r in ranks]
    out = fine.groupBy(*by).agg(F.max("n").alias("n"), *at_rank)
    for name, q in (("lo", q_low), ("hi", q_high)):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        out = out.withColumn(f"q_{name}", a + (b - a) * (pos - F.floor(pos)))
    return out.select(*by, "n", "q_lo", "q_hi")


def outlier_range(
    points: DataFrame, q_low: float = 0.01, q_high: float = 0.99, logy: bool = False,
    by: list[str] | None = None, value: str = "value",
) -> DataFrame:
    """``y_lo`` / ``y_hi`` per tag: percentiles of the finite values, padded by 5 %.

    On a log axis only positive values count and the range is in log10, unpadded.
    Null when there are fewer than five values or the range is empty.
    """
    by = by or ["tag"]
    b = quantile_bounds(points, q_low, q_high, by, value, positive=logy)
    usable = (F.col("n") >= MIN_VALUES) & (F.col("q_hi") > F.col("q_lo"))
    pad = (F.col("q_hi") - F.col("q_lo")) * 0.05
    if logy:
        lo, hi = log10_floor(F.col("q_lo")), log10_floor(F.col("q_hi"))
    else:
        lo, hi = F.col("q_lo") - pad, F.col("q_hi") + pad
    return b.select(*by, "n", F.when(usable, lo).alias("y_lo"), F.when(usable, hi).alias("y_hi"))
