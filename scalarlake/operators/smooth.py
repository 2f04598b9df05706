"""Debiased exponential moving average.

``state = state*w + (1-w)*v`` over finite values, reported as
``state / (1 - w**k)`` after the k-th finite value.  Non-finite values give null
and leave the state unchanged.

The recurrence is affine, so a block of m finite values maps the state s to
``w**m * s + S``.  Blocks report (m, S), these pairs are combined in order over
the small block table, and every block then starts from its own incoming state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_finite
from ..schemas import SERIES
from .downsample import stretch_numbers
from .ordered import STEP_LEVELS, with_step_levels


def ema(points: DataFrame, weight: float, value: str = "value", out: str = "smooth") -> DataFrame:
    """Add ``out``, the smoothed ``value``; rows unique per (run, tag, step)."""
    if not 0.0 <= weight < 1.0:
        raise ValueError("weight must be in [0, 1)")
    rows = with_step_levels(points)
    block = [*SERIES, *STEP_LEVELS]
    v = F.col(value).cast("double")
    finite = rows.filter(is_finite(v))
    age = F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("step"))) - 1
    blocks = (
        finite.select(*block, "step", v.alias("_v")).withColumn("_age", age)
        .groupBy(*block)
        .agg(F.count(F.lit(1)).alias("m"),
             F.sum((1 - weight) * F.col("_v") * F.pow(F.lit(weight), F.col("_age"))).alias("s"))
    )
    carried = _carry(blocks, weight)
    schema = T.StructType([*points.schema.fields, T.StructField(out, T.DoubleType())])
    names = points.columns
    joined = rows.join(carried, block, "left").select(
        *names, *STEP_LEVELS,
        F.coalesce("s_in", F.lit(0.0)).alias("_s"), F.coalesce("m_in", F.lit(0)).alias("_m"),
    )
    return (
        joined.repartition(F.xxhash64(*block))  # not the join's partitioning, which Spark may read locally instead
        .sortWithinPartitions(*block, "step")
        .mapInArrow(_scanner(weight, value, out, names), schema)
    )


def _carry(blocks: DataFrame, weight: float) -> DataFrame:
    """Incoming state ``s_in`` and finite count ``m_in`` of every block."""
    group = [*SERIES, "_sup"]
    inner = blocks.groupBy(*group).applyInPandas(
        _composer(weight, "_blk"),
        "run_id string, tag string, _sup long, _blk long, s_in double, m_in long, s_end double, m_end long",
    )
    ends = inner.groupBy(*group).agg(
        F.max_by("s_end", "_blk").alias("s"), F.max("m_end").alias("m")
    )
    outer = ends.withColumn("_blk", F.lit(0).cast("long")).groupBy(*SERIES).applyInPandas(
        _composer(weight, "_sup"),
        "run_id string, tag string, _sup long, _blk long, s_in double, m_in long, s_end double, m_end long",
    ).select(*group, F.col("s_in").alias("s_up"), F.col("m_in").alias("m_up"))
    return inner.join(outer, group).select(
        *group, "_blk",
        (F.col("s_in") + F.pow(F.lit(weight), F.col("m_in")) * F.col("s_up")).alias("s_in"),
        (F.col("m_in") + F.col("m_up")).alias("m_in"),
    )


def _composer(weight: float, order: str):
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, seen = 0.0, 0
        rows = []
        for m, s in zip(pdf["m"].tolist(), pdf["s"].tolist()):
            nxt = state * weight**m + s
            rows.append((state, seen, nxt, seen + m))
            state, seen = nxt, seen + m
        s_in, m_in, s_end, m_end = map(list, zip(*rows))
        return pdf[["run_id", "tag", "_sup", "_blk"]].assign(s_in=s_in, m_in=m_in, s_end=s_end, m_end=m_end)

    return compose


def _scan(v: np.ndarray, first: np.ndarray, weight: float, state: np.ndarray) -> np.ndarray:
    """States after each finite value of stretches that start where ``first``, from one state per stretch.

    Doubling: with d = 1, 2, 4, ... each entry takes in w^d times the entry d places before it, which by then
    sums up d values; entries of other stretches do not count, and w^d soon is nothing.
    """
    a = (1 - weight) * v
    starts = np.flatnonzero(first)
    a[starts] += weight * state
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    d, power = 1, weight
    while d < len(a) and power > 1e-18:
        more = np.where(place[d:] >= d, a[:-d], 0.0)
        a[d:] += power * more
        d, power = 2 * d, power * power
    return a


def _scanner(weight: float, value: str, out: str, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = None
        state, seen = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = ("run_id", "tag", "_blk")
            stretch = stretch_numbers(batch, *key)
            ends = [[batch.column(c)[i].as_py() for c in key] for i in (0, batch.num_rows - 1)]
            starts = np.flatnonzero(np.diff(stretch, prepend=-1))
            states = batch.column("_s").to_numpy(zero_copy_only=False)[starts].astype(np.float64)
            counts = batch.column("_m").to_numpy(zero_copy_only=False)[starts].astype(np.int64)
            if ends[0] == last_key:  # goes on from the batch before
                states[0], counts[0] = state, seen
            last_key = ends[1]
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(v)
            res = np.zeros(len(v))
            mine = stretch[good]
            if len(mine):
                first = np.diff(mine, prepend=-1) != 0
                after = _scan(v[good], first, weight, states[mine[first]])
                begin = np.flatnonzero(first)
                place = np.arange(len(mine)) - np.repeat(begin, np.diff(np.append(begin, len(mine))))
                nth = counts[mine] + place + 1
                res[good] = after / (1 - weight ** nth.astype(np.float64))
            if len(mine) and mine[-1] == stretch[-1]:
                state, seen = after[-1], nth[-1]
            else:
                state, seen = states[-1], counts[-1]
            smoothed = pa.array(res, mask=~good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), smoothed], names=[*names, out])

    return scan
