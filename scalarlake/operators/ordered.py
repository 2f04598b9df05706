"""Running values along long ordered groups without putting a group in one task.

A plain ``Window.partitionBy("run_id", "tag")`` sends a whole series to one task,
which fails when one series holds a large share of all rows.  Here every series
is cut into *blocks* by its order key; blocks are spread over the cluster, each
is reduced to one small row, the running values are computed over those rows,
and the result is joined back to the rows of the block.

Steps are integers and unique within a deduplicated series, so a block of
2**22 consecutive steps holds at most about four million rows, and 2**22
consecutive blocks form the next level.  Every window below therefore has a
fixed upper bound, whatever the data looks like, and no sampling is involved:
replaying a lost task gives the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

BLOCK_BITS = 22

STEP_LEVELS = ["_sup", "_blk"]


def with_step_levels(df: DataFrame, keys: Sequence[str] = ("run_id", "tag"), step: str = "step") -> DataFrame:
    """Add the block columns.

    Keys and steps are never null; saying so here keeps Catalyst from adding the
    check to some branches of a plan only, which would stop it from sharing their
    common shuffles.
    """
    out = df.withColumns({"_sup": F.shiftright(step, 2 * BLOCK_BITS), "_blk": F.shiftright(step, BLOCK_BITS)})
    return out.filter(" and ".join(f"{c} is not null" for c in [*keys, "_sup", "_blk"]))


def running(
    blocks: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
) -> DataFrame:
    """Values carried into each block from the blocks before it in its group.

    ``blocks`` has one row per block: ``keys``, the ``levels`` (outermost first)
    and one column per measure.  The result has, per block,

    * ``<m>_before`` and ``<m>_total`` for each of ``sums``;
    * ``<m>_before`` (latest non-null value before the block) and ``<m>_first``
      (first non-null value of the whole group) for each of ``lasts``.  Each
      such measure ``m`` needs a column ``m`` (last value in the block) and
      ``m_head`` (first value in the block).
    """
    keys, levels = list(keys), list(levels)
    parent = keys + levels[:-1]
    measures = [*sums, *lasts]
    within = Window.partitionBy(*parent)
    earlier = within.orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    whole = within.orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Both windows have one partitioning and one order: one shuffle, one sort.
    added = {f"{m}_before": F.coalesce(F.sum(m).over(earlier), F.lit(0)) for m in sums}
    added |= {f"{m}_total": F.sum(m).over(whole) for m in sums}
    added |= {f"{m}_before": F.last(m, ignorenulls=True).over(earlier) for m in lasts}
    added |= {f"{m}_first": F.first(f"{m}_head", ignorenulls=True).over(whole) for m in lasts}
    local = blocks.withColumns(added)
    names = [f"{m}_before" for m in measures] + [f"{m}_total" for m in sums] + [f"{m}_first" for m in lasts]
    if levels[:-1]:
        # The parent level comes from the same windowed rows, so its input is shared.
        aggs = [F.first(f"{m}_total").alias(m) for m in sums]
        aggs += [F.max_by(m, F.when(F.col(m).isNotNull(), F.col(levels[-1]))).alias(m) for m in lasts]
        aggs += [F.first(f"{m}_first").alias(f"{m}_head") for m in lasts]
        up = running(local.groupBy(*parent).agg(*aggs), keys, levels[:-1], sums, lasts)
        up = up.select(*parent, *[F.col(c).alias(f"_up_{c}") for c in names])
        local = local.join(up, parent)
        merged = {f"{m}_before": F.col(f"_up_{m}_before") + F.col(f"{m}_before") for m in sums}
        merged |= {f"{m}_before": F.coalesce(f"{m}_before", f"_up_{m}_before") for m in lasts}
        merged |= {c: F.col(f"_up_{c}") for c in names if not c.endswith("_before")}
        local = local.withColumns(merged)
    return local.select(*keys, *levels, *names)


def with_position(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str | Column],
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``k``, the 0-based position in the group, and ``n``, the group's size.

    ``levels`` are columns that cut the order into nested blocks; ``order`` sorts
    rows inside the innermost block.  ``counted`` (keys, levels, ``_c``) gives the rows of each
    block where they are known already; the table is then read once.
    """
    keys, levels = list(keys), list(levels)
    block = keys + levels
    if counted is None:
        counted = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_c"))
    carry = running(counted, keys, levels, sums=["_c"])
    local = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
    return (
        df.withColumn("_r", local)
        .join(carry, block)
        .withColumns({"k": F.col("_c_before") + F.col("_r") - 1, "n": F.col("_c_total")})
        .drop("_r", "_c_before", "_c_total")
    )


#: Characters of a sort key that cut a whole table into nested blocks.
KEY_CUTS = ((1, 2), (3, 4), (7, 8))


def with_place(df: DataFrame, key: str, order: Sequence[str | Column], out: str = "place") -> DataFrame:
    """Add ``out``, the 0-based position of each row of the whole table under (string column ``key``, then ``order``).

    The first characters of the key are the nested blocks, so the windows over blocks have as many rows as there are
    beginnings of keys; only keys that agree in 14 characters are sorted together.
    """
    levels = [f"_p{n}" for n in range(len(KEY_CUTS))]
    cut = df.withColumns({name: F.substring(key, *at) for name, at in zip(levels, KEY_CUTS)})
    return with_position(cut, [], levels, [key, *order]).withColumnRenamed("k", out).drop("n", *levels)


def with_sorted_place(df: DataFrame, order: Sequence[str | Column], out: str = "place") -> DataFrame:
    """Add ``out``, the 0-based position of each row of the whole table in any order that Spark can sort by.

    The rows are sorted in ranges and checkpointed, each with its range and its number there, so that both are fixed; a
    range adds the number of rows before it.  One number for each range is what meets in one task.
    """
    shared_dir(df.sparkSession)
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = dealt.withColumns({"_range": F.spark_partition_id(), "_r": here}).checkpoint()
    sizes = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return fixed.join(before, "_range").withColumn(out, F.col("_before") + F.col("_r")).drop("_range", "_r", "_before")


def with_first(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``, the ``value`` at the smallest step of the row's group."""
    block = [*keys, *STEP_LEVELS]
    rows = with_step_levels(df, keys)
    heads = rows.groupBy(*block).agg(F.min_by(value, "step").alias("w_head")).withColumn("w", F.col("w_head"))
    carry = running(heads, keys, STEP_LEVELS, lasts=["w"]).select(*block, F.col("w_first").alias(out))
    return rows.join(carry, block).drop(*STEP_LEVELS)
