"""Per-tag and per-run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_tag, first_segment, is_finite, natural_key
from ..schemas import SERIES
from .ordered import STEP_LEVELS, with_place, with_step_levels


def tag_stats(points: DataFrame) -> DataFrame:
    """Count, step extent and last value (by step) of each series of deduplicated points."""
    return points.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        F.max_by("value", "step").alias("last_value"),
    )


def positions(points: DataFrame) -> DataFrame:
    """Position index of deduplicated points: per series and block of steps the points, those that are not finite, and
    the first and last finite value.

    A few rows per series.  Running positions and values follow from it without a pass over the points.
    """
    value = F.col("value").cast("double")
    finite = F.when(is_finite(value), F.col("step"))
    return with_step_levels(points).groupBy(*SERIES, *STEP_LEVELS).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(~is_finite(value)).alias("bad"),
        F.max_by(value, finite).alias("fin"), F.min_by(value, finite).alias("fin_head"))


def fold_stats(stats: DataFrame, tag=None, order=None) -> DataFrame:
    """Combine statistics of several parts of a series, or of tags that become one.

    Counts add up; the last value is that of the greatest ``max_step``, later parts
    (by ``order``) winning ties.
    """
    tag = F.col("tag") if tag is None else tag
    rank = F.struct("max_step", *(order or []))
    return stats.groupBy("run_id", tag.alias("tag")).agg(
        F.sum("count").alias("count"),
        F.min("min_step").alias("min_step"),
        F.max("max_step").alias("max_step"),
        F.max_by("last_value", rank).alias("last_value"),
    )


def fold_renamed_stats(stats: DataFrame) -> DataFrame:
    """Statistics under cleaned tag names."""
    return fold_stats(stats.withColumn("_old", F.col("tag")), clean_tag(F.col("tag")), ["_old"])


def run_totals(stats: DataFrame) -> DataFrame:
    """Per run: number of tags and rows, and step extent, from per-tag statistics."""
    return stats.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("num_tags"),
        F.sum("count").alias("num_rows"),
        F.min("min_step").alias("step_min"),
        F.max("max_step").alias("step_max"),
    )


def pass_rows(files: DataFrame, stats: DataFrame, known: DataFrame, texts: DataFrame, bad: DataFrame) -> DataFrame:
    """Per run, what a pass added.

    ``files``: (run_id, size, mtime, start, consumed, first_rec, records, is_new) of the files it read, ``stats`` the
    statistics of its series, ``known`` (run_id, tag) of series that were there before, ``texts`` (run_id) a row for each of
    its texts, ``bad`` (run_id) one for each undecodable record.  Every table is aggregated before it is joined.
    """
    read = files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_new").alias("new_files"), F.sum(F.col("consumed") - F.col("start")).alias("bytes"),
        F.sum(F.col("records") - F.col("first_rec")).alias("records"), F.max("mtime").alias("updated_at"))
    totals = run_totals(stats).withColumnsRenamed({"num_rows": "new_rows"}).drop("num_tags")
    fresh = stats.join(known.select(*SERIES).distinct(), SERIES, "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("new_tags"))
    out = read.join(totals, "run_id", "left").join(fresh, "run_id", "left")
    for rows, name in ((texts, "new_texts"), (bad, "bad_records")):
        out = out.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left")
    counts = ("new_rows", "new_tags", "new_texts", "bad_records")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def fold_passes(passes: DataFrame) -> DataFrame:
    """Runs from what each pass added: sums, extents of the steps, newest modification."""
    return passes.groupBy("run_id").agg(
        F.sum("new_tags").alias("num_tags"), F.sum("new_rows").alias("num_rows"),
        F.coalesce(F.min("step_min"), F.lit(0)).alias("step_min"), F.coalesce(F.max("step_max"), F.lit(0)).alias("step_max"),
        F.sum("new_files").alias("num_event_files"), F.max("updated_at").alias("updated_at"),
        F.sum("bad_records").alias("bad_records"))


def files_per_run(files: DataFrame) -> DataFrame:
    """Event files per run and newest modification time."""
    return files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("num_event_files"), F.max("mtime").alias("updated_at")
    )


def step_extent(runs: DataFrame) -> DataFrame:
    """One row with the step extent over ``runs``; 0 and 0 when there are none."""
    return runs.agg(
        F.coalesce(F.min("step_min"), F.lit(0)).alias("step_min"),
        F.coalesce(F.max("step_max"), F.lit(0)).alias("step_max"),
    )


def group_counts(tags: DataFrame) -> DataFrame:
    """Tags per top-level group, with the group's position (from 0) in natural tag order.

    A group stands where the first of its tags does.  Tags are reduced to one row per group
    before anything is ordered.
    """
    t = tags.select("tag").distinct()
    first = F.min(F.struct(natural_key(F.col("tag")).alias("key"), F.col("tag").alias("tag")))
    groups = t.groupBy(first_segment(F.col("tag")).alias("group")).agg(F.count(F.lit(1)).alias("tags"), first.alias("_first"))
    groups = groups.select("group", "tags", F.col("_first.tag").alias("first_tag"), F.col("_first.key").alias("_key"))
    return with_place(groups, "_key", ["first_tag"], "position").select("group", "tags", "first_tag", "position")


def single_points(points: DataFrame, value: str = "value") -> DataFrame:
    """Number of finite values per series and whether it is drawn as a dot."""
    finite = F.count_if(is_finite(F.col(value).cast("double")))
    return points.groupBy(*SERIES).agg(finite.alias("finite"), (finite <= 1).alias("is_point"))
