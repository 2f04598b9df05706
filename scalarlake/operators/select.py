"""Choosing runs and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import by_locale, contains_ignore_case, first_non_empty, locale_key, tag_matches
from .ordered import with_sorted_place


def restrict(df: DataFrame, runs: Sequence[str] | DataFrame | None = None,
             tags: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows of the given runs and tags.

    Lists become literal predicates, which reach the partition filter (runs) and
    the Parquet filter (tags).  DataFrames of keys become semi-joins; whether one
    is broadcast is left to Spark, which knows its size at run time.
    """
    for column, wanted in (("run_id", runs), ("tag", tags)):
        if wanted is None:
            continue
        if isinstance(wanted, DataFrame):
            df = df.join(wanted.select(column), column, "left_semi")
        else:
            df = df.filter(F.col(column).isin(*wanted)) if len(wanted) else df.limit(0)
    return df


def search_tags(tags: DataFrame, pattern: str) -> DataFrame:
    return tags.filter(tag_matches(F.col("tag"), pattern))


def search_runs(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose display name or id contains ``text``, ignoring case."""
    if not text:
        return runs
    return runs.filter(
        contains_ignore_case(F.col("display_name"), text) | contains_ignore_case(F.col("run_id"), text)
    )


def suggest_tags(tags: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Tags containing ``text`` in order, the first ``limit`` if one is given, each with the number of all matches."""
    needle = text.strip()
    found = tags.select("tag").distinct()
    if needle:
        found = found.filter(contains_ignore_case(F.col("tag"), needle))
    total = found.agg(F.count(F.lit(1)))
    found = found.orderBy("tag") if limit is None else found.orderBy("tag").limit(limit)
    return found.withColumn("matches", total.scalar())


def tag_names(tags: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """Sorted union of the tags of the given runs (all runs if none are given)."""
    return restrict(tags, runs or None).select("tag").distinct().orderBy("tag")


def missing_tags(tags: DataFrame, have: str, lack: str) -> DataFrame:
    """Tags that run ``have`` logs and run ``lack`` does not."""
    a = tags.filter(F.col("run_id") == have).select("tag").distinct()
    b = tags.filter(F.col("run_id") == lack).select("tag").distinct()
    return a.join(b, "tag", "left_anti")


def save_selection(sel_id: str, runs: DataFrame, tags: DataFrame) -> DataFrame:
    """A selection as rows ``(sel_id, kind, key)``."""
    return (
        runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("key"))
        .unionByName(tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("key")))
        .distinct()
        .select(F.lit(sel_id).alias("sel_id"), "kind", "key")
    )


def apply_selection(df: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows whose run and tag are both in the selection; unknown keys are ignored."""
    keys = {k: selection.filter(F.col("kind") == k).select("key").distinct() for k in ("run", "tag")}
    return restrict(df, keys["run"].withColumnRenamed("key", "run_id"),
                    keys["tag"].withColumnRenamed("key", "tag"))


def with_display_name(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach each run's display name; its id where it has none."""
    names = runs.select("run_id", "display_name")
    return df.join(names, "run_id", "left").withColumn(
        "display_name", first_non_empty(F.col("display_name"), F.col("run_id"))
    )


def display_name(given: Column, stored: Column, configured: Column, run_id: Column) -> Column:
    return first_non_empty(given, stored, configured, run_id)


def natural_order(tags: DataFrame) -> DataFrame:
    """Tags by locale, numbers in them as numbers."""
    return tags.orderBy(locale_key(F.col("tag")), "tag")


def natural_places(tags: DataFrame) -> DataFrame:
    """The same as a column: ``place``, from 0."""
    return with_sorted_place(tags, [locale_key(F.col("tag")), "tag"])


def _by_name() -> list[Column]:
    return [by_locale(F.col("display_name")), F.col("display_name"), F.col("run_id")]


def runs_by_name(runs: DataFrame) -> DataFrame:
    """Runs by display name, as their locale sorts it."""
    return runs.orderBy(*_by_name())


def run_places(runs: DataFrame) -> DataFrame:
    """The same as a column: ``place``, from 0."""
    return with_sorted_place(runs, _by_name())


def request_keys(spark: SparkSession, runs: Sequence[str]) -> DataFrame:
    """(run_id, place) of the runs of a request; a run that is asked for twice has two places."""
    return spark.createDataFrame([(r, n) for n, r in enumerate(runs)], "run_id string, place long")


def in_request_order(df: DataFrame, runs: Sequence[str] | DataFrame) -> DataFrame:
    """Series rows with the ``place`` of their run in the request, sorted by place, tag and step.

    ``runs`` lists the runs, or is a table (run_id, place).  Rows are dealt in ranges of that order, so that a run
    or a series of any length is sorted by several tasks.
    """
    keys = runs if isinstance(runs, DataFrame) else request_keys(df.sparkSession, runs)
    order = ["place", "tag", "step"]
    return df.join(keys.select("run_id", "place"), "run_id").repartitionByRange(*order).sortWithinPartitions(*order)
