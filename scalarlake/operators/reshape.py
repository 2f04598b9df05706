"""Whole-store transformations on DataFrames: re-tagging and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_tag, first_non_empty, numbered_name
from .dedup import latest


def retag(scalars: DataFrame) -> DataFrame:
    """Points under cleaned tags; equal (tag, step) keeps the latest."""
    return latest(scalars.withColumn("tag", clean_tag(F.col("tag"))))


def retag_report(tags: DataFrame) -> DataFrame:
    """Per run the number of tags that are renamed and the number that disappear by merging."""
    t = tags.select("run_id", "tag").distinct().withColumn("new", clean_tag(F.col("tag")))
    per_new = t.groupBy("run_id", "new").agg(
        F.count(F.lit(1)).alias("old"), F.count_if(F.col("tag") != F.col("new")).alias("renamed")
    )
    return per_new.groupBy("run_id").agg(
        F.sum("renamed").alias("tags_renamed"), (F.sum("old") - F.count(F.lit(1))).alias("tags_merged")
    )


def fan_out(rows: DataFrame, copies: int, prefix: str) -> DataFrame:
    """``copies`` copies of the rows of a run under numbered run ids."""
    i = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return rows.withColumn("_i", i).withColumn("run_id", numbered_name(prefix, F.col("_i"))).drop("_i")


def fan_out_names(names: DataFrame, copies: int, prefix: str) -> DataFrame:
    """Run names of the copies: ``<name> #<number>``."""
    i = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    name = first_non_empty(F.col("display_name"), F.col("run_id"))
    return names.withColumn("_i", i).select(
        numbered_name(prefix, F.col("_i")).alias("run_id"),
        F.concat(name, F.lit(" #"), F.format_string("%03d", F.col("_i"))).alias("display_name"),
    )
