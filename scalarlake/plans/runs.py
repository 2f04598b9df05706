"""Listing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_non_empty
from ..operators.stats import run_totals


def config_maps(configs: DataFrame) -> DataFrame:
    """Per run the kept configuration as a map (a fixed, small set of keys)."""
    return configs.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("config")
    )


def run_summary(
    stats: DataFrame,
    files: DataFrame,
    text_tags: DataFrame | None = None,
    configs: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """One row per run, from small per-tag, per-file and per-key tables.

    ``files``: (run_id, num_event_files, updated_at).  Runs without points are
    listed too, with zero tags and rows.  Tags that hold text are counted here and
    listed by ``text_tags`` itself, so that no row grows with their number.
    """
    out = files.join(run_totals(stats), "run_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("num_tags", "num_rows", "step_min", "step_max")]
    out = out.select("run_id", "num_event_files", "updated_at", *zero)
    return described(out, text_tags, configs, names)


def described(out: DataFrame, text_tags: DataFrame | None = None, configs: DataFrame | None = None,
              names: DataFrame | None = None) -> DataFrame:
    """Runs with the number of their text tags, their configuration and their name."""
    if text_tags is not None:
        counted = text_tags.select("run_id", "tag").distinct().groupBy("run_id").agg(
            F.count(F.lit(1)).alias("num_text_tags")
        )
        out = out.join(counted, "run_id", "left").withColumn("num_text_tags", F.coalesce("num_text_tags", F.lit(0)))
    if configs is not None:
        out = out.join(config_maps(configs), "run_id", "left")
        out = out.withColumn("config", F.coalesce("config", F.create_map().cast("map<string,string>")))
    if names is not None:
        out = out.join(names.select("run_id", "display_name"), "run_id", "left")
        out = out.withColumn("display_name", first_non_empty(F.col("display_name"), F.col("run_id")))
    return out
