"""Run configuration: top-level ``key: value`` lines of ``config.yaml``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clean_config_value
from .files import exists

# The keys kept as run metadata.
CONFIG_KEYS = (
    "exp_name", "run_name", "user", "global_seed", "seed",
    "max_seq_len", "tensorboard_path", "save_folder",
)


def config_pairs(lines: DataFrame, keys: tuple[str, ...] | None = CONFIG_KEYS) -> DataFrame:
    """(run_id, key, value) from rows (run_id, line_no, line).

    Blank, indented and comment lines are skipped, as are empty keys and values;
    the last line of a key wins.
    """
    line = F.col("line")
    pairs = (
        lines.filter(line.rlike("^[^ \t#\r\n]") & F.contains(line, F.lit(":")))
        .select(
            "run_id", "line_no",
            F.btrim(F.substring_index(line, ":", 1), F.lit(" \t\r\n")).alias("key"),
            clean_config_value(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"),
        )
        .filter((F.col("key") != "") & (F.col("value") != ""))
    )
    if keys is not None:
        pairs = pairs.filter(F.col("key").isin(*keys))
    return pairs.groupBy("run_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def read_configs(spark: SparkSession, runs_dir: str, flat_run_id: str | None = None,
                 keys: tuple[str, ...] | None = CONFIG_KEYS) -> DataFrame:
    """Configuration of every run below ``runs_dir`` (of the folder itself in a flat layout)."""
    root = runs_dir.rstrip("/")
    pattern = f"{root}/config.yaml" if flat_run_id else f"{root}/*/config.yaml"
    if not exists(spark, pattern):  # no run has a configuration
        return spark.createDataFrame([], "run_id string, key string, value string")
    files = spark.read.option("wholetext", True).text(pattern)
    run = F.lit(flat_run_id) if flat_run_id else F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -2)
    text = F.regexp_replace("value", "\r\n?", "\n")
    lines = files.select(run.alias("run_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return config_pairs(lines, keys)
