"""Comparing the logged text of runs.  Entries are paired by digest; bodies come last."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.diff import diff_summary, line_diff
from ..operators.texts import bodies, bodies_of_pairs, collapse, pair_texts, paired, successive


def _entries(texts: DataFrame) -> DataFrame:
    return collapse(texts.drop("text"))


def compare_runs(texts: DataFrame, run_a: str, run_b: str) -> tuple[DataFrame, DataFrame]:
    """Line differences, and their summary, of all entries two runs have in common."""
    diff = line_diff(bodies_of_pairs(paired(_entries(texts), run_a, run_b), bodies(texts)), ["tag", "i"])
    return diff, diff_summary(diff, ["tag", "i"])


def compare_pairs(texts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for an explicit table of entry pairs."""
    keys = ["run_a", "tag_a", "i_a", "run_b", "tag_b", "i_b"]
    diff = line_diff(bodies_of_pairs(pair_texts(_entries(texts), pairs), bodies(texts)), keys)
    return diff, diff_summary(diff, keys)


def text_history(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What changes from each entry of a tag to the next one."""
    diff = line_diff(bodies_of_pairs(successive(_entries(texts)), bodies(texts)), ["run_id", "tag", "i"])
    return diff, diff_summary(diff, ["run_id", "tag", "i"])
