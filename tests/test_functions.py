"""Scalar functions, selection and configuration."""

import math

import pytest
from pyspark.sql import functions as F

from scalarlake.functions import scalar as fn
from scalarlake.operators import reshape, select, stats
from scalarlake.sources.config import config_pairs, read_configs


def values(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr(F.col("x"))).collect()]


def test_clean_tag(spark):
    given = ["metrics/20260618_101116_148035/auto/acc", "1700000000", "layers/12/w", "a/1234567/b", "a/12_345_678/b", "a//b", ""]
    assert values(spark, fn.clean_tag, given) == ["metrics/auto/acc", "1700000000", "layers/12/w", "a/1234567/b", "a/b", "a//b", ""]
    assert values(spark, fn.clean_path, ["1700000000", "m/1700000000"]) == ["", "m"]


def test_natural_order(spark):
    tags = spark.createDataFrame([(t,) for t in ["layers.10", "layers.2", "layers.1", "abc", "layers.002x", "B"]], "tag string")
    assert [r.tag for r in select.natural_order(tags).collect()] == ["abc", "B", "layers.1", "layers.2", "layers.002x", "layers.10"]


def test_numbers(spark):
    v = [1.0, math.nan, math.inf, -math.inf, None]
    assert values(spark, fn.is_finite, v, "x double") == [True, False, False, False, False]
    assert values(spark, fn.non_finite_kind, v[1:4], "x double") == ["nan", "+inf", "-inf"]
    assert values(spark, fn.log10_floor, [100.0, 0.0], "x double") == [2.0, -12.0]
    assert values(spark, lambda x: x.cast("float"), [1e300], "x double") == [math.inf]


def test_names(spark):
    assert values(spark, lambda i: fn.numbered_name("run_", i), [0, 7, 1234], "x int") == ["run_000", "run_007", "run_1234"]
    assert values(spark, lambda x: fn.prefixed(x, F.lit("t")), ["", "a/b"]) == ["t", "a/b/t"]
    assert values(spark, lambda x: F.char_length(x), ["é∗😀"]) == [3]
    df = spark.createDataFrame([("r", "d"), ("s", None)], "run_id string, display_name string")
    got = reshape.fan_out_names(df, 2, "c_").orderBy("run_id", "display_name").collect()
    assert [tuple(r) for r in got] == [("c_000", "d #000"), ("c_000", "s #000"), ("c_001", "d #001"), ("c_001", "s #001")]


@pytest.mark.parametrize("pattern,hits", [("LOSS", 2), ("loss(", 1), ("^a", 1), ("", 3), ("l.s+", 2)])
def test_search(spark, pattern, hits):
    tags = spark.createDataFrame([("train/loss",), ("x/Loss(y)",), ("acc",)], "tag string")
    assert select.search_tags(tags, pattern).count() == hits


def test_runs(spark):
    runs = spark.createDataFrame([("r1", "Zeta"), ("r2", "alpha"), ("r3", None)], "run_id string, display_name string")
    named = select.with_display_name(runs.select("run_id"), runs)
    assert [r.display_name for r in select.runs_by_name(named).collect()] == ["alpha", "r3", "Zeta"]
    assert select.search_runs(named, "R3").count() == 1 and select.search_runs(named, "").count() == 3
    pick = lambda *v: spark.range(1).select(
        select.display_name(*[F.lit(x).cast("string") for x in v])).first()[0]
    assert [pick(None, None, "r", "id"), pick("", "s", "r", "id"), pick(None, None, "", "id")] == ["r", "s", "id"]


def test_suggest_and_groups(spark):
    tags = spark.createDataFrame([(f"g{i % 2}/t{i:03d}",) for i in range(120)], "tag string")
    got = select.suggest_tags(tags, "T0", limit=50).collect()
    assert select.suggest_tags(tags, "T0").count() == 100
    assert len(got) == 50 and {r.matches for r in got} == {100} and got[0].tag == "g0/t000"
    assert select.suggest_tags(tags, "zzz").count() == 0
    assert {(r.group, r.tags, r.first_tag) for r in stats.group_counts(tags).collect()} == {("g0", 60, "g0/t000"), ("g1", 60, "g1/t001")}


def test_config(spark, tmp_path):
    lines = [" x: 1", "# c", "a:", "seed: '7'", "seed: 8", "other: 1", "user: \"me: you\"", "", "\tuser: no"]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(lines)], "run_id string, line_no long, line string")
    assert {(r.key, r.value) for r in config_pairs(df).collect()} == {("seed", "8"), ("user", "me: you")}
    assert {r.key for r in config_pairs(df, None).collect()} == {"seed", "user", "other"}
    for run, text in (("001", "seed: 1\r\nrun_name: one\r\n"), ("run b", "user: u\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "config.yaml").write_text(text)
    got = {(r.run_id, r.key, r.value) for r in read_configs(spark, str(tmp_path)).collect()}
    assert got == {("001", "seed", "1"), ("001", "run_name", "one"), ("run b", "user", "u")}
    flat = read_configs(spark, str(tmp_path / "001"), "flat").collect()
    assert {(r.run_id, r.key) for r in flat} == {("flat", "seed"), ("flat", "run_name")}
    assert read_configs(spark, str(tmp_path / "none")).count() == 0
