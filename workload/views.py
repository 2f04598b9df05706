"""Scalar, text and config views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarlake.functions.scalar import text_digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SECONDS = "unix_micros(cast({0} as timestamp)) / 1e6"


def sc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight runs, five tags, repeated steps, some non-finite values."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('run_', user_id % 8) run_id",
        "concat('metrics/', event_type) tag",
        "event_id div 100 step",
        _SECONDS.format("ts") + " wall_time",
        """case when event_id % 97 = 0 then float('NaN')
                when event_id % 101 = 0 then float('Infinity')
                when event_id % 103 = 0 then float('-Infinity')
                else cast(value as float) end value""",
        "event_type src",
        "event_id rec",
    )


def sc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, 126 tags each, long series."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('run_', l_linestatus) run_id",
        "concat('train/', l_returnflag, '/layers.', l_linenumber, '.expert_idx_', l_suppkey % 6) tag",
        "l_orderkey step",
        _SECONDS.format("l_shipdate") + " wall_time",
        "cast(l_extendedprice as float) value",
        "l_returnflag src",
        "l_partkey rec",
    )


def sc_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sc_events`` with a timestamp inside each tag."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr(
        "concat('run_', user_id % 8) run_id",
        "concat('metrics/', date_format(ts, 'yyyyMMdd_HHmmss'), '/auto/', event_type) tag",
        "event_id div 100 step",
        _SECONDS.format("ts") + " wall_time",
        "cast(value as float) value",
        "event_type src",
        "event_id rec",
    )


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", text_digest(F.col("text"))).withColumn("chars", F.char_length("text"))


def tx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts that repeat, several per step."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    return _texts(joined.selectExpr(
        "concat('run_', source) run_id", "concat('config/', lang) tag", "doc_id div 50 step",
        "cast(doc_id as double) wall_time", "concat('quality: ', quality, '\\ntoxic: ', toxic) text",
        "source src", "doc_id rec",
    ))


def tx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts."""
    return _texts(table(spark, sf_dir, "documents").selectExpr(
        "concat('run_', source) run_id", "concat('config/', lang) tag", "doc_id div 50 step",
        "cast(doc_id as double) wall_time", "text", "source src", "doc_id rec",
    ))


def tx_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(table(spark, sf_dir, "conversations").selectExpr(
        "concat('conv_', conv_id) run_id", "role tag", "turn step", "cast(turn as double) wall_time",
        "text", "cast('' as string) src", "turn rec",
    ))


def cfg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration file lines of eight runs."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('run_', (c_custkey div 4) % 8) run_id",
        "c_custkey line_no",
        """case c_custkey % 4 when 0 then concat('seed: ', c_custkey)
                when 1 then concat('user: "', c_name, '"')
                when 2 then concat('  nested: ', c_nationkey)
                else '# comment' end line""",
    )


# The same views for the SQL side; ``WITH`` bodies to put in front of a query.
SQL = {
    "sc_events": """sc_events as (
      select concat('run_', user_id % 8) run_id, concat('metrics/', event_type) tag,
             event_id // 100 step, epoch_us(ts) / 1e6 wall_time,
             case when event_id % 97 = 0 then 'NaN'::float when event_id % 101 = 0 then 'Infinity'::float
                  when event_id % 103 = 0 then '-Infinity'::float else cast(value as float) end as value,
             event_type src, event_id rec
      from events)""",
    "sc_lineitem": """sc_lineitem as (
      select concat('run_', l_linestatus) run_id,
             concat('train/', l_returnflag, '/layers.', l_linenumber, '.expert_idx_', l_suppkey % 6) tag,
             l_orderkey step, epoch_us(l_shipdate) / 1e6 wall_time,
             cast(l_extendedprice as float) as value, l_returnflag src, l_partkey rec
      from lineitem)""",
    "sc_dirty": """sc_dirty as (
      select concat('run_', user_id % 8) run_id,
             concat('metrics/', strftime(ts, '%Y%m%d_%H%M%S'), '/auto/', event_type) tag,
             event_id // 100 step, epoch_us(ts) / 1e6 wall_time, cast(value as float) as value,
             event_type src, event_id rec
      from events)""",
    "tx_labels": """tx_labels as (
      select concat('run_', d.source) run_id, concat('config/', d.lang) tag, l.doc_id // 50 step,
             cast(l.doc_id as double) wall_time,
             'quality: ' || l.quality || chr(10) || 'toxic: ' || l.toxic as text, d.source src, l.doc_id rec
      from labels l join documents d using (doc_id))""",
    "tx_docs": """tx_docs as (
      select concat('run_', source) run_id, concat('config/', lang) tag, doc_id // 50 step,
             cast(doc_id as double) wall_time, text, source src, doc_id rec
      from documents)""",
    "tx_conv": """tx_conv as (
      select concat('conv_', conv_id) run_id, role tag, turn step, cast(turn as double) wall_time,
             text, '' src, turn rec
      from conversations)""",
    "cfg_lines": """cfg_lines as (
      select concat('run_', (c_custkey // 4) % 8) run_id, c_custkey line_no,
             case c_custkey % 4 when 0 then 'seed: ' || c_custkey when 1 then 'user: "' || c_name || '"'
                  when 2 then '  nested: ' || c_nationkey else '# comment' end line
      from customer)""",
}


def with_views(*names: str) -> str:
    return "with recursive " + ",\n".join(SQL[n] for n in names)
