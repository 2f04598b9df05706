"""Table schemas.

``src`` is the relative path of the event file a row came from and ``rec`` its
position in that file.  They make "logged order" and tie-breaks deterministic.
``seq`` numbers the passes in the order in which they were planned: what was read later
counts, whichever kind of pass read it.
"""

from pyspark.sql import types as T

SERIES = ["run_id", "tag"]

SCALARS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("wall_time", T.DoubleType()),
    T.StructField("value", T.FloatType()),
    T.StructField("src", T.StringType()),
    T.StructField("rec", T.LongType()),
])

# Text entries without their bodies, which are addressed by ``digest``: a text that is logged
# at every step, or by every run, is stored once.
TEXTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("wall_time", T.DoubleType()),
    T.StructField("src", T.StringType()),
    T.StructField("rec", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("chars", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])

BODIES = T.StructType([
    T.StructField("digest", T.StringType()),
    T.StructField("text", T.StringType()),
])

CONFIGS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# How much of each event file has been ingested.
FILES = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("relkey", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("consumed", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("seq", T.LongType()),
])

TAG_STATS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("min_step", T.LongType()),
    T.StructField("max_step", T.LongType()),
    T.StructField("last_value", T.FloatType()),
    T.StructField("seq", T.LongType()),
])

RUN_NAMES = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# Position index of a segment's points, see ``stats.positions``.
POSITIONS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("_sup", T.LongType()),
    T.StructField("_blk", T.LongType()),
    T.StructField("points", T.LongType()),
    T.StructField("bad", T.LongType()),
    T.StructField("fin", T.DoubleType()),
    T.StructField("fin_head", T.DoubleType()),
])

# What a pass added to a run: a row that adds up over passes, so that listing runs reads no other
# big table, and counters of the pass.  ``new_tags``, ``new_files`` were not there before it.
PASSES = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("files", T.LongType()),
    T.StructField("new_files", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("bad_records", T.LongType()),
    T.StructField("new_rows", T.LongType()),
    T.StructField("new_tags", T.LongType()),
    T.StructField("new_texts", T.LongType()),
    T.StructField("step_min", T.LongType()),
    T.StructField("step_max", T.LongType()),
    T.StructField("updated_at", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

# Tags that hold text, by pass; void where the text is.
TEXT_TAGS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# Written last by a text backfill.  Where ``replaces``, older text of the run is void.
BACKFILLS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("replaces", T.BooleanType()),
    T.StructField("seq", T.LongType()),
])


def stored(schema: T.StructType) -> T.StructType:
    """Schema of a table on disk: the segment partition column comes last."""
    return T.StructType(schema.fields + [T.StructField("seg", T.LongType())])
