"""Latest-wins: one row per (run, tag, step)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SERIES


def latest(df: DataFrame) -> DataFrame:
    """Keep, per (run, tag, step), the row written last.

    The greatest ``wall_time`` wins; ``(src, rec)`` decides equal times.  An
    aggregation, not a window: map-side reduction means that a step repeated any
    number of times reaches the reducer once per map task.  ``step`` comes first
    because sorting by a number is much cheaper than by a text.
    """
    pick = F.max(F.struct("wall_time", "src", "rec", "value")).alias("_w")
    return df.groupBy("step", *SERIES).agg(pick).select(*SERIES, "step", "_w.wall_time", "_w.value", "_w.src", "_w.rec")
