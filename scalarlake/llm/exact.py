"""Exact deduplication by content sort (operator 10): DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarlake.llm.common import keep


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None, salts: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after normalised(); of equal texts the smallest id stays.

    Sampled splitters deal the texts to ranges, each range is sorted (on disk where needed), so equal texts
    are neighbours, and neighbours are compared in full.  The splitters see a short prefix, a hash and a
    salt drawn from the id, so the sample that reaches the driver is small, and a text that a third of all
    rows repeat lies in as many neighbouring ranges as there are salts.  Each run of equal neighbours becomes one
    small row; the runs that a text has in several ranges meet by its SHA-256.

    Null and empty texts are equal; rows of a null id take part, and stay only if all ids of their group are
    null; rows that repeat the kept id all stay.  Empty input gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select(
        "doc_id", "norm", F.substring("norm", 1, 16).alias("head"), F.xxhash64("norm").alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts or n)).alias("salt"),
    )
    order = ["head", "h", "salt"]
    run = Window.partitionBy(*order, "norm").orderBy(F.col("doc_id").asc_nulls_last())
    dealt = rows.repartitionByRange(n, *order)
    # The ranges already keep (head, h, salt, norm) together: the window sorts, it does not shuffle.
    placed = keep(dealt.select(
        "doc_id", (F.row_number().over(run) == 1).alias("first"), F.sha2("norm", 256).alias("text_sha256"),
    ), "exact")
    runs = placed.groupBy("text_sha256").agg(
        F.min(F.when(F.col("first"), F.col("doc_id"))).alias("keep_id"), F.count("*").alias("group_size"))
    return (
        placed.select("doc_id", "text_sha256").join(runs, "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                "text_sha256")
    )
