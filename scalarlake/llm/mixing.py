"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 8): DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarlake.llm.common import count_words

#: Buckets of the sampling key per source; prefix sums are taken over buckets, then inside one of them.
BUCKETS = 1 << 14


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Targets per source from (source, source_size): source, source_size, target.

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating.  They share
    `share` times all sizes by weight; a target stops at `most` times its source's size and the excess goes to the
    others by weight until none is above.  With a level x, the target is min(most * size, weight * x): the
    sources stop in the order of most * size / weight, so the level follows from prefix sums in that order.
    One row per source passes through one window; sources, unlike rows, are few.  A source of size 0 has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("stop", F.col("bound") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    budget = F.least(F.lit(share) * F.sum("source_size").over(everything), F.sum("bound").over(everything))
    # The level if exactly the sources before this one in the order have stopped.
    s = s.withColumn("level", (budget - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source that does not stop at its own level fixes it; without one, all have stopped.
    s = s.withColumn("fixed", F.min(F.when(F.col("level") < F.col("stop"), F.struct("stop", "source", "level"))).over(everything))
    return s.select("source", "source_size", F.coalesce(
        F.least(F.col("bound"), F.col("weight") * F.col("fixed.level")), F.col("bound")).alias("target"))


def sampling_key(id_col: Column, quality: Column, seed: int) -> Column:
    """Exponential key -ln(u) / quality; u in (0, 1) from the id, so reruns agree."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def mix_sources(docs: DataFrame, quality: Column | None = None, size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
                share: float = 1.5, most: float = 2.0,
                seed: int = 1) -> DataFrame:
    """docs with size, source_size, target, epochs (how often the mix takes the row) and taken (words).

    Complete epochs come first: floor(target / source size) times every document.  What is left of the budget goes
    to the documents with the smallest keys in turn, as long as the running size of those before is less
    than the budget by at least half the document: the last one is taken when that brings the sum nearer.

    A source may hold any share of the rows: sizes are summed over buckets of the key, running sums are taken
    over at most BUCKETS rows per source, and only the bucket in which the budget ends is put in order.

    size: words of a row, those of its text by default.  quality: positive weight of a row; null, missing or not positive counts as the smallest, 1e-6.  Null texts
    have size 0; null ids and repeated rows share a key and are ordered by size; which of several with equal key and
    size comes last is open, the taken words are the same.  Extra columns pass through.  Empty input gives no rows.
    """
    names = docs.columns
    q = F.greatest(F.coalesce(quality, F.lit(1e-6)), F.lit(1e-6)) if quality is not None else F.lit(1.0)
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("source").alias("source"),
        (count_words(F.col("text")) if size is None else size).alias("size"), sampling_key(F.col("doc_id"), q, seed).alias("key"),
    )
    # A fixed, monotone cut of the key: 1 - exp(-key) is even for quality 1.
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(
        F.col("source").alias("t_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("full"))
    targets = targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.select("source", "bucket", "bucket_size",
                       F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("below"))
    # Per source: budget, and the bucket in which it ends.
    cuts = (
        cuts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).groupBy("t_source")
        .agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
             F.first("full").alias("full"), F.first("rest").alias("rest"),
             F.max(F.when(F.col("below") <= F.col("rest"), F.struct("bucket", "below"))).alias("cut"))
    )
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("t_source")))
    last = Window.partitionBy("t_source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("bucket") - F.col("cut.bucket")
    outside = joined.where(at != 0).withColumn("more", (at < 0).cast("long"))
    inside = joined.where(at == 0).withColumn("sum", F.col("cut.below") + F.coalesce(F.sum("size").over(last), F.lit(0)))
    inside = inside.withColumn("more", (F.col("sum") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("sum")
    epochs = F.col("full") + F.col("more")
    return outside.unionByName(inside).select(
        *[F.col(f"row.`{n}`").alias(n) for n in names if n not in ("size", "source_size", "target", "epochs", "taken")],
        "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))
