"""Logged text: collapsing repeats, entry ids, index and lookup.

The order inside a tag is (step, src, rec).  Many texts may share a step, so the
blocks of ``ordered`` get two more levels: the step itself, and (file, stretch of
records) within the step.  No window below holds more than one such level.

Bodies are addressed by their digest.  Collapsing, indexing and pairing move digests only;
``with_bodies`` fetches the texts at the very end, each different one once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_tag
from ..schemas import SERIES
from .ordered import BLOCK_BITS, with_position, with_step_levels
from .select import with_display_name

_LEVELS = ["_sup", "_blk", "step", "_part"]


def _levelled(texts: DataFrame) -> DataFrame:
    part = F.struct(F.coalesce("src", F.lit("")).alias("s"), F.shiftright("rec", BLOCK_BITS).alias("r"))
    return with_step_levels(texts).withColumn("_part", part)


def collapse(texts: DataFrame) -> DataFrame:
    """Drop texts equal to the one before them under the same tag; number the rest.

    Adds ``i``, the entry's id (its position under its tag), and ``ordinal`` /
    ``at_step``: its number among, and the number of, entries of the same step.

    Equality is decided on the digest, so bodies are not moved: where the rows have them
    (``text``), those of the remaining entries are fetched last.  A block reports its
    first and last digest and how many entries it keeps; whether its first text
    repeats the block before it is settled when blocks are combined.
    """
    if "text" in texts.columns:
        return with_bodies(collapse(texts.drop("text")), bodies(texts))
    rows = _levelled(texts)
    block = [*SERIES, *_LEVELS]
    here = Window.partitionBy(*block).orderBy("rec")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.when(F.lag("digest").over(here).eqNullSafe(F.col("digest")), 0).otherwise(1)
    marks = rows.select(*block, "rec", "digest").withColumn("_kept", kept.cast("long"))
    blocks = marks.groupBy(*block).agg(
        F.min_by("digest", "rec").alias("head"), F.max_by("digest", "rec").alias("tail"),
        F.sum("_kept").alias("kept"),
    )
    carry = _combine(blocks, _LEVELS)
    return (
        rows.withColumn("_kept", kept.cast("long"))
        .withColumn("_nth", F.sum("_kept").over(upto))
        .join(carry, block)
        .filter((F.col("_kept") == 1) & ~((F.col("_nth") == 1) & F.col("dup")))
        .withColumn("i", F.col("offset") + F.col("_nth") - 1 - F.col("dup").cast("long"))
        .withColumns({"ordinal": F.col("i") - F.col("step_first") + 1, "at_step": F.col("step_n")})
        .drop("_kept", "_nth", "_sup", "_blk", "_part", "offset", "dup", "step_first", "step_n")
    )


def bodies(texts: DataFrame) -> DataFrame:
    """(digest, text): each different text once.

    Not dropDuplicates(): it is planned anew wherever it is read, and shuffles after it would be written once for each reader.
    """
    return texts.groupBy("digest").agg(F.first("text").alias("text"))


def with_bodies(rows: DataFrame, bodies: DataFrame, digest: str = "digest", text: str = "text") -> DataFrame:
    """rows with the texts of their digests.  Digests of very many rows are split by adaptive skew joins."""
    found = bodies.select(F.col("digest").alias("_digest"), F.col("text").alias(text))
    return rows.join(found, F.col(digest) == F.col("_digest"), "left").drop("_digest")


def bodies_of_pairs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``text_a`` and ``text_b`` for ``digest_a`` and ``digest_b``."""
    for s in ("a", "b"):
        pairs = with_bodies(pairs, bodies, f"digest_{s}", f"text_{s}")
    return pairs.drop("digest_a", "digest_b")


def _combine(blocks: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Per block: ``offset``, entries kept before it, and ``dup``, whether its first
    text repeats the last text before it."""
    parent = [*SERIES, *levels[:-1]]
    order = Window.partitionBy(*parent).orderBy(levels[-1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        blocks.withColumn("_prev", F.lag("tail").over(order))
        .withColumns({"leads": F.col("_prev").isNull(), "dup": F.coalesce(F.col("_prev") == F.col("head"), F.lit(False))})
        .withColumn("net", F.col("kept") - F.col("dup").cast("long"))
        .withColumn("offset", F.coalesce(F.sum("net").over(before), F.lit(0)))
    )
    if levels[:-1]:
        up = local.groupBy(*parent).agg(
            F.min_by("head", levels[-1]).alias("head"), F.max_by("tail", levels[-1]).alias("tail"),
            F.sum("net").alias("kept"),
        )
        outer = _combine(up, levels[:-1])
        extra = [c for c in ("step_first", "step_n") if c in outer.columns]
        outer = outer.select(*parent, F.col("offset").alias("_o"), F.col("dup").alias("_d"), *extra)
        joined = local.join(outer, parent)
        # A parent whose first text is a repeat keeps one entry less than it counted.
        shift = F.when(~F.col("leads") & F.col("_d"), 1).otherwise(0)
        local = joined.withColumns({
            "offset": F.col("_o") + F.col("offset") - shift,
            "dup": F.when(F.col("leads"), F.col("_d")).otherwise(F.col("dup")),
        })
    else:
        extra = []
    if levels[-1] == "step":
        # For a leading step the repeat is known only now.
        net = F.col("kept") - F.col("dup").cast("long")
        local, extra = local.withColumns({"step_first": F.col("offset"), "step_n": net}), ["step_first", "step_n"]
    return local.select(*SERIES, *levels, "offset", "dup", *extra)


def text_index(collapsed: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Entries without their bodies."""
    out = collapsed.select(*SERIES, "i", "step", "wall_time", F.col("chars").cast("long").alias("chars"), "ordinal", "at_step")
    return with_display_name(out, runs) if runs is not None else out


def text_counts(collapsed: DataFrame) -> DataFrame:
    """Per run: entries, tags and characters."""
    per_tag = collapsed.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("e"), F.sum("chars").alias("c"))
    return per_tag.groupBy("run_id").agg(
        F.sum("e").alias("entries"), F.count(F.lit(1)).alias("tags"), F.sum("c").alias("chars")
    )


def lookup(collapsed: DataFrame, wanted: DataFrame, what: str = "text") -> DataFrame:
    """Texts (or digests) for rows (run_id, tag, i); an ``i`` that is no entry id is taken as a step.

    The result has a row for each wanted row; ``what`` is null where there is none.
    """
    asked = wanted.select(*SERIES, "i").distinct()
    entries = collapsed.select(*SERIES, F.col("i").alias("entry"), "step", what, "ordinal")
    by_id = asked.join(entries.drop("ordinal").withColumn("i", F.col("entry")), [*SERIES, "i"], "left")
    found = by_id.filter(F.col("entry").isNotNull())
    # The first entry of a step is unique, so this join has no heavy keys either.
    first = entries.filter("ordinal = 1").drop("ordinal").withColumn("i", F.col("step"))
    rest = by_id.filter(F.col("entry").isNull()).select(*SERIES, "i").join(first, [*SERIES, "i"], "left")
    return found.unionByName(rest)


def retag_texts(collapsed: DataFrame) -> DataFrame:
    """Entries under cleaned tags, merged by (step, old tag, old id) without collapsing."""
    merged = (
        collapsed.withColumnsRenamed({"tag": "old_tag", "i": "old_i"})
        .withColumn("tag", clean_tag(F.col("old_tag")))
        .drop("ordinal", "at_step")
    )
    part = F.struct(F.col("old_tag").alias("t"), F.shiftright("old_i", BLOCK_BITS).alias("p"))
    rows = with_step_levels(merged).withColumn("_part", part)
    placed = with_position(rows, SERIES, _LEVELS, ["old_i"])
    return placed.withColumnRenamed("k", "i").drop("n", "_sup", "_blk", "_part")


def paired(collapsed: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Digests of the entries of two runs side by side: same tag, same entry id.

    At most one row per entry, so the number of pairs is that of the entries.
    """
    cols = ["tag", "i"]

    def side(run, s):
        return collapsed.filter(F.col("run_id") == run).select(
            *cols, F.col("run_id").alias(f"run_{s}"), F.col("digest").alias(f"digest_{s}"))

    return side(run_a, "a").join(side(run_b, "b"), cols)


def successive(collapsed: DataFrame) -> DataFrame:
    """Each entry (run_id, tag, i) with the digests of its text and of the text after it under the same tag."""
    key = [*SERIES, "i"]
    a = collapsed.select(*key, F.col("digest").alias("digest_a"))
    b = collapsed.select(*SERIES, (F.col("i") - 1).alias("i"), F.col("digest").alias("digest_b"))
    return a.join(b, key)


def pair_texts(collapsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests for an explicit pair table (run_a, tag_a, i_a, run_b, tag_b, i_b).

    Each side is an equi-join on a unique entry.  One entry may be compared with very
    many others; such a key is split by adaptive skew joins.
    """
    out = pairs
    for s in ("a", "b"):
        side = collapsed.select(
            F.col("run_id").alias(f"run_{s}"), F.col("tag").alias(f"tag_{s}"), F.col("i").alias(f"i_{s}"),
            F.col("digest").alias(f"digest_{s}"))
        out = out.join(side, [f"run_{s}", f"tag_{s}", f"i_{s}"])
    return out
