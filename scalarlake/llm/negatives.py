"""Hard negatives by angles to reference directions (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarlake.llm.common import drop, keep, pieces
from scalarlake.llm.vectors import (
    SHELF_ROWS, SLICE_ROWS, Best, Block, matrix, meet, pairs, scaled, scores, shelves, slices, wide)

#: Reference directions: so many rows, drawn by hash, copies once.  They only decide how much is left out.
REFERENCES = 24
#: Candidates that share angle and length intervals; sorted by nearest reference and angle, so the intervals are short.
STRETCH = 128
#: arccos of a rounded cosine is off by less near 0 and pi, where it is worst.
ANGLE_ROOM = 1e-6

_RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
_POSITIVE = "slice bigint, place int, anchor_id bigint, own bigint, positive_id bigint, positive_score bigint"
_NEGATIVE = "slice bigint, place int, nth int, negative_id bigint, negative_score bigint"


def angles(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference; pi / 2 for rows of length 0."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0)[:, None]
        unit = x / np.where(top > 0, top, 1)
        unit = unit / np.where(top > 0, np.linalg.norm(unit, axis=1)[:, None], 1)
        return np.arccos(np.clip(unit @ references.T, -1, 1))


class Stretches:
    """Intervals of a shelf's angles and lengths, by stretch."""

    def __init__(self, shelf: Block) -> None:
        start = np.arange(0, len(shelf.ids), STRETCH)
        self.parts = [slice(s, s + STRETCH) for s in start]
        self.low, self.high = np.minimum.reduceat(shelf.more, start), np.maximum.reduceat(shelf.more, start)
        self.short, self.long = np.minimum.reduceat(shelf.length, start), np.maximum.reduceat(shelf.length, start)

    def bounds(self, queries: Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of any row of a stretch with a query, safe for rounding.

        Angles keep the triangle inequality: two directions are at least the difference and at most the sum of
        their angles to a reference apart, and never more than what is left of a full turn.
        """
        near = np.zeros((len(queries.ids), len(self.parts)))
        far = np.full(near.shape, np.pi)
        for r in range(queries.more.shape[1]):
            a, low, high = queries.more[:, r, None], self.low[None, :, r], self.high[None, :, r]
            near = np.maximum(near, np.maximum(low - a, a - high))
            far = np.minimum(far, np.minimum(a + high, 2 * np.pi - a - low))
        most, least = np.cos(np.maximum(near - ANGLE_ROOM, 0)), np.cos(np.minimum(far + ANGLE_ROOM, np.pi))
        with np.errstate(all="ignore"):
            a = queries.length[:, None]
            room = 1e-9 * a * self.long[None] + 1e-6
            return (a * np.where(least >= 0, self.short, self.long) * least - room,
                    a * np.where(most >= 0, self.long, self.short) * most + room)


def _positives(dims: int, k: int):
    """The k + 1 best rows of the anchor's own label in a shelf; the anchor itself is one of them."""

    def run(left: dict, right: dict) -> list[pa.Array]:
        queries, shelf = Block(left, dims), Block(right, dims)
        is_wide = wide(queries, shelf)
        best = Best(len(queries.ids), k + 1, is_wide)
        cut = Stretches(shelf)
        _, most = cut.bounds(queries)
        for p in np.argsort(-np.nan_to_num(most, nan=np.inf).max(axis=0), kind="stable"):
            part = cut.parts[p]
            same = queries.labels[:, None] == shelf.labels[None, part]
            at = np.flatnonzero(same.any(axis=1) & ~(most[:, p] < best.least()))
            if len(at):
                best.add(at, scores(queries.x[at], shelf.x[part], is_wide), shelf.place[part], same[at])
        own = [int(scores(v[None], v[None], wide(queries, queries))[0, 0]) for v in queries.x]
        query, score, place = best.found()
        return [pa.array([left["slice"]] * len(query), pa.int64()), pa.array(query, pa.int32()),
                pa.array([queries.ids[q] for q in query], pa.int64()), pa.array([own[q] for q in query], pa.int64()),
                pa.array([shelf.ids[shelf.by_place[p]] for p in place], pa.int64()), pa.array([int(s) for s in score], pa.int64())]

    return run


def _negatives(dims: int, k: int, low: int, high: int):
    """For each anchor and positive, the k best rows of other labels in a shelf whose score is in the positive's window."""

    def run(left: dict, right: dict) -> list[pa.Array]:
        queries, shelf = Block(left, dims), Block(right, dims)
        is_wide = wide(queries, shelf)
        kind = object if is_wide else np.int64
        cut = Stretches(shelf)
        least, most = cut.bounds(queries)
        out: list[list] = [[], [], [], [], []]
        windows = left["windows"]
        for nth in sorted({w["nth"] for w in windows}):
            mine = [w for w in windows if w["nth"] == nth]
            row = np.array([w["place"] for w in mine])
            score = np.array([w["positive_score"] for w in mine], object)
            wanted = Block.__new__(Block)
            wanted.x, wanted.labels = queries.x[row], queries.labels[row]
            best = Best(len(row), k, is_wide)
            bottom, top = (score * low / high).astype(np.float64), score.astype(np.float64)
            # Scores of a window are not above the positive's and not under low / high of it.
            bottom, top = bottom - 1e-9 * abs(bottom) - 1, top + 1e-9 * abs(top) + 1
            for p in np.argsort(-np.nan_to_num(most, nan=np.inf).max(axis=0), kind="stable"):
                meets = ~(most[row, p] < np.maximum(bottom, best.least())) & ~(least[row, p] > top)
                part = cut.parts[p]
                other = wanted.labels[:, None] != shelf.labels[None, part]
                at = np.flatnonzero(meets & other.any(axis=1))
                if not len(at):
                    continue
                got = scores(wanted.x[at], shelf.x[part], is_wide)
                ceiling = score[at].astype(kind)[:, None]
                # Whole numbers throughout; scores of narrow blocks times 100 are far inside 64 bits.
                inside = (low * ceiling <= high * got) & (got <= ceiling)
                best.add(at, got, shelf.place[part], other[at] & inside.astype(bool))
            query, found, place = best.found()
            for column, values in zip(out, ([left["slice"]] * len(query), row[query].tolist(), [nth] * len(query),
                                            [shelf.ids[shelf.by_place[i]] for i in place], [int(s) for s in found])):
                column.extend(values)
        return [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]

    return run


def _located(references: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            x = matrix(batch.column("entries").to_pylist(), dims)
            theta = angles(x, references) if len(references) else np.full((len(x), 1), np.pi / 2)
            home = theta.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), pa.array(theta[np.arange(len(x)), home])], [*batch.schema.names, "home", "angle"])

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
                   references: int = REFERENCES, shelf_rows: int = SHELF_ROWS, slice_rows: int = SLICE_ROWS // 2) -> DataFrame:
    """For each anchor (rows where `is_anchor`, a condition on vec_id, holds) and each of its positives the hardest negatives:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); a row's score is its exact inner product with the anchor, higher ones come
    first, ties by smaller vec_id.  Positives are the first `positives` other rows of the anchor's label; the negatives of one
    are the first `negatives` rows of other labels with low * positive_score <= high * negative_score <= high * positive_score.

    Every row stores its angles to the reference directions.  Rows are sorted by nearest reference and angle, dealt in even
    ranges whatever their labels, and packed into shelves.  Slices of anchors meet all shelves; in a task, stretches of
    consecutive angles get score bounds (Stretches), and only those whose interval overlaps an anchor's window are scored.  A
    shelf reports few rows for an anchor and positive, which are then ranked over all shelves.

    Rows with a null label or vector, or null or non-finite components, take no part (nor those that the scale carries out of
    the range of doubles); shorter vectors end in zeros.  Rows of null ids are no anchors; on ties they come last.  Rows that
    repeat an id are separate; an anchor is only kept from its own row.  Scores beyond the range of long are held at
    its ends.  Empty input gives no rows.
    """
    spark = rows.sparkSession
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    base = scaled(rows.where(label.isNotNull()), scale, F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"), label)
    base = keep(base, "vectors")
    n, size, n_asked = base.agg(F.count("*"), F.max(F.octet_length("entries")), F.count_if(is_anchor)).first()
    if not n_asked:
        drop(base)
        return spark.createDataFrame([], _RESULT)
    dims = size // 8
    drawn = base.where("length > 0").groupBy(F.xxhash64("entries").alias("h")).agg(F.min("entries").alias("entries"))
    chosen = matrix([bytes(r.entries) for r in drawn.orderBy("h").limit(references).collect()], dims)
    with np.errstate(all="ignore"):
        chosen = chosen / np.abs(chosen).max(axis=1, initial=0)[:, None] if len(chosen) else chosen
        chosen = chosen / np.linalg.norm(chosen, axis=1)[:, None]

    def stored(x: np.ndarray) -> np.ndarray:
        return angles(x, chosen) if len(chosen) else np.full((len(x), 1), np.pi / 2)

    located = base.mapInArrow(_located(chosen, dims), "vec_id bigint, label bigint, entries binary, length double, home int, angle double")
    packed = keep(shelves(located, [F.asc("home"), F.asc("angle"), F.asc_nulls_last("vec_id")], dims, stored, n, shelf_rows), "shelves")
    sliced = keep(slices(base.where(is_anchor), dims, stored, n_asked, slice_rows), "slices")
    which = pairs(packed.select("shelf"), sliced.select("slice"), n_asked, slice_rows)
    best = keep(meet(which, packed, sliced, _positives(dims, positives), _POSITIVE), "best")

    anchor = Window.partitionBy("slice", "place")
    placed = best.withColumn("r", F.row_number().over(anchor.orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))))
    placed = placed.where(F.col("r") <= positives + 1)
    # The anchor's own row: equal rows are interchangeable, so any one of its id and score may go.
    own = F.min(F.when((F.col("positive_id") == F.col("anchor_id")) & (F.col("positive_score") == F.col("own")), F.col("r"))).over(anchor)
    placed = placed.withColumn("at", F.coalesce(own, F.lit(positives + 2))).where("r != at")
    nth = (F.col("r") - F.when(F.col("r") > F.col("at"), 1).otherwise(0)).cast("int")
    chosen_rows = keep(placed.withColumn("nth", nth).where(F.col("nth") <= positives).select(
        "slice", "place", "nth", "anchor_id", "positive_id", "positive_score"), "positives")

    # A slice has so many anchors at most, so its windows fit a row.
    windows = chosen_rows.groupBy("slice").agg(F.collect_list(F.struct("place", "nth", "positive_score")).alias("windows"))
    found = keep(meet(which.join(windows.select("slice"), "slice"), packed, sliced.join(windows, "slice"),
                      _negatives(dims, negatives, low, high), _NEGATIVE), "negatives")
    for table in (base, packed, sliced, best):
        drop(table)
    window = Window.partitionBy("slice", "place", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    return ranked.join(chosen_rows, ["slice", "place", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
