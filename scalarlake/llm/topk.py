"""Exact top-k inner products over vectors sorted by length (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarlake.llm.common import drop, keep
from scalarlake.llm.vectors import (
    SHELF_ROWS, SLICE_ROWS, Best, Block, matrix, meet, pairs, scaled, scores, shelves, slices, upper, wide)

#: Candidates that are bounded together: their lengths are nearly equal.
STRETCH = 1024
#: Share of the rotated dimensions that the partial sums cover.
HEAD = 4

_RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
_FOUND = "slice bigint, place int, query_id bigint, own bigint, vec_id bigint, score bigint, need double"


def rotation(rows: DataFrame, dims: int, longest: float) -> np.ndarray:
    """Right singular vectors of all rows, by falling singular value: most of every length lies in the first dimensions.

    Tasks add up products of their rows; the dims x dims sums are what the driver gets.  Any rotation keeps inner
    products, so rounding here only changes how much is pruned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), dims) / longest
            total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = rows.select("entries").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dims, dims))
    for r in sums:
        total[r.i, r.j] = total[r.j, r.i] = r.s
    return np.linalg.eigh(total)[1][:, ::-1] if np.isfinite(total).all() else np.eye(dims)


def search(queries: Block, shelf: Block, floor: np.ndarray, k: int) -> Best:
    """The k best candidates of a shelf for each query, as far as they can reach `floor`; the query's own row is one of them.

    Stretches come by falling length.  A query leaves when no later candidate is long enough.  For the others the products
    of the first rotated dimensions plus the lengths of the rest bound the score; only pairs whose bound reaches
    the query's k-th best score are scored, on whole numbers.
    """
    is_wide = wide(queries, shelf)
    best = Best(len(queries.ids), k, is_wide)
    head = max(1, queries.x.shape[1] // HEAD)
    (qh, qt), (ch, ct) = [(b.more[:, :head], np.linalg.norm(b.more[:, head:], axis=1)) for b in (queries, shelf)]
    for start in range(0, len(shelf.ids), STRETCH):
        part = slice(start, start + STRETCH)
        longest = float(shelf.length[part].max())
        least = np.maximum(floor, best.least())
        at = np.flatnonzero(~(upper(queries.length, longest) < least))
        if not len(at):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            room = 1e-9 * queries.length[at, None] * longest + 1e-6
            bound = qh[at] @ ch[part].T + qt[at, None] * ct[None, part] + room
        alive = ~(bound < least[at, None])
        some = alive.any(axis=1)
        at, alive = at[some], alive[some]
        if not len(at):
            continue
        if alive.mean() > 0.05 or is_wide:
            score = scores(queries.x[at], shelf.x[part], is_wide)
        else:
            score = np.zeros(alive.shape, np.int64)
            i, j = np.nonzero(alive)
            for a in range(0, len(i), 1 << 16):
                b = slice(a, a + (1 << 16))
                score[i[b], j[b]] = np.einsum("nd,nd->n", queries.x[at[i[b]]], shelf.x[start + j[b]]).astype(np.int64)
        best.add(at, score, shelf.place[part], alive)
    return best


def _searching(dims: int, k: int):
    def run(left: dict, right: dict) -> list[pa.Array]:
        queries, shelf = Block(left, dims), Block(right, dims)
        floor = np.full(len(queries.ids), -np.inf)
        for f in left.get("floors") or []:
            floor[f["place"]] = f["floor"] if f["floor"] > -(1 << 62) else -np.inf
        best = search(queries, shelf, floor, k)
        own = [int(scores(v[None], v[None], wide(queries, queries))[0, 0]) for v in queries.x]
        query, score, place = best.found()
        reached = np.array([not float(s) < floor[q] for q, s in zip(query, score)], bool)
        query, score, place = query[reached], score[reached], place[reached]
        least = best.least()
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, least / queries.length, 0.0)
        return [pa.array([left["slice"]] * len(query), pa.int64()), pa.array(query, pa.int32()),
                pa.array([queries.ids[q] for q in query], pa.int64()), pa.array([own[q] for q in query], pa.int64()),
                pa.array([shelf.ids[shelf.by_place[p]] for p in place], pa.int64()), pa.array([int(s) for s in score], pa.int64()),
                pa.array(np.nan_to_num(need[query], nan=0.0, posinf=0.0))]

    return run


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
                       vector_col: str = "embedding", shelf_rows: int = SHELF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each row where `is_query` (a condition on vec_id) holds, the k other rows of greatest inner product:
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Components become floor(scale * x); scores are exact.  Rows are sorted by falling length and packed into shelves.
    All queries meet the shelf of the longest rows first, whose k-th best score is their floor; a slice of queries
    goes on to those shelves that are long enough for one of its floors.  Inside a shelf see search().  What a shelf finds
    for a query is k + 1 rows at most, and the rows of all shelves are ranked by query.  Nothing is approximate.

    Vectors that are null or hold null or non-finite components take no part (a component that the scale carries out of the
    range of doubles counts as non-finite); empty ones and shorter ones end in zeros.  Rows of null ids are candidates,
    after all others on ties, and no queries.  Rows that repeat an id are separate queries and candidates; a query is
    only kept from its own row.  Scores beyond the range of long are held at its ends.  Empty input gives no rows.
    """
    spark = rows.sparkSession
    base = keep(scaled(rows, scale, F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")), "vectors")
    asked = base.where(is_query)
    n, size, longest, n_asked = base.agg(F.count("*"), F.max(F.octet_length("entries")), F.max("length"), F.count_if(is_query)).first()
    if not n_asked:
        drop(base)
        return spark.createDataFrame([], _RESULT)
    dims = size // 8
    turn = rotation(base, dims, longest or 1.0) if dims else np.eye(0)

    def rotated(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return x @ turn

    packed = keep(shelves(base, [F.desc("length"), F.asc_nulls_last("vec_id")], dims, rotated, n, shelf_rows), "shelves")
    sliced = keep(slices(asked, dims, rotated, n_asked, slice_rows), "slices")
    fn = _searching(dims, k + 1)
    first = packed.agg(F.max_by("shelf", F.struct("longest", "shelf"))).first()[0]
    small = packed.select("shelf", "longest")
    numbers = sliced.select("slice")
    head = keep(meet(pairs(small.where(F.col("shelf") == first), numbers, n_asked, slice_rows), packed, sliced, fn, _FOUND), "first")

    floors = head.groupBy("slice", "place").agg(
        F.when(F.count("*") > k, F.min("score")).alias("floor"), F.first("need").alias("need"))
    by_slice = floors.groupBy("slice").agg(
        F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("place", "floor"))).alias("floors"),
        F.min(F.when(F.col("floor").isNull(), 0.0).otherwise(F.col("need"))).alias("need"))
    reach = keep(by_slice, "floors")
    others = pairs(small.where(F.col("shelf") != first), reach.select("slice", "need"), n_asked, slice_rows)
    others = others.where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    found = head.unionByName(meet(others, packed, sliced.join(reach.select("slice", "floors"), "slice"), fn, _FOUND))
    found = keep(found.drop("need"), "found")
    for table in (base, packed, sliced, head, reach):
        drop(table)

    query = Window.partitionBy("slice", "place")
    placed = found.withColumn("r", F.row_number().over(query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("r") <= k + 1)
    # The query's own row: equal rows are interchangeable, so any one of its id and score may go.
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(query)
    placed = placed.withColumn("at", F.coalesce(own, F.lit(k + 2))).where("r != at")
    rank = (F.col("r") - F.when(F.col("r") > F.col("at"), 1).otherwise(0)).cast("int")
    return placed.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
