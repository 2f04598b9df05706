"""Connected groups: of given links, and of members that a link function compares in bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalarlake.llm.common import drop, keep

#: Members that one task compares with one another at a time.
CHUNK = 512


#: Links that a task contracts at a time.
LINKS = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) of a task as stars: each node with the smallest one that these links connect it to."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LINKS:
            yield _stars(held)
            held = []
    if held:
        yield _stars(held)


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    kind = held[0].schema.field(0).type
    ends = [np.array([v for b in held for v in b.column(k).to_pylist()], object if pa.types.is_binary(kind) else np.int64) for k in (0, 1)]
    nodes, code = np.unique(np.concatenate(ends), return_inverse=True)
    hi, lo = code[:len(ends[0])], code[len(ends[0]):]
    label = np.arange(len(nodes))
    while True:  # codes are in the order of the nodes, so the least code is the least node
        least = label.copy()
        np.minimum.at(least, label[hi], label[lo])
        np.minimum.at(least, label[lo], label[hi])
        least = least[least[least]]
        least = np.minimum(least, least[label])
        if np.array_equal(least, label):
            break
        label = least
    return pa.RecordBatch.from_arrays([pa.array(nodes.tolist(), kind), pa.array(nodes[label].tolist(), kind)], names=["hi", "lo"])


def connected(edges: DataFrame, most_rounds: int = 60, links: int = LINKS) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that can be reached.

    Alternating star contraction: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours; before that, tasks contract the links that they hold.  The rounds grow with the logarithm of the longest
    path and end when only stars are left.  A node with very many neighbours only takes part in a minimum, which is
    aggregated before the shuffle, and in a join, whose skew Spark splits.  As soon as the links that are left are no more
    than a task contracts at a time (``links``, at most LINKS), one such contraction ends it.  Nulls are no nodes, loops only
    make their node known, repeated edges count once.  No edges, no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"hi {kind}, lo {kind}"
    # A loop stays as (node, node), so that a node without other links is in the result.
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = keep(pairs.mapInArrow(_contract, schema).distinct(), "edges")

    def both_ways(rows: DataFrame, *ways: tuple[str, str], names: tuple[str, str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in ways])).alias("e")
        return rows.select(each).select("e.*")

    for _ in range(most_rounds):
        if pairs.count() <= links:
            after = keep(pairs.coalesce(1).mapInArrow(_contract, schema), "edges")
            drop(pairs)
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        ends = both_ways(pairs.where("hi != lo"), ("hi", "lo"), ("lo", "hi"), names=("node", "other"))
        # Only stars are left when no node has two smaller neighbours, or a smaller and a larger one.
        mixed = ends.groupBy("node").agg(F.count_if(F.col("other") < F.col("node")).alias("up"), F.count("*").alias("n"))
        if mixed.where("up > 0 and n > 1").isEmpty():
            break
        stars = pairs.mapInArrow(_contract, schema)
        both = both_ways(stars, ("hi", "lo"), ("lo", "hi"), names=("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = both_ways(large.join(low, "hi"), ("lo", "m"), ("hi", "m"), names=("hi", "lo")).distinct()
        after = keep(small, "edges")
        drop(pairs)
        pairs = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of one key after another, as columns, from batches that are sorted by their first `keys` columns."""
    key, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        marks = list(zip(*columns[:keys]))
        while start < n:
            end = start + 1
            while end < n and marks[end] == marks[start]:
                end += 1
            part = [c[start:end] for c in columns]
            if marks[start] == key:
                held = [a + b for a, b in zip(held, part)]
            else:
                if held:
                    yield held
                key, held = marks[start], part
            start = end
    if held:
        yield held


def _compare(link: Callable, keys: int):
    """Rows of a group: side (0, 1 or 2), node, payload.  Links are sought among side 0, or between sides 1 and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list = []
        b: list = []
        kind = None
        for group in _groups(batches, keys):
            side, node, payload = group[keys:]
            kind = type(node[0])
            if len(node) > 1:
                for i, j in link(payload, side):
                    a.append(node[i])
                    b.append(node[j])
            if len(a) >= 10_000:
                yield _edge_batch(a, b, kind)
                a, b = [], []
        if a:
            yield _edge_batch(a, b, kind)

    return run


def _edge_batch(a: list, b: list, kind: type) -> pa.RecordBatch:
    t = pa.binary() if kind is bytes else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(a, t), pa.array(b, t)], names=["a", "b"])


def linked(members: DataFrame, link: Callable, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect what link() connects, among members (cand, node, payload) of equal cand.

    link(payloads, sides) yields pairs of positions: enough to connect all that are linked among them (a spanning
    forest), among side 0 or between sides 1 and 2.  node is unique.

    Nothing is lost in candidate groups of any size, and no task sees more than two chunks of one:
    1. Groups of at most `chunk` members are compared as they are.
    2. Larger ones are dealt twice into random chunks.  That connects what is densely linked.
    3. What then is not in the largest part of its group is compared with all chunks of the group, in blocks.
       So work beyond the members themselves is the number of such stragglers times the number of chunks.
    """
    node_type = members.schema["node"].dataType.simpleString()
    schema = f"a {node_type}, b {node_type}"

    def among(rows: DataFrame, *keys: str) -> DataFrame:
        cols = [*keys, "side", "node", "payload"]
        # Not the partitioning of the join before it, which Spark may read locally, in pieces of a group.
        dealt = rows.select(*cols).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)
        return dealt.mapInArrow(_compare(link, len(keys)), schema)

    members = keep(members.select("cand", "node", "payload"), "members")
    sizes = members.groupBy("cand").agg(F.count("*").alias("n"))
    sizes = keep(sizes.where("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "sizes")
    small = members.join(sizes.where("chunks = 1"), "cand").withColumn("side", F.lit(0))
    found = keep(among(small, "cand"), "links")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return found
    large_members = members.join(large, "cand")
    for seed in (1, 2):
        dealt = large_members.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks"))).withColumn("side", F.lit(0))
        found = found.union(keep(among(dealt, "cand", "part"), "links"))
    slim = large_members.select("cand", "node", "n", "chunks")
    parts = connected(found.union(slim.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    placed = keep(slim.join(parts, "node"), "parts")
    counts = placed.groupBy("cand", "component").agg(F.count("*").alias("size"))
    main = counts.groupBy("cand").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    stray = placed.join(main, "cand").where("component != main").select("cand", "node", "n", "chunks")
    per = stray.groupBy("cand").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    all_rows = large_members.join(per, "cand").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    lookers = all_rows.join(stray.select("node"), "node", "left_semi").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    left = all_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    right = lookers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(2))
    cols = ["cand", "part", "block", "side", "node", "payload"]
    return found.union(keep(among(left.select(*cols).union(right.select(*cols)), "cand", "part", "block"), "links"))


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric link matrix."""
    n = len(link)
    left = np.ones(n, bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(link[i] & left)
            left[new] = False
            out.extend((i, int(j)) for j in new)
            front.extend(new.tolist())
    return out
