"""Substring deduplication by merging Burrows-Wheeler transforms of aligned strings (operator 7).

Strings that share an anchor are laid out so that the anchor stands in the same columns.  The suffixes of such
strings at one column are ordered from those at the next one by a stable partition on one symbol, which is the
LF step; the transform of a shard holds, per column, the symbols before the ordered suffixes.  Shards are merged by
refining only the interleave: from the last column to the first, the shards' symbols are read in
the interleave's order and partitioned stably, which moves the interleave's entries and never looks at a suffix.
Along with it goes, for each pair of neighbours, the column where their common prefix ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import Prefix, binary, blocks, cleaned, drop, keep, mix, pieces
from scalarlake.llm.linking import _groups
from scalarlake.llm.windows import changes, leftmost_places

#: Bytes of an anchor.
ANCHOR = 64
#: Strings of one shard, and the most strings of one anchor that are merged in a task.
SHARD, MOST = 2048, 4096
#: Neighbouring starts whose strings are looked up across the parts of an anchor by what they have in common first.
CELL = 16
#: Texts are handled in blocks of about this many bytes, one call of NumPy for all texts of a block.
BLOCK = 1 << 17


def shard_transform(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column c: numbers of the rows ordered by their suffix from c on, and the symbols before those suffixes.

    Column 0 has no symbols before it; its entry stays 0.
    """
    n, width = rows.shape
    order = np.zeros((width + 1, n), np.int32)
    before = np.zeros((width + 1, n), rows.dtype)
    order[width] = np.arange(n)
    for c in range(width, 0, -1):
        before[c] = rows[order[c], c - 1]
        order[c - 1] = order[c][np.argsort(before[c], kind="stable")]
    return order, before


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, low: np.ndarray, high: np.ndarray,
                     length: int) -> np.ndarray:
    """For each row and column c: whether the string of `length` symbols at c is also that of another row of its group.

    Rows count through the shards one after the other; low and high are the columns between which a row has text.
    """
    width = len(shards[0][0]) - 1
    sizes = [s[0].shape[1] for s in shards]
    offset = np.cumsum([0, *sizes])
    n = offset[-1]
    found = np.zeros((n, max(0, width - length + 1)), bool)
    shard = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)  # the interleave
    end = np.full(n, width, np.int32)  # end[k]: column where entries k - 1 and k cease to agree
    end[0] = 0
    for c in range(width, 0, -1):
        symbol = np.zeros(n, shards[0][1].dtype)
        for s, (_, before) in enumerate(shards):
            symbol[shard == s] = before[c]
        move = np.argsort(symbol, kind="stable")
        shard = shard[move]
        rows = np.zeros(n, np.int64)
        for s, (order, _) in enumerate(shards):
            rows[shard == s] = offset[s] + order[c - 1]
        same = symbol[move[1:]] == symbol[move[:-1]]
        # Neighbours with one symbol agree as far as all pairs between their old places did.
        after = np.zeros(n, np.int32)
        pairs = np.flatnonzero(same)
        if len(pairs):
            first, last = move[pairs] + 1, move[pairs + 1] + 1
            after[pairs + 1] = end[last - 1]
            far = np.flatnonzero(last - first > 1)
            if len(far):
                bounds = np.stack([first[far], last[far]], axis=1).ravel()
                after[pairs[far] + 1] = np.minimum.reduceat(np.append(end, width), bounds)[::2]
        # Neighbours with different symbols agree on nothing: their prefix ends where it starts.
        broken = np.ones(n, bool)
        broken[pairs + 1] = False
        after[broken] = c - 1
        end = after
        if c - 1 < found.shape[1]:
            k = np.flatnonzero(end >= c - 1 + length)
            a, b = rows[k - 1], rows[k]
            fit = (group[a] == group[b]) & (low[a] <= c - 1) & (low[b] <= c - 1) & (high[a] >= c - 1 + length) & (high[b] >= c - 1 + length)
            found[a[fit], c - 1] = True
            found[b[fit], c - 1] = True
    return found


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other: their bytes, and where each one starts and its size."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def _lists(count, values, kind: pa.DataType | None = None) -> pa.Array:
    """Lists of so many values each, one after the other."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), values)


def _spots(length: int):
    """Per document: version, size, digest, and its anchors: hash and place of the leftmost smallest per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or b"" for t in binary(batch.column(1))]
            whole = [hashlib.sha256(t) for t in texts]
            count, anchors, places = [], [], []
            for i, j in blocks(texts, BLOCK):
                buf, first, size = _joined(texts[i:j])
                h = Prefix(buf).hash_run(max(0, len(buf) - ANCHOR + 1), ANCHOR)
                # Stretches that lie in one text.
                many = np.maximum(0, size - length + 1)
                within = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
                at = changes(leftmost_places(h, length - ANCHOR + 1)[within])
                text = np.searchsorted(first, at, "right") - 1
                count.append(np.bincount(text, minlength=j - i))
                anchors.append(h[at].view(np.int64))
                places.append(at - first[text])
            count = np.concatenate(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([int.from_bytes(w.digest()[:8], "big", signed=True) for w in whole], pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([w.hexdigest() for w in whole], pa.string()),
                 _lists(count, np.concatenate(anchors), pa.int64()), _lists(count, np.concatenate(places).astype(np.int32), pa.int32())],
                names=["doc_id", "version", "n_bytes", "digest", "anchors", "places"])

    return run


def _around(texts: list[bytes], spots: pa.ListArray, length: int):
    """Number of the text and place of each spot, and start and end of its context: what windows holding the anchor can reach."""
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(spots).to_numpy())
    place = spots.flatten().field("place").to_numpy().astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return text, place, np.maximum(0, place - (length - ANCHOR)), np.minimum(size[text], place + length)


def _contexts(length: int):
    """(anchor, context, version, place): context is a hash of the bytes around the anchor and of its place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, spots = binary(batch.column(1)), batch.column(2)
            text, place, a, b = _around(texts, spots, length)
            context = ((place - a) * 1_000_003 + (b - a)).astype(np.uint64)
            for i, j in blocks(texts, BLOCK):
                buf, first, _ = _joined(texts[i:j])
                k = slice(*np.searchsorted(text, [i, j]))
                shift = first[text[k] - i]
                context[k] ^= Prefix(buf).hash(a[k] + shift, b[k] + shift)
            yield pa.RecordBatch.from_arrays(
                [spots.flatten().field("anchor"), pa.array(context.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(place.astype(np.int32))],
                names=["anchor", "context", "version", "place"])

    return run


def _strings(length: int):
    """(anchor, context, lead, bytes) of rows (text, wanted: (place, anchor, context)); lead is the anchor's place in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, wanted = binary(batch.column(0)), batch.column(1)
            text, place, a, b = _around(texts, wanted, length)
            spots = wanted.flatten()
            for k in range(0, len(text), 10_000):
                part = slice(k, k + 10_000)
                data = [texts[i][x:y] for i, x, y in zip(text[part].tolist(), a[part].tolist(), b[part].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [spots.field("anchor")[part], spots.field("context")[part], pa.array((place - a)[part].astype(np.int32)), pa.array(data, pa.binary())],
                    names=["anchor", "context", "lead", "bytes"])

    return run


def _merge(length: int):
    """(anchor, context, spans, open, cells, known) of rows (anchor, part, split, context, lead, bytes), sorted by anchor and part.

    spans: where, counted from the anchor, strings of `length` bytes start that another context of the part has as well:
    first and last start of a span, first and last of the next one, and so on.
    Only if the anchor is split into parts: open has the other strings of the context by cells of CELL columns that they
    start in; a cell's hash is that of the bytes that all strings starting in it would share.  cells has the hashes of
    all cells of the part, known those of the strings found in it, each with one context.
    """
    reach, width = length - ANCHOR, 2 * length - ANCHOR

    def solve(anchor: list, part: list, split: list, context: list, lead: list, data: list) -> pa.RecordBatch:
        n = len(data)
        # One row per string, text as symbols 1 .. 256, nothing as 0 or 257 by side, so that it never looks like text.
        rows = np.zeros((n, width), np.uint16)
        buf, first, size = _joined(data)
        low = (reach - np.array(lead)).astype(np.int32)
        high = (low + size).astype(np.int32)
        rows[np.arange(width) >= high[:, None]] = 257
        rows.reshape(-1)[np.arange(len(buf)) + np.repeat(np.arange(n) * width + low - first, size)] = buf.astype(np.uint16) + 1
        _, group = np.unique(np.array(anchor, np.int64), return_inverse=True)
        shards = [shard_transform(rows[k:k + SHARD]) for k in range(0, n, SHARD)]
        found = merged_intervals(shards, group, low, high, length)
        edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        row, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1] - 1
        spans = np.stack([a, b], axis=1).ravel().astype(np.int32) - reach
        n_spans = 2 * np.bincount(row, minlength=n)
        n_open, n_cells, n_known = np.zeros((3, n), np.int64)
        none = np.zeros(0, np.int64)
        start, gram, open_cell, n_strings, cells, known = [none], [none], [none], [none], [], []
        told: set[int] = set()
        for i in np.flatnonzero(split).tolist():
            c = np.arange(low[i], max(low[i], high[i] - length + 1))
            sums = Prefix(buf[first[i]:first[i] + size[i]])
            # With the place: equal strings hold their anchor at the same place, and one string of a text may
            # be in the contexts of several anchors, at several.  What a cell's strings share holds the anchor, too.
            grams = mix(sums.hash_run(len(c), length) + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            cell, at = np.unique(c // CELL, return_inverse=True)
            keys = sums.hash(np.minimum(cell * CELL + CELL - 1, reach) - low[i], cell * CELL + length - low[i])
            keys = mix(keys + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            had = found[i, c]
            for hashes, out, count in ((keys, cells, n_cells), (grams[had], known, n_known)):
                new = set(hashes.tolist()) - told
                told |= new
                out.extend(new)
                count[i] = len(new)
            many = np.bincount(at[~had], minlength=len(cell))
            start.append(c[~had] - reach)
            gram.append(grams[~had])
            open_cell.append(keys[many > 0])
            n_strings.append(many[many > 0])
            n_open[i] = len(n_strings[-1])
        some = np.flatnonzero(n_spans + n_open)  # every start is in a span or open, so contexts with cells are among them
        strings = pa.StructArray.from_arrays([pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(gram))], ["start", "gram"])
        opened = pa.StructArray.from_arrays([pa.array(np.concatenate(open_cell)), _lists(np.concatenate(n_strings), strings)], ["cell", "strings"])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()).take(pa.array(some)), pa.array(context, pa.int64()).take(pa.array(some)),
             _lists(n_spans[some], spans, pa.int32()), _lists(n_open[some], opened),
             _lists(n_cells[some], cells, pa.int64()), _lists(n_known[some], known, pa.int64())],
            names=["anchor", "context", "spans", "open", "cells", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], [], []]
        for group in _groups(batches, 2):
            if len(held[0]) + len(group[0]) > MOST and held[0]:
                yield solve(*held)
                held = [[], [], [], [], [], []]
            if len(group[0]) > 1 or group[2][0]:
                for column, more in zip(held, group):
                    column.extend(more)
        if held[0]:
            yield solve(*held)

    return run


def _cut(length: int):
    """Rows (version, text, hits: (place, spans)): text without the bytes that strings starting in the spans, counted from the places, cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, hits = binary(batch.column(1)), batch.column(2)
            spans = hits.flatten().field("spans")
            many = pc.list_value_length(spans).to_numpy() // 2
            text = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(hits).to_numpy()), many)
            place = np.repeat(hits.flatten().field("place").to_numpy(), many).astype(np.int64)
            ends = spans.flatten().to_numpy().reshape(-1, 2) + place[:, None]
            removed, runs, kept = [], [], []
            for i, j in blocks(texts, BLOCK):
                buf, first, size = _joined(texts[i:j])
                k = slice(*np.searchsorted(text, [i, j]))
                own = text[k] - i
                a, b = np.maximum(0, ends[k, 0]), np.minimum(size[own] - length, ends[k, 1])
                fit = a <= b
                edge = np.zeros(len(buf) + 1, np.int32)
                np.add.at(edge, (first[own] + a)[fit], 1)
                np.add.at(edge, (first[own] + b)[fit] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[first[size > 0]] = gone[first[size > 0]]  # runs do not cross texts
                bounds = np.append(first, len(buf))
                removed.append(np.diff(np.append(0, np.cumsum(gone))[bounds]))
                runs.append(np.diff(np.append(0, np.cumsum(begin))[bounds]))
                rest, at = buf[~gone].tobytes(), np.append(0, np.cumsum(size - removed[-1])).tolist()
                kept.extend(rest[x:y] for x, y in zip(at, at[1:]))
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(removed)), pa.array(np.concatenate(runs)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["version", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null if nothing was removed).

    Every byte of a text in UTF-8 that is covered by a string of `length` bytes that also starts elsewhere, in any row or
    the same one, is removed, judged on the input; strings do not cross rows.

    1. Of each stretch of length - ANCHOR + 1 neighbouring strings of ANCHOR bytes the one with the smallest hash is an anchor:
       equal long strings hold the same one.  Anchors that occur once are done with.
    2. What windows around an anchor can reach is its context.  Equal contexts are one class; a class of several
       is repeated throughout.  So copies cost nothing further, and texts that are copies as a whole are settled
       by their digest.
    3. The contexts of each remaining anchor are aligned; their transforms are built in shards and merged,
       and the merge yields the common prefixes, hence the repeated intervals.
    4. An anchor with more than MOST different contexts, which a task should not hold, is dealt into parts.  What a part
       leaves open is looked up, by hash, among the strings of the anchor's other parts, first by cells of neighbouring starts,
       then, where another part has the cell, string by string; so the work stays linear.

    Null and empty texts have no bytes.  Ids play no part: null and repeated ones pass through.  length must be more than ANCHOR.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be more than {ANCHOR}")
    with cleaned(docs.sparkSession):
        base = docs.select(F.col("doc_id").cast("long"), "text")
        seen = keep(base.mapInArrow(_spots(length), "doc_id long, version long, n_bytes long, digest string, anchors array<long>, places array<int>"), "anchors")
        copies = keep(seen.where(f"n_bytes >= {length}").groupBy("version").agg(F.count("*").alias("copies"), F.min(F.xxhash64("doc_id")).alias("k")), "versions")
        one = seen.select("version", F.xxhash64("doc_id").alias("k"), "anchors", "places").join(copies, ["version", "k"]).dropDuplicates(["version"])
        spots = one.select("version", "k", F.explode(F.arrays_zip("anchors", "places")).alias("s")).select(
            "version", "k", F.col("s.anchors").alias("anchor"), F.col("s.places").alias("place"))
        often = spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        wanted = spots.join(often, "anchor").groupBy("k", "version").agg(F.collect_list(F.struct("place", "anchor")).alias("spots"))
        texts = base.where(F.octet_length("text") >= length).select(F.xxhash64("doc_id").alias("k"), "text").join(wanted, "k")
        texts = texts.where(F.conv(F.substring(F.sha2("text", 256), 1, 16), 16, -10).cast("long") == F.col("version"))
        candidates = keep(texts.select("version", "text", "spots"), "candidates")
        found = keep(candidates.mapInArrow(_contexts(length), "anchor long, context long, version long, place int").distinct(), "contexts")
        classes = keep(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("version", "place")).alias("at")), "classes")
        groups = classes.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
        chosen = classes.join(groups, "anchor").groupBy("at.version").agg(
            F.collect_list(F.struct("at.place", "anchor", "context")).alias("wanted"))
        strings = candidates.join(chosen, "version").dropDuplicates(["version"]).select("text", "wanted").mapInArrow(
            _strings(length), "anchor long, context long, lead int, bytes binary").join(groups, "anchor")
        parts = F.ceil(F.col("m") / MOST)
        strings = strings.select("anchor", F.pmod(F.xxhash64("context"), parts).alias("part"), (parts > 1).alias("split"), "context", "lead", "bytes")
        solved = keep(strings.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
            _merge(length), "anchor long, context long, spans array<int>, "
            "open array<struct<cell: long, strings: array<struct<start: int, gram: long>>>>, cells array<long>, known array<long>"), "solved")
        # Across the parts of an anchor: a string that its own part has once is repeated if any other part has it.
        # Only those are looked up whose cell is in another part as well; strings of other cells occur nowhere else.
        shared = solved.select("anchor", F.explode("cells").alias("cell")).groupBy("anchor", "cell").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "cell")
        far = solved.select("anchor", "context", F.explode("open").alias("o")).select("anchor", "context", "o.cell", "o.strings").join(shared, ["anchor", "cell"])
        far = keep(far.select("anchor", "context", F.explode("strings").alias("s")).select("anchor", "context", "s.start", "s.gram"), "far")
        had = far.select("anchor", "gram", F.lit(1).alias("n")).union(solved.select("anchor", F.explode("known").alias("gram"), F.lit(2).alias("n")))
        twice = had.groupBy("anchor", "gram").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "gram")
        across = far.join(twice, ["anchor", "gram"]).groupBy("anchor", "context").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("spans"))
        partly = solved.where("size(spans) > 0").select("anchor", "context", "spans").union(across)
        partly = partly.groupBy("anchor", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        marks = keep(classes.join(partly, ["anchor", "context"], "left").where("n > 1 or spans is not null").select("anchor", "context", "n", "spans"), "marks")
        drop(classes)
        drop(solved)
        drop(far)
    reach = length - ANCHOR
    hits = found.join(marks, ["anchor", "context"]).select(
        "version", "place", F.when(F.col("n") > 1, F.array(F.lit(-reach), F.lit(0))).otherwise(F.col("spans")).alias("spans"))
    hits = hits.groupBy("version").agg(F.collect_list(F.struct("place", "spans")).alias("hits"))
    rows = candidates.select("version", "text").join(hits, "version").dropDuplicates(["version"])
    cut = rows.mapInArrow(_cut(length), "version long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = seen.select("doc_id", "version", "n_bytes", "digest").join(copies.select("version", "copies"), "version", "left").join(cut, "version", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
