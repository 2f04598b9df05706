"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import Words, binary, blocks, drop, keep, numbered, pieces, scope
from scalarlake.llm.linking import connected, linked

#: Fingerprints may differ in so many of their 64 bits.
BITS = 3


def line_key(line: bytes) -> bytes:
    """A line as it is compared: lower case, white space runs as one space, trimmed."""
    return b" ".join(line.decode("utf-8", "replace").lower().encode().split())


def fingerprints(lines: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each line: per bit, the majority over the hashes of its distinct words; ties give 1.

    Words count once, or a separator that stands between all cells of a table would make all tables alike.
    """
    out = np.zeros(len(lines), np.uint64)
    for a, b in blocks(lines, 1 << 17):
        words = Words(lines[a:b])
        line = np.repeat(np.arange(b - a), np.diff(words.bounds))
        order = np.lexsort((words.hashes, line))
        line, hashes = line[order], words.hashes[order]
        new = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1]))[:len(line)]
        line, hashes = line[new], hashes[new]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        size = np.bincount(line, minlength=b - a)
        full = np.flatnonzero(size)
        if len(full):
            ones = np.add.reduceat(bits, np.cumsum(size)[full] - size[full], axis=0, dtype=np.int32)
            out[a + full] = np.packbits(2 * ones >= size[full, None], axis=1).view(np.uint64)[:, 0]
    return out


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether at most `most` code points must be inserted, deleted or replaced.

    Bit-parallel dynamic programming: one big integer holds a whole column of the table.
    """
    x, y = a.decode(), b.decode()
    if abs(len(x) - len(y)) > most:
        return False
    start, end = 0, 0
    least = min(len(x), len(y))
    while start < least and x[start] == y[start]:
        start += 1
    while end < least - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start:len(x) - end], y[start:len(y) - end]
    if max(len(x), len(y)) <= most:
        return True
    if not x or not y:
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    plus, minus, distance = full, 0, len(x)
    for j, c in enumerate(y):
        eq = where.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - (len(y) - j - 1) > most:
            return False
        up = up << 1 | 1
        down <<= 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal & full
    return distance <= most


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether 1 - distance / longer length is at least percent / 100."""
    longest = max(len(a.decode()), len(b.decode()))
    return within(a, b, longest * (100 - percent) // 100)


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


def _letters(line: bytes) -> np.ndarray:
    points = np.frombuffer(line.decode().encode("utf-32-le"), np.uint32)
    return np.bincount(points & 127, minlength=128).astype(np.int32)


def _verify(bits: int, percent: int):
    def link(payloads: list[bytes], sides: list[int]) -> list[tuple[int, int]]:
        prints = np.frombuffer(b"".join(p[:8] for p in payloads), np.uint64)
        lines = [p[8:] for p in payloads]
        side = np.array(sides)
        letters = np.stack([_letters(x) for x in lines])
        longest = letters.sum(axis=1)
        union, out = _Union(len(lines)), []
        for i in range(1, len(lines)):
            near = np.bitwise_count(prints[:i] ^ prints[i]) <= bits
            if side[i]:
                near &= side[:i] != side[i]
            near = np.flatnonzero(near)
            # Each edit takes at most one letter away and adds one, so letter counts bound the distance from below.
            more = letters[near] - letters[i]
            least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
            near = near[least <= np.maximum(longest[near], longest[i]) * (100 - percent) // 100]
            for j in near.tolist():
                if union.find(i) != union.find(j) and similar(lines[i], lines[j], percent):
                    union.join(i, j)
                    out.append((i, j))
        return out

    return link


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, place, line, fingerprint) of each line that is not blank."""
    for batch in pieces(batches):
        ids, version, place, line, keys = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
            if not text:
                continue
            v = hashlib.md5(text).digest()
            for k, x in enumerate(text.split(b"\n")):
                x = line_key(x)
                if x:
                    ids.append(i)
                    version.append(v)
                    place.append(k)
                    line.append(hashlib.md5(x).digest())
                    keys.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(version, pa.binary()), pa.array(place, pa.int32()), pa.array(line, pa.binary()),
             pa.array(fingerprints(keys).view(np.int64))], names=["doc_id", "version", "place", "line", "print"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cand, node, payload) of rows (text, wanted: (place, line, cand, print))."""
    for batch in pieces(batches):
        cands, nodes, payloads = [], [], []
        for text, wanted in zip(binary(batch.column(0)), batch.column(1).to_pylist()):
            parts = text.split(b"\n")
            for w in wanted:
                key = line_key(parts[w["place"]]) if w["place"] < len(parts) else b""
                if hashlib.md5(key).digest() == w["line"]:
                    cands.append(w["cand"])
                    nodes.append(w["line"])
                    payloads.append(np.int64(w["print"]).tobytes() + key)
        yield pa.RecordBatch.from_arrays([pa.array(cands, pa.int64()), pa.array(nodes, pa.binary()), pa.array(payloads, pa.binary())],
                                         names=["cand", "node", "payload"])


def block_keys(print_col: Column, bits: int, agree: int) -> Column:
    """Keys of the pigeonhole blocks: cut into bits + agree blocks, two near fingerprints agree in `agree` of them."""
    n = bits + agree
    cuts = [64 * k // n for k in range(n + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(n), agree)):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(t), print_col.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def _close(bits: int):
    """A forest of the pairs within `bits` in each run of equal keys of sorted rows (key, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([tail_key, batch.column(0).to_numpy()])
            value = np.concatenate([tail, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1]) if np.all(key[:-1] <= key[1:]) else int(np.flatnonzero(key != key[-1])[-1]) + 1
            tail_key, tail = key[last:], value[last:]
            yield from _edges(key[:last], value[:last], bits)
        yield from _edges(tail_key, tail, bits)

    return run


def _edges(key: np.ndarray, value: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    pair = start[size == 2]
    close = np.bitwise_count(value[pair] ^ value[pair + 1]) <= bits
    a.extend(value[pair[close]].tolist())
    b.extend(value[pair[close] + 1].tolist())
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        run, left = value[s:s + n], np.arange(n)
        while len(left):  # breadth first; each value leaves `left` when it is reached
            front, left = [left[0]], left[1:]
            while front and len(left):
                i = front.pop()
                near = np.bitwise_count(run[left] ^ run[i]) <= bits
                new, left = left[near], left[~near]
                a.extend([int(run[i])] * len(new))
                b.extend(run[new].tolist())
                front.extend(new.tolist())
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def line_groups(docs: DataFrame, bits: int = BITS, percent: int = 80, agree: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(occurrences, keepers): lines (doc_id, version, place, line) and per line the occurrence its group keeps.

    agree: blocks in which near fingerprints are joined; more give longer keys and more of them.  It is derived from
    the number of distinct fingerprints, so that chance meetings stay fewer than lines; it has no influence on
    the result, because every choice finds all pairs.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = keep(base.mapInArrow(_lines, "doc_id long, version binary, place int, line binary, print long"), "lines")
    at = F.struct("doc_id", "version", "place")
    # The text of a line is fetched from an occurrence with an id, if there is one.
    held = F.min(F.struct(F.isnull("doc_id"), "doc_id", "version", "place"))
    lines = keep(seen.groupBy("line").agg(F.min(at).alias("first"), held.alias("held"), F.first("print").alias("print"), F.count("*").alias("n")), "distinct")
    prints = keep(lines.groupBy("print").agg(F.count("*").alias("n")), "prints")
    if agree is None:
        need = max(1, prints.count()).bit_length() + 4
        agree = next((r for r in range(1, 6) if 64 * r / (r + bits) >= need), 6)
    keys = prints.select(F.explode(block_keys(F.col("print"), bits, agree)).alias("key"), "print")
    close = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_close(bits), "a long, b long")
    # Lines of one fingerprint are candidates of each other as well.
    same = prints.where("n > 1").select(F.col("print").alias("a"), F.col("print").alias("b"))
    # Written first: connected() begins in Python, and a task that runs both would hold two workers.
    links = keep(close.union(same), "close")
    cands = connected(links)
    drop(links)
    wanted = lines.join(cands, F.col("print") == F.col("node")).select(
        F.col("held.doc_id").alias("i"), F.col("held.version").alias("v"),
        F.struct("held.place", "line", F.col("component").alias("cand"), "print").alias("w"))
    wanted = wanted.groupBy("i", "v").agg(F.collect_list("w").alias("wanted"))
    texts = base.where("text is not null").join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.unhex(F.md5("text")) == F.col("v")))
    members = texts.select("text", "wanted").mapInArrow(_texts, "cand long, node binary, payload binary").dropDuplicates(["node"])
    groups = connected(linked(members, _verify(bits, percent)))
    placed = lines.join(groups, lines.line == groups.node, "left").select(
        "line", "first", "n", F.coalesce("component", "line").alias("group"))
    least = placed.groupBy("group").agg(F.min("first").alias("keeper"), F.sum("n").alias("members")).where("members > 1")
    return seen.select("doc_id", "version", "place", "line"), placed.join(least, "group").select("line", "keeper")


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, version, removed) per document that loses lines: positions of the lines, from 0.

    Lines are what "\\n" separates.  Blank lines are left alone.  Lines are compared in lower case with white space
    runs as one space.  Two lines are linked when their fingerprints differ in at most `bits` bits and their
    edit similarity is at least `percent` / 100; equal lines are.  Of a connected group the occurrence with the
    smallest (doc_id, MD5 of the text, position) stays.  Rows that repeat id and text share one fate; null texts have no
    lines; null ids are the smallest.
    """
    with scope(docs.sparkSession):
        seen, keepers = line_groups(docs, **options)
        lost = seen.join(keepers, "line").where(~F.struct("doc_id", "version", "place").eqNullSafe(F.col("keeper")))
        lost = lost.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("removed"))
        return keep(lost, "removed", stays=True)


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (blank ones included), n_removed, removed (positions).

    See removed_lines(); a null text has no lines, an empty one has one.
    """
    text = F.col("text")
    base = docs.select("doc_id", F.unhex(F.md5(text)).alias("version"),
                       F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"))
    lost = removed_lines(docs, **options).select(F.col("doc_id").alias("i"), F.col("version").alias("v"), "removed")
    out = base.join(lost, base.doc_id.eqNullSafe(F.col("i")) & (base.version == F.col("v")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows without their last column, the positions of lines that go; text without these; rows of which only blanks are left go."""
    for batch in pieces(batches):
        texts, stay = [], []
        for text, removed in zip(binary(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
            if removed:
                gone = set(removed)
                text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone)
            texts.append(text)
            stay.append(not removed or bool(text.strip()))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
        fields = [pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)).filter(pa.array(stay, pa.bool_()))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without repeated lines; a document that loses lines and keeps none but blank ones goes.

    Columns stay as they are, whatever their names; so do rows that lose nothing, null and empty texts included.
    """
    at = docs.columns.index("text")
    lost, rows = removed_lines(docs, **options).alias("lost"), docs.alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("lost.doc_id")) & (F.unhex(F.md5(F.col("docs.text"))) == F.col("lost.version"))
    joined = numbered(rows.join(lost, same, "left").select("docs.*", "lost.removed"))
    return joined.mapInArrow(lambda batches: _without(batches, at), numbered(docs).schema).toDF(*docs.columns)
