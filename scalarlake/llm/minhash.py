"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import LOWER, Words, binary, blocks, keep, mix, pieces, scope, shingles
from scalarlake.llm.linking import connected, forest, linked

#: Bands and rows of a signature.  A pair at a similarity of 0.8 shares no band with probability 1.7e-4, at 0.85 with
#: 7.6e-7, at 0.9 with 4e-10.
BANDS, ROWS = 24, 5


def _scramble(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(features: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit features, which must not be empty.

    The first permutation scatters the features over a ring of 2^32 places; coordinate k is the least value of the second
    permutation, shifted circularly by k, over the places taken.
    """
    place = _scramble((features >> np.uint64(32)).astype(np.uint32) ^ features.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for start in range(0, len(place), 1024):
        ring = place[None, start:start + 1024] - shift
        np.minimum(out, _scramble(ring, 0x21F0AAAD, 0xD35A2D97).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for column in sig.reshape(bands, rows).T:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + column)
    return h.view(np.int64)


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    texts = [t.translate(LOWER) if t else b"" for t in texts]
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        for i in range(b - a):
            yield shingles(words.hashes[words.bounds[i]:words.bounds[i + 1]], size)


def _node(features: np.ndarray) -> bytes:
    return hashlib.md5(features.tobytes()).digest()


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, nodes, versions, keys = [], [], [], []
            texts = binary(batch.column(1))
            for text, features in zip(texts, _sets(texts, size)):
                versions.append(hashlib.md5(text).digest() if len(features) else None)
                counts.append(len(features))
                nodes.append(_node(features) if len(features) else None)
                keys.append(band_keys(signature(features, bands * rows), bands, rows) if len(features) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(versions, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "version", "bands"])

    return run


def _members(size: int):
    """(cand, node, payload) of rows (cand, node, text) whose text has the wanted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cands, nodes, payloads = [], [], []
            for cand, node, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(binary(batch.column(2)), size)):
                if len(features) and _node(features) == node:
                    cands.append(cand)
                    nodes.append(node)
                    payloads.append(features.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (cands, nodes, payloads)], names=["cand", "node", "payload"])

    return run


def _similar(percent: int):
    def link(payloads: list[bytes], sides: list[int]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        n = len(sets)
        sizes = np.fromiter(map(len, sets), np.int64, n)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        used, column = np.unique(column, return_inverse=True)
        common = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, len(used), 8192):  # counts stay far below 2^24, so they are exact
            a, b = np.searchsorted(column, [start, start + 8192])
            has = np.zeros((n, min(8192, len(used) - start)), np.float32)
            has[row[a:b], column[a:b] - start] = 1
            common += has @ has.T
        common = common.astype(np.int64)
        close = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        side = np.array(sides)
        if side.any():
            close &= side[:, None] != side[None, :]
        return forest(close)

    return link


def _components(docs: DataFrame, size: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, n_shingles, component, least) of every row: the MD5 of its text, its group and the group's smallest
    id; null for rows without words but for doc_id and n_shingles."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = keep(base.mapInArrow(_sketch(size, bands, rows),
                                    "doc_id bigint, n_shingles bigint, node binary, version binary, bands array<bigint>"), "sketch")
    # The text of a set is fetched from a row with an id, if there is one.
    held = F.min(F.struct(F.isnull("doc_id"), "doc_id", "version"))
    nodes = keep(sketched.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), held.alias("held"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = keys.join(hubs, "key").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    cands = connected(stars)
    wanted = cands.join(nodes, "node").select("node", F.col("component").alias("cand"), F.col("held.doc_id").alias("i"), F.col("held.version").alias("v"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.unhex(F.md5("text")) == F.col("v"))).select("cand", "node", "text")
    members = texts.mapInArrow(_members(size), "cand binary, node binary, payload binary").dropDuplicates(["node"])
    groups = connected(linked(members, _similar(percent)))
    node_ids = nodes.select("node", "first_id").join(groups, "node", "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component"))
    least = node_ids.groupBy("component").agg(F.min("first_id").alias("least"))
    placed = node_ids.join(least, "component").select("node", "component", "least")
    return sketched.select("doc_id", "version", "n_shingles", "node").join(placed, "node", "left").drop("node")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a document's set has its distinct shingles of
    `size` words, the whole sequence if there are fewer words; shingles count as equal when their 64-bit hashes are.
    Documents are linked when 100 * intersection >= percent * union; the component is the smallest id
    reachable, the row of that id is kept.

    Equal sets are one node from the start, so copies cost nothing further.  Banding proposes candidates: a band's
    bucket is a star around its smallest node, not all pairs.  linked() then verifies on the full sets, whole
    candidate groups at a time.

    Null and empty texts, and those of white space, have empty sets and are linked with nothing.  A row of a null id has
    a null component unless others of its component have an id, and is kept if it is null.  Rows that repeat an id are
    separate documents, all kept if theirs is the smallest.
    """
    with scope(docs.sparkSession):
        found = _components(docs, size, percent, bands, rows, id_col, text_col)
        component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        found = found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
        return keep(found, "near", stays=True)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, any others) with exactly one row of each group of near duplicates, see near_duplicates().

    That of the smallest (doc_id, MD5 of the text) stays, ids before null ones; of rows that repeat both, the one whose other
    columns have the smallest hash.  Null texts and texts without words are in no group and stay, every one.
    """
    with scope(docs.sparkSession):
        found = _components(docs.select("doc_id", "text"), size, percent, bands, rows, "doc_id", "text").where("component is not null")
        copies = found.groupBy("component", "doc_id", "version").agg(F.count("*").alias("copies"))
        first = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "version", "copies"))
        kept = copies.groupBy("component").agg(first.alias("f")).select(F.col("f.doc_id").alias("i"), F.col("f.version").alias("v"), "f.copies")
        kept = keep(kept, "kept", stays=True)
    words = F.regexp_like("docs.text", F.lit(r"[^\x20\x09-\x0D]"))
    own = F.col("docs.doc_id").eqNullSafe(F.col("kept.i")) & (F.unhex(F.md5(F.col("docs.text"))) == F.col("kept.v"))
    out = docs.alias("docs").join(kept.alias("kept"), own, "left")
    out = out.where(F.col("kept.v").isNotNull() | F.coalesce(~words, F.lit(True)))
    if kept.where("copies > 1").isEmpty():
        return out.select("docs.*")
    whole = F.struct("docs.*")
    several = out.where("kept.copies > 1").select("kept.i", "kept.v", whole.alias("row"), F.xxhash64(F.to_json(whole)).alias("h"))
    several = several.groupBy("i", "v").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return out.where("kept.copies is null or kept.copies = 1").select("docs.*").unionByName(several)
