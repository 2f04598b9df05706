"""Substring deduplication over word windows by level-wise doubling (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import Words, binary, blocks, drop, keep, mix, pieces

#: Lower bits of a number that hold a place; longer arrays are handled in stretches.
PLACE_BITS = 24


def leftmost_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` neighbouring hashes the place of its smallest by the upper 64 - PLACE_BITS bits, the leftmost if equal.

    Hash and place are one number, so that minima are taken over 2, 4, 8, ... neighbours for all stretches at once.
    """
    low = np.uint64(PLACE_BITS)
    found = [np.zeros(0, np.int64)]
    for k in range(0, len(h) - width + 1, 1 << PLACE_BITS - 1):
        least = h[k:k + (1 << PLACE_BITS - 1) + width - 1] >> low
        least <<= low
        least |= np.arange(len(least), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        found.append((least & np.uint64((1 << PLACE_BITS) - 1)).view(np.int64) + k)
    return np.concatenate(found)


def changes(places: np.ndarray) -> np.ndarray:
    """The places without those that repeat the one before."""
    return places[np.append(True, places[1:] != places[:-1])] if len(places) else places


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that leftmost_places() has for some `width` neighbours; so each such stretch has one."""
    return changes(leftmost_places(h, width))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; position i is the run that starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k:k + n]
    return mix(h)


def _joined(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_level(start: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or b"" for t in binary(batch.column(1))]
            version, count, digest, grams, places = [], [], [], [], []
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                for i in range(b - a):
                    own = words.hashes[words.bounds[i]:words.bounds[i + 1]]
                    text = texts[a + i].split()
                    whole = hashlib.sha256(b" ".join(text))
                    version.append(whole.digest()[:16])
                    digest.append(whole.hexdigest())
                    count.append(len(text))
                    h = gram_hashes(own, start) if len(own) >= window else np.zeros(0, np.uint64)
                    at = leftmost_minima(h, window - start + 1)
                    grams.append(h[at].view(np.int64))
                    places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(version, pa.binary()), pa.array(count, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "version", "n_words", "digest", "grams", "places"])

    return run


def _starts(spans: list[dict], n: int) -> np.ndarray:
    """Sorted distinct starts of inclusive spans, cut to 0 .. n - 1."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        a, b = max(0, s["a"]), min(n - 1, s["b"])
        if a <= b:
            edge[a] += 1
            edge[b + 1] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _next_level(size: int):
    """(doc_id, version, gram, place) of the windows of `size` words at the wanted starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = binary(batch.column(2))
            ids, versions, spans = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                out = ([], [], [], [])
                for i in range(b - a):
                    h = gram_hashes(words.hashes[words.bounds[i]:words.bounds[i + 1]], size)
                    at = _starts(spans[a + i], len(h))
                    out[0].append(np.full(len(at), ids[a + i]))
                    out[1].extend([versions[a + i]] * len(at))
                    out[2].append(h[at].view(np.int64))
                    out[3].append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(np.concatenate(out[2])),
                     pa.array(np.concatenate(out[3]))], names=["doc_id", "version", "gram", "place"])

    return run


def _cut(window: int):
    """(doc_id, version, n_removed, kept_sha256, text) of rows (doc_id, version, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, digest, kept = [], [], []
            for text, starts in zip(binary(batch.column(2)), batch.column(3)):
                words = text.split()
                at = np.asarray(starts.values.to_numpy(zero_copy_only=False), np.int64)
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rest = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(int(gone.sum()))
                digest.append(_joined(rest))
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "version", "n_removed", "kept_sha256", "kept"])

    return run


def levels(window: int, start: int) -> list[int]:
    out = [start]
    while out[-1] < window:
        out.append(2 * out[-1])
    if out[-1] != window or start < 1:
        raise ValueError("window must be start times a power of two")
    return out


def repeated_windows(docs: DataFrame, window: int = 50, start: int = 25) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (text; null if nothing was removed).

    Words are [^\\x20\\x09-\\x0D]+ of the text.  A window is `window` consecutive words of one document; every word
    covered by a window whose words also start in a document of a smaller id is removed, all judged on the input.
    kept has the other words joined by one space.

    Level by level: windows of `start` words that occur in two documents are extended to twice that length, and
    so on to `window`, until no candidates survive.  On the first level one window of each window - start + 1 neighbours,
    that of the smallest hash, stands for all: equal long windows choose the same.  Documents of equal word
    sequences count once; all but the smallest id lose every word if there are `window` or more.

    Null and empty texts have no words.  A null id is compared with nothing and loses nothing.  Rows that repeat an id are
    separate documents, none smaller than the other; rows that repeat id and text share one result.
    """
    sizes = levels(window, start)
    base = docs.select(F.col("doc_id").cast("long"), "text")
    seen = keep(base.mapInArrow(_first_level(sizes[0], window), "doc_id long, version binary, n_words long, digest string, "
                                "grams array<long>, places array<int>"), "grams")
    first = keep(seen.where(f"doc_id is not null and n_words >= {window}").groupBy("version").agg(F.min("doc_id").alias("least")), "versions")
    source = seen.join(first, "version").where("doc_id = least").dropDuplicates(["version"])
    rows = source.select("doc_id", "version", F.explode(F.arrays_zip("grams", "places")).alias("g")).select(
        "doc_id", "version", F.col("g.grams").alias("gram"), F.col("g.places").alias("place"))
    candidates = None
    for k, size in enumerate(sizes):
        twice = rows.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        survivors = rows.join(twice.select("gram", "least"), "gram")
        if size == window:
            break
        after = sizes[k + 1]
        if k == 0:  # sampled: all starts that a final window around the survivor can have
            span = F.struct((F.col("place") - (window - size)).alias("a"), (F.col("place") + (window - after)).alias("b"))
            spans = survivors.groupBy("doc_id", "version").agg(F.collect_set(span).alias("spans"))
        else:  # complete: a window survives if both of its halves did
            left = survivors.select("doc_id", "version", "place")
            right = left.select("doc_id", "version", (F.col("place") - size).alias("place"))
            both = left.join(right, ["doc_id", "version", "place"])
            spans = both.groupBy("doc_id", "version").agg(F.collect_set(F.struct(F.col("place").alias("a"), F.col("place").alias("b"))).alias("spans"))
        old = candidates
        texts = base.select(F.col("doc_id").alias("i"), "text") if old is None else old.select(F.col("doc_id").alias("i"), F.col("version").alias("v"), "text")
        on = F.col("doc_id") == F.col("i")
        found = texts.where("text is not null").join(spans, on if old is None else on & (F.col("version") == F.col("v")))
        found = found.select("doc_id", "version", "text", "spans")
        if old is None and _repeats(seen):
            found = found.where(_same_words(F.col("text")) == F.hex("version")).dropDuplicates(["doc_id", "version"])
        candidates = keep(found, "candidates")
        rows = keep(candidates.mapInArrow(_next_level(after), "doc_id long, version binary, gram long, place int"), "windows")
        if old is not None:
            drop(old)
    gone = survivors.where("doc_id > least").groupBy("doc_id", "version").agg(F.collect_set("place").alias("starts"))
    texts = candidates.select("doc_id", "version", "text") if candidates is not None else base.where("text is not null").select(
        "doc_id", _version(F.col("text")).alias("version"), "text").dropDuplicates(["doc_id", "version"])
    cut = texts.join(gone, ["doc_id", "version"]).select("doc_id", "version", "text", "starts").mapInArrow(
        _cut(window), "doc_id long, version binary, n_removed long, kept_sha256 string, kept string")
    cut = cut.select(F.col("doc_id").alias("i"), F.col("version").alias("v"), "n_removed", "kept_sha256", "kept")
    out = seen.select("doc_id", "version", "n_words", "digest").join(first, "version", "left")
    out = out.join(cut, (F.col("doc_id") == F.col("i")) & (F.col("version") == F.col("v")), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_joined([]))).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def _version(text):
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.substring(F.sha2(words, 256), 1, 32))


def _same_words(text):
    return F.hex(_version(text))


def _repeats(seen: DataFrame) -> bool:
    """Whether any id has more than one row: only then a join by id must look at versions."""
    return not seen.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
