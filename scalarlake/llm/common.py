"""What the operators share: the shared folder, cutting lineage, byte-level words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space as the contracts have it: \x20 and \x09-\x0D, which is what bytes.split() splits at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in blocks of about this many bytes, so that the arrays stay in the cache.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers of both for the longest text so far; shorter ones use the beginning.
_powers: list[np.ndarray] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, because
    a machine-local folder would be read incompletely.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    Inside a scope() the table goes with the scope, unless it `stays`: then it belongs to the one around, if any.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._llm_path = path
    if len(_scopes) > stays:
        _scopes[-1 - stays].append(kept)
    return kept


_scopes: list[list[DataFrame]] = []
#: Setting of Spark: shuffle files go when the query that wrote them has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run in this block leave no shuffle files; what they found is in the tables that they wrote."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept in this block are dropped at its end, when their last reader is done."""
    _scopes.append([])
    try:
        with cleaned(spark):
            yield
    finally:
        for table in _scopes.pop():
            drop(table)


def drop(kept: DataFrame) -> None:
    """Remove a table that keep() wrote and nothing reads any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> DataFrame:
    """df with columns named by position: mapInArrow takes names with dots for fields of structs."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def count_words(text):
    """Number of words [^\\x20\\x09-\\x0D]+ of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a worker holds few texts as Python objects.

    Workers outlive their tasks, so Arrow's free memory is given back at the end.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    batch = None
    pa.default_memory_pool().release_unused()


def binary(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def blocks(items: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` bytes; a longer item is a range of its own."""
    start = size = 0
    for i, item in enumerate(items):
        if i > start and size + len(item) > most:
            yield start, i
            start, size = i, 0
        size += len(item)
    if items[start:]:
        yield start, len(items)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly; works in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Prefix:
    """64-bit hashes of any substring of a byte array in constant time."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        size = 1 << max(16, int(n).bit_length())
        if not _powers or len(_powers[0]) < size:
            _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
        power, self.inverse = _powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def hash_run(self, count: int, length: int) -> np.ndarray:
        """Hashes of the substrings of one length at starts 0 .. count - 1."""
        return mix((self.sums[length:length + count] - self.sums[:count]) * self.inverse[:count])


class Words:
    """Words of a block of texts: hash and text number of each, in order."""

    def __init__(self, texts: list[bytes]) -> None:
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[buf]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = Prefix(buf).hash(start, end)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(size) - size
        #: Words of text i are at bounds[i] .. bounds[i + 1].
        self.bounds = np.append(np.searchsorted(start, first), len(start))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of `size` consecutive words, sorted; of all words, if there are fewer; empty of none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k:k + n]
    return np.unique(mix(h))
