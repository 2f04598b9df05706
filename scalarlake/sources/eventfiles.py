"""Event files as a Spark source.

``eventfiles`` is a Python data source, for batch and streaming reads, that *lists*
event files: run folders are dealt to input partitions and walked on executors.  Reading is
a DataFrame pipeline on top:

    listing -> stretches of whole records -> decoded rows

Large files are cut into even stretches, each of which finds its own first record by the
checksum of its length (``framing``); a prefix sum over a file's stretches numbers the
records.  So neither a run with most of the files nor one huge file keeps a single task busy.

The streaming source's offset is the change signature of every run: files, newest
modification, bytes.  Runs whose signature has not changed are not planned.
"""

from __future__ import annotations

import os
import posixpath
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalar import clean_path
from . import framing
from .files import filesystem as _filesystem
from .files import prefix, qualified
from .wire import Undecodable, parse_alike, parse_event

NAME_START = "events.out.tfevents."  # fixed value: event files are named like this
HEAD_RECORDS = HEAD_GAP = 512  # fixed values of the head-only text scan

SPLIT_BYTES = 32 * 1024 * 1024
LIST_TASKS = 64  # at most so many tasks list run folders
REC_SCALE = 1 << 32  # ``rec`` = record number * REC_SCALE + n-th value of a tag in the record
_CHUNK = 8 * 1024 * 1024
_HEADS_CHUNK = 1024 * 1024  # where only lengths are read
_ROWS = 50_000
_BLOCK = 2 * 1024 * 1024  # records are decoded together in blocks of about this size
_LEN = struct.Struct("<Q")

LISTING = "run_id string, relkey string, path string, size bigint, mtime double"
_STRETCH = "run_id string, relkey string, prefix string, path string, start bigint, stop bigint, first_rec bigint"
DECODED = (
    "run_id string, kind string, tag string, step bigint, wall_time double, value double, text string, "
    "src string, rec bigint, offset bigint"
)
_DECODED_ARROW = pa.schema([
    ("run_id", pa.string()), ("kind", pa.string()), ("tag", pa.string()), ("step", pa.int64()),
    ("wall_time", pa.float64()), ("value", pa.float64()), ("text", pa.string()), ("src", pa.string()),
    ("rec", pa.int64()), ("offset", pa.int64()),
])


# --- listing -------------------------------------------------------------------

def _children(filesystem, folder: str):
    from pyarrow import fs

    return filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _is_dir(info) -> bool:
    from pyarrow import fs

    return info.type == fs.FileType.Directory


def _event_files(filesystem, folder: str, top: str = "") -> Iterator[tuple[str, object]]:
    """(relative path, info) of the event files below ``folder``; links inside are not followed."""
    from pyarrow import fs

    local = isinstance(filesystem, fs.LocalFileSystem)
    pending = [(folder, top)]
    while pending:
        path, rel = pending.pop()
        for info in _children(filesystem, path):
            name = posixpath.join(rel, info.base_name)
            if _is_dir(info):
                if not (local and os.path.islink(info.path)):
                    pending.append((info.path, name))
            elif info.base_name.startswith(NAME_START):
                yield name, info


def run_of_flat_folder(root: str) -> str:
    return posixpath.basename(_filesystem(root)[1].rstrip("/")) or "run"


class RunFolder(InputPartition):
    def __init__(self, run_id: str, folder: str, flat: bool):
        super().__init__((run_id, folder, flat))
        self.run_id, self.folder, self.flat = run_id, folder, flat

    @property
    def folders(self) -> list[RunFolder]:
        return [self]


def _run_folders(root: str, wanted: set[str] | None) -> list[RunFolder]:
    """Sub-folders of the root; the root itself if none of them is a run but it holds event files.

    Sub-folders without event files simply list nothing.
    """
    filesystem, path = _filesystem(root)
    infos = sorted(_children(filesystem, path), key=lambda i: i.base_name)
    folders = [i for i in infos if _is_dir(i)]
    if any(not _is_dir(i) and i.base_name.startswith(NAME_START) for i in infos):
        if not any(next(_event_files(filesystem, f.path), None) for f in folders):
            name = run_of_flat_folder(root)
            return [RunFolder(name, path, True)] if wanted is None or name in wanted else []
    return [RunFolder(f.base_name, f.path, False) for f in folders if wanted is None or f.base_name in wanted]


def _list(part: RunFolder, root: str) -> Iterator[tuple]:
    filesystem, _ = _filesystem(root)
    scheme = prefix(root)
    for rel, info in _event_files(filesystem, part.folder):
        if part.flat and "/" in rel:
            continue
        mtime = info.mtime.timestamp() if info.mtime else 0.0
        yield part.run_id, rel, scheme + info.path, info.size, mtime


class RunFolders(InputPartition):
    def __init__(self, folders: list[RunFolder]):
        super().__init__(tuple(f.run_id for f in folders))
        self.folders = folders


def _dealt(folders: list[RunFolder]) -> list[RunFolder] | list[RunFolders]:
    """Partitions of folders for at most LIST_TASKS tasks."""
    return folders if len(folders) <= LIST_TASKS else [RunFolders(folders[k::LIST_TASKS]) for k in range(LIST_TASKS)]


class _Options:
    def __init__(self, options):
        self.root = options["path"]
        runs = options.get("runs")
        self.runs = set(runs.split("\n")) if runs else None


class _Lister(_Options, DataSourceReader):
    def partitions(self):
        return _dealt(_run_folders(self.root, self.runs)) or [RunFolders([])]

    def read(self, partition):
        for folder in partition.folders:
            yield from _list(folder, self.root)


_POLL_THREADS = 16


def signatures(root: str, wanted: set[str] | None = None) -> dict[str, list]:
    """Per run: event files, newest modification time and bytes; runs without event files have none."""

    def one(folder: RunFolder) -> list:
        files, newest, size = 0, 0.0, 0
        for _, _, _, bytes_, mtime in _list(folder, root):
            files, newest, size = files + 1, max(newest, mtime), size + bytes_
        return [files, newest, size]

    folders = _run_folders(root, wanted)
    with ThreadPoolExecutor(_POLL_THREADS) as pool:
        found = zip([f.run_id for f in folders], pool.map(one, folders))
    return {run: sig for run, sig in sorted(found) if sig[0]}


class _Poller(_Options, DataSourceStreamReader):
    """The offset says what every run looked like.  Without a change there is no batch; a batch lists the runs that
    have changed.  What has grown in them is decided by the consumer, whose table of consumed bytes is the state
    (see ``streaming.ingest``)."""

    def initialOffset(self):
        return {"runs": {}}

    def latestOffset(self):
        return {"runs": signatures(self.root, self.runs)}

    def partitions(self, start, end):
        known, now = start.get("runs") or {}, end.get("runs")
        folders = _run_folders(self.root, self.runs)
        if now is not None:
            folders = [f for f in folders if f.run_id in now and now[f.run_id] != known.get(f.run_id)]
        return _dealt(folders)

    def read(self, partition):
        for folder in partition.folders:
            yield from _list(folder, self.root)

    def commit(self, end):
        pass


class EventFiles(DataSource):
    @classmethod
    def name(cls):
        return "eventfiles"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _Lister(self.options)

    def streamReader(self, schema):
        return _Poller(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFiles)


def list_event_files(spark: SparkSession, root: str, runs: list[str] | None = None) -> DataFrame:
    """Event files of all (or the given) runs; see ``in_order`` for a stable listing."""
    register(spark)
    reader = spark.read.format("eventfiles")
    if runs is not None:
        reader = reader.option("runs", "\n".join(runs))
    return with_prefix(reader.load(qualified(spark, root)))


def in_order(listing: DataFrame) -> DataFrame:
    """Files with their ``place`` in the run, from 0, by relative key."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("relkey")) - 1
    return listing.withColumn("place", place.cast("long"))


def with_prefix(listing: DataFrame) -> DataFrame:
    """Adds what stands before the tags of a file: its folder without timestamp and id parts."""
    return listing.withColumn("prefix", clean_path(F.regexp_extract("relkey", "^(.*)/[^/]*$", 1)))


# --- records -----------------------------------------------------------------

class _Window:
    """Forward reader over a file: keeps one chunk, seeks over what is not asked for."""

    def __init__(self, handle, start: int, stop: int, chunk: int = _CHUNK):
        self.handle, self.stop, self.chunk = handle, stop, chunk
        self.base, self.buf = start, b""

    def get(self, at: int, size: int) -> tuple[bytes, int]:
        """Buffer and position in it holding ``size`` bytes of the file from ``at``."""
        off = at - self.base
        if off < 0 or off + size > len(self.buf):
            self.handle.seek(at)
            self.buf = self.handle.read(min(max(size, self.chunk), self.stop - at))
            self.base, off = at, 0
        return self.buf, off


def _open(path: str):
    filesystem, local = _filesystem(path)
    return filesystem.open_input_file(local)


_CUT = pa.schema([("run_id", pa.string()), ("relkey", pa.string()), ("prefix", pa.string()), ("path", pa.string()),
                  ("start", pa.int64()), ("stop", pa.int64()), ("first_rec", pa.int64())])


def _sync(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For even stretches [lo, hi) of files: the first record in each, the boundary behind it, and how many lie between."""
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            try:
                with _open(r["path"]) as handle:
                    window = _Window(handle, r["lo"], r["size"], min(_HEADS_CHUNK, r["hi"] - r["lo"]))
                    begin = r["lo"] if r["lo"] == r["start"] else framing.first_record(window, r["lo"], r["hi"], r["size"])
                    found.append((begin, *(framing.walk(window, begin, r["hi"], r["size"]) if begin is not None else (0, 0))))
            except OSError:  # left to decode(), which says so
                found.append((None, 0, 0))
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "begin", "after", "count"])


def _number(table: pa.Table) -> pa.Table:
    """Stretches of whole records of one file."""
    rows = sorted(table.to_pylist(), key=lambda r: r["lo"])
    first = rows[0]

    def again(at: int, stop: int) -> tuple[int, int]:
        try:
            with _open(first["path"]) as handle:
                return framing.walk(_Window(handle, at, first["size"], min(_HEADS_CHUNK, stop - at)), at, stop, first["size"])
        except OSError:
            return at, 0

    parts = [(r["hi"], r["begin"], r["after"], r["count"]) for r in rows]
    cuts = list(framing.cut(parts, first["start"], first["size"], first["first_rec"], again))
    same = {c: [first[c]] * len(cuts) for c in ("run_id", "relkey", "prefix", "path")}
    starts, stops, recs = (list(x) for x in zip(*cuts))
    return pa.Table.from_pydict({**same, "start": starts, "stop": stops, "first_rec": recs}, schema=_CUT)


def _tasks(files: DataFrame) -> int:
    """Tasks that share the reading of files.  The rows that name them are small, so that Spark would merge them into one task
    if the number were left to it."""
    return int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stretches(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stretches of whole records for rows (listing columns, ``start``, ``first_rec``).

    A file of more than ``split_bytes`` is cut by as many tasks as it has stretches, each of which reads its own part.
    """
    cols = ["run_id", "relkey", "prefix", "path", "size", "start", "first_rec"]
    rows = files.select(*cols)
    long = F.col("size") - F.col("start") > split_bytes
    whole = rows.filter(~long & (F.col("start") < F.col("size"))).select(
        "run_id", "relkey", "prefix", "path", "start", F.col("size").alias("stop"), "first_rec")
    lo = F.explode(F.sequence(F.col("start"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    parts = rows.filter(long).withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + split_bytes, F.col("size")))
    even = parts.repartition(_tasks(files), F.xxhash64("run_id", "relkey", "lo"))
    seen = even.mapInArrow(_sync, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields) + ", begin bigint, after bigint, count bigint")
    cut = seen.groupBy("run_id", "relkey").applyInArrow(_number, _STRETCH)
    return _spread(whole.unionByName(cut))


def _spread(parts: DataFrame) -> DataFrame:
    return parts.repartition(_tasks(parts), F.xxhash64("run_id", "relkey", "start"))


class _Rows:
    """Decoded rows, turned into Arrow batches: column lists of single ones, and columns of many."""

    def __init__(self):
        self.cols: list[list] = [[] for _ in _DECODED_ARROW]
        self.many: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, *row):
        for c, v in zip(self.cols, row):
            c.append(v)
        self.size += 1

    def add_scalars(self, r: dict, tags: np.ndarray, steps: np.ndarray, walls: np.ndarray, values: np.ndarray, recs: np.ndarray):
        """Values that are the only ones of their records; ``tags`` are rows of bytes."""
        n, width = tags.shape
        same = lambda v: pa.repeat(pa.scalar(v, pa.string()), n)
        before = np.frombuffer((r["prefix"] + "/" if r["prefix"] else "").encode(), np.uint8)
        tags = np.hstack([np.broadcast_to(before, (n, len(before))), tags]) if len(before) else tags
        ends = np.arange(n + 1, dtype=np.int32) * (len(before) + width)
        tag = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(tags.tobytes()))
        self.many.append(pa.RecordBatch.from_arrays(
            [same(r["run_id"]), same("scalar"), tag, pa.array(steps), pa.array(walls), pa.array(values.astype(np.float64)),
             pa.nulls(n, pa.string()), same(r["relkey"]), pa.array(recs), pa.nulls(n, pa.int64())], schema=_DECODED_ARROW))
        self.size += n

    def __len__(self):
        return self.size

    def batch(self) -> pa.RecordBatch:
        single = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.cols, _DECODED_ARROW)], schema=_DECODED_ARROW)
        out = pa.Table.from_batches([*self.many, single]).combine_chunks().to_batches()
        self.cols, self.many, self.size = [[] for _ in _DECODED_ARROW], [], 0
        return out[0] if out else single


def _decode(r: dict, scalars: bool, texts: bool, skip_bad: bool, head: int, gap: int, rows: _Rows) -> Iterator[None]:
    """Add the rows of one stretch; yields whenever a batch may be taken."""
    with _open(r["path"]) as handle:
        window = _Window(handle, r["start"], r["stop"])
        at, rec = r["start"], r["first_rec"]
        since, found = 0, False
        while at + 12 <= r["stop"]:
            buf, off = window.get(at, 12)
            length = _LEN.unpack_from(buf, off)[0]
            nxt = at + 16 + length
            if nxt > r["stop"]:
                break
            buf, off = window.get(at, 16 + length)
            try:
                wall, step, values = parse_event(buf, off + 12, off + 12 + length, scalars, texts)
            except Undecodable:
                rows.add(r["run_id"], "bad", None, None, None, None, None, r["relkey"], rec, nxt)
                values = []
                if not skip_bad:
                    at, rec = nxt, rec + 1
                    break
            got, seen = False, {}
            for tag, value, text in values:
                nth = seen[tag] = seen.get(tag, -1) + 1
                kind = "scalar" if text is None else "text"
                got |= text is not None
                rows.add(r["run_id"], kind, r["prefix"] + "/" + tag if r["prefix"] else tag, step, wall, value, text,
                         r["relkey"], rec * REC_SCALE + nth, None)
            at, rec = nxt, rec + 1
            if got:
                found, since = True, 0
            else:
                since += 1
            if (head and not found and rec - r["first_rec"] >= head) or (gap and found and since >= gap):
                break
            if len(rows) >= _ROWS:
                yield
        rows.add(r["run_id"], "end", None, None, None, None, None, r["relkey"], rec, at)


def _places(buf: bytes, off: int) -> list[int]:
    """Where whole records of a buffer begin, from ``off`` on, and the end of the last one."""
    out, last = [off], len(buf) - 12
    while off <= last:
        off += 16 + _LEN.unpack_from(buf, off)[0]
        if off > len(buf):
            break
        out.append(off)
    return out


def _decode_whole(r: dict, scalars: bool, texts: bool, skip_bad: bool, only_bad: bool, rows: _Rows) -> Iterator[None]:
    """As _decode without ``head`` and ``gap``: events that differ only in their numbers are decoded together."""
    with _open(r["path"]) as handle:
        window = _Window(handle, r["start"], r["stop"], _BLOCK)
        at, rec, going = r["start"], r["first_rec"], True
        while going and at + 12 <= r["stop"]:
            size = min(_BLOCK, r["stop"] - at)
            while True:
                buf, off = window.get(at, size)
                if len(buf) - off < size:
                    raise OSError(f"{r['path']} is shorter than {r['stop']} bytes")
                places = _places(buf, off)
                if len(places) > 1 or (size := 16 + _LEN.unpack_from(buf, off)[0]) > r["stop"] - at:
                    break  # else a record longer than the block
            count = len(places) - 1
            if not count:
                break
            starts = np.array(places, np.int64) + 12
            lengths = np.diff(starts) - 16
            single, alike = np.ones(count, bool), []
            for found in parse_alike(np.frombuffer(buf, np.uint8), starts[:-1], lengths):
                single[found[0]] = False
                if scalars and not only_bad:
                    alike.append(found)
            for k in np.flatnonzero(single).tolist():
                nxt = at + places[k + 1] - off
                try:
                    wall, step, values = parse_event(buf, places[k] + 12, places[k + 1] - 4, scalars, texts)
                except Undecodable:
                    rows.add(r["run_id"], "bad", None, None, None, None, None, r["relkey"], rec + k, nxt)
                    if skip_bad:
                        continue
                    count, going = k + 1, False
                    break
                seen: dict[str, int] = {}
                for tag, value, text in () if only_bad else values:
                    nth = seen[tag] = seen.get(tag, -1) + 1
                    rows.add(r["run_id"], "scalar" if text is None else "text", r["prefix"] + "/" + tag if r["prefix"] else tag, step, wall,
                             value, text, r["relkey"], (rec + k) * REC_SCALE + nth, None)
                if len(rows) >= _ROWS:
                    yield
            for numbers, tags, walls, steps, values in alike:
                some = numbers < count
                rows.add_scalars(r, tags[some], steps[some], walls[some], values[some], (rec + numbers[some]) * REC_SCALE)
            at, rec = at + places[count] - off, rec + count
            if len(rows) >= _ROWS:
                yield
        if not only_bad:
            rows.add(r["run_id"], "end", None, None, None, None, None, r["relkey"], rec, at)


def decode(parts: DataFrame, kinds: str = "all", on_corrupt: str = "stop", head: int = 0, gap: int = 0,
           on_error: str = "raise", only_bad: bool = False) -> DataFrame:
    """Rows of record stretches.

    ``kind`` is ``scalar`` or ``text`` for data, ``bad`` for an undecodable record
    and ``end`` for how far a stretch was read: for these two, ``rec`` is a record
    number and ``offset`` the position after the record.  A file that cannot be read fails the
    query, or with ``on_error="report"`` gives a row of kind ``error`` with the message as text.
    With ``only_bad`` everything is decoded, but only rows of undecodable records and errors are given.
    """
    if kinds not in ("all", "scalar", "text") or on_corrupt not in ("stop", "skip"):
        raise ValueError("kinds is all, scalar or text; on_corrupt is stop or skip")
    scalars, texts, skip_bad = kinds != "text", kinds != "scalar", on_corrupt == "skip"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    some = _decode(r, scalars, texts, skip_bad, head, gap, rows) if head or gap else _decode_whole(
                        r, scalars, texts, skip_bad, only_bad, rows)
                    for _ in some:
                        yield rows.batch()
                    if len(rows) >= _ROWS:
                        yield rows.batch()
                except OSError as ex:
                    if on_error == "raise":
                        raise
                    rows.add(r["run_id"], "error", None, None, None, None, str(ex), r["relkey"], r["first_rec"], r["start"])
        if len(rows):
            yield rows.batch()

    return parts.mapInArrow(run, DECODED)


def drop_after_bad(decoded: DataFrame) -> DataFrame:
    """Without what follows a file's first undecodable record in other stretches."""
    bad = (
        decoded.filter("kind = 'bad'").groupBy("run_id", "src")
        .agg(F.min(F.struct("rec", "offset")).alias("_bad"))
    )
    record = F.when(F.col("kind").isin("bad", "end"), F.col("rec")).otherwise(F.floor(F.col("rec") / REC_SCALE))
    rows = decoded.withColumn("_rec", record).join(bad, ["run_id", "src"], "left")
    data = F.col("kind").isin("scalar", "text")
    keep = F.col("_bad").isNull() | (F.col("kind") == "error") | (data & (F.col("_rec") < F.col("_bad.rec"))) | (F.col("kind") == "bad") & (
        F.col("_rec") == F.col("_bad.rec")) | ((F.col("kind") == "end") & (F.col("_rec") <= F.col("_bad.rec") + 1))
    return rows.filter(keep).drop("_rec", "_bad")


def whole_files(files: DataFrame) -> DataFrame:
    """Listing rows to be read from their beginning."""
    zero = F.lit(0).cast("long")
    return files.withColumns({"start": zero, "first_rec": zero})


def read_events(files: DataFrame, kinds: str = "all", on_corrupt: str = "stop",
                split_bytes: int = SPLIT_BYTES, on_error: str = "raise") -> DataFrame:
    """Scalars and texts of listed files: run_id, kind, tag, step, wall_time, value, text, src, rec.

    With ``on_error="report"`` also a row of kind ``error`` for each stretch that cannot be read.
    """
    parts = stretches(whole_files(files), split_bytes)
    if on_corrupt == "skip":
        rows = decode(parts, kinds, on_corrupt, on_error=on_error)
    else:  # what drop_after_bad() gives, but by stretches: rows need not meet in one place for each file
        seen = decode(parts, kinds, on_corrupt, on_error=on_error, only_bad=True)
        bad = seen.filter("kind = 'bad'").groupBy("run_id", F.col("src").alias("relkey")).agg(F.min("rec").alias("_bad"))
        kept = parts.join(bad, ["run_id", "relkey"], "left").filter("_bad is null or first_rec <= _bad").drop("_bad")
        rows = decode(_spread(kept.select(*parts.columns)), kinds, on_corrupt, on_error=on_error)
        if on_error == "report":
            late = seen.filter("kind = 'error'").join(bad.withColumnRenamed("relkey", "src"), ["run_id", "src"]).filter("rec > _bad")
            rows = rows.unionByName(late.select(*rows.columns))
    return rows.filter("kind in ('scalar', 'text', 'error')").drop("offset")


def read_head_texts(files: DataFrame, head: int = HEAD_RECORDS, gap: int = HEAD_GAP) -> DataFrame:
    """Text near the beginning of each file: a file is left after ``head`` records
    without text, or ``gap`` records after the last text."""
    one = whole_files(files).select(
        "run_id", "relkey", "prefix", "path", "start", F.col("size").alias("stop"), "first_rec"
    ).repartition(_tasks(files), F.xxhash64("run_id", "relkey"))
    return decode(one, "text", "stop", head, gap).filter("kind = 'text'").drop("offset", "value")
