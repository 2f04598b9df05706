"""Event files written from a table by Spark tasks, to have something to ingest."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarlake.session import shared_dir
from scalarlake.sources.files import qualified
from scalarlake.sources.framing import HEAD, checksum, checksums, framed


#: Encoded records go to the writer of their run in pieces of about this size.
_PIECE_BYTES = 4096


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= 0xFFFFFFFFFFFFFFFF
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def encode(tag: str, step: int, wall: float, value: float | None, text: str | None) -> bytes:
    """One framed record; field numbers are those of the public Event message.  Without value and text it is not decodable."""
    if text is None and value is None:
        return framed(b"\x07\x07\x07")
    if text is None:
        body = _varint(2 << 3 | 5) + struct.pack("<f", value)
    else:
        body = _bytes(8, _varint(1 << 3) + _varint(7) + _bytes(8, text.encode()))
    summary = _bytes(1, _bytes(1, tag.encode()) + body)
    event = _varint(1 << 3 | 1) + struct.pack("<d", wall) + _varint(2 << 3) + _varint(step) + _bytes(5, summary)
    return framed(event)


def _plain(pdf: pd.DataFrame) -> np.ndarray:
    """Rows with a value and no text, whose records differ only in a few numbers."""
    if pdf["step"].dtype != np.int64 or pdf["tag"].isna().any():
        return np.zeros(len(pdf), bool)
    with np.errstate(over="ignore"):
        wide = np.isinf(pdf["value"].to_numpy().astype(np.float32)) & ~np.isinf(pdf["value"].to_numpy())
    return (pdf["text"].isna() & ~pdf["empty"]).to_numpy(bool) & ~wide


def encode_all(pdf: pd.DataFrame) -> tuple[bytes, np.ndarray]:
    """What encode() gives for each row (tag, step, wall_time, value, text, empty), one behind the other, and where each record ends.

    Records of one tag whose steps take as many bytes are made together, as rows of a byte matrix.
    """
    plain = _plain(pdf)
    step = pdf["step"].to_numpy().astype(np.int64).view(np.uint64) if plain.any() else np.zeros(len(pdf), np.uint64)
    width = 1 + sum((step >= np.uint64(1) << np.uint64(7 * k)).astype(np.int64) for k in range(1, 10))
    with np.errstate(over="ignore"):
        wall, value = (pdf[c].to_numpy().astype(t) for c, t in (("wall_time", "<f8"), ("value", "<f4")))
    codes, tags = pd.factorize(pdf["tag"])
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for key in np.unique((codes * 16 + width)[plain]):
        at = np.flatnonzero(plain & (codes * 16 + width == key))
        n = int(key) % 16
        tail = _bytes(5, _bytes(1, _bytes(1, tags[int(key) // 16].encode()) + _varint(2 << 3 | 5) + bytes(4)))
        body = 10 + n + len(tail)
        head = struct.pack("<Q", body)
        out = np.empty((len(at), HEAD + body + 4), np.uint8)
        out[:, :HEAD] = np.frombuffer(head + struct.pack("<I", checksum(head)), np.uint8)
        event = out[:, HEAD:HEAD + body]
        event[:, 0], event[:, 9] = 1 << 3 | 1, 2 << 3
        event[:, 1:9] = wall[at].view(np.uint8).reshape(-1, 8)
        for k in range(n):
            event[:, 10 + k] = step[at] >> np.uint64(7 * k) & np.uint64(0x7F) | np.uint64(0x80 if k < n - 1 else 0)
        event[:, 10 + n:] = np.frombuffer(tail, np.uint8)
        event[:, -4:] = value[at].view(np.uint8).reshape(-1, 4)
        out[:, -4:] = checksums(event).astype("<u4").view(np.uint8).reshape(-1, 4)
        made.append((at, out))
    others = np.flatnonzero(~plain)
    single = [encode(r.tag, r.step, r.wall_time, None if r.empty else r.value, r.text) for r in pdf.iloc[others].itertuples(index=False)]
    sizes = np.zeros(len(pdf), np.int64)
    sizes[others] = [len(b) for b in single]
    for at, out in made:
        sizes[at] = out.shape[1]
    ends = np.cumsum(sizes)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for at, out in made:
        np.lib.stride_tricks.sliding_window_view(data, out.shape[1], writeable=True)[ends[at] - out.shape[1]] = out
    for k, b in zip(others, single):
        data[ends[k] - len(b):ends[k]] = np.frombuffer(b, np.uint8)
    return data.tobytes(), ends


def write_event_files(rows: DataFrame, folder: str, part: str, below: str = "") -> None:
    """Write rows (run_id, tag, step, wall_time, value, text, rec) below ``folder``, in a sub-folder ``below`` of each run.

    One file per run, its records in the order of ``rec``.  Tasks encode ranges of (run_id, rec), whatever the size of a run;
    the task that writes a run's file only copies their bytes.  A retried task writes the same file again.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId() << 40
        for pdf in batches:
            out: list[tuple] = []
            data, ends = encode_all(pdf)
            run = pdf["run_id"].to_numpy()
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else []
            for lo, hi in zip(first, [*first[1:], len(run)]):
                begin = int(ends[lo - 1]) if lo else 0
                while lo < hi:  # whole records, at least one
                    lo = min(int(np.searchsorted(ends, begin + _PIECE_BYTES)) + 1, hi)
                    out.append((run[lo - 1], place + len(out), data[begin:int(ends[lo - 1])]))
                    begin = int(ends[lo - 1])
            place += len(out)
            yield pd.DataFrame(out, columns=["run_id", "place", "data"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from scalarlake.sources.files import filesystem as of

        filesystem, base = of(folder)
        run, out = None, None
        n = 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None or r.run_id != run:
                    if out is not None:
                        out.close()
                    run = r.run_id
                    at = f"{base}/{run}/{below}".rstrip("/")
                    filesystem.create_dir(at, recursive=True)
                    out = filesystem.open_output_stream(f"{at}/events.out.tfevents.{part}.0")
                out.write(r.data)
                n += 1
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [n]})

    folder = qualified(rows.sparkSession, folder)
    cols = rows.selectExpr("run_id", "tag", "step", "wall_time", "cast(value as double) value", "text", "rec",
                           "value is null and text is null empty")
    order = ["run_id", "rec"]
    pieces = cols.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(encoded, "run_id string, place long, data binary")
    whole = pieces.repartition("run_id").sortWithinPartitions("run_id", "place")
    whole.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def write_configs(lines: DataFrame, folder: str) -> None:
    """Write rows (run_id, line_no, line) as ``config.yaml`` of each run."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from scalarlake.sources.files import filesystem as of

        filesystem, base = of(folder)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                filesystem.create_dir(f"{base}/{r.run_id}", recursive=True)
                with filesystem.open_output_stream(f"{base}/{r.run_id}/config.yaml") as out:
                    out.write("\n".join(r.lines).encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    folder = qualified(lines.sparkSession, folder)
    texts = lines.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    texts.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
