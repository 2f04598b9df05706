"""WARC archives whose records share a Zstandard dictionary (operator 4)."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import binary, keep, shared_folder

#: Format constants of dictionary-compressed archives: a leading skippable frame of this magic holds the dictionary.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: The dictionary is built from at most so many records, each cut to so many bytes: for training only.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16_384, 65_536
#: An archive is closed when it has reached this size.
ARCHIVE_BYTES = 1 << 28
#: Payloads below this size are never replaced by a reference.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the payloads with the smallest hashes; empty if there is nothing to learn from."""
    chosen = pages.where("length(html) > 0").select("html", F.xxhash64("page_id", "html").alias("h")).orderBy("h").limit(sample)
    rows = chosen.select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).collect()
    samples = [record_bytes("", r.html.encode(), None, "") for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: the start of what there is serves as it is
        return b"".join(samples)[:size]


def record_bytes(url: str | None, payload: bytes, revisits: str | None, record_id: str) -> bytes:
    """One WARC record with an HTTP response; a revisit has the response's head alone."""
    digest = hashlib.sha256(payload).hexdigest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisits is not None else head + payload
    fields = [
        ("WARC-Type", "response" if revisits is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(body))),
    ]
    if revisits is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{revisits}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"WARC/1.1\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = body[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["http-length"] = next(x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def urn_page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as the executors reach it; schemes of Hadoop are mapped."""
    uri = uri.replace("s3a://", "s3://", 1)
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


class Archive:
    """Writes one archive file: the dictionary's frame, then a frame for each record."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes) -> None:
        self.out, self.size = fs.open_output_stream(path), 0
        self.pack = compressor(dictionary)
        if dictionary:
            self.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self.write(self.pack.compress(record))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive, one frame after another, from a readable stream."""
    held, dictionary = b"", b""
    unpack = None
    ended = False
    while True:
        if not ended and len(held) < 8:
            more = source.read(1 << 20)
            ended = not more
            held += more
        if not held:
            return
        magic, size = struct.unpack("<II", held[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            while len(held) < 8 + size:
                more = source.read(1 << 20)
                if not more:
                    raise ValueError("archive is cut off")
                held += more
            if magic == SKIPPABLE:
                dictionary = held[8:8 + size]
            held = held[8 + size:]
            continue
        if unpack is None:
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        frame, parts = unpack.decompressobj(), []
        parts.append(frame.decompress(held))
        while not frame.eof:
            held = source.read(1 << 20)
            if not held:
                raise ValueError("archive is cut off")
            parts.append(frame.decompress(held))
        held = frame.unused_data
        yield b"".join(parts)


def _writer(folder: str, dictionary, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        archive, names, counts = None, [], []
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), batch.column(3).to_pylist())
            for page_id, url, payload, refers in rows:
                if archive is None:
                    names.append(f"{name}-{len(names):04d}.warc.zst")
                    counts.append(0)
                    archive = Archive(fs, f"{root}/{names[-1]}", dictionary.value)
                archive.add(record_bytes(url, payload or b"", None if refers is None else page_urn(refers), page_urn(page_id)))
                counts[-1] += 1
                if archive.size >= most:
                    archive.out.close()
                    archive = None
        if archive is not None:
            archive.out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64())],
                                         names=["archive", "records"])

    return run


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id with an equal payload of at least `least` bytes,
    null where that is the row's own, and for smaller payloads.

    Digests are counted first, so the join only meets those that repeat; its skew is Spark's to split.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digest = F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256)))
    groups = rows.select(digest.alias("d"), "page_id").where("d is not null").groupBy("d").agg(
        F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("d", "least")
    # Rows without a digest get a random key, so that they are spread over all tasks; it meets no digest.
    out = rows.withColumn("digest", F.coalesce(digest, F.unhex(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))))) \
        .join(groups, F.col("digest") == F.col("d"), "left")
    other = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return out.select("page_id", "url", "html", F.when(other, F.col("least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None, least: int = REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of pages to archives in folder; returns (archive, records) of the files that count.

    A task that is tried again writes files of another name; the list names those of the attempt that succeeded.
    """
    spark = pages.sparkSession
    if dictionary is None:
        dictionary = train_dictionary(pages)
    write = _writer(folder, spark.sparkContext.broadcast(dictionary), archive_bytes)
    return keep(revisits(pages, least).mapInArrow(write, "archive string, records long"), "archives")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            fs, path = file_system(archive)
            rows, size = [], 0
            with fs.open_input_stream(path) as source:
                for data in read_archive(source):
                    headers, payload = parse_record(data)
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record in {archive}")
                    refers = urn_page(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((urn_page(headers["warc-record-id"]), headers["warc-target-uri"], kind, refers,
                                 int(headers["http-length"]), digest, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 1 << 23 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives listed: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    n = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(max(1, n), "archive").mapInArrow(
        _reader, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the whole html in UTF-8, a null one is empty.  A null page_id is archived as such and may revisit another
    page; if all ids of equal payloads are null, each is a response.  Rows that repeat the smallest id are responses each.
    No pages, no archives.  Extra columns are not archived.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
