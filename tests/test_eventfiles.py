"""Listing and decoding synthetic event files."""

import math
import os
import random
import struct

import eventwriter as w
import pytest

from scalarlake.sources import eventfiles as ef
from scalarlake.sources import files, framing


def rows(df):
    cols = ("run_id", "kind", "tag", "step", "value", "text")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_listing(spark, tmp_path):
    root = str(tmp_path / "runs")
    w.write(f"{root}/run_a/events.out.tfevents.1")
    w.write(f"{root}/run_a/metrics/20260618_101116_148035/auto/events.out.tfevents.m")
    w.write(f"{root}/run_a/metrics/20260626_113351_772697/auto/events.out.tfevents.m")
    w.write(f"{root}/run_a/1700000000/events.out.tfevents.x")
    w.write(f"{root}/001/events.out.tfevents.1")
    os.makedirs(f"{root}/not_a_run")
    open(f"{root}/not_a_run/readme.txt", "w").close()
    os.symlink(f"{root}/run_a", f"{root}/run_a/metrics/loop")
    os.symlink(f"{root}/001", f"{root}/linked")
    got = {(r.run_id, r.relkey, r.prefix) for r in ef.list_event_files(spark, root).collect()}
    assert got == {
        ("run_a", "events.out.tfevents.1", ""),
        ("run_a", "metrics/20260618_101116_148035/auto/events.out.tfevents.m", "metrics/auto"),
        ("run_a", "metrics/20260626_113351_772697/auto/events.out.tfevents.m", "metrics/auto"),
        ("run_a", "1700000000/events.out.tfevents.x", ""),
        ("001", "events.out.tfevents.1", ""),
        ("linked", "events.out.tfevents.1", ""),
    }
    assert {r.run_id for r in ef.list_event_files(spark, root, ["001"]).collect()} == {"001"}


def test_flat_layout(spark, tmp_path):
    root = str(tmp_path / "single")
    w.write(f"{root}/events.out.tfevents.1", w.event(1, 1.0, w.simple("a", 2.0)))
    os.makedirs(f"{root}/empty")
    assert [(r.run_id, r.relkey) for r in ef.list_event_files(spark, root).collect()] == [("single", "events.out.tfevents.1")]
    w.write(f"{root}/sub/events.out.tfevents.1")
    assert [r.run_id for r in ef.list_event_files(spark, root).collect()] == ["sub"]
    assert ef.list_event_files(spark, str(tmp_path / "none")).count() == 0


def test_values(spark, tmp_path):
    root = str(tmp_path / "runs")
    packed = lambda field, n: w._len(field, w._varint(n))
    w.write(
        f"{root}/r/events.out.tfevents.1",
        w.event(0, 1.0),
        w.event(1, 1.0, w.simple("simple", 0.5), w.simple("other", 1.5)),
        w.event(2, 2.0, w.floats("f", [1.25], ())),
        w.event(3, 2.0, w.floats("f2", [1.25], (1, 1))),
        w.event(4, 2.0, w.tensor("d", 2, content=struct.pack("<d", 1e300))),
        w.event(5, 2.0, w.tensor("half", 19, typed=packed(13, 0x3C00))),
        w.event(6, 2.0, w.tensor("bf16", 14, typed=packed(13, 0x3FC0))),
        w.event(7, 2.0, w.tensor("i32", 3, typed=packed(7, -3))),
        w.event(8, 2.0, w.tensor("i64", 9, content=struct.pack("<q", -9))),
        w.event(9, 2.0, w.tensor("u64", 23, typed=packed(17, 2**63))),
        w.event(10, 2.0, w.floats("two", [1.0, 2.0], (2,))),
        w.event(11, 2.0, w.tensor("bool", 10, typed=packed(11, 1))),
        w.event(12, 2.0, w._len(1, w._len(1, b"histo") + w._len(5, b""))),
        w.event(13, 2.0, w.strings("cfg", ["a: 1", b"b\xff"])),
        w.event(14, 2.0, w.strings("none", [], (0,))),
        w.event(-5, 2.0, w.simple("neg", math.nan)),
    )
    got = {r.tag: r for r in ef.read_events(ef.list_event_files(spark, root)).collect()}
    assert set(got) == {"simple", "other", "f", "f2", "d", "half", "bf16", "i32", "i64", "u64", "cfg", "neg"}
    want = {"simple": 0.5, "other": 1.5, "f": 1.25, "f2": 1.25, "d": 1e300, "half": 1.0, "bf16": 1.5, "i32": -3.0,
            "i64": -9.0, "u64": float(2**63)}
    assert {t: got[t].value for t in want} == want
    assert got["cfg"].text == "a: 1\nb�" and got["cfg"].kind == "text"
    assert got["neg"].step == -5 and math.isnan(got["neg"].value)
    assert got["simple"].rec == ef.REC_SCALE and got["simple"].src == "events.out.tfevents.1"


def test_truncated_empty_and_bad(spark, tmp_path):
    root = str(tmp_path / "runs")
    ev = [w.event(i, 1.0, w.simple("t", float(i))) for i in range(5)]
    w.write(f"{root}/a/events.out.tfevents.1", *ev[:3], raw=w.record(ev[3])[:-2])
    w.write(f"{root}/b/events.out.tfevents.1")
    w.write(f"{root}/c/events.out.tfevents.1", ev[0], b"\x07\x07\x07", ev[1])
    files = ef.list_event_files(spark, root)
    stop = rows(ef.read_events(files))
    assert [(r[0], r[3]) for r in stop] == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    skip = rows(ef.read_events(files, on_corrupt="skip"))
    assert [(r[0], r[3]) for r in skip] == [("a", 0), ("a", 1), ("a", 2), ("c", 0), ("c", 1)]
    with pytest.raises(ValueError):
        ef.read_events(files, on_corrupt="maybe")


def test_small_stretches_equal_one(spark, tmp_path):
    """Cutting a file differently never changes the rows, also around a bad record."""
    root = str(tmp_path / "runs")
    ev = [w.event(i, float(i), w.simple("t", i / 7), w.simple("u", i)) for i in range(300)]
    ev[40] = w.event(40, 1.0, w.strings("cfg", ["x" * 5000]))
    w.write(f"{root}/a/events.out.tfevents.1", *ev)
    ev[200] = b"\xff\xff"
    w.write(f"{root}/b/events.out.tfevents.1", *ev, raw=b"\x01\x02")
    files = ef.list_event_files(spark, root)
    whole = sorted(ef.read_events(files).collect(), key=repr)
    assert len(whole) == 599 + 399
    for size in (1, 100, 3000):
        assert sorted(ef.read_events(files, split_bytes=size).collect(), key=repr) == whole


def test_checksums():
    assert framing.checksum(b"123456789") == framing.masked(0xE3069283)  # the published check value of CRC-32C
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(50))
    block = b"??" + framing.framed(data) + framing.framed(b"") + b"rest of it"
    assert framing.heads(block).tolist() == [2, 2 + 66]
    assert framing.heads(b"short").tolist() == []


class Bytes:
    """A window over bytes that remembers what was read."""

    def __init__(self, data):
        self.data, self.read = data, []

    def get(self, at, size):
        assert at + size <= len(self.data)
        self.read.append((at, at + size))
        return self.data, at


@pytest.mark.parametrize("checked", [True, False])
def test_cut_brute_force(checked):
    """Stretches of any size, around records of any size, inner records, cut tails: as if walked from the start."""
    rng = random.Random(2)
    for _ in range(300):
        inner = w.record(b"x" * rng.randrange(30), checked=True)
        bodies = [rng.choice([b"", bytes(rng.randrange(256) for _ in range(rng.choice([1, 9, 40, 200]))), inner * 3])
                  for _ in range(rng.randrange(12))]
        records = [w.record(b, checked) for b in bodies]
        skipped = rng.randrange(len(records) + 1)
        tail = rng.choice([b"", b"\0" * 5, w.record(b"y" * 50, checked)[:-1], w.record(b"y" * 50, checked)[:13]])
        data = b"".join(records) + tail
        start = sum(map(len, records[:skipped]))
        places, at = [], start
        for r in records[skipped:]:
            places.append(at)
            at += len(r)
        for split in (1, 7, 64, 300):
            parts = []
            for lo in range(start, len(data), split):
                hi = min(lo + split, len(data))
                begin = lo if lo == start else framing.first_record(Bytes(data), lo, hi, len(data))
                parts.append((hi, begin, *(framing.walk(Bytes(data), begin, hi, len(data)) if begin is not None else (0, 0))))
            got = list(framing.cut(parts, start, len(data), skipped, lambda a, b: framing.walk(Bytes(data), a, b, len(data)))) if parts else []
            if not parts:
                continue
            assert got[0][0] == start and got[-1][1] == len(data)
            assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
            for a, _, rec in got:
                assert rec == skipped + (places.index(a) if a in places else len(places))


def test_stretch_reads_its_own_part():
    """With checksums, no stretch is walked again and none reads much beyond its end."""
    data = b"".join(w.record(bytes([i % 256]) * 90, checked=True) for i in range(2000))
    parts, split = [], 10_000
    for lo in range(0, len(data), split):
        window, hi = Bytes(data), min(lo + split, len(data))
        begin = framing.first_record(window, lo, hi, len(data)) if lo else 0
        parts.append((hi, begin, *framing.walk(window, begin, hi, len(data))))
        assert min(a for a, _ in window.read) >= lo and max(b for _, b in window.read) <= hi + 300
    got = list(framing.cut(parts, 0, len(data), 0, None))  # nothing to walk again
    assert len(got) == len(parts) and [r for _, _, r in got] == [a // 106 for a, _, _ in got]


def test_one_file_of_many_stretches(spark, tmp_path):
    root = str(tmp_path / "runs")
    ev = [w.event(i, float(i), w.simple("t", i / 7)) for i in range(3000)]
    for name, checked in (("a", True), ("b", False)):
        w.write(f"{root}/{name}/events.out.tfevents.1", *ev, checked=checked, raw=w.record(ev[0])[:20])
    listed = ef.list_event_files(spark, root)
    parts = ef.stretches(ef.whole_files(listed), 5000).orderBy("run_id", "start").collect()
    per_run = {run: [p for p in parts if p.run_id == run] for run in "ab"}
    assert [(p.start, p.stop, p.first_rec) for p in per_run["a"]] == [(p.start, p.stop, p.first_rec) for p in per_run["b"]]
    assert len(per_run["a"]) > 20 and per_run["a"][0].start == 0
    rows = ef.read_events(listed, split_bytes=5000).orderBy("run_id", "rec").collect()
    assert [(r.run_id, r.step, r.rec // ef.REC_SCALE) for r in rows] == [(run, i, i) for run in "ab" for i in range(3000)]


def test_paths(spark, tmp_path):
    assert files.prefix("s3a://bucket/a/b/") == "s3a://" and files.prefix("hdfs://host:9000/a") == "hdfs://host:9000"
    assert files.prefix("/a/b") == "" and files.prefix("file:///a") == ""
    assert files.filesystem("file:///a/b")[1] == files.filesystem("file:/a/b")[1] == files.filesystem("/a/b/")[1] == "/a/b"
    assert files.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    assert files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://store/")
        conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
        assert files.qualified(spark, "/in/runs") == "viewfs://store/in/runs"
    finally:
        conf.set("fs.defaultFS", before)


def test_head_scan(spark, tmp_path):
    root = str(tmp_path / "runs")
    scalar = [w.event(i, 1.0, w.simple("t", 1.0)) for i in range(600)]
    late = w.event(0, 1.0, w.strings("late", ["x"]))
    early = w.event(0, 1.0, w.strings("early", ["y"]))
    w.write(f"{root}/a/events.out.tfevents.1", *scalar, late)
    w.write(f"{root}/b/events.out.tfevents.1", early, *scalar[:400], early, *scalar, late)
    files = ef.list_event_files(spark, root)
    head = sorted((r.run_id, r.tag) for r in ef.read_head_texts(files).collect())
    assert head == [("b", "early"), ("b", "early")]
    full = sorted((r.run_id, r.tag) for r in ef.read_events(files, "text").collect())
    assert full == [("a", "late"), ("b", "early"), ("b", "early"), ("b", "late")]


def test_files_are_read_by_many_tasks(spark, tmp_path):
    """The rows that name files are small; the files need not be."""
    root = str(tmp_path / "runs")
    for k in range(12):
        w.write(f"{root}/run_{k}/events.out.tfevents.1", *(w.event(s, 1.0, w.simple("loss", s)) for s in range(5)))
    parts = ef.stretches(ef.whole_files(ef.list_event_files(spark, root)), 100)
    assert parts.selectExpr("spark_partition_id() p").distinct().count() > 1


def test_many_folders_share_tasks():
    folders = [ef.RunFolder(f"r{k}", f"/runs/r{k}", False) for k in range(1000)]
    dealt = ef._dealt(folders)
    assert len(dealt) == ef.LIST_TASKS and sorted(f.run_id for p in dealt for f in p.folders) == sorted(f.run_id for f in folders)


def test_short_stretches_read_little(tmp_path, monkeypatch):
    """Looking for the records of a stretch reads about the stretch, not a megabyte behind it."""
    import pyarrow as pa

    path = str(tmp_path / "events.out.tfevents.1")
    w.write(path, *(w.event(s, 1.0, w.simple("loss", s)) for s in range(5000)))
    size, seen = os.path.getsize(path), []
    real = ef._Window.get

    def get(self, at, n):
        buf, off = real(self, at, n)
        seen.append(len(buf))
        return buf, off

    monkeypatch.setattr(ef._Window, "get", get)
    row = {"path": path, "lo": 0, "hi": 1000, "start": 0, "size": size, "first_rec": 0}
    batch = pa.RecordBatch.from_pylist([row])
    assert next(ef._sync(iter([batch]))).column("count").to_pylist()[0] > 5
    assert max(seen) <= 1000


def test_one_file_for_each_run_in_order(spark, tmp_path):
    from workload.eventlog import write_event_files

    table = spark.createDataFrame(
        [(f"run_{k % 3}", "t", k, 1.0, float(k), None, 300 - k) for k in range(300)],
        "run_id string, tag string, step long, wall_time double, value double, text string, rec long").repartition(5)
    root = str(tmp_path / "runs")
    write_event_files(table, root, "a")
    assert sorted(os.listdir(root)) == ["run_0", "run_1", "run_2"]
    assert all(os.listdir(f"{root}/{run}") == ["events.out.tfevents.a.0"] for run in os.listdir(root))
    got = ef.read_events(ef.list_event_files(spark, root)).orderBy("run_id", "rec").collect()
    assert [(r.run_id, r.step) for r in got] == [(f"run_{n}", k) for n in range(3) for k in range(299, -1, -1) if k % 3 == n]


def test_records_encoded_together():
    """Many records at once give the bytes of one after the other, at the limits of every number too."""
    import pandas as pd

    from workload.eventlog import encode, encode_all

    steps = [0, 1, 127, 128, 16383, 16384, 2**35, 2**62, -1, -(2**63)] + list(range(100, 300))
    rows = [(("a", "metrics/längere")[k % 2], s, k / 3, float("nan") if k % 7 == 0 else k * 1.5, "note" * k if k % 11 == 0 else None, k % 13 == 5)
            for k, s in enumerate(steps)]
    pdf = pd.DataFrame(rows, columns=["tag", "step", "wall_time", "value", "text", "empty"])
    pdf.loc[pdf["text"].notna(), "empty"] = False
    single = [encode(r.tag, r.step, r.wall_time, None if r.empty else r.value, r.text) for r in pdf.itertuples(index=False)]
    data, ends = encode_all(pdf)
    assert data == b"".join(single)
    assert ends.tolist() == [sum(map(len, single[:k + 1])) for k in range(len(single))]
    assert encode_all(pdf[:0])[0] == b""


def test_records_are_encoded_by_columns(monkeypatch):
    """Plain records cost no call each."""
    import pandas as pd

    from workload import eventlog

    calls = []
    monkeypatch.setattr(eventlog, "encode", lambda *a: calls.append(a))
    data, ends = eventlog.encode_all(pd.DataFrame({"tag": "t", "step": range(5000), "wall_time": 1.0, "value": 2.0, "text": None, "empty": False}))
    assert not calls and len(ends) == 5000 and ends[-1] == len(data)


def _decoded(path, **options):
    """Rows of a file, decoded together or, with ``head`` set out of reach, one by one."""
    out = ef._Rows()
    row = {"run_id": "r", "relkey": "k", "prefix": options.pop("prefix", ""), "path": path, "start": 0, "stop": os.path.getsize(path), "first_rec": 7}
    together = options.pop("together")
    args = (row, options.get("scalars", True), options.get("texts", True), options.get("skip_bad", False))
    found = []
    for _ in ef._decode_whole(*args, options.get("only_bad", False), out) if together else ef._decode(*args, 0, 0, out):
        found += out.batch().to_pylist()
    found += out.batch().to_pylist()
    return sorted(found, key=lambda r: (r["rec"] if r["kind"] in ("bad", "end") else r["rec"] / ef.REC_SCALE, str(r["tag"]), r["kind"], r["rec"]))


@pytest.mark.parametrize("block", [64, 1000, ef._BLOCK])
def test_records_decoded_together(tmp_path, monkeypatch, block):
    """Many records at once give the rows of one after the other, whatever the records are."""
    monkeypatch.setattr(ef, "_BLOCK", block)
    rnd = random.Random(3)
    step = lambda: rnd.choice([0, 5, 127, 128, 70000, -1, 2**40])
    kinds = [lambda: w.event(step(), rnd.random(), w.simple("a", rnd.random())), lambda: w.event(step(), rnd.random(), w.simple(rnd.choice(["bb", "cc", "é"]), 1.5)),
             lambda: w.event(1, 1.0, w._len(1, w._len(1, rnd.choice([b"dd", b"\xff\xff"] if bad else [b"dd", b"ee"])) + b"\x15" + bytes(4))),
             lambda: w.event(step(), 1.0, w.simple("a", 1.0), w.simple("a", 2.0)), lambda: w.event(step(), 1.0, w.strings("s", ["text" * 40])),
             lambda: w.event(step(), 1.0), lambda: w.event(1, 2.0, w.floats("f", [1.25], ())), lambda: w._len(5, w.simple("a", 3.0)),
             lambda: w._len(5, w.simple("a", 3.0)) + w._len(9, b"\x07" * 3), lambda: b""]
    for case in range(6):
        bad = case > 3
        events = [rnd.choices(kinds, [40, 40, 20, 2, 2, 2, 2, 10, 5, 1])[0]() for _ in range(600)]
        if 1 < case < 4:
            events[400] = b"\x07\x07\x07"
        path = str(tmp_path / f"events.out.tfevents.{case}")
        w.write(path, *events, raw=b"\x40\0\0\0" if case % 2 else b"")
        for options in ({}, {"skip_bad": True}, {"scalars": False}, {"texts": False, "prefix": "p"}):
            want = _decoded(path, together=False, **options)
            assert _decoded(path, together=True, **options) == want
            only = _decoded(path, together=True, only_bad=True, **options)
            assert only == [r for r in want if r["kind"] == "bad"] and (len(only) > 0) == (case > 1)


def test_alike_records_are_parsed_once(tmp_path, monkeypatch):
    path = str(tmp_path / "events.out.tfevents.1")
    w.write(path, *(w.event(s, 1.0, w.simple("loss", s)) for s in range(5000)))
    monkeypatch.setattr(ef, "parse_event", None)
    assert [r["value"] for r in _decoded(path, together=True)][:-1] == [float(s) for s in range(5000)]


def test_rows_of_a_file_stay_where_they_are_decoded(spark, tmp_path):
    """What follows an undecodable record is left out by stretches, without a shuffle of rows by file."""
    root = str(tmp_path / "runs")
    good = [w.event(s, 1.0, w.simple("loss", s)) for s in range(100)]
    w.write(f"{root}/a/events.out.tfevents.1", *good)
    w.write(f"{root}/b/events.out.tfevents.1", *good[:40], b"\x07\x07\x07", *good[40:], b"\x07\x07\x07", *good)
    files = ef.list_event_files(spark, root)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")
        read = ef.read_events(files, split_bytes=200)
        assert sorted((r.run_id, r.step) for r in read.collect()) == [("a", s) for s in range(100)] + [("b", s) for s in range(40)]
        assert read.filter("run_id = 'a'").selectExpr("spark_partition_id() p").distinct().count() > 1
    finally:
        for name in names:
            spark.conf.unset(name)
    assert ef.read_events(files, on_corrupt="skip", split_bytes=200).count() == 300
