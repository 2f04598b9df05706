"""Incremental ingest, store reads and maintenance, on synthetic event files."""

import os
import time

import eventwriter as w
import pytest

from scalarlake.sources import eventfiles as ef
from scalarlake.sources.store import Store, import_nested_texts, nested_texts, write_segment
from scalarlake.streaming.ingest import Ingest, PassLog, status


def ev(step, value, wall=None, tag="loss"):
    return w.event(step, float(step if wall is None else wall), w.simple(tag, value))


def write_runs(root):
    w.write(f"{root}/run_a/events.out.tfevents.1", ev(0, 1.0), ev(1, 0.5), w.event(0, 1.0, w.strings("config", ["A"])))
    w.write(f"{root}/run_a/eval/20260618_101116_148035/events.out.tfevents.m", ev(5, 9.0, tag="acc"))
    w.write(f"{root}/001/events.out.tfevents.1", ev(0, 3.0))
    with open(f"{root}/run_a/config.yaml", "w") as f:
        f.write("seed: '7'\nrun_name: \"first try\"\n# seed: 1\nmodel:\n  seed: 2\nother: x\nseed: 8\n")


@pytest.fixture
def ingest(spark, tmp_path):
    root = str(tmp_path / "runs")
    write_runs(root)
    return Ingest(Store(spark, str(tmp_path / "store")), root)


def points(store):
    p = store.get_series(None, None, 0).points
    return sorted((r.run_id, r.tag, r.step, r.value) for r in p.collect())


BASE = [("001", "loss", 0, 3.0), ("run_a", "eval/acc", 5, 9.0), ("run_a", "loss", 0, 1.0), ("run_a", "loss", 1, 0.5)]


def test_two_passes(ingest):
    store, root = ingest.store, ingest.runs_dir
    ingest.scan_once()
    assert points(store) == BASE
    ingest.scan_once()  # nothing new
    assert store.table("scalars").count() == 4 and store.table("files").count() == 3

    # a record that was cut off, then completed; a repeated step; a new run
    late = w.record(ev(2, 0.25))
    cut = os.path.getsize(f"{root}/run_a/events.out.tfevents.1")
    w.write(f"{root}/run_a/events.out.tfevents.1", append=True, raw=late[:10])
    w.write(f"{root}/run_b/events.out.tfevents.1", ev(0, 7.0))
    ingest.scan_once()
    assert points(store) == sorted([*BASE, ("run_b", "loss", 0, 7.0)])
    w.write(f"{root}/run_a/events.out.tfevents.1", ev(1, 0.75, wall=9.0), append=True, raw=b"")
    with open(f"{root}/run_a/events.out.tfevents.1", "r+b") as f:  # put the cut record back together
        data = f.read()
        f.seek(0)
        f.write(data[:cut] + late + data[cut + 10:])
    ingest.scan_once()
    want = sorted([p for p in BASE if p[2:] != (1, 0.5)] + [("run_b", "loss", 0, 7.0), ("run_a", "loss", 1, 0.75), ("run_a", "loss", 2, 0.25)])
    assert points(store) == want
    runs = {r.run_id: r for r in store.list_runs().collect()}
    assert set(runs) == {"001", "run_a", "run_b"}
    a = runs["run_a"]
    assert (a.display_name, a.num_tags, a.num_event_files, a.step_min, a.step_max, a.num_text_tags) == ("first try", 2, 2, 0, 5, 1)
    assert a.config == {"seed": "8", "run_name": "first try"} and runs["001"].config == {}
    assert [r.tag for r in store.tag_names(["run_a"]).collect()] == ["eval/acc", "loss"]
    stats = {(r.run_id, r.tag): (r["count"], r.last_value) for r in store.tag_stats(exact=True).collect()}
    assert stats[("run_a", "loss")] == (3, 0.25)
    assert {r.run_id for r in store.run_ids().collect()} == {"001", "run_a", "run_b"}
    e = store.step_extent(["run_a", "nope"]).first()
    assert (e.step_min, e.step_max) == (0, 5)

    # maintenance keeps what is read
    store.compact()
    assert points(store) == want and store._single_segment()
    w.write(f"{root}/run_b/events.out.tfevents.1", ev(1, 8.0), append=True)
    ingest.scan_once()
    want = sorted([*want, ("run_b", "loss", 1, 8.0)])
    assert points(store) == want
    store.clone_run("run_b", 3, "copy_", 1)
    copies = [(f"copy_00{i}", "loss", s, v) for i in range(3) for s, v in ((0, 7.0), (1, 8.0))]
    assert points(store) == sorted([*want, *copies])
    assert {r.display_name for r in store.names().filter("run_id like 'copy%'").collect()} == {f"run_b #00{i}" for i in range(3)}


def batches(query):
    return [(p.batchId, p.numInputRows) for p in query.recentProgress if p.numInputRows]


def committed(store):
    return sorted(int(n) for n in os.listdir(f"{store.root}/checkpoint/commits") if n.isdigit())


def test_polls_without_change_start_no_batch(ingest):
    """The offset is what the runs look like: no change, no batch; a change plans the changed run only."""
    first = ingest.start(once=True)
    first.awaitTermination()
    assert batches(first) == [(0, 3)] and committed(ingest.store) == [0]
    again = ingest.start(once=True)
    again.awaitTermination()
    assert batches(again) == [] and committed(ingest.store) == [0]
    w.write(f"{ingest.runs_dir}/001/events.out.tfevents.1", ev(1, 4.0), append=True)
    w.write(f"{ingest.runs_dir}/run_z/events.out.tfevents.1", ev(1, 5.0))
    third = ingest.start(once=True)
    third.awaitTermination()
    assert batches(third) == [(1, 2)] and committed(ingest.store) == [0, 1]  # the files of 001 and run_z
    assert points(ingest.store) == sorted([*BASE, ("001", "loss", 1, 4.0), ("run_z", "loss", 1, 5.0)])


def test_signatures(ingest):
    got = ef.signatures(ingest.runs_dir)
    assert {run: (sig[0], sig[2] > 0, sig[1] > 0) for run, sig in got.items()} == {"001": (1, True, True), "run_a": (2, True, True)}
    poller = ef._Poller({"path": ingest.runs_dir})
    start, now = poller.initialOffset(), poller.latestOffset()
    assert poller.latestOffset() == now
    assert {f.run_id for f in poller.partitions(start, now)} == {"001", "run_a"} and poller.partitions(now, now) == []
    old = {"poll": 1}  # an offset of an earlier version: everything is listed
    assert len(poller.partitions(old, old)) == 2 and len(poller.partitions(old, now)) == 2


def test_replay_rewrites_its_segment(ingest, spark):
    listing = ef.list_event_files(spark, ingest.runs_dir)
    assert ingest.write(listing, 0)
    before = points(ingest.store)
    assert ingest.write(listing, 0)  # the batch again, after a failure
    assert points(ingest.store) == before and ingest.store.table("texts").count() == 1
    assert not ingest.write(listing, 2)
    report = {r.run_id: (r.files, r.new_rows) for r in ingest.report(0).collect()}
    assert report == {"run_a": (2, 3), "001": (1, 1)}


def listed(store):
    cols = ("run_id", "num_tags", "num_rows", "step_min", "step_max", "num_event_files", "updated_at")
    counted = sorted(tuple(r[c] for c in cols) for r in store.counted_runs().collect())
    assert sorted(tuple(r[c] for c in cols) for r in store.list_runs().collect()) == counted
    return counted


def test_run_rows_add_up(ingest, spark):
    """Listing sums what passes left and equals a count of everything, also after maintenance and odd passes."""
    store, root = ingest.store, ingest.runs_dir
    ingest.write(ef.list_event_files(spark, root), 0)
    first = listed(store)
    w.write(f"{root}/run_a/events.out.tfevents.1", ev(7, 1.0), ev(7, 1.0, tag="new"), b"\x07\x07", ev(9, 1.0), append=True)
    w.write(f"{root}/run_c/events.out.tfevents.1", w.event(0, 1.0, w.strings("note", ["only text"])))
    ingest.write(ef.list_event_files(spark, root), 2)
    assert ingest.last_pass == {"seg": 2, "runs": 2, "files": 2, "new_files": 1, "bytes": ingest.last_pass["bytes"], "records": 4,
                                "bad_records": 1, "new_rows": 2, "new_tags": 1, "new_texts": 1}
    got = {r.seg: (r.runs, r.files, r.records, r.bad_records, r.new_rows, r.new_tags, r.new_texts) for r in store.passes().collect()}
    assert got == {0: (2, 3, 5, 0, 4, 3, 1), 2: (2, 2, 4, 1, 2, 1, 1)}
    assert len(listed(store)) == 3 and len(first) == 2
    plan = store.list_runs()._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "/scalars" not in plan and "/texts" not in plan and "/tag_stats" not in plan
    # a replay, which writes the same row again; two passes of one number; a segment without a row
    ingest.write(ef.list_event_files(spark, root), 2)
    listed(store)
    part = store.table("passes").filter("seg = 2 and run_id = 'run_a'").drop("seg")
    part.write.parquet(store.path("passes", 5))
    assert [r.num_tags for r in store.list_runs().filter("run_id = 'run_a'").collect()] == [3]
    store.compact()
    ingest.write(ef.list_event_files(spark, root), 8)
    assert len(listed(store)) == 3
    store.clone_run("run_a", 2, "copy_", 1)
    assert [r[:3] for r in listed(store) if r[0].startswith("copy")] == [("copy_000", 3, 5), ("copy_001", 3, 5)]


def test_bodies_are_stored_once(spark, tmp_path):
    """A text that is logged at every step, by every run and in every pass has one body; entries carry its digest."""
    root = str(tmp_path / "runs")
    note = lambda step, text: w.event(step, float(step), w.strings("config", [text]))
    for run in "ab":
        w.write(f"{root}/{run}/events.out.tfevents.1", *[note(s, "same") for s in range(5)], note(5, run))
    job = Ingest(Store(spark, str(tmp_path / "s")), root)
    store = job.store
    job.write(ef.list_event_files(spark, root), 0)
    for run in "ab":
        w.write(f"{root}/{run}/events.out.tfevents.1", note(6, "same"), note(7, "late"), append=True)
    job.write(ef.list_event_files(spark, root), 2)
    entries = lambda: sorted((r.run_id, r.i, r.step, r.text) for r in store.texts().collect())
    want = [(run, i, s, t) for run in "ab" for i, (s, t) in enumerate([(0, "same"), (5, run), (6, "same"), (7, "late")])]
    held = lambda: sorted(r.text for r in store.table("bodies").collect())
    assert entries() == want and held() == ["a", "b", "late", "same"] and store.table("texts").count() == 16
    assert store.get_text("b", "config", 1) == "b" and store.get_text("b", "config", 9) is None
    assert "text:string" not in store.text_index()._jdf.queryExecution().executedPlan().toString()
    write_segment(store.table("bodies").filter("text = 'late'").drop("seg"), store.path("bodies", 4), "bodies")  # a pass at the same time
    assert entries() == want and held().count("late") == 2
    store.clone_run("a", 2, "copy_", 1)
    assert [r.text for r in store.texts(["copy_001"]).orderBy("i").collect()] == ["same", "a", "same", "late"]
    assert held().count("a") == 1
    with open(f"{root}/b/events.out.tfevents.1", "wb"):
        pass
    w.write(f"{root}/b/events.out.tfevents.1", note(0, "new"))
    job.backfill_texts(["b"], force=True)
    store.compact()  # bodies that nothing refers to any more go
    assert held() == ["a", "late", "new", "same"]
    assert [r.text for r in store.texts(["b"]).collect()] == ["new"]


def test_pass_log(ingest, spark):
    log = PassLog()
    spark.streams.addListener(log)
    try:
        ingest.scan_once()
        for _ in range(50):
            if log.ended:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert [(p["batch"], p["files"]) for p in log.polls] == [(0, 3)] and [e["error"] for e in log.ended] == [None]
    assert ingest.last_pass["new_rows"] == 4 and ingest.last_pass["bad_records"] == 0


def test_chunks_equal_at_once(spark, tmp_path):
    """Ingest in several passes gives the same series as in one."""
    root, events = str(tmp_path / "runs"), [ev(i % 40, i / 3, wall=i) for i in range(100)]
    path = f"{root}/r/events.out.tfevents.1"
    many = Ingest(Store(spark, str(tmp_path / "many")), root)
    for i in range(0, 100, 25):
        w.write(path, *events[i:i + 25], append=i > 0)
        many.write(ef.list_event_files(spark, root), i)
    once = Ingest(Store(spark, str(tmp_path / "once")), root)
    once.write(ef.list_event_files(spark, root), 0)
    assert points(many.store) == points(once.store) and len(points(once.store)) == 40


def test_bad_record_resumes_after_growth(spark, tmp_path):
    root = str(tmp_path / "runs")
    path = f"{root}/r/events.out.tfevents.1"
    w.write(path, ev(0, 1.0), b"\x07\x07", ev(1, 2.0))
    job = Ingest(Store(spark, str(tmp_path / "s")), root)
    job.write(ef.list_event_files(spark, root), 0)
    assert [p[2] for p in points(job.store)] == [0]
    assert not job.write(ef.list_event_files(spark, root), 2)  # not grown
    w.write(path, ev(2, 3.0), append=True)
    job.write(ef.list_event_files(spark, root), 4)
    assert [p[2] for p in points(job.store)] == [0, 1, 2]


def test_shrunk_file_is_left_alone(ingest, spark):
    ingest.write(ef.list_event_files(spark, ingest.runs_dir), 0)
    w.write(f"{ingest.runs_dir}/001/events.out.tfevents.1")
    listing = ef.list_event_files(spark, ingest.runs_dir)
    assert not ingest.write(listing, 2)
    assert [r.run_id for r in ingest.shrunk(listing).collect()] == ["001"]


def test_names_stick(spark, ingest):
    ingest.names = spark.createDataFrame([("001", "given")], "run_id string, display_name string")
    ingest.write(ef.list_event_files(spark, ingest.runs_dir), 0)
    names = {r.run_id: r.display_name for r in ingest.store.names().collect()}
    assert names == {"001": "given", "run_a": "first try"}
    with open(f"{ingest.runs_dir}/run_a/config.yaml", "w") as f:
        f.write("run_name: second\n")
    w.write(f"{ingest.runs_dir}/run_a/events.out.tfevents.1", ev(3, 1.0), append=True)
    ingest.write(ef.list_event_files(spark, ingest.runs_dir), 2)
    assert {r.run_id: r.display_name for r in ingest.store.names().collect()} == names
    assert {r.run_id: r.value for r in ingest.store.configs().collect()} == {"run_a": "second"}


def test_retag(spark, tmp_path):
    root = str(tmp_path / "runs")
    w.write(f"{root}/r/events.out.tfevents.1",
            ev(0, 1.0, wall=1, tag="m/20260618_101116_148035/acc"), ev(0, 2.0, wall=2, tag="m/20260619_101116_148035/acc"),
            ev(1, 3.0, tag="m/acc"), w.event(0, 1.0, w.strings("c/12345678/t", ["x"])))
    job = Ingest(Store(spark, str(tmp_path / "s")), root)
    job.write(ef.list_event_files(spark, root), 0)
    dry = job.store.retag(dry_run=True).first()
    assert (dry.run_id, dry.tags_renamed, dry.tags_merged) == ("r", 2, 2)
    assert job.store.generation() == 0
    assert job.store.retag().first() == dry
    assert points(job.store) == [("r", "m/acc", 0, 2.0), ("r", "m/acc", 1, 3.0)]
    assert [r.tag for r in job.store.text_tags().collect()] == ["c/t"]
    assert [(r.tag, r["count"]) for r in job.store.tag_stats().collect()] == [("m/acc", 2)]


def test_texts_and_backfill(spark, ingest):
    store, root = ingest.store, ingest.runs_dir
    ingest.write(ef.list_event_files(spark, root), 0)
    assert store.get_text("run_a", "config", 0) == "A" and store.get_text("run_a", "config", 5) is None
    w.write(f"{root}/run_a/events.out.tfevents.1", w.event(7, 1.0, w.strings("config", ["B"])), append=True)
    # has text already: skipped; forced: replaced by all that is there now
    assert ingest.backfill_texts().count() == 0
    assert [(r.run_id, r.entries) for r in ingest.backfill_texts(force=True).collect()] == [("run_a", 2)]
    assert store.get_text("run_a", "config", 7) == "B" and store.table("texts").count() == 2
    assert [(r.run_id, r.i, r.step, r.chars) for r in store.text_index(["run_a"]).orderBy("i").collect()] == [
        ("run_a", 0, 0, 1), ("run_a", 1, 7, 1)]
    nested = nested_texts(store.texts()).first()
    assert [e.text for e in nested.entries] == ["A", "B"]


def test_refresh(spark, ingest):
    got = {r.run_id: (r.new_rows, r.error) for r in ingest.refresh(["001", "nope"]).collect()}
    assert got == {"001": (1, None), "nope": (0, None)}
    assert points(ingest.store) == [p for p in BASE if p[0] == "001"]
    ingest.scan_once()
    assert points(ingest.store) == BASE


def test_refresh_goes_on_without_what_it_cannot_read(spark, ingest, monkeypatch):
    """A file that cannot be read is reported with its run and read by a later pass; other files are taken in."""
    listing = ef.list_event_files(spark, ingest.runs_dir).collect()
    gone = [r.asDict() | {"path": r.path + ".gone"} if r.run_id == "001" else r.asDict() for r in listing]
    schema = ef.list_event_files(spark, ingest.runs_dir).schema
    with monkeypatch.context() as m:
        m.setattr(ef, "list_event_files", lambda *_: spark.createDataFrame(gone, schema))
        got = {r.run_id: (r.new_rows, bool(r.error)) for r in ingest.refresh(["001", "run_a"]).collect()}
    assert got == {"001": (0, True), "run_a": (3, False)} and "001" in ingest.failed
    assert points(ingest.store) == [p for p in BASE if p[0] == "run_a"]
    assert {r.run_id: (r.new_rows, r.error) for r in ingest.refresh(["001", "run_a"]).collect()} == {"001": (1, None), "run_a": (0, None)}
    assert points(ingest.store) == BASE and ingest.failed == {}


def test_refresh_reads_nothing_twice(spark, ingest, monkeypatch):
    """Runs without text are not read again to see that they have none; those of other segments are, once."""
    ingest.refresh(["001", "run_a"])
    read = []
    monkeypatch.setattr(ef, "read_events", lambda files, *a, f=ef.read_events, **k: read.append(files.count()) or f(files, *a, **k))
    decoded = []
    monkeypatch.setattr(ef, "decode", lambda parts, *a, f=ef.decode, **k: decoded.append(parts.count()) or f(parts, *a, **k))
    assert {r.new_rows for r in ingest.refresh(["001", "run_a"]).collect()} == {0}
    assert read == [] and decoded == []
    # points of run_a written by hand into another store: its text is still to be read
    other = Ingest(Store(spark, ingest.store.root + "_2"), ingest.runs_dir)
    for table in ("scalars", "tag_stats", "files"):
        write_segment(ingest.store.table(table).drop("seg"), other.store.path(table, 0), table)
    assert sorted(r.run_id for r in other.without_text().collect()) == ["001", "run_a"]
    assert [(r.run_id, r.entries) for r in other.backfill_texts().collect()] == [("run_a", 1)] and read == [3]
    assert other.without_text().count() == 0 and other.backfill_texts().count() == 0 and read == [3]
    listed(other.store)


def test_status_and_polling(spark, ingest):
    q = ingest.start(seconds=1)
    try:
        for _ in range(60):
            if ingest.store.table("files").count() == 3:
                break
            time.sleep(1)
        state = status(q, ingest)
    finally:
        q.stop()
    assert state["error"] is None and "message" in state["status"] and state["pass"]["runs"] == 2
    assert points(ingest.store) == BASE


def test_import_nested(spark):
    df = spark.createDataFrame(
        [("r", {"t": [(0, 1.0, "é∗😀"), (0, 2.0, "y")]})],
        "run_id string, texts map<string, array<struct<step: long, wall_time: double, text: string>>>")
    got = import_nested_texts(df).orderBy("rec").collect()
    assert [(r.tag, r.step, r.rec, r.chars) for r in got] == [("t", 0, 0, 3), ("t", 0, 1, 1)]


def test_pruning(spark, ingest):
    """Runs are pruned by folder, tags are pushed into Parquet, bodies are not read."""
    ingest.write(ef.list_event_files(spark, ingest.runs_dir), 0)
    plan = ingest.store.scalars(["run_a"], ["loss"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "run_id#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(tag,loss)" in plan or "In(tag" in plan
    index = ingest.store.text_index()._jdf.queryExecution().optimizedPlan().toString()
    scan = ingest.store.text_index()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in scan and "text:string" not in scan and index


def test_newest_pass_counts(spark, tmp_path):
    """A pass after a refresh is newer than it, whatever the numbers of their segments."""
    root = str(tmp_path / "runs")
    job = Ingest(Store(spark, str(tmp_path / "s")), root)
    for seed, how in ((1, "pass"), (2, "refresh"), (3, "pass")):
        w.write(f"{root}/r/events.out.tfevents.1", ev(5, 10.0 * seed), append=seed > 1)
        with open(f"{root}/r/config.yaml", "w") as f:
            f.write(f"seed: {seed}\n")
        if how == "refresh":
            assert [(r.new_rows, r.error) for r in job.refresh(["r"]).collect()] == [(1, None)]
        else:
            assert job.write(ef.list_event_files(spark, root), 2 * seed)
    assert [r.value for r in job.store.configs().collect()] == ["3"]
    assert [r.last_value for r in job.store.tag_stats().collect()] == [30.0]


def test_pass_during_compaction(spark, tmp_path, monkeypatch):
    """What a pass writes between the copies of two tables is in the new generation, points and positions alike."""
    from scalarlake.sources import store as module

    root = str(tmp_path / "runs")
    w.write(f"{root}/r/events.out.tfevents.1", ev(0, 1.0))
    job = Ingest(Store(spark, str(tmp_path / "s")), root)
    job.write(ef.list_event_files(spark, root), 0)
    write, calls = module.write_segment, []

    def interrupted(df, path, table):
        write(df, path, table)
        calls.append(table)
        if calls == ["scalars"]:
            w.write(f"{root}/r/events.out.tfevents.1", ev(1, 2.0), append=True)
            assert job.write(ef.list_event_files(spark, root), 2)

    monkeypatch.setattr(module, "write_segment", interrupted)
    job.store.compact()
    assert points(job.store) == [("r", "loss", 0, 1.0), ("r", "loss", 1, 2.0)]
    assert not job.write(ef.list_event_files(spark, root), 4)
    assert [r["count"] for r in job.store.tag_stats().collect()] == [2]


def test_files_do_not_grow_with_runs(spark, tmp_path):
    """Segments have no folder for each run; those of older stores are read all the same."""
    store = Store(spark, str(tmp_path / "store"))
    new = spark.createDataFrame([(f"{k:03}", "loss", 1, 1.0, 2.0, "f", k) for k in range(40)],
                                "run_id string, tag string, step long, wall_time double, value float, src string, rec long")
    write_segment(new, store.path("scalars", 2), "scalars")
    held = [f for f in os.listdir(store.path("scalars", 2)) if f.endswith(".parquet")]
    assert held and len(held) < 40 and not any(f.startswith("run_id=") for f in os.listdir(store.path("scalars", 2)))
    old = new.limit(3).selectExpr("concat('x', run_id) run_id", "tag", "step", "wall_time", "value", "src", "rec")
    old.write.partitionBy("run_id").parquet(store.path("scalars", 0))
    got = {(r.run_id, r.seg) for r in store.table("scalars").collect()}
    assert {r for r in got if r[1] == 2} == {(f"{k:03}", 2) for k in range(40)} and sum(s == 0 for _, s in got) == 3
    assert len(store.scalars(["007"]).collect()) == 1
