"""Keeping a store in step with growing event files.

A streaming query lists the files at every trigger.  Each micro-batch then

1. compares the listing with the ``files`` table and notes what is new or grown
   (written down first, so a replayed batch starts from one fixed plan);
2. cuts and decodes just the new byte ranges, on all executors;
3. writes its segment of every table; ``files`` comes last.

A replay rewrites the same segment, and ignores that segment when it works out
where files had been read to, so data enters the store exactly once.  There is no
operator state and no lateness bound: late or repeated steps are settled when read.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from .. import schemas as S
from ..functions.scalar import text_digest
from ..operators import stats
from ..operators.dedup import latest
from ..operators.select import display_name
from ..sources import eventfiles
from ..sources.config import read_configs
from ..sources.files import filesystem, qualified
from ..sources.store import TABLES, Store, write_segment

log = logging.getLogger(__name__)

COUNTERS = ("files", "new_files", "bytes", "records", "bad_records", "new_rows", "new_tags", "new_texts")
POLL_SECONDS = 10  # fixed value: default pause between passes


@dataclass
class Ingest:
    store: Store
    runs_dir: str
    on_corrupt: str = "stop"
    split_bytes: int = eventfiles.SPLIT_BYTES
    names: DataFrame | None = None  # (run_id, display_name) given by the user
    last_pass: dict | None = None  # counters of the last pass that wrote something
    failed: dict[str, str] = field(default_factory=dict)  # error by run, of the last refresh

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def root(self) -> str:
        """``runs_dir`` with its file system."""
        return qualified(self.spark, self.runs_dir)

    # -- planning -------------------------------------------------------------------

    def plan(self, listing: DataFrame, without: int | None = None) -> DataFrame:
        """Files to read: new ones from the start, grown ones from where they were left."""
        known = self.store.files(without).select(
            "run_id", "relkey", F.col("size").alias("_size"), F.col("consumed").alias("_at"), F.col("records").alias("_rec"))
        todo = listing.join(known, ["run_id", "relkey"], "left")
        return todo.filter(F.col("_size").isNull() | (F.col("size") > F.col("_size"))).select(
            *listing.columns, F.coalesce("_at", F.lit(0)).alias("start"), F.coalesce("_rec", F.lit(0)).alias("first_rec"),
            F.col("_size").isNull().alias("is_new"))

    def shrunk(self, listing: DataFrame) -> DataFrame:
        """Files that are now smaller than what was read; they are not read again."""
        known = self.store.files().select("run_id", "relkey", F.col("size").alias("_size"))
        return listing.join(known, ["run_id", "relkey"]).filter("size < _size").drop("_size")

    # -- one pass -------------------------------------------------------------------

    def write(self, listing: DataFrame, seg: int, on_error: str = "raise") -> bool:
        """Ingest what a listing adds, as segment ``seg``; False if there is nothing new.

        A file that cannot be read fails the pass.  With ``on_error="report"`` it is left for a later pass, and
        ``failed`` says so by run; all others are taken in.
        """
        store = self.store
        gen = store.generation()
        seq = F.lit(store.next_seq(without=seg)).cast("long")
        at = {n: store.path(n, seg, gen) for n in TABLES if n != "backfills"}
        work = f"{store.root}/work/seg={seg}"

        self.plan(listing, without=seg).write.mode("overwrite").parquet(f"{work}/plan")
        plan = self.spark.read.parquet(f"{work}/plan")
        if plan.isEmpty():
            return False

        decoded = eventfiles.decode(eventfiles.stretches(plan, self.split_bytes), on_corrupt=self.on_corrupt, on_error=on_error)
        decoded.write.mode("overwrite").partitionBy("kind").parquet(f"{work}/rows")
        rows = self.spark.read.parquet(f"{work}/rows")
        unread = rows.filter("kind = 'error'")
        if on_error == "report" and not unread.isEmpty():
            self.failed |= {r.run_id: r.error for r in unread.groupBy("run_id").agg(F.min("text").alias("error")).collect()}
            lost = unread.select("run_id", F.col("src").alias("relkey")).distinct()
            plan = plan.join(lost, ["run_id", "relkey"], "left_anti")
            rows = rows.join(lost.withColumnRenamed("relkey", "src"), ["run_id", "src"], "left_anti")
        if self.on_corrupt == "stop" and not rows.filter("kind = 'bad'").isEmpty():
            rows = eventfiles.drop_after_bad(rows)

        write_segment(latest(rows.filter("kind = 'scalar'").withColumn("value", F.col("value").cast("float"))),
                      at["scalars"], "scalars")
        texts = rows.filter("kind = 'text'").withColumns(
            {"digest": text_digest(F.col("text")), "chars": F.char_length("text")})
        write_segment(texts.withColumn("seq", seq), at["texts"], "texts")
        write_segment(Store(self.spark, store.root, gen).new_bodies(texts, seg), at["bodies"], "bodies")
        points = store._read(at["scalars"], S.SCALARS)
        write_segment(stats.tag_stats(points).withColumn("seq", seq), at["tag_stats"], "tag_stats")
        write_segment(stats.positions(points), at["positions"], "positions")
        write_segment(texts.select("run_id", "tag").distinct().withColumn("seq", seq), at["text_tags"], "text_tags")

        touched = plan.select("run_id").distinct()
        flat = eventfiles.run_of_flat_folder(self.root) if self._is_flat() else None
        configs = read_configs(self.spark, self.root, flat)
        # A run without configuration gets one empty row: its older one is void.
        write_segment(touched.join(configs, "run_id", "left").withColumn("seq", seq), at["configs"], "configs")
        write_segment(self._new_names(touched, configs, seg).withColumn("seq", seq), at["names"], "names")

        ends = rows.filter("kind = 'end'").groupBy("run_id", F.col("src").alias("relkey")).agg(
            F.max("offset").alias("consumed"), F.max("rec").alias("records"))
        files = plan.join(ends, ["run_id", "relkey"], "left").withColumns({
            "consumed": F.coalesce("consumed", "start"), "records": F.coalesce("records", "first_rec")})
        known = Store(self.spark, store.root, gen).table("tag_stats").filter(F.col("seg") != seg).join(touched, "run_id", "left_semi")
        added = stats.pass_rows(files, store._read(at["tag_stats"], S.TAG_STATS), known, texts.select("run_id"),
                                rows.filter("kind = 'bad'").select("run_id"))
        # Counted while the rows are written, without a job of its own.
        seen = Observation(f"pass {seg}")
        added = added.observe(seen, F.count(F.lit(1)).alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
        write_segment(added.withColumn("seq", seq), at["passes"], "passes")
        self.last_pass = {"seg": seg, **seen.get}
        write_segment(files.withColumn("seq", seq), at["files"], "files")
        self._discard(work)
        return True

    def _new_names(self, touched: DataFrame, configs: DataFrame, seg: int) -> DataFrame:
        """A name sticks once stored; else the given one, else the configured one, else the id."""
        stored = self.store.table("names").filter(F.col("seg") != seg).select("run_id").distinct()
        new = touched.join(stored, "run_id", "left_anti")
        configured = configs.filter("key = 'run_name'").select("run_id", F.col("value").alias("_configured"))
        out = new.join(configured, "run_id", "left")
        if self.names is not None:
            out = out.join(self.names.select("run_id", F.col("display_name").alias("_given")), "run_id", "left")
        else:
            out = out.withColumn("_given", F.lit(None).cast("string"))
        none = F.lit(None).cast("string")
        return out.select("run_id", display_name(F.col("_given"), none, F.col("_configured"), F.col("run_id")).alias("display_name"))

    def _is_flat(self) -> bool:
        folders = eventfiles._run_folders(self.root, None)
        return len(folders) == 1 and folders[0].flat

    def _discard(self, path: str) -> None:
        where, local = filesystem(qualified(self.spark, path))
        where.delete_dir(local)

    # -- drivers --------------------------------------------------------------------

    def start(self, once: bool = False, seconds: int = POLL_SECONDS, checkpoint: str | None = None) -> StreamingQuery:
        """Watch the run folders; with ``once`` make one pass over everything and stop.

        The checkpoint belongs to the store: batch numbers name its segments.
        """
        eventfiles.register(self.spark)
        stream = eventfiles.with_prefix(self.spark.readStream.format("eventfiles").load(self.root))
        writer = (
            stream.writeStream.foreachBatch(lambda batch, batch_id: self.write(batch, 2 * batch_id) and None)
            .option("checkpointLocation", checkpoint or f"{self.store.root}/checkpoint")
        )
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
        return writer.start()

    def scan_once(self) -> None:
        self.start(once=True).awaitTermination()

    def watch(self, seconds: int = POLL_SECONDS) -> None:
        """Watch for ever; an error is logged and the query restarted from its checkpoint."""
        while True:
            try:
                self.start(seconds=seconds).awaitTermination()
                return
            except Exception:
                log.exception("ingest failed, restarting")
                time.sleep(seconds)

    def refresh(self, runs: list[str]) -> DataFrame:
        """Bring the given runs up to date now, with the text of those whose text no pass has read.

        One pass reads all of them; a file that cannot be read does not hold up the others.  The result has
        one row per run with its new points and an error, if any.
        """
        self.failed = {}
        seg = _odd_segment()
        wrote = self.write(eventfiles.list_event_files(self.spark, self.root, runs), seg, on_error="report")
        self.backfill_texts(runs, on_error="report")
        asked = self.spark.createDataFrame([(r, self.failed.get(r)) for r in runs], "run_id string, error string")
        new = self.report(seg if wrote else -1).select("run_id", "new_rows")
        return asked.join(new, "run_id", "left").select(
            "run_id", F.coalesce("new_rows", F.lit(0)).alias("new_rows"), "error")

    def without_text(self) -> DataFrame:
        """Runs (run_id) that hold files whose text nobody has read: of segments written without a pass, and no backfill since.

        A pass reads points and text together, so its runs are never read a second time for text.
        """
        now = self.store.snapshot()
        by_hand = now.table("files").join(now.table("passes").select("run_id", "seg"), ["run_id", "seg"], "left_anti")
        newest = by_hand.groupBy("run_id").agg(F.max(F.coalesce("seq", F.lit(0))).alias("_files"))
        marks = now.table("backfills").groupBy("run_id").agg(F.max(F.coalesce("seq", F.lit(0))).alias("_mark"))
        return newest.join(marks, "run_id", "left").filter("_mark is null or _mark < _files").select("run_id")

    def backfill_texts(self, runs: list[str] | None = None, force: bool = False, full: bool = True,
                       on_error: str = "raise") -> DataFrame:
        """Read the text of ingested runs again, without touching scalars.

        Only runs whose text nobody has read (``without_text``), unless ``force``.  Files are read as a whole and the text found
        replaces all text of these runs; with ``full=False`` only the head of each file is read,
        and nothing is replaced.  Returns the number of entries per run.
        """
        store = self.store.snapshot()
        files = eventfiles.list_event_files(self.spark, self.root, runs)
        files = files.join(store.table("files").select("run_id").distinct(), "run_id", "left_semi")
        if not force:
            files = files.join(self.without_text(), "run_id", "left_semi").join(store.text_tags(), "run_id", "left_anti")
        seg, seq = _odd_segment(), F.lit(store.next_seq()).cast("long")
        work = f"{store.root}/work/seg={seg}"
        files.write.mode("overwrite").parquet(f"{work}/plan")
        files = self.spark.read.parquet(f"{work}/plan")
        if files.isEmpty():
            self._discard(work)
            return self.spark.createDataFrame([], "run_id string, entries long")
        found = eventfiles.read_events(files, "text", on_error=on_error) if full else eventfiles.read_head_texts(files)
        found = found.withColumns({"digest": text_digest(F.col("text")), "chars": F.char_length("text"), "seq": seq})
        found.write.mode("overwrite").parquet(f"{work}/texts")
        found = self.spark.read.parquet(f"{work}/texts")
        unread = found.filter("kind = 'error'").groupBy("run_id").agg(F.min("text").alias("error"))
        if errors := {r.run_id: r.error for r in unread.collect()}:
            self.failed |= errors
            found, files = (df.filter(~F.col("run_id").isin(*errors)) for df in (found, files))
        write_segment(found, store.path("texts", seg), "texts")
        write_segment(store.new_bodies(found, seg), store.path("bodies", seg), "bodies")
        write_segment(found.select("run_id", "tag").distinct().withColumn("seq", seq), store.path("text_tags", seg), "text_tags")
        # The mark comes last: from here on readers skip the older text, which compaction removes.
        marks = files.select("run_id").distinct().withColumns({"replaces": F.lit(force and full), "seq": seq})
        write_segment(marks, store.path("backfills", seg), "backfills")
        self._discard(work)
        new = store.table("texts").filter(F.col("seg") == seg).select("run_id").distinct()
        return store.texts().join(new, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))

    # -- progress -------------------------------------------------------------------

    def report(self, seg: int) -> DataFrame:
        """Per run: points and tags a pass added, event files and records it read, and records that could not be decoded."""
        rows = self.store.table("passes").filter(F.col("seg") == seg)
        tags = self.store.table("tag_stats").filter(F.col("seg") == seg).groupBy("run_id").agg(F.count(F.lit(1)).alias("tags"))
        return rows.join(tags, "run_id", "left").select(
            "run_id", "files", "new_rows", F.coalesce("tags", F.lit(0)).alias("tags"), "records", "bad_records")


def _odd_segment() -> int:
    return 2 * int(time.time() * 1000) + 1


class PassLog(StreamingQueryListener):
    """What ingest queries did, as Spark reports it: a row for each poll that found something, and how queries ended.

    Attach with ``spark.streams.addListener(log)``.  Only the last ``keep`` rows are held.
    """

    def __init__(self, keep: int = 100):
        self.keep, self.polls, self.ended = keep, [], []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            self.polls = [*self.polls, {"query": str(p.id), "batch": p.batchId, "files": p.numInputRows,
                                        "at": p.timestamp, "milliseconds": p.batchDuration}][-self.keep:]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended = [*self.ended, {"query": str(event.id), "error": event.exception}][-self.keep:]


def status(query: StreamingQuery, job: Ingest | None = None) -> dict:
    """What a running query is doing, its last poll, and the counters of the job's last pass."""
    return {"status": query.status, "last": query.lastProgress, "pass": job.last_pass if job else None,
            "error": str(query.exception() or "") or None}
