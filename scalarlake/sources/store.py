"""The store: Parquet tables, one directory per ingest pass (``seg``).

    <root>/generations/            one row per generation; the greatest one is read
    <root>/gen=<g>/scalars/seg=<s>/*.parquet       sorted by run, tag, step
    <root>/gen=<g>/texts/seg=<s>/*.parquet         sorted in the same way: entries with the digests of their bodies
    <root>/gen=<g>/bodies/seg=<s>/*.parquet               sorted by digest, each text once
    <root>/gen=<g>/{positions,tag_stats,configs,names,text_tags,passes,backfills,files}/seg=<s>/*.parquet

A pass writes ``files`` (a text backfill: ``backfills``) last, which makes its segment a finished one.

Segments are only ever replaced whole, by a replay of the pass that wrote them.
Reads merge segments (latest write wins).  Compaction and re-tagging write a new
generation and then append its number, so readers switch in one step.  They copy a fixed set of
finished segments; segments that finish meanwhile are carried over as they are.

The number of files follows the size of a table, not the number of runs.  Segments of older stores have a folder
``run_id=<r>`` for each run and are read as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalar import clean_tag, text_digest
from ..operators import reshape, select, stats, texts
from ..operators.dedup import latest
from ..plans import series as series_plans
from ..plans.runs import described, run_summary
from .files import exists, matching

TABLES = {
    "scalars": S.SCALARS, "positions": S.POSITIONS, "texts": S.TEXTS, "bodies": S.BODIES, "tag_stats": S.TAG_STATS,
    "configs": S.CONFIGS, "names": S.RUN_NAMES, "text_tags": S.TEXT_TAGS, "passes": S.PASSES,
    "backfills": S.BACKFILLS, "files": S.FILES,
}
BY_RUN = ("scalars", "texts")
ROW_GROUP_BYTES = 8 * 1024 * 1024  # about 256,000 scalar rows
COMPACTED = -1  # segment number of a compacted generation


def write_segment(df: DataFrame, path: str, table: str) -> None:
    """Replace one segment.

    Big tables are range-partitioned so that each file holds a contiguous range of
    runs and tags (Parquet statistics then skip files and row groups).  ``step`` is part of the range:
    a series of any length is spread over several files.
    """
    schema = TABLES[table]
    if "seq" in schema.names and "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(None))
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if table in BY_RUN:
        order = ["run_id", "tag", "step"]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    elif table == "bodies":  # one digest is found in few row groups
        writer = df.repartitionByRange("digest").sortWithinPartitions("digest").write.option("parquet.block.size", ROW_GROUP_BYTES)
    else:
        writer = df.write
    writer.mode("overwrite").parquet(path)


class Store:
    """``generation`` and ``segments`` pin what is read; see snapshot()."""

    def __init__(self, spark: SparkSession, root: str, generation: int | None = None, segments: Sequence[int] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._generation, self._segments = generation, segments

    # -- layout ---------------------------------------------------------------

    def snapshot(self, segments: Sequence[int] | None = None) -> Store:
        """The store as of one generation, so that the tables of a read belong together; only some segments, if given."""
        return Store(self.spark, self.root, self.generation(), self._segments if segments is None else segments)

    def finished(self) -> list[int]:
        """Segments whose pass has finished (one number per pass since the last compaction)."""
        segs = self.table("files").select("seg").union(self.table("backfills").select("seg"))
        return sorted(r.seg for r in segs.distinct().collect())

    def next_seq(self, without: int | None = None) -> int:
        """A number greater than those of all passes that have finished; a pass leaves itself out when it is replayed."""
        seqs = self.table("files").select("seq", "seg").union(self.table("backfills").select("seq", "seg"))
        if without is not None:
            seqs = seqs.filter(F.col("seg") != without)
        return (seqs.agg(F.max("seq")).first()[0] or 0) + 1

    def generation(self) -> int:
        if self._generation is not None:
            return self._generation
        rows = self._read(f"{self.root}/generations", T.StructType([T.StructField("generation", T.LongType())]))
        return rows.agg(F.max("generation")).first()[0] or 0

    def path(self, table: str, seg: int | None = None, generation: int | None = None) -> str:
        gen = self.generation() if generation is None else generation
        base = f"{self.root}/gen={gen}/{table}"
        return base if seg is None else f"{base}/seg={seg}"

    def _read(self, path: str, schema: T.StructType, by_run: bool = False) -> DataFrame:
        """Always with an explicit schema: run ids such as ``001`` must stay text.

        ``by_run``: segments may be of an older store, with a folder for each run.
        """
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema)
        if by_run and (old := {p.rsplit("/", 1)[0] for p in matching(self.spark, f"{path}/seg=*/run_id=*")}):
            new = set(matching(self.spark, f"{path}/seg=*")) - old
            read = read.option("basePath", path)
            parts = [read.parquet(*sorted(p)).select(*schema.names) for p in (old, new) if p]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return read.parquet(path)

    def table(self, name: str) -> DataFrame:
        """Rows of all segments; of text, those that no later backfill has replaced."""
        t = self._stored(name)
        if name not in ("texts", "text_tags"):
            return t
        void = self._stored("backfills").filter("replaces").groupBy("run_id").agg(F.max("seq").alias("_from"))
        current = F.coalesce(F.col("seq"), F.lit(0)) >= F.coalesce(F.col("_from"), F.lit(0))
        return t.join(void, "run_id", "left").filter(current).select(*t.columns)

    def _stored(self, name: str) -> DataFrame:
        t = self._read(self.path(name), S.stored(TABLES[name]), by_run=name in BY_RUN)
        return t if self._segments is None else t.filter(F.col("seg").isin(list(self._segments)))

    def _single_segment(self) -> bool:
        """Whether scalars have one segment (already deduplicated when written); folders are listed, no file is opened."""
        segs = {int(p.rsplit("=", 1)[1]) for p in matching(self.spark, f"{self.path('scalars')}/seg=*")}
        return len(segs if self._segments is None else segs & set(self._segments)) <= 1

    def _positions(self) -> DataFrame | None:
        """The position index, if it covers what is read: one segment, written with its index."""
        segs = {p.rsplit("=", 1)[1] for p in matching(self.spark, f"{self.path('scalars')}/seg=*")}
        if not self._single_segment() or not all(exists(self.spark, f"{self.path('positions')}/seg={s}") for s in segs):
            return None
        return self.table("positions").drop("seg")

    # -- small tables, folded over segments -------------------------------------

    def names(self) -> DataFrame:
        """Display names; the first name a run got stays."""
        t = self.table("names")
        return t.groupBy("run_id").agg(F.min_by("display_name", F.struct("seq", "seg")).alias("display_name"))

    def configs(self) -> DataFrame:
        """Each run's configuration as of the last pass that read it."""
        t = self.table("configs")
        newest = t.groupBy("run_id").agg(F.max(F.struct(F.coalesce("seq", F.lit(0)), "seg"))["seg"].alias("seg"))
        return t.join(newest, ["run_id", "seg"]).filter(F.col("key").isNotNull()).select("run_id", "key", "value")

    def files(self, without: int | None = None) -> DataFrame:
        """How far each event file has been read."""
        t = self.table("files")
        if without is not None:
            t = t.filter(F.col("seg") != without)
        last = F.max(F.struct("consumed", "size", "records", "mtime")).alias("f")
        return t.groupBy("run_id", "relkey").agg(last).select("run_id", "relkey", "f.*")

    def tag_stats(self, runs: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
        """Statistics per series.

        The default folds the statistics each pass wrote, without reading points: a
        step logged again in a later pass counts twice, and the last value is that of
        the newest pass among equal greatest steps.  ``exact`` reads the points.
        """
        if exact:
            return stats.tag_stats(latest(select.restrict(self.table("scalars"), runs)))
        return stats.fold_stats(select.restrict(self.table("tag_stats"), runs), order=["seq", "seg"])

    # -- reads --------------------------------------------------------------------

    def scalars(self, runs=None, tags=None) -> DataFrame:
        return select.restrict(self.table("scalars"), runs, tags)

    def run_ids(self) -> DataFrame:
        return self.table("files").select("run_id").distinct().orderBy("run_id")

    def list_runs(self) -> DataFrame:
        """Runs from the rows that passes left (``passes``): neither points nor texts nor statistics of tags are read.

        Only runs whose rows do not add up are counted from the statistics of their tags: two of their passes ran
        at the same time (both may have counted a tag as new), or a segment was written by hand.
        """
        now = self.snapshot()
        passes, written = now.table("passes"), now.table("files").select("run_id", "seg").distinct()
        odd = passes.groupBy("run_id", "seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id")
        odd = odd.unionByName(written.join(passes, ["run_id", "seg"], "left_anti").select("run_id")).distinct()
        kept = stats.fold_passes(passes).drop("bad_records")
        if not odd.isEmpty():
            counted = now.counted_runs(odd)
            kept = kept.join(odd, "run_id", "left_anti").unionByName(counted.select(*kept.columns))
        return described(kept, now.table("text_tags"), now.configs(), now.names())

    def counted_runs(self, runs: DataFrame | None = None) -> DataFrame:
        """The same totals counted from the statistics of all tags."""
        some = lambda df: df if runs is None else df.join(runs, "run_id", "left_semi")
        folded = stats.fold_stats(some(self.table("tag_stats")), order=["seq", "seg"])
        return run_summary(folded, stats.files_per_run(some(self.files())))

    def new_bodies(self, rows: DataFrame, seg: int) -> DataFrame:
        """(digest, text) of rows that no other segment holds."""
        known = self._stored("bodies").filter(F.col("seg") != seg).select("digest")
        return texts.bodies(rows).join(known, "digest", "left_anti")

    def passes(self, seg: int | None = None) -> DataFrame:
        """Counters of each pass: runs, files, bytes, records, undecodable records, rows, texts, tags that were new."""
        rows = self.table("passes")
        rows = rows if seg is None else rows.filter(F.col("seg") == seg)
        sums = [F.sum(c).alias(c) for c in ("files", "new_files", "bytes", "records", "bad_records", "new_rows", "new_tags", "new_texts")]
        return rows.groupBy("seg", "seq").agg(F.count(F.lit(1)).alias("runs"), *sums)

    def tag_names(self, runs: Sequence[str] | None = None) -> DataFrame:
        return select.tag_names(self.table("tag_stats"), runs)

    def step_extent(self, runs: Sequence[str]) -> DataFrame:
        return stats.step_extent(stats.run_totals(self.tag_stats(runs)))

    def get_series(self, runs, tags, max_points: int = 1500) -> series_plans.SeriesResult:
        now = self.snapshot()
        return series_plans.get_series(
            now.table("scalars"), runs, tags, max_points, now.names(), deduplicated=now._single_segment(),
            counted=now._positions())

    def series_view(self, runs=None, tags=None, **options) -> series_plans.View:
        now = self.snapshot()
        return series_plans.series_view(now.table("scalars"), runs, tags, names=now.names(), **options)

    def texts(self, runs=None) -> DataFrame:
        """Entries with their bodies, which are fetched last."""
        now = self.snapshot()
        entries = texts.collapse(select.restrict(now.table("texts"), runs))
        return texts.with_bodies(entries, now.bodies())

    def bodies(self) -> DataFrame:
        """(digest, text), each digest once: two passes at the same time may both have stored a text."""
        return texts.bodies(self.table("bodies"))

    def text_tags(self, runs=None) -> DataFrame:
        return select.restrict(self.table("text_tags"), runs).select("run_id", "tag").distinct()

    def text_index(self, runs=None) -> DataFrame:
        now = self.snapshot()
        entries = texts.collapse(select.restrict(now.table("texts"), runs))
        return texts.text_index(entries, now.names())

    def get_text(self, run_id: str, tag: str, i: int) -> str | None:
        wanted = self.spark.createDataFrame([(run_id, tag, i)], "run_id string, tag string, i long")
        now = self.snapshot()
        entries = texts.collapse(select.restrict(now.table("texts"), [run_id], [tag]))
        digest = texts.lookup(entries, wanted, "digest").first()["digest"]
        if digest is None:
            return None
        return now.table("bodies").filter(F.col("digest") == digest).first()["text"]

    # -- maintenance ----------------------------------------------------------------

    def compact(self) -> int:
        """Merge all segments into one, in a new generation."""
        return self._next_generation(lambda name, df: df)

    def retag(self, dry_run: bool = False) -> DataFrame:
        """Clean all tags.  Returns the report per run; ``dry_run`` only reports."""
        report = reshape.retag_report(self.table("tag_stats"))
        if dry_run:
            return report
        at = f"{self.path('retag_report', generation=self.generation() + 1)}"
        report.write.mode("overwrite").parquet(at)
        self._next_generation(
            lambda name, df: df.withColumn("tag", clean_tag(F.col("tag"))) if name in BY_RUN else df)
        return self.spark.read.parquet(at)

    def _next_generation(self, change) -> int:
        old = self.snapshot()
        fixed = old.finished()
        merged = old.snapshot(fixed)
        new = old.generation() + 1
        at = {n: self.path(n, COMPACTED, new) for n in TABLES}
        seq = merged.next_seq() - 1
        write_segment(latest(change("scalars", merged.table("scalars"))), at["scalars"], "scalars")
        points = self._read(at["scalars"], S.SCALARS)
        write_segment(stats.tag_stats(points).withColumn("seq", F.lit(seq)), at["tag_stats"], "tag_stats")
        write_segment(stats.positions(points), at["positions"], "positions")
        # Text that a backfill replaced is left out, so its mark is no longer needed.
        once = change("texts", merged.table("texts")).drop("seg").dropDuplicates(["run_id", "tag", "step", "src", "rec"])
        write_segment(once, at["texts"], "texts")
        used = self._read(at["texts"], S.TEXTS).select("digest").distinct()
        write_segment(merged.bodies().join(used, "digest", "left_semi"), at["bodies"], "bodies")
        tagged = change("texts", merged.table("text_tags")).groupBy("run_id", "tag").agg(F.max("seq").alias("seq"))
        write_segment(tagged, at["text_tags"], "text_tags")
        write_segment(merged._folded_passes(self._read(at["tag_stats"], S.TAG_STATS), seq), at["passes"], "passes")
        write_segment(merged.configs().withColumn("seq", F.lit(seq)), at["configs"], "configs")
        write_segment(merged.names().withColumn("seq", F.lit(0)), at["names"], "names")
        write_segment(merged.files().withColumn("seq", F.lit(seq)), at["files"], "files")
        carried = self._carry(old, new, set(fixed), change)
        row = self.spark.createDataFrame([(new,)], "generation long")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/generations")
        # Passes that began before the switch write to the old generation.  One that finishes even later is not
        # known to the new generation, whose next pass over these files reads their bytes again.
        self._carry(old, new, carried, change)
        return new

    def _carry(self, old: Store, new: int, known: set[int], change) -> set[int]:
        """Copy finished segments that are not ``known`` to generation ``new``; returns all that are known then."""
        later = [seg for seg in old.finished() if seg not in known]
        for seg in later:
            one = old.snapshot([seg])
            for name in TABLES:
                df = one._stored(name)
                if name in BY_RUN:
                    df = change(name, df)
                    df = latest(df) if name == "scalars" else df
                elif name == "tag_stats":
                    points = self._read(self.path("scalars", seg, new), S.SCALARS)
                    df = stats.tag_stats(points).withColumn("seq", F.lit(one.next_seq() - 1))
                elif name == "positions":
                    df = stats.positions(self._read(self.path("scalars", seg, new), S.SCALARS))
                elif name == "text_tags":
                    df = change("texts", df).distinct()
                elif name == "passes":
                    df = self._carried_passes(df, seg, new)
                write_segment(df, self.path(name, seg, new), name)
        return known | set(later)

    def _folded_passes(self, tag_stats: DataFrame, seq: int) -> DataFrame:
        """One row per run for all its passes; tags and rows as they are after merging."""
        p = self.table("passes")
        past = p.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("bytes", "bad_records", "new_texts")])
        seen = self.files()
        read = seen.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.max("mtime").alias("updated_at"))
        totals = stats.run_totals(tag_stats).withColumnsRenamed({"num_tags": "new_tags", "num_rows": "new_rows"})
        out = read.join(past, "run_id", "left").join(totals, "run_id", "left").withColumn("new_files", F.col("files"))
        counts = ("bytes", "bad_records", "new_texts", "new_tags", "new_rows")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("seq", F.lit(seq))

    def _carried_passes(self, rows: DataFrame, seg: int, new: int) -> DataFrame:
        """A later pass on top of generation ``new``: rows and tags are counted again, under the names they have there."""
        there = Store(self.spark, self.root, new)._stored("tag_stats")
        mine, known = there.filter(F.col("seg") == seg), there.filter(F.col("seg") != seg)
        totals = stats.run_totals(mine).withColumnsRenamed({"num_rows": "new_rows"}).drop("num_tags")
        fresh = mine.join(known, S.SERIES, "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("new_tags"))
        out = rows.drop("new_rows", "new_tags", "step_min", "step_max").join(totals, "run_id", "left").join(fresh, "run_id", "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_rows", "new_tags")})

    def clone_run(self, run_id: str, copies: int, prefix: str, seg: int) -> None:
        """Numbered copies of a run, as one new segment (for scale tests)."""
        seq = self.next_seq()
        one = {n: self.table(n).filter(F.col("run_id") == run_id).drop("seg") for n in TABLES if n not in ("backfills", "bodies")}
        one["scalars"] = latest(one["scalars"])
        one["tag_stats"] = self.tag_stats([run_id])
        one["positions"] = stats.positions(one["scalars"])
        one["names"] = reshape.fan_out_names(self.names().filter(F.col("run_id") == run_id), copies, prefix)
        one["files"] = self.files().filter(F.col("run_id") == run_id)
        one["configs"] = self.configs().filter(F.col("run_id") == run_id)
        one["passes"] = self.snapshot()._folded_passes(one["tag_stats"], seq).filter(F.col("run_id") == run_id)
        for name, df in one.items():
            out = df if name == "names" else reshape.fan_out(df, copies, prefix)
            out = out.withColumn("seq", F.lit(seq)) if "seq" in TABLES[name].names else out
            write_segment(out, self.path(name, seg), name)


def import_nested_texts(nested: DataFrame) -> DataFrame:
    """Text rows from the nested shape (run_id, texts map<tag, array<struct<step, wall_time, text>>>)."""
    rows = nested.select("run_id", F.explode("texts").alias("tag", "_e")).select(
        "run_id", "tag", F.posexplode("_e").alias("_i", "_v"))
    return rows.select(
        "run_id", "tag", F.col("_v.step").cast("long").alias("step"), F.col("_v.wall_time").alias("wall_time"),
        F.col("_v.text").alias("text"), F.lit("").alias("src"), F.col("_i").cast("long").alias("rec"),
        text_digest(F.col("_v.text")).alias("digest"), F.char_length(F.col("_v.text")).alias("chars"),
    )


def nested_texts(collapsed: DataFrame, part_size: int = 10_000) -> DataFrame:
    """The reverse: arrays of at most ``part_size`` entries per (run, tag, part)."""
    part = F.floor(F.col("i") / part_size).alias("part")
    entry = F.struct("i", "step", "wall_time", "text")
    return collapsed.groupBy("run_id", "tag", part).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
