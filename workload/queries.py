"""Registered queries.  Each reads the given tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarlake.functions.scalar import clean_tag, finite_or_null, natural_key
from scalarlake.operators import diff, quantiles, reshape, select, smooth, stats, tagtree, texts
from scalarlake.operators.dedup import latest
from scalarlake.operators.gaps import gap_markers
from scalarlake.plans import compare
from scalarlake.plans import runs as run_plans
from scalarlake.plans import series as series_plans
from scalarlake.sources import config, eventfiles
from scalarlake.sources.store import Store, import_nested_texts, write_segment
from scalarlake.streaming.ingest import Ingest

from . import eventlog, views

SERIES = ["run_id", "tag"]
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str, out: str | None = None):
    return F.round(F.col(c).cast("double"), 6).alias(out or c)


# --- series ---------------------------------------------------------------

@query
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    d = latest(views.sc_events(spark, sf))
    return d.select(*SERIES, "step", r6("wall_time"), finite_or_null(F.col("value").cast("double")).alias("value"), "rec")


@query
def series_raw(spark, sf):
    """Everything the request's runs and tags hold, without downsampling, in the order of the request."""
    p = series_plans.get_series(
        views.sc_events(spark, sf), ["run_3", "run_missing", "run_1"], ["metrics/click", "metrics/view"], 0
    ).in_order
    return p.select("place", *SERIES, "step", r6("wall_time"), r6("value"), "count")


def _lttb(view, spark, sf, max_points):
    p = series_plans.get_series(view(spark, sf), max_points=max_points).points
    return p.select(*SERIES, "step", r6("wall_time"), r6("value"), "count")


@query
def series_lttb(spark, sf):
    return _lttb(views.sc_lineitem, spark, sf, 20)


@query
def series_lttb_gappy(spark, sf):
    return _lttb(views.sc_events, spark, sf, 30)


@query
def series_nested(spark, sf):
    p = series_plans.get_series(views.sc_events(spark, sf), max_points=30).points
    return series_plans.nested(p).select(
        *SERIES, F.col("part").cast("bigint").alias("part"), "count", F.inline("points")
    ).select(*SERIES, "part", "count", "step", r6("value"), r6("wall_time"))


@query
def series_named(spark, sf):
    names = views.table(spark, sf, "nation").selectExpr(
        "concat('run_', n_nationkey) run_id", "n_name display_name").filter("run_id <> 'run_3'")
    p = series_plans.get_series(views.sc_events(spark, sf), max_points=0, names=names).points
    return p.groupBy("run_id", "display_name").agg(F.count(F.lit(1)).alias("points"))


@query
def gaps(spark, sf):
    g = series_plans.get_series(views.sc_events(spark, sf)).gaps
    return g.select(*SERIES, "step", r6("wall_time"), "kind", r6("y"))


@query
def gaps_window(spark, sf):
    v = series_plans.series_view(views.sc_events(spark, sf), window=(20, 70))
    return v.gaps.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("markers"))


@query
def ema(spark, sf):
    d = latest(views.sc_events(spark, sf)).select(*SERIES, "step", "value")
    return smooth.ema(d, 0.6).select(*SERIES, "step", F.round("smooth", 4).alias("smooth"))


@query
def step_window(spark, sf):
    v = series_plans.series_view(views.sc_lineitem(spark, sf), max_points=20, window=(10000, 40000))
    return v.points.select(*SERIES, "step", r6("value"), "count")


@query
def step_window_first(spark, sf):
    v = series_plans.series_view(
        views.sc_lineitem(spark, sf), max_points=0, window=(10000, 40000), window_first=True)
    return v.points.select(*SERIES, "step", r6("value"), "count")


@query
def relative_time(spark, sf):
    v = series_plans.series_view(views.sc_events(spark, sf), max_points=0, x="wall_time")
    return v.points.select(*SERIES, "step", F.round("minutes", 4).alias("minutes"))


@query
def series_view(spark, sf):
    """Downsampled, windowed and smoothed."""
    v = series_plans.series_view(views.sc_lineitem(spark, sf), max_points=20, window=(10000, 50000), smooth=0.6)
    return v.points.select(*SERIES, "step", F.round(F.log10("smooth"), 7).alias("log_smooth"))


@query
def outlier_range(spark, sf):
    d = latest(views.sc_lineitem(spark, sf))
    return quantiles.outlier_range(d).select("tag", "n", F.round("y_lo", 4).alias("y_lo"), F.round("y_hi", 4).alias("y_hi"))


@query
def outlier_range_log(spark, sf):
    d = latest(views.sc_events(spark, sf))
    return quantiles.outlier_range(d, 0.05, 0.9, logy=True).select("tag", "n", r6("y_lo"), r6("y_hi"))


@query
def single_points(spark, sf):
    return stats.single_points(latest(views.sc_events(spark, sf)))


@query
def overlay(spark, sf):
    o = series_plans.overlay(views.sc_events(spark, sf), "metrics/click", "metrics/view", max_points=0)
    return o.points.select("side", *SERIES, "step", r6("value"))


@query
def overlay_ranges(spark, sf):
    o = series_plans.overlay(views.sc_events(spark, sf), "metrics/click", "metrics/error", max_points=0)
    return o.ranges.select("side", "n", F.round("y_lo", 4).alias("y_lo"), F.round("y_hi", 4).alias("y_hi"))


@query
def positive_only(spark, sf):
    p = series_plans.positive_only(latest(views.sc_events(spark, sf)))
    return p.groupBy("tag").agg(F.count(F.lit(1)).alias("points"))


# --- statistics and runs ---------------------------------------------------

@query
def tag_stats(spark, sf):
    s = stats.tag_stats(latest(views.sc_lineitem(spark, sf)))
    return s.select(*SERIES, "count", "min_step", "max_step", r6("last_value"))


@query
def stats_fold(spark, sf):
    s = stats.fold_renamed_stats(stats.tag_stats(latest(views.sc_dirty(spark, sf))))
    return s.select(*SERIES, "count", "min_step", "max_step", r6("last_value"))


def _files(df):
    return df.groupBy("run_id", "src").agg(F.max("wall_time").alias("mtime"))


@query
def run_summary(spark, sf):
    ev = views.sc_events(spark, sf)
    files = stats.files_per_run(_files(ev))
    out = run_plans.run_summary(
        stats.tag_stats(latest(ev)), files, names=views.table(spark, sf, "nation").selectExpr(
            "concat('run_', n_nationkey) run_id", "n_name display_name"))
    return out.select("run_id", "display_name", "num_tags", "num_rows", "num_event_files", "step_min", "step_max", r6("updated_at"))


@query
def step_extent(spark, sf):
    li = views.sc_lineitem(spark, sf)
    runs = stats.run_totals(stats.tag_stats(latest(li)))
    return stats.step_extent(select.restrict(runs, ["run_F", "run_missing"]))


@query
def files_per_run(spark, sf):
    return stats.files_per_run(_files(views.sc_events(spark, sf))).select("run_id", "num_event_files", r6("updated_at"))


@query
def group_counts(spark, sf):
    both = views.sc_events(spark, sf).select("tag").unionByName(views.sc_lineitem(spark, sf).select("tag"))
    nets = views.table(spark, sf, "customer").selectExpr("concat('Net', c_nationkey, '/', c_mktsegment) tag")
    return stats.group_counts(both.unionByName(nets))


# --- selection ---------------------------------------------------------------

def _tags(spark, sf):
    return views.sc_lineitem(spark, sf).select(*SERIES).distinct()


@query
def tag_names(spark, sf):
    return select.tag_names(views.sc_events(spark, sf), ["run_0", "run_1"])


@query
def tag_search(spark, sf):
    return select.search_tags(_tags(spark, sf).select("tag").distinct(), "A/LAYERS\\.[12]\\.")


@query
def tag_search_literal(spark, sf):
    """Not a valid regular expression, so a substring."""
    names = views.table(spark, sf, "customer").selectExpr("concat('loss(', c_mktsegment, ')/', c_nationkey) tag")
    return select.search_tags(names.distinct(), "LOSS(")


@query
def run_search(spark, sf):
    runs = views.table(spark, sf, "customer").selectExpr("concat('run_', c_custkey) run_id", "c_name display_name")
    return select.search_runs(runs, "ER#00000001")


@query
def suggest_tags(spark, sf):
    return select.suggest_tags(_tags(spark, sf), " R/layers.3 ")


def _selection(spark, sf):
    regions = views.table(spark, sf, "region")
    runs = regions.selectExpr("concat('run_', r_regionkey * 2 + 1) run_id")
    tags = regions.selectExpr("case when r_regionkey = 0 then 'metrics/click' when r_regionkey = 1 then 'metrics/view' "
                              "else concat('metrics/none', r_regionkey) end tag")
    return select.save_selection("s1", runs, tags)


@query
def apply_selection(spark, sf):
    d = select.apply_selection(latest(views.sc_events(spark, sf)), _selection(spark, sf))
    return d.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"))


@query
def save_selection(spark, sf):
    return _selection(spark, sf)


@query
def missing_tags(spark, sf):
    t = views.tx_docs(spark, sf).selectExpr("run_id", "concat(tag, '/', step % 9) tag")
    runs = t.agg(F.min("run_id").alias("a"), F.max("run_id").alias("b"))
    have = t.join(runs.select(F.col("a").alias("run_id")), "run_id", "left_semi").select("tag").distinct()
    lack = t.join(runs.select(F.col("b").alias("run_id")), "run_id", "left_semi").select("tag").distinct()
    both = have.withColumn("run_id", F.lit("a")).unionByName(lack.withColumn("run_id", F.lit("b")))
    return select.missing_tags(both, "a", "b")


@query
def natural_sort(spark, sf):
    """Sort key of each tag under natural order."""
    tags = views.table(spark, sf, "supplier").selectExpr("concat('Layers.', s_suppkey % 120, '/w') tag").distinct()
    return select.natural_order(tags).select("tag", natural_key(F.col("tag")).alias("sort_key"))


def _accented(spark, sf):
    """Names in upper and lower case, some with accents."""
    return views.table(spark, sf, "nation").selectExpr(
        "n_nationkey", """replace(case when n_nationkey % 2 = 0 then n_name else lower(n_name) end,
                               case when n_nationkey % 3 = 0 then 'A' else 'a' end, case when n_nationkey % 3 = 0 then 'Ä' else 'á' end) name""")


@query
def natural_sort_locale(spark, sf):
    """Position of each tag by locale, numbers as numbers."""
    numbers = views.table(spark, sf, "customer").selectExpr("c_nationkey n_nationkey", "c_custkey % 12 * 7 number")
    tags = numbers.join(_accented(spark, sf), "n_nationkey").selectExpr("concat(name, '/layers.', number) tag").distinct()
    return select.natural_places(tags).select("tag", "place")


@query
def run_sort(spark, sf):
    """Position of each run by display name, its id where it has none."""
    runs = _accented(spark, sf).selectExpr("concat('run_', n_nationkey) run_id", "if(n_nationkey = 7, '', name) display_name")
    return select.run_places(select.with_display_name(runs.select("run_id"), runs)).select("run_id", "display_name", "place")


@query
def clean_tags(spark, sf):
    d = views.sc_dirty(spark, sf).select("tag", clean_tag(F.col("tag")).alias("clean"))
    return d.distinct()


# --- texts -------------------------------------------------------------------

@query
def text_collapse(spark, sf):
    return texts.collapse(views.tx_labels(spark, sf)).select(*SERIES, "i", "step", "text", "rec")


@query
def text_index(spark, sf):
    c = texts.collapse(views.tx_docs(spark, sf).drop("text"))
    return texts.text_index(c).select(*SERIES, "i", "step", "wall_time", "chars")


@query
def text_step_ordinal(spark, sf):
    c = texts.text_index(texts.collapse(views.tx_labels(spark, sf).drop("text")))
    return c.filter("at_step > 1").select(*SERIES, "i", "step", "ordinal")


@query
def text_counts(spark, sf):
    return texts.text_counts(texts.collapse(views.tx_docs(spark, sf).drop("text")))


@query
def text_lookup(spark, sf):
    """Entry ids for even conversations' turns, some of them only steps."""
    c = texts.collapse(views.tx_conv(spark, sf))
    wanted = views.tx_conv(spark, sf).selectExpr("run_id", "tag", "step i")
    return texts.lookup(c, wanted).select(*SERIES, "i", "entry", "text")


@query
def text_retag(spark, sf):
    docs = views.tx_docs(spark, sf).withColumn(
        "tag", F.concat(F.lit("config/2024"), F.lpad((F.col("rec") % 7).cast("string"), 4, "0"), F.lit("/lang")))
    return texts.retag_texts(texts.collapse(docs)).select(*SERIES, "i", "old_tag", "old_i", "step", "rec")


def _next_entries(index):
    """Each entry beside the one after it in its tag."""
    a = index.select(F.col("run_id").alias("run_a"), F.col("tag").alias("tag_a"), F.col("i").alias("i_a"))
    b = index.select(F.col("run_id").alias("run_b"), F.col("tag").alias("tag_b"), F.col("i").alias("i_b"))
    on = (F.col("run_a") == F.col("run_b")) & (F.col("tag_a") == F.col("tag_b")) & (F.col("i_a") + 1 == F.col("i_b"))
    return a.join(b, on)


@query
def text_pairs(spark, sf):
    lab = views.tx_labels(spark, sf)
    c = texts.collapse(lab.drop("text"))
    return texts.bodies_of_pairs(texts.pair_texts(c, _next_entries(texts.text_index(c))), texts.bodies(lab))


@query
def line_diff(spark, sf):
    """Every short text against the next one of its tag, line by line."""
    return compare.text_history(views.tx_labels(spark, sf))[0]


@query
def line_diff_summary(spark, sf):
    """The same as counts of added and removed lines."""
    return compare.text_history(views.tx_labels(spark, sf))[1]


@query
def line_diff_long(spark, sf):
    """Long texts against the next one of their tag: added and removed lines."""
    return compare.text_history(views.tx_docs(spark, sf))[1]


@query
def line_diff_rows(spark, sf):
    """The same, line by line: texts of many lines that repeat and move."""
    return compare.text_history(views.tx_docs(spark, sf))[0]


@query
def line_diff_boxes(spark, sf):
    """The same, with every text of more than eight lines cut into boxes on both sides."""
    docs = views.tx_docs(spark, sf)
    pairs = texts.bodies_of_pairs(texts.successive(texts.collapse(docs.drop("text"))), texts.bodies(docs))
    return diff.line_diff(pairs, [*SERIES, "i"], box_lines=8)


@query
def line_diff_runs(spark, sf):
    """Every turn of a conversation against the same turn of its role in the next one."""
    conv = views.tx_conv(spark, sf)
    entries = texts.text_index(texts.collapse(conv.drop("text")))
    after = F.concat(F.lit("conv_"), F.substring("run_id", 6, 20).cast("long") + 1)
    pairs = entries.select(F.col("run_id").alias("run_a"), F.col("tag").alias("tag_a"), F.col("i").alias("i_a"),
                           after.alias("run_b"), F.col("tag").alias("tag_b"), F.col("i").alias("i_b"))
    return compare.compare_pairs(conv, pairs)[0]


# --- tags --------------------------------------------------------------------

def _tree_tags(spark, sf):
    return views.sc_lineitem(spark, sf).select("tag").distinct()


@query
def tag_prefix_counts(spark, sf):
    return tagtree.prefix_counts(_tree_tags(spark, sf))


@query
def numeric_collapse(spark, sf):
    return tagtree.numeric_groups(_tree_tags(spark, sf)).select("parent", "name", "siblings", "n_tags")


@query
def tag_paths(spark, sf):
    return tagtree.tag_paths(_tree_tags(spark, sf))


@query
def tag_tree(spark, sf):
    return tagtree.tag_tree(_tree_tags(spark, sf)).select(
        "path", "parent", "name", F.col("depth").cast("bigint").alias("depth"), "n_tags", "tag", "synthetic", "is_group")


@query
def tag_tree_sources(spark, sf):
    """Chains of single children, integer levels and lone tags."""
    tags = views.table(spark, sf, "customer").selectExpr(
        "concat('net/', c_mktsegment, '.block.', c_nationkey, '/bias_', c_custkey % 3) tag")
    return tagtree.tag_paths(tags)


@query
def child_limit(spark, sf):
    tree = tagtree.tag_tree(_tree_tags(spark, sf))
    return tagtree.listed_children(tree, 3).select("parent", "name", F.col("place").cast("bigint").alias("place"), "more")


@query
def selected_counts(spark, sf):
    tags = _tree_tags(spark, sf)
    sel = tags.filter("tag like '%expert_idx_0' or tag like 'train/A/%'")
    return tagtree.selected_counts(tagtree.node_tags(tags), sel)


# --- whole store -------------------------------------------------------------

@query
def retag(spark, sf):
    d = reshape.retag(views.sc_dirty(spark, sf))
    return d.select(*SERIES, "step", r6("wall_time"), r6("value"), "rec")


@query
def retag_report(spark, sf):
    return reshape.retag_report(views.sc_dirty(spark, sf))


@query
def fan_out(spark, sf):
    one = latest(views.sc_events(spark, sf).filter("run_id = 'run_1'"))
    out = reshape.fan_out(one, 40, "copy_")
    return out.groupBy("run_id", "tag").agg(F.count(F.lit(1)).alias("points"), F.sum("step").alias("steps"))


@query
def fan_out_names(spark, sf):
    names = views.table(spark, sf, "region").selectExpr("r_name run_id", "if(r_regionkey = 1, '', r_name) display_name")
    return reshape.fan_out_names(names.filter("run_id = 'ASIA'"), 12, "run_")


@query
def config_values(spark, sf):
    return config.config_pairs(views.cfg_lines(spark, sf))


# --- files, store and ingest -------------------------------------------------

def _ingested(spark, sf):
    """``sc_events`` and ``tx_labels`` written as event files in two steps, each taken in by one pass."""
    folder = eventlog.fresh_folder(spark, "runs")
    job = Ingest(Store(spark, eventlog.fresh_folder(spark, "store")), folder)
    ev = views.sc_events(spark, sf).withColumn("text", F.lit(None).cast("string"))
    tx = views.tx_labels(spark, sf).withColumn("value", F.lit(None).cast("float"))
    eventlog.write_event_files(ev.filter("rec % 3 > 0"), folder, "a")
    job.write(eventfiles.list_event_files(spark, folder), 0)
    eventlog.write_event_files(ev.filter("rec % 3 = 0").unionByName(tx, allowMissingColumns=True), folder, "b")
    job.write(eventfiles.list_event_files(spark, folder), 2)
    return job


@query
def event_file_scan(spark, sf):
    """Event files decoded in small stretches, without a store."""
    folder = eventlog.fresh_folder(spark, "runs")
    ev = views.sc_events(spark, sf).withColumn("text", F.lit(None).cast("string"))
    eventlog.write_event_files(ev, folder, "a")
    files = eventfiles.list_event_files(spark, folder)
    rows = eventfiles.read_events(files, split_bytes=1 << 16)
    return rows.select(*SERIES, "kind", "step", r6("wall_time"), finite_or_null(F.round("value", 6)).alias("value"))


@query
def event_file_cut(spark, sf):
    """One file that holds everything, cut into stretches by many tasks: each record with its number."""
    folder = eventlog.fresh_folder(spark, "runs")
    ev = views.sc_events(spark, sf).withColumns({"text": F.lit(None).cast("string"), "tag": F.concat("run_id", F.lit("/"), "tag"), "run_id": F.lit("all")})
    eventlog.write_event_files(ev, folder, "a")
    rows = eventfiles.read_events(eventfiles.list_event_files(spark, folder), split_bytes=1 << 14)
    return rows.select("tag", "step", r6("wall_time"), finite_or_null(F.round("value", 6)).alias("value"),
                       F.floor(F.col("rec") / eventfiles.REC_SCALE).alias("record"))


@query
def event_file_texts(spark, sf):
    """Bodies of text records."""
    folder = eventlog.fresh_folder(spark, "runs")
    tx = views.tx_docs(spark, sf).withColumn("value", F.lit(None).cast("float"))
    eventlog.write_event_files(tx, folder, "a")
    rows = eventfiles.read_events(eventfiles.list_event_files(spark, folder), "text")
    return rows.select(*SERIES, "step", r6("wall_time"), "text")


def _nested_files(spark, sf):
    """Files in the run and below folders of which some are time stamps or ids."""
    folder = eventlog.fresh_folder(spark, "runs")
    ev = views.sc_events(spark, sf).withColumn("text", F.lit(None).cast("string"))
    for k, below in enumerate(("", "metrics/20260618_101116_148035/auto", "1700000000", "eval_10")):
        eventlog.write_event_files(ev.filter(F.col("rec") % 4 == k), folder, "a", below)
    return eventfiles.list_event_files(spark, folder)


@query
def event_file_listing(spark, sf):
    return eventfiles.in_order(_nested_files(spark, sf)).select("run_id", "relkey", "prefix", "place")


@query
def event_file_nested(spark, sf):
    rows = eventfiles.read_events(_nested_files(spark, sf))
    return rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"), F.sum("step").alias("steps"))


def _counted(spark, sf):
    """As _ingested, with configuration files, one file per run and step, and a file with an undecodable record."""
    folder = eventlog.fresh_folder(spark, "runs")
    job = Ingest(Store(spark, eventlog.fresh_folder(spark, "store")), folder)
    eventlog.write_configs(views.cfg_lines(spark, sf), folder)
    ev = views.sc_events(spark, sf).withColumn("text", F.lit(None).cast("string"))
    tx = views.tx_labels(spark, sf).withColumn("value", F.lit(None).cast("float"))
    eventlog.write_event_files(ev.filter("rec % 3 > 0"), folder, "a")
    job.write(eventfiles.list_event_files(spark, folder), 0)
    eventlog.write_event_files(ev.filter("rec % 3 = 0").unionByName(tx, allowMissingColumns=True), folder, "b")
    three = ev.filter("rec between 1 and 3").withColumns({
        "run_id": F.lit("run_z"), "tag": F.lit("z"), "step": F.col("rec"), "value": F.when(F.col("rec") != 2, F.col("rec").cast("float"))})
    eventlog.write_event_files(three, folder, "z")
    job.write(eventfiles.list_event_files(spark, folder), 2)
    return job


@query
def ingest_counters(spark, sf):
    """What each of two passes read and added; the second meets a record that cannot be decoded."""
    return _counted(spark, sf).store.passes().select(
        "seg", "runs", "files", "new_files", "records", "bad_records", "new_rows", "new_tags", "new_texts")


@query
def ingest_run_summary(spark, sf):
    """Runs as listed from what passes left, with configuration."""
    runs = _counted(spark, sf).store.list_runs()
    pairs = F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return runs.select("run_id", "display_name", "num_tags", "num_rows", "num_event_files", "step_min", "step_max",
                       "num_text_tags", F.array_join(pairs, ";").alias("config"))


@query
def ingest_series(spark, sf):
    """Points of all runs after two incremental passes."""
    p = _ingested(spark, sf).store.get_series(None, None, 0).points
    return p.select(*SERIES, "step", r6("wall_time"), r6("value"), "count")


@query
def ingest_texts(spark, sf):
    """Entries with their bodies after two passes: text of the first pass and text of the second, collapsed together."""
    folder = eventlog.fresh_folder(spark, "runs")
    job = Ingest(Store(spark, eventlog.fresh_folder(spark, "store")), folder)
    tx = views.tx_conv(spark, sf).withColumn("value", F.lit(None).cast("float"))
    for seg, even in ((0, 0), (2, 1)):
        eventlog.write_event_files(tx.filter(F.col("rec") % 2 == even), folder, "ab"[even])
        job.write(eventfiles.list_event_files(spark, folder), seg)
    return job.store.texts().select(*SERIES, "i", "step", "text")


@query
def ingest_bodies(spark, sf):
    """What is stored of the bodies: each different text once, whatever runs, tags and passes logged it."""
    bodies = _ingested(spark, sf).store.table("bodies")
    return bodies.groupBy("text").agg(F.count(F.lit(1)).alias("times"))


@query
def text_import(spark, sf):
    """Nested texts as an older store holds them, as entries."""
    entry = F.struct(F.col("step"), F.col("wall_time"), F.col("text"))
    conv = views.tx_conv(spark, sf).groupBy("run_id", "tag").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    nested = conv.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "e"))).alias("texts"))
    return texts.collapse(import_nested_texts(nested)).select(*SERIES, "i", "step", "text")


@query
def text_head_scan(spark, sf):
    """Text near the beginning of each file: left after 20 records without text, or 20 after the last text."""
    folder = eventlog.fresh_folder(spark, "runs")
    ev = views.sc_events(spark, sf).withColumn("text", F.when(F.expr("rec % 1000 < 60 or rec % 1000 between 300 and 310"), F.concat(F.lit("note "), F.col("rec"))))
    ev = ev.withColumns({"value": F.when(F.col("text").isNull(), F.lit(1.0).cast("float")), "run_id": F.concat(F.lit("block_"), F.floor(F.col("rec") / 500))})
    eventlog.write_event_files(ev, folder, "a")
    rows = eventfiles.read_head_texts(eventfiles.list_event_files(spark, folder), head=20, gap=20)
    return rows.select(*SERIES, "step", "text")


@query
def suggest_tags_limit(spark, sf):
    """The first five matches and the number of all."""
    return select.suggest_tags(_tags(spark, sf), "layers.2", limit=5)


@query
def gaps_limit(spark, sf):
    """The earliest two breaks of each series."""
    return gap_markers(latest(views.sc_events(spark, sf)), limit=2).select(*SERIES, "step", "kind", r6("y"))


@query
def tag_paths_single(spark, sf):
    """A top level with one tag is one leaf, however deep the tag."""
    tags = views.table(spark, sf, "nation").selectExpr("concat('net', char(65 + n_nationkey), '/only.', n_nationkey, '/deep/leaf') tag")
    return tagtree.tag_paths(tags)


@query
def ingest_refresh(spark, sf):
    """What a refresh of some runs adds after a first pass."""
    folder = eventlog.fresh_folder(spark, "runs")
    job = Ingest(Store(spark, eventlog.fresh_folder(spark, "store")), folder)
    ev = views.sc_events(spark, sf).withColumn("text", F.lit(None).cast("string"))
    eventlog.write_event_files(ev.filter("rec % 3 > 0"), folder, "a")
    job.write(eventfiles.list_event_files(spark, folder), 0)
    eventlog.write_event_files(ev.filter("rec % 3 = 0"), folder, "b")
    return job.refresh(["run_1", "run_4", "run_none"])


@query
def ingest_backfill(spark, sf):
    """Text of runs whose points were stored without it, read afterwards: entries per run."""
    folder = eventlog.fresh_folder(spark, "runs")
    job = Ingest(Store(spark, eventlog.fresh_folder(spark, "store")), folder)
    tx = views.tx_labels(spark, sf).withColumn("value", F.lit(None).cast("float"))
    eventlog.write_event_files(tx, folder, "a")
    points = latest(views.tx_labels(spark, sf).withColumn("value", F.col("rec").cast("float")))
    write_segment(points, job.store.path("scalars", 0), "scalars")
    write_segment(stats.tag_stats(points), job.store.path("tag_stats", 0), "tag_stats")
    listing = eventfiles.list_event_files(spark, folder)
    write_segment(listing.withColumns({"consumed": F.col("size"), "records": F.lit(0)}), job.store.path("files", 0), "files")
    return job.backfill_texts()


@query
def ingest_compacted(spark, sf):
    """Downsampled series of a compacted store: points in one scan, positions from the index."""
    store = _ingested(spark, sf).store
    store.compact()
    p = store.get_series(None, None, 30).points
    return p.select(*SERIES, "step", r6("wall_time"), r6("value"), "count")


@query
def ingest_gaps(spark, sf):
    """Breaks of the series of a compacted store, from the index."""
    store = _ingested(spark, sf).store
    store.compact()
    g = store.get_series(None, None, 30).gaps
    return g.select(*SERIES, "step", r6("wall_time"), "kind", r6("y"))


@query
def ingest_runs(spark, sf):
    store = _ingested(spark, sf).store
    return store.list_runs().select("run_id", "display_name", "num_tags", "step_min", "step_max", "num_text_tags")


@query
def ingest_retag_compact(spark, sf):
    """Points of a store that was written in two segments, re-tagged and so merged into one."""
    store = Store(spark, eventlog.fresh_folder(spark, "store"))
    d = views.sc_dirty(spark, sf)
    for seg in (0, 2):
        part = latest(d.filter(F.col("rec") % 4 < 3) if seg else d.filter(F.col("rec") % 4 > 1))
        write_segment(part, store.path("scalars", seg), "scalars")
        write_segment(stats.tag_stats(part), store.path("tag_stats", seg), "tag_stats")
        read = part.select("run_id").distinct().withColumns({
            "relkey": F.lit(f"part-{seg}"), "size": F.lit(0), "mtime": F.lit(0.0), "consumed": F.lit(0), "records": F.lit(0)})
        write_segment(read, store.path("files", seg), "files")  # last: the segment is finished
    store.retag()
    s = store.tag_stats()
    return s.select(*SERIES, "count", "min_step", "max_step", r6("last_value"))
