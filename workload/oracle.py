"""The same results in SQL, over the same tables."""

from __future__ import annotations

from .views import with_views

ORACLE: dict[str, str] = {}

LATEST = """{v}_d as (
  select * exclude (rn) from (
    select *, row_number() over (partition by run_id, tag, step order by wall_time desc, src desc, rec desc) rn
    from {v}) where rn = 1)"""


def latest(v: str) -> str:
    return with_views(v) + ",\n" + LATEST.format(v=v)


FIN = "case when isfinite({0}) then {0}::double end"
VAL = FIN.format("value")

ORACLE["dedup_latest"] = latest("sc_events") + f"""
select run_id, tag, step, round(wall_time, 6) wall_time, {VAL} as value, rec from sc_events_d"""

ORACLE["series_raw"] = latest("sc_events") + f"""
select case run_id when 'run_3' then 0 else 2 end::bigint place, run_id, tag, step, round(wall_time, 6) wall_time, round({VAL}, 6) as value,
       count(*) over (partition by run_id, tag) as count
from sc_events_d where run_id in ('run_1', 'run_3', 'run_missing') and tag in ('metrics/click', 'metrics/view')"""


def lttb(v: str, m: int) -> str:
    """Common table expressions ending in ``lt`` (run_id, tag, step, wall_time, value, n)."""
    fin = "(case when isfinite({0}) then {0}::double else 0 end)"
    key = (f"struct_pack(a := -abs((r.x - nx.ax) * ({fin.format('c.value')} - r.y) "
           f"- (r.x - c.step) * (nx.ay - r.y)), k := c.k)")
    return latest(v) + f""",
  i as (select run_id, tag, step, wall_time, value, row_number() over (partition by run_id, tag order by step) - 1 k,
               count(*) over (partition by run_id, tag) n from {v}_d),
  b as (select *, case when k = 0 then -1 when k = n - 1 then {m - 2}
          else (select max(j) from range(0, {m - 2}) r(j) where floor(j * ((n - 2)::double / {m - 2}) + 1) <= k) end b
        from i where n > {m}),
  nx as (select run_id, tag, b - 1 b, avg(step) ax, avg({fin.format('value')}) ay from b group by all),
  r as (select run_id, tag, b, step::double x, {fin.format('value')} y, step from b where b = -1
    union all
    select c.run_id, c.tag, c.b, arg_min(c.step::double, {key}), arg_min({fin.format('c.value')}, {key}),
           arg_min(c.step, {key})
    from r join b c on c.run_id = r.run_id and c.tag = r.tag and c.b = r.b + 1
           join nx on nx.run_id = c.run_id and nx.tag = c.tag and nx.b = c.b
    group by c.run_id, c.tag, c.b),
  ks as (select run_id, tag, step from r union all select run_id, tag, step from b where b = {m - 2}),
  lt as (select run_id, tag, step, wall_time, value, n from i where n <= {m}
    union all
    select i.run_id, i.tag, i.step, i.wall_time, i.value, i.n from i join ks using (run_id, tag, step))"""


def lttb_query(v: str, m: int) -> str:
    return lttb(v, m) + f"""
select run_id, tag, step, round(wall_time, 6) wall_time, round({VAL}, 6) as value, n as count from lt"""


ORACLE["series_lttb"] = lttb_query("sc_lineitem", 20)
ORACLE["series_lttb_gappy"] = lttb_query("sc_events", 30)
ORACLE["series_nested"] = lttb("sc_events", 30) + f"""
select run_id, tag, 0::bigint part, n as count, step, round({VAL}, 6) as value, round(wall_time, 6) wall_time from lt"""

ORACLE["series_named"] = latest("sc_events") + """
select d.run_id, coalesce(n.n_name, d.run_id) display_name, count(*) points
from sc_events_d d left join nation n on d.run_id = concat('run_', n.n_nationkey) and n.n_nationkey <> 3
group by all"""

GAPS = """,
  g as (
    select *, coalesce(
        last_value(f ignore nulls) over (partition by run_id, tag order by step rows unbounded preceding),
        first_value(f ignore nulls) over (partition by run_id, tag order by step
                                          rows between unbounded preceding and unbounded following), 0) y
    from (select *, case when isfinite(value) then value::double end f from sc_events_d)),
  gm as (
    select run_id, tag, step, wall_time, y,
           case when isnan(value) then 'nan' when value > 0 then '+inf' else '-inf' end kind
    from g where f is null
    qualify row_number() over (partition by run_id, tag order by step) <= 2000)"""

ORACLE["gaps"] = latest("sc_events") + GAPS + """
select run_id, tag, step, round(wall_time, 6) wall_time, kind, round(y, 6) y from gm"""
ORACLE["gaps_window"] = latest("sc_events") + GAPS + """
select run_id, kind, count(*) markers from gm where step between 20 and 70 group by all"""

ORACLE["ema"] = latest("sc_events") + """,
  e as (select *, isfinite(value) ok,
               sum(case when isfinite(value) then 1 else 0 end) over (partition by run_id, tag order by step) k
        from sc_events_d)
select run_id, tag, step,
       case when ok then round(0.4 * pow(0.6, k) * sum(case when ok then value::double * pow(0.6, -k) end)
            over (partition by run_id, tag order by step) / (1 - pow(0.6, k)), 4) end smooth
from e"""

ORACLE["step_window"] = lttb("sc_lineitem", 20) + f"""
select run_id, tag, step, round({VAL}, 6) as value, n as count from lt where step between 10000 and 40000"""
ORACLE["step_window_first"] = latest("sc_lineitem") + f"""
select run_id, tag, step, round({VAL}, 6) as value, count(*) over (partition by run_id, tag) as count
from sc_lineitem_d where step between 10000 and 40000"""
ORACLE["relative_time"] = latest("sc_events") + """
select run_id, tag, step,
       round((wall_time - first_value(wall_time) over (partition by run_id, tag order by step)) / 60.0, 4) as minutes
from sc_events_d"""
ORACLE["series_view"] = lttb("sc_lineitem", 20) + """,
  e as (select *, row_number() over (partition by run_id, tag order by step) k from lt
        where step between 10000 and 50000)
select run_id, tag, step,
       round(log10(0.4 * pow(0.6, k) * sum(value::double * pow(0.6, -k)) over (partition by run_id, tag order by step)
             / (1 - pow(0.6, k))), 7) log_smooth
from e"""

RANGE = """
select {by}, n, case when n >= 5 and hi > lo then {lo} end y_lo, case when n >= 5 and hi > lo then {hi} end y_hi
from (select {by}, count(v) n, quantile_cont(v, {ql}) lo, quantile_cont(v, {qh}) hi
      from (select {by}, case when {cond} then value::double end v from {src}) group by all)"""
PADDED = {"lo": "round(lo - (hi - lo) * 0.05, 4)", "hi": "round(hi + (hi - lo) * 0.05, 4)"}
ORACLE["outlier_range"] = latest("sc_lineitem") + RANGE.format(
    by="tag", ql=0.01, qh=0.99, cond="isfinite(value)", src="sc_lineitem_d", **PADDED)
ORACLE["outlier_range_log"] = latest("sc_events") + RANGE.format(
    by="tag", ql=0.05, qh=0.9, cond="isfinite(value) and value > 0", src="sc_events_d",
    lo="round(log10(greatest(lo, 1e-12)), 6)", hi="round(log10(greatest(hi, 1e-12)), 6)")
ORACLE["single_points"] = latest("sc_events") + """
select run_id, tag, count(*) filter (isfinite(value)) finite, count(*) filter (isfinite(value)) <= 1 is_point
from sc_events_d group by all"""

SIDES = """,
  sides(side, tag) as (values ('A', '{a}'), ('B', '{b}')),
  ov as (select side, d.* from sc_events_d d join sides using (tag))"""
ORACLE["overlay"] = latest("sc_events") + SIDES.format(a="metrics/click", b="metrics/view") + f"""
select side, run_id, tag, step, round({VAL}, 6) as value from ov"""
ORACLE["overlay_ranges"] = latest("sc_events") + SIDES.format(a="metrics/click", b="metrics/error") + RANGE.format(
    by="side", ql=0.01, qh=0.99, cond="isfinite(value)", src="ov", **PADDED)
ORACLE["positive_only"] = latest("sc_events") + """
select tag, count(*) points from sc_events_d where isfinite(value) and value > 0 group by all"""

STATS = """select run_id, {tag} tag, count(*) as count, min(step) min_step, max(step) max_step,
       round(arg_max(value, step)::double, 6) last_value from {v}_d group by all"""
ORACLE["tag_stats"] = latest("sc_lineitem") + STATS.format(tag="tag", v="sc_lineitem")
CLEAN = "regexp_replace(tag, '/[0-9]{8}_[0-9]{6}/', '/')"
ORACLE["stats_fold"] = latest("sc_dirty") + f""",
  s as (select run_id, tag, count(*) c, min(step) a, max(step) b, arg_max(value, step) v from sc_dirty_d group by all)
select run_id, {CLEAN} tag, sum(c)::bigint as count, min(a) min_step, max(b) max_step,
       round(arg_max(v, (b, tag))::double, 6) last_value
from s group by all"""

ORACLE["run_summary"] = latest("sc_events") + """
select d.run_id, coalesce(any_value(n_name), d.run_id) display_name, count(distinct tag) num_tags, count(*) num_rows,
       any_value(f.files) num_event_files, min(step) step_min, max(step) step_max, round(any_value(f.newest), 6) updated_at
from sc_events_d d
join (select run_id, count(distinct src) files, max(wall_time) as newest from sc_events group by all) f using (run_id)
left join nation on d.run_id = concat('run_', n_nationkey)
group by d.run_id"""
ORACLE["step_extent"] = with_views("sc_lineitem") + """
select coalesce(min(step), 0) step_min, coalesce(max(step), 0) step_max from sc_lineitem
where run_id in ('run_F', 'run_missing')"""
ORACLE["files_per_run"] = with_views("sc_events") + """
select run_id, count(distinct src) num_event_files, round(max(wall_time), 6) updated_at from sc_events group by all"""
ORACLE["group_counts"] = with_views("sc_events", "sc_lineitem") + """,
  t as (select tag from sc_events union select tag from sc_lineitem union
        select concat('Net', c_nationkey, '/', c_mktsegment) from customer),
  g as (select split_part(tag, '/', 1) "group", count(*) tags, min(tag) first_tag from t group by all)
select *, row_number() over (order by lower(regexp_replace("group", '[0-9]+', '')), coalesce(try_cast(regexp_extract("group", '[0-9]+') as int), -1)) - 1 as "position"
from g"""

ORACLE["tag_names"] = with_views("sc_events") + """
select distinct tag from sc_events where run_id in ('run_0', 'run_1')"""
ORACLE["tag_search"] = with_views("sc_lineitem") + """
select distinct tag from sc_lineitem where regexp_matches(tag, '(?i)A/LAYERS\\.[12]\\.')"""
ORACLE["tag_search_literal"] = """
select distinct concat('loss(', c_mktsegment, ')/', c_nationkey) tag from customer"""
ORACLE["run_search"] = """
select concat('run_', c_custkey) run_id, c_name display_name from customer
where contains(lower(c_name), 'er#00000001') or contains(concat('run_', c_custkey), 'er#00000001')"""
ORACLE["suggest_tags"] = with_views("sc_lineitem") + """
select tag, count(*) over () matches from (select distinct tag from sc_lineitem where contains(lower(tag), 'r/layers.3'))
order by tag limit 50"""

SEL = """sel as (
    select 's1' sel_id, 'run' kind, concat('run_', r_regionkey * 2 + 1) as key from region
    union
    select 's1', 'tag', case when r_regionkey = 0 then 'metrics/click' when r_regionkey = 1 then 'metrics/view'
                             else concat('metrics/none', r_regionkey) end from region)"""
ORACLE["save_selection"] = "with " + SEL + " select * from sel"
ORACLE["apply_selection"] = latest("sc_events") + ",\n" + SEL + """
select run_id, tag, count(*) points from sc_events_d
where run_id in (select key from sel where kind = 'run') and tag in (select key from sel where kind = 'tag')
group by all"""
ORACLE["missing_tags"] = with_views("tx_docs") + """,
  t as (select run_id, concat(tag, '/', step % 9) tag from tx_docs)
select distinct tag from t where run_id = (select min(run_id) from t)
  and tag not in (select tag from t where run_id = (select max(run_id) from t))"""
ORACLE["natural_sort"] = """
select distinct concat('Layers.', s_suppkey % 120, '/w') tag,
       concat('layers.', lpad(length((s_suppkey % 120)::varchar)::varchar, 10, '0'), s_suppkey % 120, '/w') sort_key
from supplier"""
ACCENTED = """with a as (select n_nationkey, replace(case when n_nationkey % 2 = 0 then n_name else lower(n_name) end,
    case when n_nationkey % 3 = 0 then 'A' else 'a' end, case when n_nationkey % 3 = 0 then 'Ä' else 'á' end) name from nation)"""
ORACLE["natural_sort_locale"] = ACCENTED + """
select concat(name, '/layers.', k) tag, row_number() over (order by n_nationkey, k) - 1 place
from (select distinct name, n_nationkey, c_custkey % 12 * 7 k from customer join a on c_nationkey = n_nationkey)"""
ORACLE["run_sort"] = ACCENTED + """
select concat('run_', n_nationkey) run_id, case when n_nationkey = 7 then 'run_7' else name end display_name,
       row_number() over (order by strip_accents(lower(case when n_nationkey = 7 then 'run_7' else name end))) - 1 place from a"""
ORACLE["clean_tags"] = with_views("sc_dirty") + f"""
select distinct tag, {CLEAN} as clean from sc_dirty"""

# --- texts ---

COLLAPSED = """{v}_c as (
  select *, row_number() over (partition by run_id, tag order by step, src, rec) - 1 i
  from (select *, lag(text) over (partition by run_id, tag order by step, src, rec) prev from {v})
  where text is distinct from prev)"""


def collapsed(v: str) -> str:
    return with_views(v) + ",\n" + COLLAPSED.format(v=v)


ORACLE["text_collapse"] = collapsed("tx_labels") + """
select run_id, tag, i, step, text, rec from tx_labels_c"""
ORACLE["text_index"] = collapsed("tx_docs") + """
select run_id, tag, i, step, wall_time, length(text) chars from tx_docs_c"""
ORACLE["text_step_ordinal"] = collapsed("tx_labels") + """
select run_id, tag, i, step, row_number() over (partition by run_id, tag, step order by i) as "ordinal"
from tx_labels_c qualify count(*) over (partition by run_id, tag, step) > 1"""
ORACLE["text_counts"] = collapsed("tx_docs") + """
select run_id, count(*) entries, count(distinct tag) tags, sum(length(text))::bigint chars from tx_docs_c group by all"""
ORACLE["text_lookup"] = collapsed("tx_conv") + """,
  w as (select distinct run_id, tag, step i from tx_conv)
select w.run_id, w.tag, w.i, coalesce(a.i, b.i) entry, coalesce(a.text, b.text) as text
from w left join tx_conv_c a on a.run_id = w.run_id and a.tag = w.tag and a.i = w.i
       left join (select run_id, tag, step, min(i) i, arg_min(text, i) as text from tx_conv_c group by all) b
         on b.run_id = w.run_id and b.tag = w.tag and b.step = w.i"""
ORACLE["text_retag"] = """with x as (
  select concat('run_', source) run_id, 'config/2024' || lpad((doc_id % 7)::varchar, 4, '0') || '/lang' old_tag,
         doc_id // 50 step, text, doc_id rec from documents),
  c as (select *, row_number() over (partition by run_id, old_tag order by step, rec) - 1 old_i
        from (select *, lag(text) over (partition by run_id, old_tag order by step, rec) prev from x)
        where text is distinct from prev)
select run_id, 'config/lang' tag, row_number() over (partition by run_id order by step, old_tag, old_i) - 1 i,
       old_tag, old_i, step, rec from c"""
PAIRS = """,
  pairs as (
    select a.run_id run_a, a.tag tag_a, a.i i_a, b.run_id run_b, b.tag tag_b, b.i i_b,
           a.text text_a, b.text text_b
    from tx_labels_c a join tx_labels_c b on a.run_id = b.run_id and a.tag = b.tag and a.i + 1 = b.i)"""
ORACLE["text_pairs"] = collapsed("tx_labels") + PAIRS + """
select * from pairs"""
# These texts have two lines, of which none can equal a line in another place.
DIFF = PAIRS + """,
  l as (select run_a run_id, tag_a tag, i_a i,
               split_part(text_a, chr(10), 1) a1, split_part(text_a, chr(10), 2) a2,
               split_part(text_b, chr(10), 1) b1, split_part(text_b, chr(10), 2) b2 from pairs),
  ops as (select * exclude (a1, a2, b1, b2), case
      when a1 = b1 and a2 = b2 then [(' ', a1), (' ', a2)]
      when a1 = b1 then [(' ', a1), ('-', a2), ('+', b2)]
      when a2 = b2 then [('-', a1), ('+', b1), (' ', a2)]
      else [('-', a1), ('-', a2), ('+', b1), ('+', b2)] end ops from l)"""
ORACLE["line_diff"] = collapsed("tx_labels") + DIFF + """
select run_id, tag, i, (n - 1)::bigint line_no, ops[n][1] op, ops[n][2] line
from (select *, unnest(range(1, len(ops) + 1)) n from ops)"""
ORACLE["line_diff_summary"] = collapsed("tx_labels") + DIFF + """
select run_id, tag, i, len([x for x in ops if x[1] = '+'])::bigint added,
       len([x for x in ops if x[1] = '-'])::bigint removed, len([x for x in ops if x[1] <> ' ']) = 0 as identical
from ops"""



def lcs(pairs: str, keys: str) -> str:
    """Lengths of common subsequences of all line suffixes of ``pairs`` (keys, text_a, text_b), row by row from the last line."""
    return f""",
  p as materialized (select row_number() over () id, {keys}, string_split(text_a, chr(10)) x, string_split(text_b, chr(10)) y,
        text_a, text_b from {pairs}),
  dp(id, i, row) as (
    select id, len(x) + 1, list_transform(range(len(y) + 1), lambda j: 0::bigint) from p
    union all
    select id, i, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[j:])) from (
      select p.id, dp.i - 1 i, list_append(list_transform(range(1, len(y) + 1), lambda j:
          case when y[j] = x[dp.i - 1] then dp.row[j + 1] + 1 else dp.row[j] end), 0::bigint) cand
      from dp join p using (id) where dp.i > 1))"""


def walk(keys: str) -> str:
    """The difference along these lengths: equal lines, else the first text's line as long as nothing is lost."""
    return f""",
  t as materialized (select * from dp),
  w(id, ax, ay, line_no, op, line) as (
    select id, 1::bigint, 1::bigint, -1::bigint, '', '' from p
    union all
    select id, case when o = '+' then ax else ax + 1 end, case when o = '-' then ay else ay + 1 end, line_no + 1, o,
           case when o = '+' then y[ay] else x[ax] end
    from (select w.id, w.ax, w.ay, w.line_no, p.x, p.y, case when w.ay > len(p.y) then '-' when w.ax > len(p.x) then '+'
            when p.x[w.ax] = p.y[w.ay] then ' ' when b.row[w.ay] >= a.row[w.ay + 1] then '-' else '+' end o
          from w join p using (id) left join t a on a.id = w.id and a.i = w.ax left join t b on b.id = w.id and b.i = w.ax + 1
          where w.ax <= len(p.x) or w.ay <= len(p.y)))
select {keys}, line_no, op, line from w join p using (id) where line_no >= 0"""


NEXT = """,
  pairs as (select a.run_id, a.tag, a.i, a.text text_a, b.text text_b
    from tx_docs_c a join tx_docs_c b on a.run_id = b.run_id and a.tag = b.tag and a.i + 1 = b.i)"""
ORACLE["line_diff_long"] = collapsed("tx_docs") + NEXT + lcs("pairs", "run_id, tag, i") + """
select run_id, tag, i, len(y) - row[1] added, len(x) - row[1] removed, text_a = text_b as identical
from p join (select id, row from dp where i = 1) using (id)"""
ORACLE["line_diff_rows"] = collapsed("tx_docs") + NEXT + lcs("pairs", "run_id, tag, i") + walk("run_id, tag, i")
ORACLE["line_diff_boxes"] = ORACLE["line_diff_rows"]
CONV = """,
  pairs as (select a.run_id run_a, a.tag tag_a, a.i i_a, b.run_id run_b, b.tag tag_b, b.i i_b, a.text text_a, b.text text_b
    from tx_conv_c a join tx_conv_c b on a.tag = b.tag and a.i = b.i
     and 'conv_' || (substr(a.run_id, 6)::bigint + 1) = b.run_id)"""
KEYS = "run_a, tag_a, i_a, run_b, tag_b, i_b"
ORACLE["line_diff_runs"] = collapsed("tx_conv") + CONV + lcs("pairs", KEYS) + walk(KEYS)

# --- tags ---

TREE = with_views("sc_lineitem") + """,
  t as (select distinct tag, l_returnflag f, l_linenumber n, l_suppkey % 6 e from (
    select *, concat('train/', l_returnflag, '/layers.', l_linenumber, '.expert_idx_', l_suppkey % 6) tag from lineitem))"""
ORACLE["tag_prefix_counts"] = TREE + """,
  p as (select regexp_split_to_array(tag, '[/.]') k from t),
  q as (select k, unnest(range(1, len(k) + 1)) d from p)
select d::integer depth, array_to_string(k[1:d], '/') path, count(*) n_tags from q group by all"""
ORACLE["numeric_collapse"] = TREE + """
select concat('train/', f, '/layers/', n) parent, 'expert_idx_∗' as name, count(*) siblings, count(*) n_tags
from t group by all having count(*) >= 4"""
LEAF = "concat('train/', f, '/layers/', n, '/expert_idx_∗/expert_idx_', e)"
ORACLE["tag_paths"] = TREE + f"""
select tag, {LEAF} as path from t"""
NODES = TREE + """,
  lv as (
    select tag, unnest([
      {'d': 1, 'path': 'train', 'parent': '', 'name': 'train', 's': false},
      {'d': 2, 'path': concat('train/', f, '/layers'), 'parent': 'train', 'name': concat(f, '/layers'), 's': false},
      {'d': 3, 'path': concat('train/', f, '/layers/', n), 'parent': concat('train/', f, '/layers'), 'name': n::varchar, 's': false},
      {'d': 4, 'path': concat('train/', f, '/layers/', n, '/expert_idx_∗'), 'parent': concat('train/', f, '/layers/', n), 'name': 'expert_idx_∗', 's': true},
      {'d': 5, 'path': concat('train/', f, '/layers/', n, '/expert_idx_∗/expert_idx_', e), 'parent': concat('train/', f, '/layers/', n, '/expert_idx_∗'), 'name': concat('expert_idx_', e), 's': false}]) x
    from t),
  nodes as (select x.path as path, x.parent as parent, x.name as name, x.d::bigint depth, count(*) n_tags,
                   max(case when x.d = 5 then tag end) tag, x.s synthetic, x.d < 5 is_group from lv group by all)"""
NODES = NODES.replace("x.d < 5 is_group from lv group by all", "max(x.d) < 5 is_group from lv group by x.path, x.parent, x.name, x.d, x.s")
ORACLE["tag_tree"] = NODES + """
select path, parent, name, depth, n_tags, tag, synthetic, is_group from nodes"""
ORACLE["tag_tree_sources"] = """with t as (
  select distinct concat('net/', c_mktsegment, '.block.', c_nationkey, '/bias_', c_custkey % 3) tag,
         c_mktsegment s, c_nationkey n, c_custkey % 3 b from customer)
select tag, concat('net/', s, '.block/', n, '/bias_', b) as path from t"""
ORACLE["child_limit"] = NODES + """
select parent, name, row_number() over (partition by depth, parent order by name) place,
       greatest(count(*) over (partition by depth, parent) - 3, 0) more
from nodes qualify place <= 3"""
ORACLE["selected_counts"] = NODES + """,
  k as (select x.path as path, count(*) n_tags,
               count(*) filter (tag like '%expert_idx_0' or tag like 'train/A/%') selected from lv group by all)
select path, n_tags, selected,
       case when selected = 0 then 'none' when selected = n_tags then 'all' else 'some' end state from k"""

# --- whole store ---

ORACLE["retag"] = with_views("sc_dirty") + f""",
  x as (select * replace ({CLEAN} as tag) from sc_dirty),
""" + LATEST.format(v="x") + """
select run_id, tag, step, round(wall_time, 6) wall_time, round(value::double, 6) as value, rec from x_d"""
ORACLE["retag_report"] = with_views("sc_dirty") + f"""
select run_id, count(distinct tag) filter (tag <> {CLEAN}) tags_renamed,
       count(distinct tag) - count(distinct {CLEAN}) tags_merged
from sc_dirty group by all"""
ORACLE["fan_out"] = latest("sc_events") + """
select 'copy_' || lpad(i::varchar, 3, '0') run_id, tag, count(*) points, sum(step)::bigint steps
from sc_events_d, range(40) r(i) where run_id = 'run_1' group by all"""
ORACLE["fan_out_names"] = """
select 'run_' || lpad(i::varchar, 3, '0') run_id, 'ASIA #' || lpad(i::varchar, 3, '0') display_name from range(12) r(i)"""
ORACLE["config_values"] = with_views("cfg_lines") + """
select run_id, trim(split_part(line, ':', 1)) as key,
       arg_max(trim(trim(substr(line, instr(line, ':') + 1)), '"'), line_no) as value
from cfg_lines where line not like ' %' and line not like '#%' group by all"""

# --- files, store and ingest ---

ORACLE["event_file_scan"] = with_views("sc_events") + f"""
select run_id, tag, 'scalar' kind, step, round(wall_time, 6) wall_time,
       case when isfinite(value) then round(value::double, 6) end as value from sc_events"""
ORACLE["ingest_series"] = latest("sc_events") + f"""
select run_id, tag, step, round(wall_time, 6) wall_time, round({VAL}, 6) as value,
       count(*) over (partition by run_id, tag) as count from sc_events_d"""
ORACLE["ingest_runs"] = with_views("sc_events", "tx_labels") + """,
  t as (select run_id, count(distinct tag) n from tx_labels group by all),
  s as (select run_id, count(distinct tag) n, min(step) a, max(step) b from sc_events group by all),
  r as (select run_id from t union select run_id from s)
select r.run_id, r.run_id display_name, coalesce(s.n, 0)::bigint num_tags, coalesce(a, 0)::bigint step_min,
       coalesce(b, 0)::bigint step_max, coalesce(t.n, 0)::bigint num_text_tags
from r left join s using (run_id) left join t using (run_id)"""
ORACLE["ingest_retag_compact"] = with_views("sc_dirty") + f""",
  x as (select * replace ({CLEAN} as tag) from sc_dirty),
""" + LATEST.format(v="x") + """
select run_id, tag, count(*) as count, min(step) min_step, max(step) max_step,
       round(arg_max(value, step)::double, 6) last_value from x_d group by all"""

ORACLE["event_file_cut"] = with_views("sc_events") + """
select concat(run_id, '/', tag) tag, step, round(wall_time, 6) wall_time,
       case when isfinite(value) then round(value::double, 6) end as value, row_number() over (order by rec) - 1 record from sc_events"""
ORACLE["event_file_texts"] = with_views("tx_docs") + """
select run_id, tag, step, round(wall_time, 6) wall_time, text from tx_docs"""
NESTED = with_views("sc_events") + """,
  n as (select *, ['', 'metrics/20260618_101116_148035/auto/', '1700000000/', 'eval_10/'][rec % 4 + 1] below,
               ['', 'metrics/auto', '', 'eval_10'][rec % 4 + 1] prefix from sc_events)"""
ORACLE["event_file_listing"] = NESTED + """,
  f as (select distinct run_id, below || 'events.out.tfevents.a.0' relkey, prefix from n)
select *, row_number() over (partition by run_id order by relkey) - 1 place from f"""
ORACLE["event_file_nested"] = NESTED + """
select run_id, case when prefix = '' then tag else prefix || '/' || tag end tag, count(*) points, sum(step)::bigint steps from n group by 1, 2"""
COUNTED = with_views("sc_events", "tx_labels", "cfg_lines") + """,
  s as (select run_id, tag, step, case when rec % 3 > 0 then 0 else 2 end seg from sc_events
        union all select 'run_z', 'z', rec, 2 from sc_events where rec = 1),
  r as (select seg, run_id, count(*) n, 1 files from s where run_id <> 'run_z' group by all
        union all select 2, run_id, count(*), 0 from tx_labels group by run_id
        union all select 2, 'run_z', 2, 1),
  f as (select seg, run_id, sum(n) n, greatest(max(files), 1) files from r group by all),
  t as (select run_id, tag, min(seg) seg from s group by all),
  p as (select seg, count(distinct (run_id, tag, step)) n from s group by all)"""
ORACLE["ingest_counters"] = COUNTED + """
select seg::bigint seg, count(*) runs, sum(files)::bigint files, sum(files)::bigint new_files, sum(f.n)::bigint records,
       (case when seg = 2 then 1 else 0 end)::bigint bad_records, any_value(p.n) new_rows,
       coalesce(any_value(g.n), 0)::bigint new_tags, (case when seg = 2 then (select count(*) from tx_labels) else 0 end)::bigint new_texts
from f join p using (seg) left join (select seg, count(*) n from t group by seg) g using (seg) group by seg"""
ORACLE["ingest_run_summary"] = COUNTED + """,
  kv as (select run_id, trim(split_part(line, ':', 1)) as key,
                arg_max(trim(trim(substr(line, instr(line, ':') + 1)), '"'), line_no) as value
         from cfg_lines where line not like ' %' and line not like '#%' group by all),
  c as (select run_id, string_agg(concat(key, '=', value), ';' order by key) config from kv group by all),
  g as (select run_id, count(distinct tag) num_tags, min(step) a, max(step) b from s group by all),
  w as (select run_id, sum(n) num_rows from (select run_id, seg, count(distinct (tag, step)) n from s group by all) group by all),
  e as (select run_id, sum(files) files from f group by all),
  x as (select run_id, count(distinct tag) n from tx_labels group by all)
select e.run_id, e.run_id display_name, coalesce(num_tags, 0)::bigint num_tags, coalesce(num_rows, 0)::bigint num_rows,
       files::bigint num_event_files, coalesce(a, 0)::bigint step_min, coalesce(b, 0)::bigint step_max,
       coalesce(x.n, 0)::bigint num_text_tags, coalesce(config, '') config
from e left join g using (run_id) left join w using (run_id) left join x using (run_id) left join c using (run_id)"""

ORACLE["ingest_compacted"] = ORACLE["series_lttb_gappy"]
ORACLE["ingest_gaps"] = ORACLE["gaps"]
ORACLE["ingest_refresh"] = with_views("sc_events") + """
select r.run_id, count(distinct (e.tag, e.step)) filter (e.tag is not null) new_rows, null::varchar as error
from (values ('run_1'), ('run_4'), ('run_none')) r(run_id)
left join sc_events e on e.run_id = r.run_id and e.rec % 3 = 0 group by r.run_id"""
ORACLE["ingest_backfill"] = collapsed("tx_labels") + """
select run_id, count(*) entries from tx_labels_c group by run_id"""
ORACLE["ingest_texts"] = collapsed("tx_conv") + """
select run_id, tag, i, step, text from tx_conv_c"""
ORACLE["ingest_bodies"] = with_views("tx_labels") + """
select distinct text, 1::bigint times from tx_labels"""
ORACLE["text_import"] = collapsed("tx_conv") + """
select run_id, tag, i, step, text from tx_conv_c"""
# Blocks of 500 records: every other one begins with 60 records of text, then 20 pass without.
ORACLE["text_head_scan"] = with_views("sc_events") + """
select concat('block_', rec // 500) run_id, tag, step, concat('note ', rec) as text from sc_events where rec % 1000 < 60"""
ORACLE["suggest_tags_limit"] = with_views("sc_lineitem") + """,
  t as (select distinct tag from sc_lineitem where contains(tag, 'layers.2'))
select tag, (select count(*) from t) matches from t order by tag limit 5"""
ORACLE["gaps_limit"] = latest("sc_events") + GAPS + """
select run_id, tag, step, kind, round(y, 6) y from gm qualify row_number() over (partition by run_id, tag order by step) <= 2"""
ORACLE["tag_paths_single"] = """
select concat('net', chr(65 + n_nationkey::int), '/only.', n_nationkey, '/deep/leaf') tag,
       concat('net', chr(65 + n_nationkey::int), '/only.', n_nationkey, '/deep/leaf') as path from nation"""
