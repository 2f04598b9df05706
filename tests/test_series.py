"""Series operators: golden cases, and brute force over data cut into many small blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scalarlake.operators import downsample, gaps, ordered, quantiles, select, smooth, stats
from scalarlake.operators.dedup import latest
from scalarlake.plans import series
from scalarlake.sources.store import Store, write_segment

SCHEMA = "run_id string, tag string, step long, wall_time double, value float, src string, rec long"
NAN, INF = math.nan, math.inf


@pytest.fixture(params=[2, 22])
def bits(request, monkeypatch):
    """Blocks of four steps, and blocks of the real size."""
    monkeypatch.setattr(ordered, "BLOCK_BITS", request.param)
    return request.param


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", i) for i, r in enumerate(rows)], SCHEMA)


def random_series(seed, sizes, bad=0.0):
    rng = random.Random(seed)
    out = {}
    for j, n in enumerate(sizes):
        steps = sorted(rng.sample(range(-50, 4 * n + 10), n))
        kind = j % 4
        vals = []
        for i in range(n):
            v = [rng.gauss(0, 1), math.sin(i / 9), 1 / (i + 1), 2.5][kind]
            vals.append(rng.choice([NAN, INF, -INF]) if rng.random() < bad else float(np.float32(v)))
        out[("r", f"t{j}")] = (steps, vals)
    return out


def rows_of(data):
    return [(r, t, s, float(s), v) for (r, t), (ss, vs) in data.items() for s, v in zip(ss, vs)]


def lttb_numpy(x, y, m):
    n = len(x)
    if n <= m or m < 3:
        return list(range(n))
    yf = np.where(np.isfinite(y), y, 0.0)
    edges = np.floor(np.linspace(1, n - 1, m - 1)).astype(int)
    picks, a = [0], 0
    for j in range(m - 2):
        lo, hi = edges[j], edges[j + 1]
        fx, fy = (x[hi:edges[j + 2]].mean(), yf[hi:edges[j + 2]].mean()) if j < m - 3 else (x[-1], yf[-1])
        area = np.abs((x[a] - fx) * (yf[lo:hi] - yf[a]) - (x[a] - x[lo:hi]) * (fy - yf[a]))
        a = lo + int(area.argmax())
        picks.append(a)
    return [*picks, n - 1]


@pytest.mark.parametrize("m", [3, 7, 40])
def test_lttb_brute_force(spark, bits, m):
    data = random_series(1, [5, 41, 200, 333, 7, 40, 100, 90, 250, 3], bad=0.05)
    got = {}
    for r in downsample.lttb(latest(frame(spark, rows_of(data))), m).collect():
        got.setdefault((r.run_id, r.tag), []).append((r.step, r.value, r.n))
    for key, (steps, vals) in data.items():
        want = lttb_numpy(np.array(steps, float), np.array(vals), m)
        assert sorted(s for s, _, _ in got[key]) == [steps[i] for i in want], key
        assert {n for _, _, n in got[key]} == {len(steps)}
    assert downsample.lttb(latest(frame(spark, rows_of(data))), 2).count() == sum(len(s) for s, _ in data.values())


def test_bucket_edges(spark):
    n, m = 100, 7
    df = spark.range(n).select(downsample.bucket_number(F.col("id"), F.lit(n), m).alias("b"))
    firsts = [b for b in df.groupBy("b").agg(F.count("*").alias("c")).orderBy("b").collect()]
    assert [r.c for r in firsts] == [1, 19, 20, 19, 20, 20, 1]


def test_hull_of_a_long_stretch():
    """Thinning, also over many batches, keeps every point that can win."""
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = np.arange(3000)
    y = (np.abs(np.sin(x / 70)) * 5 + rng.normal(0, 0.01, len(x))).astype(np.float32)
    pdf = pd.DataFrame({"run_id": "r", "tag": "t", "b": 0, "step": x, "wall_time": 0.0, "value": y, "n": 3000,
                        "cnt": 1, "sum_x": x.astype(float), "sum_y": y.astype(float)})
    parts = [pa.RecordBatch.from_pandas(p, preserve_index=False) for p in (pdf[:100], pdf[100:101], pdf[101:2500], pdf[2500:])]
    out = pa.Table.from_batches(list(downsample._hull_corners(iter(parts)))).to_pandas()
    assert len(out) < 100 and out["cnt"].sum() == 3000
    assert out["sum_y"].sum() == pytest.approx(y.astype(float).sum())
    kept = set(out["step"])
    for angle in np.linspace(0, 2 * np.pi, 400):
        score = np.cos(angle) * x + np.sin(angle) * y.astype(float)
        assert int(score.argmax()) in kept


def test_ema_brute_force(spark, bits):
    data = random_series(2, [1, 60, 130, 5], bad=0.2)
    for w in (0.0, 0.6, 0.99):
        got = {(r.tag, r.step): r.smooth for r in smooth.ema(latest(frame(spark, rows_of(data))), w).collect()}
        for (_, tag), (steps, vals) in data.items():
            last, k = 0.0, 0
            for s, v in zip(steps, vals):
                if not math.isfinite(v):
                    assert got[tag, s] is None
                    continue
                last, k = last * w + (1 - w) * v, k + 1
                assert got[tag, s] == pytest.approx(last / (1 - w**k), rel=1e-12, abs=1e-15)
    with pytest.raises(ValueError):
        smooth.ema(frame(spark, []), 1.0)


def test_ema_golden(spark):
    df = frame(spark, [("r", "t", i, 0.0, v) for i, v in enumerate([1.0, 2.0, NAN, INF, 4.0])])
    got = [r.smooth for r in smooth.ema(df, 0.6).orderBy("step").collect()]
    assert got[2:4] == [None, None] and [got[0], got[1], got[4]] == pytest.approx([1, 1.625, 2.8367346938775513])


def test_gaps_brute_force(spark, bits):
    data = random_series(3, [50, 120, 9, 80], bad=0.4)
    data[("r", "all")] = ([1, 2, 900], [NAN, INF, -INF])
    got = {(r.tag, r.step): (r.kind, r.y) for r in gaps.gap_markers(latest(frame(spark, rows_of(data)))).collect()}
    want = {}
    for (_, tag), (steps, vals) in data.items():
        fin = [v for v in vals if math.isfinite(v)]
        prev = fin[0] if fin else 0.0
        for s, v in zip(steps, vals):
            if math.isfinite(v):
                prev = v
            else:
                want[tag, s] = ("nan" if math.isnan(v) else "+inf" if v > 0 else "-inf", prev)
    assert got == want
    few = gaps.gap_markers(latest(frame(spark, rows_of(data))), limit=3)
    for (_, tag), (steps, vals) in data.items():
        bad = [s for s, v in zip(steps, vals) if not math.isfinite(v)][:3]
        assert sorted(r.step for r in few.filter(F.col("tag") == tag).collect()) == bad


def test_gap_limit(spark):
    df = spark.range(2001).selectExpr("'r' run_id", "'t' tag", "id step", "0D wall_time", "float('NaN') value")
    assert gaps.gap_markers(df, limit=2000).count() == 2000
    assert gaps.gap_markers(df).count() == 2001  # all of them, unless a limit is asked for


def test_latest(spark):
    rows = [("r", "t", 1, 1.0, 10.0), ("r", "t", 1, 2.0, 20.0), ("r", "t", 2, 5.0, 1.0), ("r", "t", 2, 5.0, 2.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "f", int(r[4])) for r in order], SCHEMA)
        once = latest(df)
        assert sorted((r.step, r.value) for r in once.collect()) == [(1, 20.0), (2, 2.0)]
        assert sorted(latest(once).collect()) == sorted(once.collect())


def test_quantiles_brute_force(spark):
    rng = random.Random(5)
    data = {f"t{j}": [rng.choice([rng.gauss(0, 10**rng.randint(-30, 30)), 0.0, -0.0, 1.5]) for _ in range(n)]
            for j, n in enumerate([1, 4, 5, 97, 1000])}
    rows = [("r", t, i, 0.0, v) for t, vs in data.items() for i, v in enumerate([*vs, NAN, INF])]
    for q in ((0.01, 0.99), (0.0, 1.0), (0.3, 0.31)):
        got = {r.tag: r for r in quantiles.quantile_bounds(frame(spark, rows), *q, by=["tag"]).collect()}
        for t, vs in data.items():
            want = np.quantile(np.array(vs, dtype=np.float32).astype(float), q)
            assert (got[t].n, got[t].q_lo, got[t].q_hi) == (len(vs), pytest.approx(want[0]), pytest.approx(want[1]))


def test_outlier_range(spark):
    def run(values, **kw):
        df = frame(spark, [("r", "t", i, 0.0, v) for i, v in enumerate(values)])
        r = quantiles.outlier_range(df, **kw).first()
        return r.y_lo, r.y_hi

    pad = (96.4 - 1.04) * 0.05
    assert run([1.0, 2.0, 3.0, 10.0, 100.0, NAN]) == pytest.approx((1.04 - pad, 96.4 + pad))
    assert run([1.0, 2.0, 3.0, 4.0]) == (None, None) == run([2.0] * 6) == run([NAN, INF])
    assert run([-1.0, 1.0, 10.0, 100.0, 1000.0], logy=True) == (None, None)
    lo, hi = run([0.0, 1.0, 10.0, 100.0, 1000.0, 10000.0], q_low=0.0, q_high=1.0, logy=True)
    assert (lo, hi) == pytest.approx((0.0, 4.0))


def test_positions_and_first(spark, bits):
    data = random_series(6, [30, 77])
    df = latest(frame(spark, rows_of(data)))
    placed = ordered.with_position(ordered.with_step_levels(df), ["run_id", "tag"], ordered.STEP_LEVELS, ["step"])
    got = {(r.tag, r.step): (r.k, r.n) for r in placed.collect()}
    for (_, tag), (steps, _v) in data.items():
        assert [got[tag, s] for s in steps] == [(i, len(steps)) for i in range(len(steps))]
    started = ordered.with_first(df, ["run_id", "tag"], "wall_time", "w0").collect()
    assert all(r.w0 == data[("r", r.tag)][0][0] for r in started)


def test_view(spark):
    df = frame(spark, [("r", "t", i, 60.0 * i, float(i)) for i in range(20)] + [("r", "t", 20, 0.0, NAN)])
    v = series.series_view(df, max_points=0, window=(5, 20), x="wall_time", smooth=0.0, clip=(0.0, 1.0))
    pts = v.points.orderBy("step").collect()
    assert [r.step for r in pts] == list(range(5, 21))
    assert [r.minutes for r in pts][:3] == [0.0, 1.0, 2.0] and pts[3].smooth == 8.0 and pts[-1].smooth is None
    assert [(g.step, g.kind, g.y) for g in v.gaps.collect()] == [(20, "nan", 19.0)]
    assert v.gaps.first().minutes == -5.0
    r = v.ranges.first()
    assert (r.y_lo, r.y_hi) == pytest.approx((5 - 0.7, 19 + 0.7))
    assert [(d.finite, d.is_point) for d in v.dots.collect()] == [(15, False)]
    with pytest.raises(ValueError):
        series.series_view(df, x="other")


def test_requests(spark):
    df = frame(spark, [("b", "t", 1, 0.0, 1.0), ("a", "t", 1, 0.0, 2.0), ("a", "u", 1, 0.0, 3.0)])
    for bad in (-1, -100_001):
        with pytest.raises(ValueError):
            series.get_series(df, ["a"], ["t"], bad)
    assert series.get_series(df, [], ["t"]).points.count() == 0
    assert series.get_series(df, ["a"], []).points.count() == 0
    from scalarlake.operators.select import in_request_order
    p = series.get_series(df, ["b", "a", "zz"], ["t", "u"]).points
    assert [(r.run_id, r.tag) for r in in_request_order(p, ["b", "a", "zz"]).collect()] == [("b", "t"), ("a", "t"), ("a", "u")]
    twice = series.get_series(df, ["b", "zz", "a", "b"], ["t", "u"], 0)
    assert [(r.place, r.run_id, r.tag) for r in twice.in_order.collect()] == [(0, "b", "t"), (2, "a", "t"), (2, "a", "u"), (3, "b", "t")]
    assert twice.points.count() == 3
    with pytest.raises(ValueError):
        series.get_series(df, None, ["t"]).in_order
    keys = spark.createDataFrame([("a", 5), ("b", 1)], "run_id string, place long")
    assert [r.run_id for r in series.get_series(df, keys, ["t"]).in_order.collect()] == ["b", "a"]
    assert [r.place for r in series.series_view(df, ["b", "a"], ["t"]).in_order.collect()] == [0, 1]
    one = series.nested(series.get_series(df, ["a"], ["t"], 0).points).first()
    assert (one["part"], one["count"], [tuple(x) for x in one.points]) == (0, 1, [(1, 2.0, 0.0)])
    o = series.overlay(df, "t", "t", max_points=0)
    assert sorted((r.side, r.run_id) for r in o.points.collect()) == [("A", "a"), ("A", "b"), ("B", "a"), ("B", "b")]


@pytest.mark.parametrize("bits", [2, 22])
def test_position_index(spark, monkeypatch, bits):
    """With the index of its blocks a series gives the same points and breaks, from one scan."""
    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    rows = rows_of(random_series(8, [1, 7, 60, 200], 0.2))
    df = latest(frame(spark, rows))
    index = stats.positions(df)
    for m in (0, 5, 30):
        plain = series.get_series(df, None, None, m, deduplicated=True)
        indexed = series.get_series(df, None, None, m, deduplicated=True, counted=index)
        assert sorted(map(repr, indexed.points.collect())) == sorted(map(repr, plain.points.collect()))
        assert sorted(map(repr, indexed.gaps.collect())) == sorted(map(repr, plain.gaps.collect()))


def test_one_scan_with_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = latest(frame(spark, rows_of(random_series(9, [40, 50]))))
    write_segment(df, store.path("scalars", 0), "scalars")


    def scans():
        plan = store.get_series(None, None, 10).points._jdf.queryExecution().executedPlan().toString()
        return sum("step:bigint" in part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:])

    assert store._single_segment() and store._positions() is None
    without = scans()
    points = sorted(map(repr, store.get_series(None, None, 10).points.collect()))
    write_segment(stats.positions(df), store.path("positions", 0), "positions")
    assert without > 1 and scans() == 1
    assert sorted(map(repr, store.get_series(None, None, 10).points.collect())) == points
    write_segment(df, store.path("scalars", 2), "scalars")
    assert not store._single_segment() and store._positions() is None


def test_places_by_locale(spark):
    names = ["b", "B", "a", "Á", "á", "A", "layer10", "layer2", "Layer 3", "_x", "ab"]
    got = select.natural_places(spark.createDataFrame([(n,) for n in names], "tag string").repartition(4)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(names)))
    assert [r.tag for r in got] == ["_x", "a", "A", "á", "Á", "ab", "b", "B", "Layer 3", "layer2", "layer10"]
    runs = spark.createDataFrame([("r1", "zeta"), ("r2", "Alpha"), ("r3", "alpha"), ("r4", "alpha")], "run_id string, display_name string")
    assert [r.run_id for r in select.run_places(runs).orderBy("place").collect()] == ["r3", "r4", "r2", "r1"]
    groups = spark.createDataFrame([("g10/a",), ("g2/b",), ("G1/c",), ("g2/a",), ("x",)], "tag string")
    got = {r.group: (r.position, r.tags, r.first_tag) for r in stats.group_counts(groups).collect()}
    assert got == {"G1": (0, 1, "G1/c"), "g2": (1, 2, "g2/a"), "g10": (2, 1, "g10/a"), "x": (3, 1, "x")}


def test_stats(spark):
    df = frame(spark, [("r", "t", 3, 0.0, 1.0), ("r", "t", 1, 9.0, 2.0), ("r", "u", 7, 0.0, 5.0)])
    s = stats.tag_stats(df)
    assert sorted((r.tag, r["count"], r.min_step, r.max_step, r.last_value) for r in s.collect()) == [
        ("t", 2, 1, 3, 1.0), ("u", 1, 7, 7, 5.0)]
    empty = stats.step_extent(stats.run_totals(s).filter("run_id = 'x'")).first()
    assert (empty.step_min, empty.step_max) == (0, 0)


def test_plan_has_no_whole_series_window(spark):
    df = frame(spark, rows_of(random_series(1, [5])))
    text = downsample.lttb(latest(df), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in text
    for line in text.splitlines():
        if "Window [row_number()" in line:
            assert "_blk" in line


def test_ema_scan_over_batches():
    """Stretches that go on over batches, with gaps and incoming states, as the recurrence has them."""
    rng = np.random.default_rng(3)
    n = 400
    tag = np.sort(rng.integers(0, 6, n))
    v = np.where(rng.random(n) < 0.15, np.nan, rng.normal(size=n) * 100)
    s, m = tag * 1.5, tag * 2
    table = pa.table({"run_id": ["r"] * n, "tag": [str(t) for t in tag], "_blk": np.zeros(n, np.int64), "value": v, "_s": s, "_m": m})
    for weight in (0.0, 0.6, 0.99):
        want, state, seen = [], 0.0, 0
        for i in range(n):
            if i == 0 or tag[i] != tag[i - 1]:
                state, seen = s[i], m[i]
            if np.isfinite(v[i]):
                state, seen = state * weight + (1 - weight) * v[i], seen + 1
            want.append(state / (1 - weight ** seen) if np.isfinite(v[i]) else None)
        for size in (1, 7, n):
            out = smooth._scanner(weight, "value", "smooth", ["run_id", "tag", "value"])(iter(table.to_batches(max_chunksize=size)))
            got = [x for b in out for x in b.column(3).to_pylist()]
            assert [x is None for x in got] == [x is None for x in want]
            assert np.allclose([x for x in got if x is not None], [x for x in want if x is not None], rtol=1e-11)


def test_ema_of_a_series_from_many_tasks(spark):
    """A series stays in one piece where Spark turns the join with its blocks into a broadcast as it runs."""
    rows = [("r", t, k, float((k * 7) % 11)) for t in ("a", "b") for k in range(600)]
    table = spark.createDataFrame(rows, "run_id string, tag string, step long, value double").repartition(6)
    smoothed = smooth.ema(table, 0.6)
    # A shuffle of its own: the join's may be read where it was written, in pieces.
    assert "REPARTITION_BY_COL" in smoothed._jdf.queryExecution().executedPlan().toString()
    got = {(r.tag, r.step): r.smooth for r in smoothed.collect()}
    for tag in ("a", "b"):
        state = 0.0
        for k in range(600):
            state = 0.6 * state + 0.4 * ((k * 7) % 11)
            assert abs(got[tag, k] - state / (1 - 0.6 ** (k + 1))) < 1e-9
