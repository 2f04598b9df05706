"""Text collapse, lookup and line differences."""

import random

import pytest
from pyspark.sql import functions as F

from scalarlake.functions.scalar import text_digest
from scalarlake.operators import diff, ordered, texts
from scalarlake.plans import compare

SCHEMA = "run_id string, tag string, step long, wall_time double, text string, src string, rec long"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("digest", text_digest(F.col("text"))).withColumn("chars", F.char_length("text"))


def simple(spark, entries, run="r"):
    return frame(spark, [(run, "t", s, 0.0, x, "f", i) for i, (s, x) in enumerate(entries)])


def collapse_plain(rows):
    out = {}
    for run, tag, step, _, text, src, rec in sorted(rows, key=lambda r: (r[2], r[5], r[6])):
        kept = out.setdefault((run, tag), [])
        if not kept or kept[-1][1] != text:
            kept.append((step, text))
        # the text before counts, also when it was dropped: equal to the last kept one anyway
    return out


def test_golden(spark):
    got = texts.collapse(simple(spark, [(0, "A"), (5, "A"), (5, "B"), (10, "B"), (12, "A")])).orderBy("i").collect()
    assert [(r.i, r.step, r.text, r.ordinal, r.at_step) for r in got] == [(0, 0, "A", 1, 1), (1, 5, "B", 1, 1), (2, 12, "A", 1, 1)]


@pytest.mark.parametrize("bits", [1, 22])
def test_collapse_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    monkeypatch.setattr(texts, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for t in range(6):
        for i in range(rng.choice([1, 20, 90])):
            step = 0 if t == 0 else rng.randint(-3, 25)
            rows.append(("r", f"t{t}", step, 0.0, rng.choice("AB" if t % 2 else "ABC"), rng.choice("fg"), i))
    want = collapse_plain(rows)
    got = {}
    for r in texts.collapse(frame(spark, rows)).collect():
        got.setdefault((r.run_id, r.tag), []).append((r.i, r.step, r.text, r.ordinal, r.at_step))
    assert set(got) == set(want)
    for key, kept in want.items():
        steps = [s for s, _ in kept]
        full = [(i, s, x, steps[:i].count(s) + 1, steps.count(s)) for i, (s, x) in enumerate(kept)]
        assert sorted(got[key]) == full


def test_lookup(spark):
    c = texts.collapse(simple(spark, [(0, "A"), (0, "B"), (7, "C"), (7, "D")]))
    assert [(r.i, r.ordinal, r.at_step) for r in c.orderBy("i").collect()] == [(0, 1, 2), (1, 2, 2), (2, 1, 2), (3, 2, 2)]
    asked = spark.createDataFrame([("r", "t", i) for i in (0, 1, 7, 9)], "run_id string, tag string, i long")
    assert {r.i: r.text for r in texts.lookup(c, asked).collect()} == {0: "A", 1: "B", 7: "C", 9: None}


def test_retag(spark):
    rows = [("r", "a/12345678/t", 5, 0.0, "X", "f", 0), ("r", "a/12345679/t", 1, 0.0, "X", "f", 1), ("r", "a/t", 5, 0.0, "X", "f", 2)]
    got = texts.retag_texts(texts.collapse(frame(spark, rows))).orderBy("i").collect()
    assert [(r.tag, r.i, r.step, r.old_tag) for r in got] == [
        ("a/t", 0, 1, "a/12345679/t"), ("a/t", 1, 5, "a/12345678/t"), ("a/t", 2, 5, "a/t")]


def lcs_plain(a, b):
    x, y = a.split("\n"), b.split("\n")
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((" ", x[i]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(("-", x[i]))
            i += 1
        else:
            out.append(("+", y[j]))
            j += 1
    return out + [("-", v) for v in x[i:]] + [("+", v) for v in y[j:]]


def test_diff_lines_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in "ab")
        got = list(diff.diff_lines(a, b))
        assert got == lcs_plain(a, b)
        # the difference turns a into b
        assert "\n".join(v for op, v in got if op != "+") == a and "\n".join(v for op, v in got if op != "-") == b
    assert list(diff.diff_lines("a\nb\nc", "a\nx\nc")) == [(" ", "a"), ("-", "b"), ("+", "x"), (" ", "c")]
    assert list(diff.diff_lines("", "x")) == [("-", ""), ("+", "x")]


def cut_plain(x, y, every, swapped, stripe):
    rows, columns = (y, x) if swapped else (x, y)
    first = len(rows) % every or every
    behind = diff.sweep(rows, columns, every, stripe)
    ahead = {len(rows) - i: b for i, b in diff._offset_sweep(rows[::-1], columns[::-1], first, every).items()}
    met = [*diff.corners(rows, columns, ahead, behind, every, swapped), (len(rows), len(columns), 0)]
    for (i, j, common), (i2, j2, _) in zip(met, met[1:]):
        part = columns[j:j2], rows[i:i2]
        yield (*(part if swapped else part[::-1]), i + j - common)


def test_boxes_brute_force():
    """Cutting a pair never changes its difference: repeats, moves, long stretches without anything in common."""
    rng = random.Random(5)
    for _ in range(3000):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 3, 5, 26])]
        x = [rng.choice(letters) for _ in range(rng.randint(0, 16))]
        y = [rng.choice(letters) for _ in range(rng.randint(0, 16))]
        if rng.random() < 0.4:
            y = x[:]
            for _ in range(3):
                at = rng.randint(0, len(y))
                y[at:at + rng.randint(0, 3)] = rng.choices(letters, k=rng.randint(0, 3))
        want = list(diff.diff_sequences(x, y))
        for swapped in (False, True):
            got = []
            for a, b, first in cut_plain(x, y, rng.choice([1, 2, 3, 5]), swapped, rng.choice([1, 2, 64])):
                assert first == len(got)
                got += diff.diff_sequences(a, b)
            assert got == want


def test_line_diff_in_boxes(spark):
    rng = random.Random(6)
    rows = [(i, f"k{i % 3}", "\n".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 30, 60]))),
             "\n".join(rng.choice("abcd") for _ in range(rng.choice([1, 30, 60])))) for i in range(12)]
    rows += [(20, "k", "a\nb\n" * 30, "a\nb\n" * 30), (21, "k", "", "a\n" * 40), (22, "k", "a\n" * 40, "")]
    pairs = spark.createDataFrame(rows, "i long, k string, text_a string, text_b string")
    want = sorted((i, k, no, *row) for i, k, a, b in rows for no, row in enumerate(diff.diff_lines(a, b)))
    for size in (7, 16_384):
        assert sorted(map(tuple, diff.line_diff(pairs, ["i", "k"], box_lines=size).collect())) == want


def test_one_long_pair(spark):
    """20,000 lines each side: boxes of 2,000 lines, spread as rows."""
    rng = random.Random(7)
    x = [f"l{rng.randrange(5000)}" for _ in range(20_000)]
    y = x[:]
    for _ in range(100):
        at = rng.randrange(len(y))
        y[at:at + rng.randrange(100)] = [f"n{rng.randrange(50)}" for _ in range(rng.randrange(100))]
    pairs = spark.createDataFrame([(1, "\n".join(x), "\n".join(y))], "i long, text_a string, text_b string")
    got = diff.line_diff(pairs, ["i"], box_lines=2000).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(len(got)))
    assert [r.line for r in got if r.op != "+"] == x and [r.line for r in got if r.op != "-"] == y
    longest = diff._from_end(diff.sweep(["?", *x], y, 1)[1], len(y))[0]
    assert sum(r.op == " " for r in got) == longest


def test_bodies_come_last(spark, tmp_path):
    """Windows and their shuffles below the last join see no body: the one scan of bodies keeps each digest once."""
    simple(spark, [(0, "A"), (1, "A"), (2, "B"), (3, "A")]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for df in (texts.collapse(stored), compare.text_history(stored)[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "FileScan" in line]
        assert any("text:" in s for s in scans)
        assert all(("text:" in s) != ("rec:" in s) for s in scans)  # windows need rec, bodies do not
    got = texts.collapse(stored).orderBy("i").collect()
    assert [(r.i, r.text) for r in got] == [(0, "A"), (1, "B"), (2, "A")]


def test_compare(spark):
    both = simple(spark, [(0, "a\nb"), (1, "same\n")]).unionByName(simple(spark, [(0, "a\nc"), (9, "same\n")], "s"))
    rows, summary = compare.compare_runs(both, "r", "s")
    got = sorted((r.i, r.line_no, r.op, r.line) for r in rows.collect())
    assert got == [(0, 0, " ", "a"), (0, 1, "-", "b"), (0, 2, "+", "c"), (1, 0, " ", "same"), (1, 1, " ", "")]
    assert {r.i: (r.added, r.removed, r.identical) for r in summary.collect()} == {0: (1, 1, False), 1: (0, 0, True)}
    pairs = spark.createDataFrame([("r", "t", 0, "s", "t", 1)], "run_a string, tag_a string, i_a long, run_b string, tag_b string, i_b long")
    s = compare.compare_pairs(both, pairs)[1].first()
    assert (s.added, s.removed) == (2, 2)
    assert compare.text_history(both)[1].count() == 2


def test_differences_hold_few_pairs_at_a_time():
    """A worker takes a few pairs of a batch at a time, however many the batch has."""
    import pyarrow as pa

    pairs = [([f"a{k}", "x", "y"], ["x", f"b{k}", "y"]) for k in range(3 * diff._PAIRS + 5)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(pairs)), pa.int64()), pa.array([0] * len(pairs), pa.int64()), *(pa.array(side) for side in zip(*pairs))],
        names=["k", "line_no", "a", "b"])
    got = list(diff._differ(["k"])(iter([batch])))
    assert len(got) == 4
    want = [(k, no, op, line) for k, (a, b) in enumerate(pairs) for no, (op, line) in enumerate(diff.diff_sequences(a, b))]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def written(plan):
    """Bytes of each shuffle of an executed plan, before compression; what is read again counts once."""
    name, children = plan.nodeName(), plan.children()
    if name == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [plan.plan()]
    elif name == "ReusedExchange":
        below = []
    else:
        below = [children.apply(k) for k in range(children.size())]
    own = [plan.getRuntimeStatistics().sizeInBytes()] if name == "ShuffleQueryStage" and below[0].nodeName() != "ReusedExchange" else []
    return own + [n for p in below for n in written(p)]


def test_texts_are_shuffled_twice(spark, tmp_path):
    """Once by their digest, once beside the text they are compared with, however many boxes a pair is cut into."""
    rng = random.Random(8)
    entries = [(k, "\n".join(f"{rng.getrandbits(200):x}" if rng.random() < 0.5 else f"line {rng.randrange(40)}" for _ in range(200))) for k in range(120)]
    simple(spark, entries).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = texts.bodies_of_pairs(texts.successive(texts.collapse(stored.drop("text"))), texts.bodies(stored))
        got = diff.line_diff(pairs, ["run_id", "tag", "i"], box_lines=8)
        rows = sorted((r.i, r.line_no, r.op, r.line) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    size = sum(len(x) for _, x in entries)
    assert sum(written(got._jdf.queryExecution().executedPlan())) < 2.5 * size
    assert rows == [(k, no, *row) for k in range(len(entries) - 1) for no, row in enumerate(diff.diff_lines(entries[k][1], entries[k + 1][1]))]


def test_boxes_of_boxes():
    """Boxes that are cut again have the lines of the whole difference."""
    rng = random.Random(9)
    for _ in range(1000):
        a, b = (rng.choices("abcde"[:rng.choice([1, 3, 5])], k=rng.randint(0, 30)) for _ in "ab")
        sizes = rng.choice([(), (1,), (4,), (7, 3), (9, 4, 2)])
        got = []
        for before, x, y in diff.boxes_of(a, b, *sizes):
            assert before == len(got) and (not sizes or max(len(x), len(y)) <= sizes[-1])
            got += diff.diff_sequences(x, y)
        assert got == list(diff.diff_sequences(a, b))


@pytest.mark.parametrize("size", [3, 7, 20])
def test_dealt_pairs(spark, monkeypatch, size):
    """Pairs too long for one task have the same rows; keys may be null, and two pairs may have the same."""
    monkeypatch.setattr(diff, "HELD_CELLS", 0)
    rng = random.Random(size)

    def text(letters):
        return "\n".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30, 60])))

    rows = [(k, f"k{k % 3}", text("abc"), text("abcd")) for k in range(10)]
    rows += [(None, "n", text("ab"), text("abé")), (None, None, text("ab"), text("ab ")), (3, "k0", text("abc"), text("bcd")), rows[5], rows[5]]
    rows += [(20, "k", "a\nb\n" * 30, "a\nb\n" * 30), (21, "k", "", "a\n" * 40), (22, "k", "a\n" * 40, ""), (23, "k", None, "a\n" * 40), (24, "k", "a\n" * 40, None)]
    pairs = spark.createDataFrame(rows, "i long, k string, text_a string, text_b string")
    want = [(str(i), str(k), no, *row) for i, k, a, b in rows if a is not None and b is not None for no, row in enumerate(diff.diff_lines(a, b))]
    got = diff.line_diff(pairs, ["i", "k"], box_lines=size).collect()
    assert sorted((str(r.i), str(r.k), r.line_no, r.op, r.line) for r in got) == sorted(want)
