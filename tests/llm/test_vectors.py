"""Vector operators against brute force: nulls, non-finite and huge entries, zeros, ties, repeats, clashing columns."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalarlake.llm import common, negatives, topk, whitening
from scalarlake.llm.negatives import hard_negatives
from scalarlake.llm.topk import top_inner_products
from scalarlake.llm.vectors import Block
from scalarlake.llm.whitening import components, cross, moments, whiten

SCHEMA = "vec_id bigint, embedding array<double>, label int, slice string, place string, length string, score string, r string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def rows(huge):
    rng = np.random.default_rng(5)
    hub = rng.normal(size=(6, 12))
    out = [(i, (hub[i % 6] + 0.4 * rng.normal(size=12)) * (1 + i % 3), i % 4) for i in range(150)]
    out += [(200 + i, out[20][1], i % 2) for i in range(40)]  # copies: ties
    out += [(i, rng.normal(size=12) * 1e-3, 1) for i in range(300, 306)]  # all entries 0 or -1
    out = [(i, [float(x) for x in v], lab) for i, v, lab in out]
    out += [(320, [0.0] * 12, 1), (340, [-0.0] * 12, 2), (360, [], 1), (400, [3.0, -1.0], 0), (401, [1.0], 1)]
    out += [(500, None, 1), (520, [1.0, None], 1), (540, [float("nan")] * 12, 1), (560, [1.0, float("inf")], 1), (580, [1.7e308], 1)]
    out += [(None, out[0][1], 0), (None, out[1][1], None), (600, out[2][1], None), (100, out[100][1], out[100][2]), (100, out[3][1], 3), (100, out[3][1], 3)]
    if huge:
        out += [(620, [2.0 ** 70] + [1.0] * 11, 0), (640, [-(2.0 ** 61), 5.0], 1), (660, [2.0 ** 26 + 1.0 / 64] * 12, 2), (680, [1e300, 1.0], 3)]
    return out


def frame(spark, data):
    clash = ("a", "b", "c", "d", "e")
    return spark.createDataFrame([(*r, *clash) for r in data], SCHEMA).repartition(3)


def whole(v, scale):
    """Entries as Python integers, or None where the row takes no part."""
    if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in v):
        return None
    return [math.floor(x * scale) for x in v]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST)


def by_preference(entry):
    i, score = entry[:2]
    return -score, i is None, i or 0


@pytest.mark.parametrize("huge", [False, True])
def test_top_inner_products(spark, huge):
    data = rows(huge)
    usable = [(i, x) for i, v, _ in data if (x := whole(v, 64)) is not None]
    want = Counter()
    for q, (i, x) in enumerate(usable):
        if i is not None and i % 20 == 0:
            ranked = sorted(((j, product(x, y)) for c, (j, y) in enumerate(usable) if c != q), key=by_preference)
            want.update((i, k, j, s) for k, (j, s) in enumerate(ranked[:20], 1))
    df = frame(spark, data)
    for sizes in ({}, {"shelf_rows": 16, "slice_rows": 3}):
        got = Counter(tuple(r) for r in top_inner_products(df, F.col("vec_id") % 20 == 0, **sizes).collect())
        assert got == want
    few = frame(spark, [(20, [1.0, 2.0], 0), (3, [1.0], 0)])
    assert [tuple(r) for r in top_inner_products(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 3, 4096)]


def test_search_leaves_out_and_loses_nothing(spark, monkeypatch):
    """With lengths and a spectrum that fall, most pairs are never scored on whole numbers."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 32)) * 0.8 ** np.arange(32) * rng.pareto(3, size=(4000, 1)) * 64)
    scored = []
    monkeypatch.setattr(topk.np, "einsum", lambda how, a, b, f=np.einsum: scored.append(len(a)) or f(how, a, b))
    monkeypatch.setattr(topk, "scores", lambda a, b, w, f=topk.scores: scored.append(len(a) * len(b)) or f(a, b, w))
    monkeypatch.setattr(topk, "STRETCH", 256)
    order = np.argsort(-np.linalg.norm(x, axis=1))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]

    def block(at):
        v = x[at]
        return Block({"ids": at.tolist(), "labels": [None] * len(at), "matrix": v.astype("<f8").tobytes(), "more": (v @ turn).astype("<f8").tobytes()}, 32)

    queries, shelf = block(np.arange(0, 4000, 40)), block(order)
    best = topk.search(queries, shelf, np.full(100, -np.inf), 5)
    got = defaultdict(list)
    for q, s, p in zip(*best.found()):
        got[q].append((int(s), shelf.ids[shelf.by_place[p]]))
    for q, i in enumerate(queries.ids):
        s = x @ x[i]
        want = sorted(((int(v), j) for j, v in enumerate(s)), key=lambda e: (-e[0], e[1]))[:5]
        assert sorted(got[q], key=lambda e: (-e[0], e[1])) == want
    assert sum(scored) < 0.5 * 100 * 4000


def label_of(i, label):
    return (label + 1) % 10 if i is not None and i % 7 == 0 else label


@pytest.mark.parametrize("huge", [False, True])
def test_hard_negatives(spark, huge):
    data = rows(huge)
    usable = [(i, x, label_of(i, lab)) for i, v, lab in data if lab is not None and (x := whole(v, 256)) is not None]
    want = Counter()
    for a, (i, x, own) in enumerate(usable):
        if i is None or i % 20:
            continue
        ranked = sorted(((j, product(x, y), lab) for c, (j, y, lab) in enumerate(usable) if c != a), key=by_preference)
        for j, s, _ in [e for e in ranked if e[2] == own][:5]:
            inside = [e for e in ranked if e[2] != own and 80 * s <= 100 * e[1] <= 100 * s][:5]
            want.update((i, j, k, e[0], s, e[1]) for k, e in enumerate(inside, 1))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = frame(spark, data)
    for sizes in ({}, {"shelf_rows": 16, "slice_rows": 3, "references": 2}):
        got = Counter(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 20 == 0, label=moved, **sizes).collect())
        assert got == want
    assert len(want) > 100


def test_angle_bounds():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(600, 8)) * rng.pareto(2, size=(600, 1)) * 256)
    x[:3] = 0
    references = rng.normal(size=(5, 8))
    references /= np.linalg.norm(references, axis=1)[:, None]
    x[3] = np.floor(references[0] * 1e6)

    def block(v):
        return Block({"ids": list(range(len(v))), "labels": [0] * len(v), "matrix": v.astype("<f8").tobytes(),
                      "more": negatives.angles(v, references).astype("<f8").tobytes()}, 8)

    order = np.argsort(negatives.angles(x, references)[:, 0])
    queries, shelf = block(x[:50]), block(x[order])
    cut = negatives.Stretches(shelf)
    least, most = cut.bounds(queries)
    exact = queries.x @ shelf.x.T
    for p, part in enumerate(cut.parts):
        assert (least[:, p, None] <= exact[:, part]).all() and (exact[:, part] <= most[:, p, None]).all()


@pytest.mark.parametrize("huge", [False, True])
def test_whitening(spark, huge):
    data = rows(huge)
    used = []
    for i, v, _ in data:
        x = whole(v, 256)
        if x is not None:
            used.append((i, [min(max(e, LEAST), MOST) for e in x] + [0] * (12 - len(x))))
    fit = sorted(set(tuple(x) for _, x in used))
    n = len(fit)
    total = [sum(c) for c in zip(*fit)]
    v = [[float(Fraction(sum((n * a[i] - total[i]) * (n * a[j] - total[j]) for a in fit), n ** 3)) for j in range(12)] for i in range(12)]
    value, vector = np.linalg.eigh(np.array(v))
    value, vector = value[::-1], vector[:, ::-1]
    got = whiten(frame(spark, data), most=4).collect()
    there = max(r.component for r in got)
    assert len(got) == len(used) * there and there == (4 if not huge else there)
    far = Counter((i, str(sum((n * a - s) ** 2 for a, s in zip(x, total)))) for i, x in used)
    assert Counter((r.vec_id, r.deviation_digits) for r in got if r.component == 1) == far
    assert all(r.deviation == (int(r.deviation_digits) if int(r.deviation_digits) <= MOST else None) for r in got)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-4
    trace = sum(v[i][i] for i in range(12))
    for k in range(there):
        of = [r for r in got if r.component == k + 1]
        assert all(abs(r.explained / (value[k] / trace) - 1) < 1e-4 for r in of)
        if not huge:
            plain = Counter((i, round(abs(float(np.dot(np.array(x) - np.array(total) / n, vector[:, k]) / np.sqrt(value[k]))), 6)) for i, x in used)
            assert Counter((r.vec_id, round(abs(r.whitened), 6)) for r in of) == plain


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(4)
    for low, high in ((0, 2), (0, 300), (0, 1 << 40)):
        u = rng.integers(low, high, size=(130, 7)).astype(np.uint64)
        want = [[sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j])) for j in range(7)] for i in range(7)]
        got = cross(u)
        assert all(sum(int(c[i, j]) << w for w, c in got.items()) == want[i][j] for i in range(7) for j in range(i, 7))
    x = rng.integers(-(1 << 62), 1 << 62, size=(50, 3))
    x[0] = [-(1 << 63), MOST, -1]
    fit = spark.createDataFrame([(v.tobytes(),) for v in x], "x binary").repartition(3)
    n, total, centred = moments(fit, 3)
    exact = x.astype(object)
    assert n == 50 and total == [int(s) for s in exact.sum(axis=0)]
    for i in range(3):
        for j in range(3):
            assert centred[i][j] == 50 * int((exact[:, i] * exact[:, j]).sum()) - total[i] * total[j]


def test_no_variance_and_empty(spark):
    assert whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    flat = whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 0), (3, [2.0, 2.0], 0)])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(flat)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in flat} == {1.0} and {r.explained for r in flat} == {1.0}
    assert len(components(1, [[0]], 4)[0]) == 0
    for data in ([], [(20, None, 1)], [(None, [1.0], None)], [(20, [], 1)]):
        df = frame(spark, data)
        assert top_inner_products(df, F.col("vec_id") % 20 == 0).count() == 0
        assert hard_negatives(df, F.col("vec_id") % 20 == 0).count() == 0
        assert whiten(df).count() == 0
    assert common.shared_folder(spark) and whitening.LIMB == 16
