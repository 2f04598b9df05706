"""The stages of the pipeline against brute force on a small corpus, with nulls, repeats and clashing column names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "_id string, removed string, score string, others string, size string, kept string, `a.b` string")
EXTRA = [f"x{k}" for k in range(7)]
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
ITEM = " ".join(rng.choice(WORDS) for _ in range(25))


def prose(n):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(n))


def corpus():
    good = [(i, prose(6)) for i in range(400)]
    junk = [(1000 + i, re.sub(r"\w+", lambda m: m[0].upper() + "!!", prose(5))) for i in range(80)]
    copies = [(2000, good[3][1]), (2001, good[3][1] + " tail"), (2002, good[5][1].replace("\n", "  \n"))]
    # Two texts in one line each, so that line dedup's edit similarity is not what links them.
    tainted = [(2100, prose(4) + "\n" + ITEM + "\n" + prose(4)), (2101, ITEM)]
    odd = [(3000, None), (3001, ""), (3002, " \n\t"), (None, prose(3)), (3003, prose(900))]
    return good + junk + copies + tainted + odd + [odd[3]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    source = ["b", "a", None, "c"]
    docs = [(i, t, None if i == 7 else "en", source[(i or 0) % 4], None if i == 8 else len(t or ""), *EXTRA) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 1000), 0) for i, _ in rows if i is not None and i < 1080 and i % 3] + [(None, 1, 0), (9999, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "qq rr ss")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def stage(spark, docs, sf, name):
    out = dict(cp.STAGES)[name](spark, docs, sf)
    if name != "source_mixing":
        assert out.columns == docs.columns
    return out.collect()


def untouched(got, rows):
    """Rows pass whole: text and extra columns are what they were."""
    left = Counter(rows)
    for r in got:
        assert left[r["doc_id"], r["text"]] > 0 and [r[c] for c in ("_id", "removed", "score", "others", "size", "kept", "a.b")] == EXTRA


def test_quality_stage(spark, docs, sf, rows):
    got = stage(spark, docs, sf, "quality_classifier")
    untouched(got, rows)
    ids = {r["doc_id"] for r in got}
    assert len(ids & set(range(400))) >= 392 and len(ids & set(range(1000, 1080))) <= 2


def test_line_stage(spark, docs, sf, rows):
    seen, want = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        out = []
        for x in (t or "").split("\n"):
            key = " ".join(x.lower().split())
            if not key or key not in seen:
                out.append(x)
            seen.add(key)
        want[i] = "\n".join(out)
    got = {r["doc_id"]: r for r in stage(spark, docs, sf, "line_dedup")}
    for i in [*range(400), *range(1000, 1080), 2100, 3003]:  # no line of these is near another
        assert got[i]["text"] == want[i]
        assert got[i]["n_chars"] == len(want[i])
    assert 2000 not in got and 2002 not in got and 2101 not in got and len(got[2001]["text"].split("\n")) <= 1
    assert got[3000]["text"] is None and got[3001]["text"] == "" and got[3002]["text"] == " \n\t"


def test_near_duplicate_stage(spark, docs, sf, rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    def groups(rows):
        some = [(k, shingles(t)) for k, (_, t) in enumerate(rows)]
        group = {k: k for k, _ in some}
        for k, a in some:
            for j, b in some[k + 1:]:
                common = len(a & b)
                if common and 100 * common >= 80 * (len(a) + len(b) - common):
                    x, y = group[k], group[j]
                    group = {n: min(x, y) if g in (x, y) else g for n, g in group.items()}
        return group

    def want(rows):
        """Of each group the smallest id; ids that are null come last."""
        group = groups(rows)
        best = {}
        for k, g in group.items():
            i = rows[k][0]
            best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
        return Counter(None if unknown else i for unknown, i in best.values())

    got = stage(spark, docs, sf, "minhash_near_dedup")
    untouched(got, rows)
    assert Counter(r["doc_id"] for r in got) == want(rows)
    assert not {2000, 2001, 2002} & {r["doc_id"] for r in got} and sum(r["doc_id"] is None for r in got) == 1
    # Rows that repeat the smallest id, or all have none: one of each group stays.
    again = [(5, prose(2)), (5, prose(3)), (6, None), (None, None), (7, ""), (7, "")]
    again += [again[0], again[0], (9, again[0][1] + " x"), (None, again[1][1]), (None, prose(2))]
    again += [again[-1], (None, again[-1][1] + " y")]
    odd = spark.createDataFrame([(i, t, f"l{k}") for k, (i, t) in enumerate(again)], "doc_id bigint, text string, lang string").repartition(3)
    out = cp.near_duplicate_stage(spark, odd, sf).collect()
    assert Counter(r["doc_id"] for r in out) == want(again)
    assert Counter(r["doc_id"] for r in out) == {5: 2, 6: 1, None: 2, 7: 2}
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, cp.near_duplicate_stage(spark, odd, sf).collect()), key=repr)


def test_decontamination_stage(spark, docs, sf, rows):
    got = stage(spark, docs, sf, "benchmark_decontamination")
    text = dict(rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows if i != 2101)
    for r in got:
        if r["doc_id"] == 2100:
            assert r["text"].split() == text[2100].replace(ITEM, "").split() and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == text[r["doc_id"]]


def test_mixing_stage(spark, docs, sf, rows):
    got = stage(spark, docs, sf, "source_mixing")
    source = ["b", "a", None, "c"]
    size = Counter()
    for i, t in rows:
        size[source[(i or 0) % 4]] += len((t or "").split())
    taken, target = Counter(), {}
    for r in got:
        assert r["epochs"] > 0 and r["taken"] == r["epochs"] * r["size"] <= 2 * r["size"] == 2 * len((r["text"] or "").split())
        assert r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    longest = max(len((t or "").split()) for _, t in rows)
    assert set(target) == set(size) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in stage(spark, docs, sf, "source_mixing"))


def test_run(spark, sf, rows, tmp_path):
    got = cp.run(spark, sf).collect()
    ids = {r["doc_id"] for r in got}
    assert not ids & {2000, 2002, 2101} and len(ids & set(range(1000, 1080))) <= 2
    assert all(ITEM not in (r["text"] or "") for r in got) and ids <= {i for i, _ in rows}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
