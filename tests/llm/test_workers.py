"""What Python workers hold: one worker a task, each text once, one table of powers."""

import numpy as np

from scalarlake.llm import common, lines
from scalarlake.llm.quality import CUTS, MEASURES, Model, score


def test_links_of_lines_take_one_worker_a_task(spark, monkeypatch):
    plans, inner = [], lines.connected

    def connected(edges, *args, **more):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return inner(edges, *args, **more)

    monkeypatch.setattr(lines, "connected", connected)
    docs = spark.createDataFrame([(1, "one line of several words\nanother one"), (2, "one line of several words"), (None, None)],
                                 "doc_id long, text string")
    assert sorted(map(tuple, lines.removed_lines(docs).select("doc_id", "removed").collect())) == [(2, [0])]
    # connected() begins in Python, so what it is given must not end in Python in the same stage.
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_score_passes_texts_once(spark):
    model = Model(np.zeros((MEASURES, len(CUTS))), np.zeros(MEASURES * (len(CUTS) + 1) + 1), 0.5)
    docs = spark.createDataFrame([(1, "x", "a text", 2.0), (None, "y", None, None)], "doc_id long, `t` string, text string, score double")
    out = score(docs, model)
    assert out.columns == ["doc_id", "t", "text", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "x", "a text", 0.5), (None, "y", None, 0.5)]
    assert out._jdf.queryExecution().analyzed().children().head().output().size() == 3


def test_powers_are_kept_once():
    short, long = np.arange(500, dtype=np.uint8), np.zeros(1 << 18, np.uint8)
    before = common.Prefix(short).hash_run(400, 100)
    common.Prefix(long)
    assert np.array_equal(common.Prefix(short).hash_run(400, 100), before)
    assert len(common._powers) == 2 and all(len(p) == len(common._powers[0]) > 1 << 18 for p in common._powers)
