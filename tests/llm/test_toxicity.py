import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.llm import toxicity
from accordant.llm.queries import QUERIES
from accordant.llm.toxicity import ToxicModel, fit_toxicity, scan, score_toxicity, segments

ROOT = "/root/testdata/sf0.01"


def plain_segments(scores):
    """The best segment, then those to the left and right of it, again and again."""
    def best(lo, hi):
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if top is None or top[0] <= 0:
            return []
        return best(lo, top[3]) + [(top[3], top[4] - 1, top[0])] + best(top[4], hi)

    return best(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just(-1), st.integers(1, 10**6).map(lambda x: 3 + x / 1e5), st.integers(1, 10**6).map(lambda x: -2 - x / 1e5)), max_size=16))
def test_segments_equal_the_recursive_ones(scores):
    """Spans, not only sums: scores are such that hardly any two sums tie."""
    got = segments([(i, s) for i, s in enumerate(scores) if s != -1], -1)
    want = plain_segments(scores)
    if len({round(s, 9) for *_, s in want}) == len(want):
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_spread_hits_take_linear_time():
    """Left sums that rise and rise again are what a plain backward search is quadratic on."""
    import time

    def spent(n):
        scored = [(3 * i, 1.0 + (i % 7) / 100) for i in range(n)]
        start = time.process_time()
        out = segments(scored, -1.0)
        return time.process_time() - start, len(out)

    spent(1000)
    (a, n), (b, m) = spent(32_000), spent(128_000)
    assert b < 12 * a + 0.2 and (n, m) == (32_000, 128_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 5, 3, 17]), max_size=14))
def test_segments_are_all_maximal(scores):
    got = segments([(i, s) for i, s in enumerate(scores) if s > 0], -1)
    assert sum(s for *_, s in got) == sum(s for *_, s in plain_segments(scores))
    assert all(s == sum(scores[a:b + 1]) for a, b, s in got)
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_scan_gives_spans_in_the_text():
    n, best, found = scan("Nice É. You IDIOT, you moron! " + "fine words " * 60 + "idiot", lambda w: 8.0 if w in ("idiot", "moron") else 0.0, 1.5, 0.01)
    text = "Nice É. You IDIOT, you moron! " + "fine words " * 60 + "idiot"
    assert [text[a:b] for a, b, *_ in found] == ["IDIOT, you moron", "idiot"] and best > 15 and n == 127


def corpus(spark, n=400):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "vilewort"]) + rng.choice(["", "s"]))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_handles_odd_rows(spark):
    docs, labels = corpus(spark)
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (9999, 1), (0, 1)], labels.schema))
    model = fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(None, "you idiot", "x", 1), (1, None, None, None), (1, "", "x", 1), (2, "wak " * 40_000 + "vileworts idiot idiots", "x", 1)], docs.schema)
    got = score_toxicity(docs.union(odd), model, "t").select("doc_id", "text", F.col("t.score").alias("s")).collect()
    assert len(got) == docs.count() + 4 and all(0 <= r.s <= 1 for r in got)
    for r in got:
        assert (r.s >= 0.5) == any(w in (r.text or "") for w in ("idiot", "vilewort"))


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        model = fit_toxicity(docs, some)
        assert model.odds == {} and all(r.t.score < 0.5 for r in score_toxicity(docs, model, "t").collect())
    assert score_toxicity(docs.filter("false"), ToxicModel({}, 1.0, 1.0, 0.0, 0.0), "t").collect() == []


def test_chance_rate():
    rate = toxicity.chance_rate([(2.0, 0.01), (8.0, 0.0001)])
    import math

    assert 0.01 * math.exp(2 * rate) + 0.0001 * math.exp(8 * rate) + 0.9899 * math.exp(-0.25 * rate) == pytest.approx(1, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_held_out_accuracy(spark):
    got = QUERIES["op2_toxic_segments"](spark, ROOT).join(spark.read.parquet(f"{ROOT}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
