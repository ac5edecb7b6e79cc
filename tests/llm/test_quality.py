import os

import numpy as np
import pytest

from accordant.llm.quality import NAMES, AdditiveModel, fit_additive, fit_quality, quality, text_features
from accordant.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def test_learns_shapes_and_a_pair():
    rng = np.random.default_rng(11)
    x = rng.random((4000, len(NAMES)))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) & (x[:, 2] > 0.2)).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    p = model.score(x[3000:])
    assert ((p >= 0.5) == y[3000:]).mean() > 0.93 and {0, 1} in [{i, j} for i, j, _ in model.pairs]
    by_hand = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(model.edges, model.tables, x[3000]))
    by_hand += sum(t[np.searchsorted(model.coarse[i], x[3000, i], side="right"), np.searchsorted(model.coarse[j], x[3000, j], side="right")] for i, j, t in model.pairs)
    assert p[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_constant_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 0.1), (None, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for some in (labels, labels.filter("false")):
        model = fit_quality(docs, some)
        assert not model.pairs and len({r.q for r in docs.select(quality(model).alias("q")).collect()}) == 1
    assert docs.filter("false").select(quality(AdditiveModel(0.0)).alias("q")).collect() == []


def test_features_of_odd_texts():
    for t in ("", " \n", "!", "A" * 200_000, "　é|| \n\n|", "a " * 50_000):
        f = text_features(t)
        assert len(f) == len(NAMES) and np.isfinite(f).all()


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_held_out_accuracy(spark):
    got = QUERIES["op8_additive_quality"](spark, ROOT).join(spark.read.parquet(f"{ROOT}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9 and all(0 <= r.score <= 1 for r in got)
