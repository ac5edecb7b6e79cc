"""Paired tests, matrices and properties, against plain Python."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant import names
from accordant.functions import sets, stats
from accordant.operators import analysis, correlation, filters, reshape, rollup, significance, workqueue

MODELS = ["m1", "m2", "m3", "m4"]
ACTIONS = ["zero-shot", "fixing"]


def flags(seed=3, n=40):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        for ds in ("d1", "d2"):
            for m in MODELS[:3]:
                for a in ACTIONS:
                    if rng.random() < 0.9:
                        rows.append((str(q), a, ds, m, *[rng.choice([0, 1, 1, None]) for _ in names.TESTED]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "q_id string, action string, dataset string, llm string, " + ", ".join(f"{f} int" for f in names.TESTED)
    )


def tail(k, n):
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n if n else 1.0


def test_action_counts_and_p_values(spark):
    rows = flags()
    df = frame(spark, rows)
    got = {(r.dataset, r.llm, r.action): r for r in significance.paired_counts(df, ACTIONS).collect()}
    p = {(r.dataset, r.llm, r.action): r for r in significance.action_p_values(df, ACTIONS).collect()}
    at = {(r[0], r[1], r[2], r[3]): r[4:] for r in rows}
    for (ds, m, act), r in got.items():
        for i, f in enumerate(names.TESTED):
            n10 = n01 = 0
            for (q, a, d, mm), v in at.items():
                base = at.get((q, "zero-shot", d, mm))
                if a == act and mm == m and base and ds in (d, "overall"):
                    n10 += v[i] == 1 and base[i] == 0
                    n01 += v[i] == 0 and base[i] == 1
            assert (r[f"n10_{f}"], r[f"n01_{f}"]) == (n10, n01)
            assert p[ds, m, act][f"p_{f}"] == pytest.approx(tail(n10, n10 + n01), abs=6e-5)
    assert all(p[k][f"p_{f}"] == 1.0 for k in p if k[2] == "zero-shot" for f in names.TESTED)


@pytest.mark.parametrize("pool", [False, True])
def test_pairwise_matrix(spark, pool):
    rows = flags(5, 25)
    got = {
        (r.action, r.dataset, r.predicate, r.llm_i, r.llm_j): r
        for r in significance.pairwise_p_values(frame(spark, rows), MODELS, ACTIONS, pool_by_id=pool).collect()
    }
    assert len(got) == 2 * 3 * 6 * 16
    for (act, ds, f, mi, mj), r in got.items():
        k = 4 + names.TESTED.index(f)
        a = [x for x in rows if x[1] == act and x[3] == mi and ds in (x[2], "overall")]
        b = [x for x in rows if x[1] == act and x[3] == mj and ds in (x[2], "overall")]
        pairs = [(x[k], y[k]) for x in a for y in b if x[0] == y[0] and (x[2] == y[2] or (pool and ds == "overall"))]
        n10, n01 = pairs.count((1, 0)), pairs.count((0, 1))
        assert r.p == (1.0 if mi == mj else pytest.approx(tail(n10, n10 + n01), abs=6e-5))
        if mi != mj:
            assert (r.n10, r.n01) == (n10, n01)
    assert got["fixing", "d1", "eq_a1_a2", "m1", "m4"].p == 1.0


@pytest.mark.parametrize("pool", [False, True])
def test_pair_counts_over_many_words(spark, pool):
    """Hundreds of questions, dealt over tasks, some models absent from a dataset or altogether."""
    rng = random.Random(1)
    models = [f"m{i}" for i in range(7)]
    flags = ["eq_a1_a2", "disj_a3_a4"]
    rows = [
        (str(q), "zero-shot", d, m, rng.choice([0, 1, None]), rng.choice([0, 1]))
        for d, n in (("d1", 300), ("d2", 130), ("d3", 1)) for q in range(n) for m in models[:-1]
        if rng.random() < 0.8 and not (d == "d2" and m == "m0")
    ]
    df = spark.createDataFrame(rows, "q_id string, action string, dataset string, llm string, eq_a1_a2 int, disj_a3_a4 int").repartition(5)
    got = {
        (r.dataset, r.predicate, r.llm_i, r.llm_j): (r.n10, r.n01)
        for r in significance.pairwise_counts(df, models, ["zero-shot"], flags, pool_by_id=pool).collect()
    }
    seen = sorted({r[2] for r in rows})
    assert set(got) == {(d, f, a, b) for d in [*seen, "overall"] for f in flags for a in models for b in models}
    by_question = {}
    for q, _, d, m, *values in rows:
        by_question.setdefault(q, []).append((d, m, values))
    want = dict.fromkeys(got, (0, 0))
    for entries in by_question.values():
        for d, m, v in entries:
            for e, n, w in entries:
                for f, x, y in zip(flags, v, w):
                    where = ([d] if d == e else []) + (["overall"] if d == e or pool else [])
                    for level in where:
                        k = (level, f, m, n)
                        want[k] = (want[k][0] + ((x, y) == (1, 0)), want[k][1] + ((x, y) == (0, 1)))
    assert got == want


def test_hot_group_and_hot_element(spark):
    """A third of all rows in one group, a third of one element; nothing is lost or doubled."""
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("q_id"),
        F.lit("zero-shot").alias("action"), F.lit("d").alias("dataset"), F.lit("m").alias("llm"),
        F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("element"),
        (F.col("id") % 128).cast("int").alias("mask"), F.lit(15).alias("seen"),
    )
    got = analysis.analyse_masks(rows).filter("q_id = 'hot'").first()
    masks = {}
    for i in range(0, n, 3):
        e = "same" if i % 2 == 0 else str(i)
        masks[e] = masks.get(e, 0) | (i % 128)
    a1, a2 = ({e for e, m in masks.items() if m >> b & 1} for b in (0, 1))
    assert got.size_a1 == len(a1) and got.size_a2 == len(a2)
    assert got.jac_a1_a2 == pytest.approx(len(a1 & a2) / len(a1 | a2), abs=5.1e-5)
    assert got.eq_a1_a2 == int(a1 == a2)


words = st.lists(st.sampled_from(["a", "b", "c", "d", None]), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_set_properties(spark, pairs):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(
        sets.jaccard(a, b).alias("ab"), sets.jaccard(b, a).alias("ba"), sets.equal(a, b).alias("eq"),
        sets.is_subset(a, b).alias("sub"), sets.is_subset(b, a).alias("sup"), "a", "b",
    )
    for r in df.collect():
        x, y = set(r.a), set(r.b)
        assert r.ab == r.ba and 0 <= r.ab <= 1
        assert r.eq == (r.sub and r.sup) == (x == y)
        assert r.ab == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)


def test_one_sided_tails_overlap(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("a"), F.floor(F.col("id") / 20).alias("b"))
    low = df.select(
        (stats.mcnemar_one_sided(F.col("a"), F.col("b")) + stats.mcnemar_one_sided(F.col("b"), F.col("a"))).alias("s")
    ).agg(F.min("s")).first()[0]
    assert low >= 1.0 - 1e-12


def test_stratified_means_skip_unlabelled(spark):
    rows = [("d1", "zero-shot", "m", "Equivalence", 1, 0.5), ("d1", "zero-shot", "m", "Overlap", 0, 0.25),
            ("d2", "zero-shot", "m", None, 1, 1.0), ("d2", "zero-shot", "m", "Equivalence", 0, 0.0),
            ("d1", "fixing", "m", "Equivalence", 1, 1.0)]
    df = spark.createDataFrame(rows, "dataset string, action string, llm string, r_12 string, eq_a1_a2 int, jac_a1_a2 double")
    got = {(r.dataset, r.action): r for r in rollup.stratified_means(df).collect()}
    assert set(got) == {("d1", "zero-shot"), ("d2", "zero-shot"), ("overall", "zero-shot")}
    assert (got["overall", "zero-shot"].eq_a1_a2_pos, got["overall", "zero-shot"].eq_a1_a2_neg) == (0.5, 0.0)
    assert got["d2", "zero-shot"].jac_a1_a2_neg is None
    summary = df.groupBy("dataset", "action", "llm").count()
    assert rollup.add_stratified_means(summary, df).filter("action = 'fixing'").first().eq_a1_a2_pos is None


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), float((i * 7) % 11), 5.0 - i) for i in range(14)], "x double, y double, z double")
    got = {r.metric: r for r in correlation.correlate(df, F.col("x"), {"y": F.col("y"), "z": F.col("z")}).collect()}
    assert got["z"].r == pytest.approx(-1.0) and got["z"].p == pytest.approx(0.0, abs=1e-12) and got["z"].significant == "Yes"
    assert got["y"].n == 14 and got["y"].significant == "No"
    assert stats.pearson_p_value(0.0, 10) == 1.0 and stats.pearson_p_value(None, 10) is None
    assert stats.pearson_p_value(0.002, 1_000_000) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-4)


def test_work_queue(spark):
    q = spark.range(6).select("id", F.col("id").alias("q_index"))
    a = spark.createDataFrame([(0, "Q1", ["x"]), (0, "Q3", []), (1, "Q1", []), (2, "Q3", ["y"])], "id long, q_serie string, answer array<string>")
    assert sorted(r.id for r in workqueue.pending(q, a, ["id"]).collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in workqueue.pending(q, a, ["id"], require_nonempty=False).collect()) == [3, 4, 5]
    assert sorted(r.id for r in workqueue.pending_in_any(q, a, ["id"], ["Q1", "Q3"]).collect()) == [1, 2, 3, 4, 5]
    assert workqueue.id_range(q, 2, 4).count() == 2 and workqueue.id_range(q, 4).count() == 2


def test_result_helpers(spark):
    df = spark.createDataFrame(
        [("g1", "m1", 0.2, None), ("g1", "m2", 0.01, None), ("g2", "m1", 0.6, None)], "g string, llm string, p double, v double"
    )
    assert filters.groups_with_signal(df, ["g"], ["p"]).count() == 2
    assert filters.groups_with_values(df, ["g"], ["v"]).count() == 0
    assert filters.without_sentinel(df, ["p", "v"], 0.6).count() == 2
    assert filters.columns_after(df, "llm") == ["p", "v"]
    with pytest.raises(Exception, match="unknown model"):
        dim = spark.createDataFrame([("m1", 1)], "llm string, id int")
        reshape.attach_models(df, dim, ["id"], strict=True).collect()
    order = spark.createDataFrame(
        [(0, "b", "fixing"), (1, "a", "zero-shot"), (2, "b", "zero-shot"), (3, "c", "fixing")], "row int, llm string, action string"
    )
    assert [tuple(r) for r in reshape.model_order(order, "row").orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    none = order.filter("action = 'fixing'")
    assert [r.llm for r in reshape.model_order(none, "row").orderBy("pos").collect()] == ["b", "c"]
    sizes = spark.createDataFrame([("a", "7b"), ("b", "70b"), ("c", "large")], "llm string, size string")
    areas = {r.llm: r.area for r in reshape.bubble_areas(sizes).collect()}
    assert areas == {"a": 200.0, "b": 200.0, "c": 420.0}
    areas = {r.llm: r.area for r in reshape.bubble_areas(sizes.filter("llm <> 'c'")).collect()}
    assert areas == {"a": 80.0, "b": 420.0}
