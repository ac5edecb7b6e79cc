"""Row numbers, medians by counting and summaries that grow."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from accordant import names
from accordant.operators import rollup
from accordant.operators.ordering import in_file_order, numbered
from accordant.operators.rollup import medians
from accordant.streaming import summary_store


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(50)]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, a int, b double").repartition(7)
    got = sorted((r.pos, r.a, r.b) for r in numbered(df, ["a", F.desc("b")]).collect())
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want] and [g[0] for g in got] == list(range(3000))
    assert numbered(df.filter("false"), ["a"]).count() == 0


def test_in_file_order(spark, tmp_path):
    for f in range(5):
        (tmp_path / f"{f}.csv").write_text("\n".join(f"{f},{i}" for i in range(f * 300)) + ("\n" if f else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = in_file_order(spark.read.schema("f int, i int").csv(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.f, r.i) for r in sorted(rows, key=lambda r: r.position)] == [(f, i) for f in range(5) for i in range(f * 300)]
    assert sorted(r.position for r in rows) == list(range(3000))


def test_medians_against_the_plain_ones(spark):
    rng = random.Random(2)
    pools = {
        "a": [0.0, 0.25, 0.5, 1.0], "b": [rng.uniform(-1e9, 1e9) for _ in range(500)], "c": [None],
        "d": [1e-300, -1e-300, 0.0, float("inf"), float("-inf"), 5e-324, 1.0], "e": [None, 3.0],
    }
    rows = [(g, rng.choice(pool), rng.choice(pools["a"])) for g, pool in pools.items() for _ in range(rng.choice([101, 200]))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r.g: (r.x, r.y) for r in medians(df, ["g"], ["x", "y"]).collect()}
    plain = {r.g: (r.x, r.y) for r in df.groupBy("g").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    assert got == plain
    for g in "ab":
        values = [r[1] for r in rows if r[0] == g]
        assert got[g][0] == pytest.approx(statistics.median(values), rel=1e-12)


def analysis(spark, seed, n=300):
    rng = random.Random(seed)
    columns = [*names.FLAGS, *names.JACCARDS, *names.IDKS]
    rows = [
        (f"{seed}-{q}", rng.choice(["zero-shot", "classification", "fixing"]), rng.choice(["d1", "d2"]), rng.choice(["m1", "m2"]),
         *[rng.choice([None, 0, 1]) for _ in names.FLAGS], *[rng.choice([None, round(rng.random(), 4)]) for _ in names.JACCARDS],
         *[rng.choice([0, 1]) for _ in names.IDKS])
        for q in range(n)
    ]
    types = [*["int"] * len(names.FLAGS), *["double"] * len(names.JACCARDS), *["int"] * len(names.IDKS)]
    schema = "q_id string, action string, dataset string, llm string, " + ", ".join(f"{c} {t}" for c, t in zip(columns, types))
    return spark.createDataFrame(rows, schema)


def test_summary_of_batches_is_the_summary_of_all(spark, tmp_path):
    store, parts = str(tmp_path / "store"), [analysis(spark, i) for i in range(3)]
    assert summary_store.batches(spark, store) == []
    added = [summary_store.add_batch(parts[i], store, f"b{i}") for i in (0, 1, 0, 2, 1)]
    assert added == [True, True, False, True, False] and summary_store.batches(spark, store) == ["b0", "b1", "b2"]
    whole = rollup.summarise(parts[0].union(parts[1]).union(parts[2]))
    got = summary_store.read_summary(spark, store).select(*whole.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    with pytest.raises(ValueError):
        summary_store.add_batch(parts[0], store, "../b")
