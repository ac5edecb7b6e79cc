import re

import pytest
from pyspark.sql import types as T

from accordant.llm.mixing import _fill, mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size int, taken string, row string"


def words(n):
    return " ".join(["w"] * n)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], SCHEMA)


def targets(sizes):
    """Targets by hand: share by weight, cap at three times the size, share what exceeds again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in order}
        capped |= over


def test_targets_and_budgets(spark):
    rows, i = [], 0
    for source, lengths in {"b": range(1, 80), "a": [3] * 40 + [7] * 9, "é": [200, 1], None: range(5, 30), "Z": [50] * 11}.items():
        for n in lengths:
            rows.append((i, words(n), source))
            i += 1
    got = mix(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(i))
    sizes, source_of, size_of = {}, {}, {}
    for d, t, s in rows:
        size_of[d] = len(t.split())
        sizes[s] = sizes.get(s, 0) + size_of[d]
        source_of[d] = s
    want, taken = targets(sizes), {}
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size_of[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    smallest = {s: min(size_of[d] for d in size_of if source_of[d] == s) for s in sizes}
    for s in sizes:
        assert 0 <= want[s] - taken[s] + 1e-6 < smallest[s] + 1e-6 + 3 * (s == "Z") * 50
    again = mix(frame(spark, rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    copies = mixed_documents(frame(spark, rows))
    assert copies.columns == ["doc_id", "text", "source", "size", "taken", "row"]
    times = {}
    for r in copies.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert {r.doc_id: r.taken // r.size for r in got if r.taken} == times


def test_fill_is_exact_where_a_subset_fits():
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 25), 4))
        spare = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, 60)
        best = max(t for c in itertools.product(*[range(k + 1) for k in spare]) if (t := sum(a * b for a, b in zip(c, sizes))) <= budget)
        got = _fill(np.array(sizes), np.array(spare), budget)
        assert (got <= spare).all() and int((got * sizes).sum()) == best


def test_nulls_empty_repeats_and_long(spark):
    rows = [(1, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (2, "", None), (3, " \t\n", "a"), (4, words(70_000), "b"), (4, words(70_000), "b")]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.size) for r in got} == {(1, 0), (None, 2), (2, 0), (3, 0), (4, 70_000)}
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) <= 140_004
    assert mix(frame(spark, [])).collect() == []
    assert mixed_documents(frame(spark, [])).collect() == []
    assert sorted(r.size for r in mix(frame(spark, [(1, None, None)])).collect()) == [0]


def test_word_pattern(spark):
    text = "a\u00a0b c\x0bd\x0ce\x1cf  g"
    n = len(re.findall("[^\x20\x09-\x0d]+", text))
    assert mix(frame(spark, [(1, text, "s")])).first().size == n == 5


def test_schema(spark):
    got = mix(frame(spark, [(1, "a", "s")])).schema
    assert [(f.name, f.dataType) for f in got] == [
        ("doc_id", T.LongType()), ("size", T.LongType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("taken", T.LongType()),
    ]
