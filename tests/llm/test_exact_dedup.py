import hashlib
import random
import re

import numpy as np

from accordant.llm.exact_dedup import decoded, encoded, exact_duplicates, keep_first, quotient_filters, repeated_prints

SCHEMA = "doc_id long, text string, fp long, kept string, text_sha256 string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "k", "s") for i, t in rows], SCHEMA).repartition(parts)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "a  b", "a\tb", "a\x0bb ", "A b", "é", "e\u0301", "x" * 300_000, "x" * 300_000 + " "]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "a b"), (None, "only"), (7, "only"), (5, "twice"), (5, "twice")]
    got = exact_duplicates(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        want.append((i, min(known) if known else None, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = keep_first(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "fp", "kept", "text_sha256"]
    rows_left = left.collect()
    assert sorted(norm(r.text) for r in rows_left) == sorted(groups)
    assert all(r.doc_id == min((x for x in groups[norm(r.text)] if x is not None), default=None) for r in rows_left)


def test_filters_merge_without_loss(spark):
    rng = np.random.default_rng(2)
    prints = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    prints = np.r_[prints, prints[:500], prints[:20], -1, -1, 0]
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long").repartition(5)
    values, n = np.unique(prints, return_counts=True)
    want = {(int(v), int(k)) for v, k in zip(values, n) if k > 1}
    for bits in (0, 3):
        assert {(r.fp, r.n) for r in repeated_prints(quotient_filters(df, "fp", bits), bits).collect()} == want


def test_empty_and_all_alike(spark):
    assert exact_duplicates(frame(spark, [])).collect() == [] and keep_first(frame(spark, [])).collect() == []
    got = exact_duplicates(frame(spark, [(i, "same") for i in range(50)])).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 50)} and [r.doc_id for r in got if r.kept] == [0]


CLASHES = ["_at", "_gone", "_hit", "_mark", "_id", "_id2", "_digest", "_digest2", "_row", "_word", "_bits", "hash", "gone", "sha", "id", "norm", "fp", "row", "n"]


def clashing(spark, rows):
    """Documents with a column of every name used inside."""
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame([(i, t, *range(len(CLASHES))) for i, t in rows], schema).repartition(3)


def test_clashing_names(spark):
    rows = [(i, f"t{i % 4}") for i in range(20)] + [(0, "t0"), (None, "u"), (None, "u")]
    left = keep_first(clashing(spark, rows))
    got = left.collect()
    assert left.columns == ["doc_id", "text", *CLASHES]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, i, f"t{i}") for i in range(4)] + [(True, 0, "u")]
    assert all(tuple(r)[2:] == tuple(range(len(CLASHES))) for r in got)


def test_a_filter_gives_back_all_values_and_is_smaller_than_they_are():
    rng = np.random.default_rng(3)
    for bits, size in ((64, 1), (64, 3), (64, 50_000), (40, 20_000), (6, 40), (3, 8)):
        values = np.unique(rng.integers(0, 2**bits - 1, size, dtype=np.uint64, endpoint=True))
        values = np.unique(np.r_[values, values[:1] + np.uint64(1) if values[0] < 2**bits - 1 else values[:1]])
        n = np.where(rng.random(len(values)) < 0.1, 7, 1).astype(np.uint64)
        row = encoded(values, n, bits)
        got, counts = decoded(row)
        assert (got == values).all() and (counts == n).all()
    values = np.sort(rng.integers(0, 2**63, 60_000).astype(np.uint64) * np.uint64(2))
    row = encoded(np.unique(values), np.ones(len(np.unique(values)), np.uint64), 64)
    assert len(row["marks"]) + len(row["remainders"]) < 0.9 * values.nbytes
    run = np.arange(5000, dtype=np.uint64)  # all want one slot and shift each other
    assert (decoded(encoded(run, np.ones(5000, np.uint64), 64))[0] == run).all()
