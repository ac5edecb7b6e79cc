import random
import zlib
from collections import defaultdict

import pytest

from accordant.llm.kd_shards import DIMENSIONS, _metadata, kd_tree, sharded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, cell int, size int, row int, slot int, own int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(parts)


def size(t):
    return len((t or "").encode()) + 1


def check(spark, rows, shards=16, parts=3, **more):
    got = sharded(frame(spark, rows, parts), shards, **more).collect()
    key = lambda v: tuple((x is None, x or 0) for x in v)
    want = [(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows]
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=key) == sorted(want, key=key)
    by_shard = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
    for mine in by_shard.values():
        mine.sort(key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [(r.doc_id is None, r.doc_id or 0) for r in mine]
        assert ids == sorted(ids)
    weights = [sum(r.size for r in by_shard[s]) for s in range(max(shards, max(by_shard, default=0) + 1))]
    return weights


def sample(n, seed=1):
    rng = random.Random(seed)
    return [
        (rng.choice([i, i, None, 7, i << 40, -i]), rng.choice(["", None, "é" * rng.randrange(50), "x" * rng.randrange(300)]),
         rng.choice([None, "en", "de"]), rng.choice(["hot", "hot", None, f"s{i % 5}"]), rng.choice([None, rng.randrange(300), -4]))
        for i in range(n)
    ]


def brute(rows, shards):
    """The same cuts over a list: ``rows`` are tuples of the dimensions, then id, row and size."""
    spread = [(min(r[d] for r in rows), max(r[d] for r in rows)) for d in range(5)]
    out = {}

    def cut(mine, first, k):
        if k == 1 or not mine:
            out.update({r[6]: first for r in mine})
            return
        share = [(max(r[d] for r in mine) - min(r[d] for r in mine)) / max(1, spread[d][1] - spread[d][0]) for d in range(5)]
        d = max(range(5), key=lambda i: (share[i], -i))
        mine = sorted(mine, key=lambda r: (r[d], r[5], r[6]))
        aim, upto, at = sum(r[7] for r in mine) * (k // 2) / k, 0, 0
        while upto + mine[at][7] < aim:
            upto += mine[at][7]
            at += 1
        at += upto + mine[at][7] - aim < aim - upto
        cut(mine[:at], first, k // 2)
        cut(mine[at:], first + k // 2, k - k // 2)

    cut(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [16, 5])
def test_cuts_against_brute_force(spark, shards):
    rows = _metadata(frame(spark, sample(700), 1), "doc_id", "text", "lang", "source", "n_chars")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    dealt, tree = kd_tree(rows, shards)
    got = {r.row: r.shard for r in dealt.collect()}
    listed = [(*[r[d] for d in DIMENSIONS], r.by_id, r.row, r.size) for r in rows.collect()]
    assert got == brute(listed, shards)
    assert len({c.dimension for c in tree}) > 1


def test_near_equal(spark):
    rows = sample(3000, 2)
    most = max(size(r[1]) for r in rows)
    weights = check(spark, rows)
    assert max(weights) - min(weights) <= 4 * most and len(weights) == 16


def test_alike_and_hot(spark):
    weights = check(spark, [(1, "same", "en", "s", 4)] * 160)
    assert max(weights) - min(weights) <= 10
    weights = check(spark, [(None, "x" * 9, None, None, None)] * 70 + [(i, "y" * 9, "en", "s", 9) for i in range(90)])
    assert weights == [100] * 16


def test_few_rows_empty_and_long(spark):
    assert check(spark, []) == [0] * 16
    assert sum(check(spark, [(i, "t", "en", "s", 1) for i in range(3)])) == 6
    weights = check(spark, [(0, "z" * 500_000, "en", "s", 500_000)] + [(i, "t" * 99, "en", "s", 99) for i in range(1, 200)])
    assert sorted(weights)[-1] >= 500_001
    ends = [(2**63 - 1, "a", None, "s", 2**63 - 1), (-(2**63), "b", None, "s", -(2**63)), (0, "c", None, "s", 0)] * 8
    check(spark, ends)


def test_target_bytes(spark):
    rows = [(i, "t" * 99, "en", "s", 99) for i in range(300)]
    weights = check(spark, rows, shards=1, target_bytes=3000)
    assert len(weights) == 10 and all(w == 3000 for w in weights)
