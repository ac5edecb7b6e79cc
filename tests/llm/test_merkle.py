import hashlib
import random
import zlib

import pytest

from accordant.llm import merkle
from accordant.llm.bitmap_rank import placed
from accordant.llm.merkle import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, total string, word int, leaf string, gkey int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "t", 2, "l", 3) for r in rows], SCHEMA).repartition(parts)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def up(nodes):
    """All levels over ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = up([leaf_of(r, r[1]) for r in by_source[s]])
    top = up([trees[s][-1][0] for s in names])
    root = top[-1][0] if names else None
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            text = r[1]
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at, siblings = leaf_of(r, text), []
            for levels, k in ((trees[s], i), (top, place)):
                for nodes in levels[:-1]:
                    lo = k - k % 3
                    run = nodes[lo:lo + 3]
                    siblings += run[:k - lo] + run[k - lo + 1:]
                    at = sha(*run[:k - lo], at, *run[k - lo + 1:])
                    k //= 3
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, sha(*siblings), at, at == root))
    return out


def check(spark, rows, parts=3):
    got = [tuple(r) for r in manifest(frame(spark, rows, parts)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def sample(n, seed=1):
    rng = random.Random(seed)
    texts = ["", None, "a\nb", "\n", "é\n x", "plain", "y" * 100_000 + "\n"]
    sources = [None, "", "b", "B", "é", "\U0001F600", "￿"] + ["hot"] * 7
    return [
        (rng.choice([i, i, i * 7_000_001, -i, i << 40]), rng.choice(texts), rng.choice([None, "en", ""]), rng.choice(sources), rng.choice([None, i, -1]))
        for i in range(n)
    ]


def test_against_brute_force(spark):
    rows = sample(400)
    rows += [(None, "x\n", "en", "hot", 1), (None, "x\n", "en", "hot", 1), (None, "z", None, "hot", 1), (None, None, None, None, None)]
    rows += [(5, "same", "en", "hot", 2)] * 9 + [(5, f"other {i}", "en", "hot", 2) for i in range(5)]
    rows += [(2**63 - 1, "end", None, "hot", 0), (-(2**63), "start", None, "hot", 0)]
    got = check(spark, rows, 5)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    check(spark, [(i, f"t\n{i}", "en", "s", i) for i in range(n)])


def test_one_per_source_and_empty(spark):
    check(spark, [(i, "t", "en", f"s{i}", i) for i in range(11)])
    assert manifest(frame(spark, [])).collect() == []


def test_several_steps(spark, monkeypatch):
    """Arrays of nine slots: four rounds up and down, in sources and above them."""
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [(i, f"t\n{i % 7}", "en", "hot", i) for i in range(800)] + [(i, "u", "en", f"s{i:03d}", i) for i in range(100)]
    check(spark, rows, 4)


def test_all_rows_alike_or_without_id(spark):
    check(spark, [(1, "same\n", "en", "s", 1)] * 40)
    check(spark, [(None, f"{i % 20}", "en", "s", 1) for i in range(60)])


def test_ranks_over_wide_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, rng.randrange(-(2**63), 2**63), rng.randrange(100)]), rng.randrange(3), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, second long, row long").repartition(4)
    got = {(r.g, r.slot): (r.id, r.second) for r in placed(df, ["g"], ["id", "second"], "row").collect()}
    assert len(got) == 600
    for g in "ab":
        want = sorted([(r[1], r[2]) for r in rows if r[0] == g], key=lambda v: (v[0] is None, v[0] or 0, v[1]))
        assert [got[g, i] for i in range(len(want))] == want
