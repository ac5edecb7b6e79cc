import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from accordant.llm import vector_codes
from accordant.llm.vector_codes import Blocks, compressed, hilbert_order, hilbert_words

SCHEMA = "vec_id long, embedding array<{}>, label int, error string, code int, v long, `of` long"


def frame(spark, rows, kind="float", parts=3):
    return spark.createDataFrame([(*r, "e", 1, 2, 3) for r in rows], SCHEMA.format(kind)).repartition(parts)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    wide = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts)) * parts
    each = wide // parts
    whole = [[math.floor(Fraction(x) * scale) for x in r[1]] + [0] * (wide - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    cut = lambda v, p: v[p * each:(p + 1) * each]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in whole:
                groups.setdefault(nearest(cut(v, p), books[p])[0], []).append(cut(v, p))
            for e, mine in groups.items():
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, whole):
        at = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in at)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{i:02x}" for i, _ in at), error, r[2]))
    fit = lambda n: n if n < 2**63 else None
    return [(i, c, fit(e), fit(by_label[lab]), sha) for i, c, e, lab in out]


def check(spark, rows, kind="float", parts=3):
    got = [tuple(r) for r in compressed(frame(spark, rows, kind, parts)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 400])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([i, i, 3, None]), [single(rng.gauss(0, 0.3)) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(9, None, 1), (8, [0.0] * 15 + [None], 1), (7, [0.0] * 15 + [float("nan")], 2), (6, [float("-inf")] * 16, None)]
    check(spark, rows)


def test_equal_vectors_ties_and_zeros(spark):
    rows = [(i, [0.0, -0.0001220703125] * 8, 1) for i in range(60)] + [(i, [single(i % 3 - 1)] * 16, None) for i in range(60, 90)]
    check(spark, rows)


def test_lengths_and_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 7, 8, 9, 19]))], i % 3) for i in range(60)]
    check(spark, rows, "double")
    rows += [(100 + i, [rng.choice([1e300, -1e300, 1e9, 1e-300, 0.5]) for _ in range(9)], 7 + i % 2) for i in range(20)]
    check(spark, rows, "double")


def test_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_NUMBERS", 16 * 300)
    rng = random.Random(6)
    rows = [(i, [single(rng.gauss(i % 5, 0.2)) for _ in range(16)], i % 4) for i in range(1500)]
    check(spark, rows, parts=2)


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert_words(grid, bits)
        order = np.lexsort(keys.T[::-1])
        assert len({k.tobytes() for k in keys}) == len(grid)
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_the_nearest_and_drop_most():
    rng = np.random.default_rng(7)
    entries = rng.integers(-1000, 1000, (16, 2)).astype(np.int64)
    part = (entries[rng.integers(0, 16, 6000)] + rng.integers(-60, 60, (6000, 2))).astype(np.int64)
    blocks = Blocks(part[hilbert_order(part)])
    d = ((blocks.rows[:, None] - entries) ** 2).sum(axis=2)
    where, error = blocks.nearest(entries)
    assert (where == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    sums, counts = blocks.totals(entries)
    for e in range(16):
        assert (sums[e] == blocks.rows[where == e].sum(axis=0)).all() and counts[e] == (where == e).sum()
    assert blocks.shortlists(entries).mean() < 0.4
