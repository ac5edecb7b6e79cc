import itertools
import math

import numpy as np

from accordant.llm.multi_index import MultiIndex, codebook, near_vectors, traverse
from test_components import brute

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n_links string, cell int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "a", "b", 2) for i, v in rows], SCHEMA).repartition(parts)


def expected(rows):
    unit = []
    for _, v in rows:
        fine = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float32).astype(float) if fine else None
        unit.append(x / np.sqrt(x @ x) if fine else None)
    links = [(i, j) for i, j in itertools.permutations(range(len(rows)), 2)
             if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    root = brute([*links, *((i, i) for i in range(len(rows)))])
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((vec, sum(a == i for a, _ in links), min(ids, default=None)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.08).tolist()))
    rows += [(1000 + i, rows[3][1]) for i in range(25)] + [(3, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15),
             (2006, [1.0, 0.0, 2.0]), (2007, [2.0, 0.0, 4.0]), (None, rows[5][1]), (2008, [5.0])]
    got = near_vectors(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_full_cells_are_cut(spark, monkeypatch):
    from accordant.llm import multi_index

    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    rows = [(i, ([1.0] * 8 + rng.normal(size=8) * 0.1).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(20)]
    got = near_vectors(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected(rows)


def test_traversal_visits_cells_by_distance():
    rng = np.random.default_rng(9)
    a, b = rng.random(6), rng.random(5)
    d = [x for *_, x in traverse(a, b)]
    assert len(d) == 30 and d == sorted(d)
    index = MultiIndex(codebook(rng.normal(size=(200, 4)), 6), codebook(rng.normal(size=(200, 4)), 6), 5)
    x = rng.normal(size=(10, 8))
    assert [v[0] for v in index.visits(x)] == index.cells(x).tolist()


def test_empty_and_unlinked(spark):
    assert near_vectors(frame(spark, [])).collect() == []
    got = near_vectors(frame(spark, [(1, None), (1, [0.0])])).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, 1, True)] * 2


def test_many_lengths(spark, monkeypatch):
    """The most frequent lengths have an index; the others are compared in one pass."""
    from accordant.llm import multi_index

    monkeypatch.setattr(multi_index, "LENGTHS", 2)
    rng = np.random.default_rng(11)
    rows = []
    for n in range(1, 80):
        centre = rng.normal(size=n)
        rows += [(len(rows) + k, (centre + rng.normal(size=n) * 0.1 * k).tolist()) for k in range(int(rng.integers(1, 5)))]
    rows += [(500 + i, [1.0, 2.0, 0.1 * i]) for i in range(12)] + [(600, rows[10][1]), (601, rows[10][1])]
    got = near_vectors(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected(rows)
