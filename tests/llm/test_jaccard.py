import os
import random
import re

import numpy as np
import pytest

from accordant.llm import jaccard
from accordant.llm.jaccard import near_duplicates
from accordant.llm.near_copies import keep_one
from test_components import brute

SCHEMA = "doc_id long, text string, n long, cls string, s int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], SCHEMA).repartition(parts)


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = brute([*links, *((i, i) for i in range(len(rows)))])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str), root


def edited(words, rng, share):
    return [rng.choice(["x", "y", f"z{rng.randrange(99)}"]) if rng.random() < share else w for w in words]


def corpus(seed, families=12, largest=40):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(40)]
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 60, 150]))] + (passage if f % 3 == 0 else [])
        for _ in range(rng.randint(1, largest)):
            rows.append((len(rows), " ".join(edited(base, rng, rng.choice([0, 0.01, 0.03, 0.06])))))
    # A chain in which only neighbours are similar, ends far apart.
    words = [f"c{i}" for i in range(200)]
    for k in range(0, 100, 10):
        rows.append((len(rows), " ".join(words[k:k + 105])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,block,pairs", [(32, 200_000, 400_000, 256), (3, 5, 500, 2)])
def test_against_brute_force(spark, monkeypatch, seed, hot, block, pairs):
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(jaccard, "HOT_PAIRS", pairs)
    monkeypatch.setattr(jaccard, "HOT_ENTRIES", hot)
    rows = corpus(seed)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected(rows)[0]


def test_edge_cases_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A\tB"), (6, "a b c d e"), (7, "a b c d e f"), (8, text), (9, text + " more"), (9, text), (9, text),
            (None, text + " null"), (None, "alone here"), (2, "a b c d e"), (10, "long " * 60_000), (0, "long " * 50_000)]
    got = near_duplicates(frame(spark, rows)).collect()
    want, root = expected(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    left = keep_one(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "n", "cls", "s"]
    groups = {}
    for i, (doc, t) in enumerate(rows):
        groups.setdefault(root[i] if shingles(t) else ("none", i), []).append((doc is None, doc or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted(min(g) for g in groups.values())


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []
    got = near_duplicates(frame(spark, [(1, None), (1, None)])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(1, 0, 1)] * 2


def test_keep_one_with_clashing_names(spark):
    from test_exact_dedup import CLASHES, clashing

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (2, text + " more"), (2, text), (7, "a b c"), (7, "A B C"), (None, "z"), (None, None), (8, ""), (9, ""), (2, text)]
    left = keep_one(clashing(spark, rows))
    got = left.collect()
    assert left.columns == ["doc_id", "text", *CLASHES]
    assert all(tuple(r)[2:] == tuple(range(len(CLASHES))) for r in got)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    assert [k[:2] for k in kept] == [(False, 2), (False, 7), (False, 8), (False, 9), (True, 0), (True, 0)]
    assert kept[0][2] in (text, text + " more") and kept[1][2] in ("a b c", "A B C")


def test_same_id_in_different_components(spark):
    """Two components with the same smallest id are not one."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y")]
    assert sorted((r.doc_id, r.text) for r in keep_one(frame(spark, rows)).collect()) == [(5, a), (5, b)]


def test_entries_that_may_meet():
    """An entry is left out only if it can be the first common n-gram with no other of its group."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        k = int(rng.integers(1, 40))
        group, n = np.sort(rng.integers(0, 6, k)), rng.integers(1, 60, k).astype(np.int64)
        place = (rng.random(k) * (n - (4 * n + 4) // 5 + 1)).astype(np.int64)
        got = jaccard.may_meet(group, n, place)
        for x in range(k):
            pairs = [
                y for y in range(k) if y != x and group[x] == group[y]
                and jaccard.first_in_common(n[x:x + 1], n[y:y + 1], place[x:x + 1], place[y:y + 1], np.minimum, np.maximum)[0]
            ]
            assert got[x] or not pairs
    assert not jaccard.may_meet(np.array([0, 0]), np.array([10, 100]), np.array([0, 0])).any()


def test_disk_between_the_steps(spark, monkeypatch):
    """Sets that were compared go before others are cut, entries before they are joined, and all of them in the end."""
    from accordant import session
    from accordant.llm import components as other

    made = {}
    put, cut = session.materialise, session.in_buckets

    def there(name):
        return [x for x, df in made.get(name, []) if df.inputFiles() and os.path.exists(df.inputFiles()[0].removeprefix("file:"))]

    def watched(df, name, *more, write=put):
        if name == "segments":
            assert not there("segments") and not there("pairs")
        if name == "rest":
            assert not there("entries")
        out = write(df, name, *more)
        made.setdefault(name, []).append((name, out))
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    monkeypatch.setattr(other, "written", watched)
    monkeypatch.setattr(jaccard, "in_buckets", lambda df, name, *more: watched(df, name, *more, write=cut))
    rows = corpus(5, families=6, largest=12)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected(rows)[0]
    assert len(made["segments"]) == 2
    assert not any(there(n) for n in ("segments", "copies", "sized", "lead", "wanted", "entries", "entries-parted", "entries-split", "pairs", "first"))


def test_parts_dealt_at_once_do_not_matter(spark, monkeypatch):
    """Small buffers, forgotten classes and copies in several of them give the same rows; a class that is remembered is dealt once."""
    monkeypatch.setattr(jaccard, "PACK_ENTRIES", 40)
    monkeypatch.setattr(jaccard, "ROWS", 3)
    rows = corpus(8, families=6, largest=12)
    counts = np.ones(jaccard.SLOTS, np.int64)
    copies = frame(spark, [(i, " ".join(f"w{k}" for k in range(400))) for i in range(20)], 1)
    packed = jaccard.prefix_entries(copies, "text", jaccard.Order(counts)).collect()
    assert sum(len(r.s) for r in packed) == 8 * (396 - (4 * 396 + 4) // 5 + 1)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected(rows)[0]
