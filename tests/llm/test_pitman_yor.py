import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from accordant.llm import pitman_yor
from accordant.llm.pitman_yor import Shard, Totals, _predictive, reseat, score_texts, seat, summed

SCHEMA = "doc_id long, text string, part string, shard int, score string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "p", 1, "s") for i, t in rows], SCHEMA).coalesce(parts)


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.mark.parametrize("small", [False, True])
def test_base_score_by_hand(spark, monkeypatch, small):
    if small:  # many shards and chunks
        monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 300)
        monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 200)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["the", "The", "a", "É", "é", *(f"w{k}" for k in range(40))], k=rng.choice([0, 1, 30])))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "the only"), (7, "twice here"), (7, "twice here"), (502, "long " * 5000)]
    counts = collections.Counter(t for i, x in rows if not held_out(i) for t in tokens(x))
    n, z = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted(((i is None, i or 0), held_out(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), round(sum(math.log10((counts[t] + 0.1) / z) for t in tokens(x)), 6)) for i, x in rows)
    got = score_texts(frame(spark, rows)).collect()
    assert {r.train_tokens for r in got} == {n}
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_beats_the_base_on_held_out_text(spark):
    rng = random.Random(13)
    follow = {k: rng.sample(range(60), 3) for k in range(60)}

    def walk():
        w = rng.randrange(60)
        out = []
        for _ in range(40):
            out.append(f"t{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    got = score_texts(frame(spark, [(i, walk()) for i in range(300)])).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(14)
    w, c = 50, 4
    counts = rng.poisson(0.7, (w, c))
    word_of, contexts = np.divmod(np.arange(w * c), c)
    words = np.sort(rng.integers(0, 2**63, w).astype(np.uint64))
    hot = np.zeros(0, np.uint64)
    s = seat(words, word_of, contexts, counts.ravel().astype(np.int64), 1, hot, 0)
    per = lambda v: np.bincount(contexts, v, pitman_yor.CONTEXTS)
    customers = np.array([t.sum() for t in s.tables])
    known = int((counts.sum(1) > 0).sum())
    totals = Totals(int(counts.sum()), known, per(counts.ravel()), np.array([per(t) for t in s.tables]), customers, np.array([t.sum() for t in s.top]), hot, hot, np.zeros((3, 0)), np.zeros((3, 0)))
    logs, seen = _predictive(s, totals)
    p = np.power(10.0, logs).reshape(w, c)
    assert (seen == counts.sum(1)).all()
    unseen = (counts.sum(1) == 0)
    # The words that occur and one class for all others share the whole probability.
    assert p[~unseen].sum(0) + p[unseen].mean(0) == pytest.approx(np.ones(c), abs=1e-9)


def test_seating_bounds():
    rng = np.random.default_rng(15)
    customers = np.array([0, 1, 2, 5, 1000, 1_000_000])
    tables = reseat(customers, np.full(6, 0.5), 0.7, rng)
    assert (tables <= customers).all() and (tables[1:] >= 1).all() and tables[0] == 0 and tables[5] > 3 and tables[4] > 1


def test_empty_and_untrained(spark):
    assert score_texts(frame(spark, [])).collect() == []
    only = next(i for i in range(100) if held_out(i))
    got = score_texts(frame(spark, [(only, "a b")])).first()
    assert (got.train_tokens, got.n_known, got.n_tokens, got.base_score, got.held_out) == (0, 0, 3, 0.0, True)


def test_every_preceding_word_has_a_restaurant_of_its_own(spark):
    """More words than 2**16, each once: every pair has one table, so a plain model gives the scores (END's tables aside)."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(500))) for i in range(170)]
    learned = [i for i, _ in rows if not held_out(i)]
    known, n = 500 * len(learned) + 1, 501 * len(learned)
    assert known > 1 << 16
    lowest = (20.0 + 0.6 * known) / (known + 1)
    parent = lambda served, top: (served - 0.6 * top + lowest) / (20.0 + n)  # noqa: E731  each token is a table of its context
    first = (1 - 0.75 + (2.0 + 0.75 * len(learned)) * parent(1, 1)) / (2.0 + len(learned))
    other = (1 - 0.75 + (2.0 + 0.75) * parent(1, 1)) / (2.0 + 1)
    want = math.log10(first) + 500 * math.log10(other)  # END is as likely as a word after its only word, but for its parent
    got = score_texts(frame(spark, rows)).filter("not held_out").collect()
    assert len(got) == len(learned) and [r.score for r in got] == pytest.approx([want] * len(got), rel=2e-3)


def test_scores_do_not_hang_on_the_number_of_shards(spark, monkeypatch):
    rng = random.Random(16)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(["the", "of", *words], weights=[200, 90, *(400 / k for k in range(1, 401))], k=rng.choice([3, 40])))) for i in range(300)]
    one = {r.doc_id: (r.n_known, r.base_score, r.score) for r in score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 400)
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(pitman_yor, "CONTEXTS", 100)  # several tasks add up contexts
    many = {r.doc_id: (r.n_known, r.base_score, r.score) for r in score_texts(frame(spark, rows)).collect()}
    assert set(one) == set(many)
    for i in one:
        assert many[i] == pytest.approx(one[i], rel=1e-6)


def test_own_tables_do_not_weigh_on_a_dish():
    """The only pair of a corpus is seated from the strength and its own new tables, whatever tables it had."""
    one = lambda tables: Shard(np.array([5], np.uint64), np.array([0]), np.array([0]), np.array([400]), np.array([9], np.uint64), np.zeros(0, np.uint64), np.array([tables]), np.array([1]))
    got = []
    for tables in (1, 300):
        shard = one(tables)
        shard.sweep(shard.per_context(shard.tables), summed(shard.part(np.zeros(0, np.uint64)), np.zeros(0, np.uint64), None, -1), 0)
        got.append(int(shard.tables[0]))
    assert got[0] == got[1]
