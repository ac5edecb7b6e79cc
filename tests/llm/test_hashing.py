import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from accordant.llm import hashing
from accordant.llm.hashing import WordHasher, set_hash

TEXT = st.text(st.sampled_from(list("abAB \t\n\x0b\x1cé 日")), max_size=30)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(0, 3))
def test_equal_words_and_only_those_hash_alike(texts, cut):
    array = pa.array(texts, pa.string()).slice(min(cut, len(texts)))
    texts = texts[min(cut, len(texts)):]
    hashes, at = WordHasher().words(array)
    assert [words(t) for t in texts] == [w for t in texts for w in [words(t)]] and list(np.diff(at)) == [len(words(t)) for t in texts]
    names = [w for t in texts for w in words(t)]
    assert len(set(zip(names, hashes.tolist()))) == len(set(names)) == len(set(hashes.tolist()))
    sets = list(WordHasher().shingle_sets(array))
    plain = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in map(words, texts)]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, p in enumerate(plain):
        for j, r in enumerate(plain):
            assert len(np.intersect1d(sets[i], sets[j])) == len(p & r) and (set_hash(sets[i]) == set_hash(sets[j])) == (p == r)


def test_blocks_do_not_change_hashes(monkeypatch):
    text = pa.array(["one two " * 50 + "x" * 300 + " three", None, "two"])
    whole, _ = WordHasher().words(text)
    monkeypatch.setattr(hashing, "BLOCK", 16)
    small, _ = WordHasher().words(text)
    assert (whole == small).all()
