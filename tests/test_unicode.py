"""The character classes against the interpreter's own functions, and labels of texts that need them."""

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.functions import labels, unicode
from accordant.operators.relations import with_canonical_labels


def texts(n, seed):
    rng = random.Random(seed)
    odd = [c for c in unicode.changed_by_composition() | unicode.changed_by_folding() if not 0xD800 <= c < 0xE000]
    pools = [list(range(32, 127)), list(range(0xA0, 0x250)), list(range(0x370, 0x530)), list(range(0x4E00, 0x4F00)), odd,
             [0x1100, 0x1161, 0x11A8, 0xAC00, 0x300, 0x301, 0x327, 0x130, 0x3A3, 0x3C2, 0xDF, 0x1E9E, 0x1F600, 0x10FFFD]]
    return ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(12))) for _ in range(n)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=20))
def test_safe_texts_are_left_alone(s):
    if not unicode.changed_by_composition() & set(map(ord, s)):
        assert unicodedata.normalize("NFKC", s) == s
    if not unicode.changed_by_folding() & set(map(ord, s)):
        assert s.lower().replace("ß", "ss") == s.casefold()


def test_every_single_character():
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        if c not in unicode.changed_by_composition():
            assert unicodedata.normalize("NFKC", chr(c)) == chr(c)
            assert unicodedata.normalize("NFKC", "e" + chr(c) + "a") == "e" + chr(c) + "a"


def test_columns_against_the_interpreter(spark):
    rows = [(i, t) for i, t in enumerate(texts(3000, 1))] + [(-1, None), (-2, ""), (-3, "x" * 200_000 + "é" * 200_000)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select(
        "t", labels.nfkc(F.col("t")).alias("c"), labels.casefold(F.col("t")).alias("f"),
        labels.composed_and_folded(F.col("t")).alias("b"),
    ).collect()
    for r in got:
        if r.t is None:
            assert r.c is None and r.f is None
            continue
        assert r.c == unicodedata.normalize("NFKC", r.t) == r.b.composed
        assert r.f == r.t.casefold()
        assert r.b.folded is None or r.b.folded == r.c.casefold()


def test_most_letters_stay_in_the_engine():
    plain = "Ärger, ça va, señor, Привет, 日本語, 한국어, Straße “quoted” – dash"
    assert not unicode.changed_by_composition() & set(map(ord, plain))
    assert not unicode.changed_by_folding() & set(map(ord, plain))


def brute_label(s):
    """The rules in order, pattern by pattern."""
    if s is None:
        return "Unknown"
    s = re.sub(r"\([^\n]*?\)", "", unicodedata.normalize("NFKC", s))
    s = re.sub(r"[-_]+", "-", s)
    s = re.sub(r"\s+", " ", s).strip()
    if s in ("Equivalence", "Contains", "ContainedBy", "Disjoint", "Overlap", "Unknown", "Else"):
        return s
    low = s.casefold()
    if low in labels.UNKNOWN_TOKENS:
        return "Unknown"
    for label, patterns in labels.LABEL_PATTERNS:
        if any(re.search(p, low) for p in patterns):
            return label
    return "Else"


def test_labels_against_all_patterns(spark):
    rng = random.Random(2)
    words = [
        "not", "disjoint", "non-", "non", "overlap", "overlapping", "overlaps", "eq", "equiv", "equivalent", "EQUALS", "same", "set", "a",
        "=", "b", "≡", "⊃", "super", "superset", "of", "contains", "containment", "include", "includes", "includesb", "⊆", "sub", "contained",
        "by", "is", "in", "belongs", "to", "∩", "∅", "= 0", "≠", "!= ", "dis", "joint", "dis-joint", "no", "intersection", "mutually",
        "exclusive", "intersects", "some", "nonempty", "share", "shares", "items", "members", "unknown", "(x", "y)", "_", "--", " ", "ß",
        "İS", "ＳＡＭＥ", "None", "n/a", "the", "sequence",
    ]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(6000)]
    rows += [(-i - 1, w) for i, w in enumerate([*words, None, ""])]
    got = with_canonical_labels(spark.createDataFrame(rows, "i int, t string"), {"label": "t"}).collect()
    bad = [(r.t, r.label, brute_label(r.t)) for r in got if r.label != brute_label(r.t)]
    assert not bad, bad[:5]
    assert len({r.label for r in got}) == 7
