"""Scalar functions: table-driven checks against the rules."""

import math
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from accordant.functions import labels, numbers, sets, stats, text
from accordant.operators.relations import with_canonical_labels
from accordant.operators.reshape import letter_code


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


LABELS = {
    None: "Unknown", "Contains": "Contains", "contains": "Contains", "overlap": "Overlap",
    "equivalence": "Equivalence", "containedby": "ContainedBy", "unknown": "Unknown", "disjoint": "Disjoint",
    "contains (q1 ⊃ q2)": "Contains", "": "Else", "containment": "Contains", "equivalent": "Equivalence",
    "containedby (q1 ⊂ q2)": "ContainedBy", "overlaps": "Else", "not contains": "Contains",
    "not  disjoint": "Overlap", "non-disjoint": "Overlap", "not overlapping": "Disjoint",
    "A ∩ B = ∅": "Disjoint", "A ∩ B ≠ ∅": "Disjoint", "a ∩ b != 0": "Disjoint", "a ∩ b != {}": "Overlap", "A ∩ B = 0": "Disjoint",
    "superset of": "Contains", "is a super set": "Contains", "sub set": "ContainedBy", "q1 is in q2": "ContainedBy",
    "mutually exclusive": "Disjoint", "share items": "Overlap", "non_empty intersection": "Overlap",
    "the same set": "Equivalence", "a = b": "Equivalence", "Can’t determine": "Unknown", "N/A": "Unknown",
    "ｅｑｕａｌ": "Equivalence", "Equivalence (0.91)": "Equivalence", "decorated unknownish": "Unknown",
    "equal sets": "Equivalence", "contained by": "ContainedBy", "EQUALS": "Equivalence", "xyz": "Else",
}


def test_canonical_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "x string")
    got = with_canonical_labels(df, {"y": "x"}).select("x", "y", labels.canonical_label(F.col("x")).alias("z"))
    for r in got.collect():
        assert r.y == LABELS[r.x], r
        assert r.z == r.y


def test_compose_and_fold_match_unicode(spark):
    samples = ["ﬁne Ⅳ ① ｆｕｌｌ é", "é", "Straße İ ǅ", "①②㎏", "plain", "ÅΩ", "ẞ", "한글", "ﷺ", None]
    got = apply(spark, samples, labels.nfkc)
    assert got == [None if s is None else unicodedata.normalize("NFKC", s) for s in samples]
    got = apply(spark, samples, labels.casefold)
    assert got == [None if s is None else s.casefold() for s in samples]


def test_strict_label(spark):
    got = apply(spark, [None, "Contains", " Contains ", "contains", ""], labels.strict_label)
    assert got == ["Unknown", "Contains", "Contains", "Else", "Else"]


def test_label_shapes(spark):
    cases = {
        '["", " contains ", "x"]': "contains", "[]": None, "plain": "plain", "{}": None,
        '{"label": "overlap"}': "overlap", '{"x": 0.2, "Disjoint": 0.7}': "Disjoint",
        '{"pred": "p", "relation": "r"}': "r", '{"first": "a", "second": "b"}': "first",
        '{"a": 1, "b": 1}': "a", '{"a": -3, "b": -0.5}': "b",
    }
    assert apply(spark, list(cases), labels.label_text) == list(cases.values())
    assert apply(spark, ['["overlap","x"]', "[]", "contains", None], labels.classified_label) == [
        "overlap", None, "contains", None,
    ]


def test_responses(spark):
    values = ["idk", "no answer", "a| b |c", "||", " x | y\n", "no sé", "idk|", "\x1cz\x1f", None]
    assert apply(spark, values, text.response_to_list) == [
        ["idk"], [], ["a", "b", "c"], [], ["x", "y"], ["no sé"], ["idk"], ["z"], None,
    ]
    assert apply(spark, ["no sé", "idk", "a|a"], text.response_to_list_es) == [[], ["idk"], ["a", "a"]]


def test_small_text_functions(spark):
    one = spark.range(1)
    q = one.select(
        text.label_score(F.lit(" Contains "), F.lit("contains")).alias("a"),
        text.directional_score(F.lit(" Containment\n"), F.lit("B ")).alias("b"),
        text.directional_score(F.lit("contención"), F.lit("a")).alias("c"),
        text.directional_score(F.lit("other"), F.lit("b")).alias("d"),
        text.file_safe_predicate(F.lit("?A4=A1|3")).alias("e"),
        text.file_safe_predicate(F.lit("?A3∅A4")).alias("f"),
        text.file_safe_predicate(F.lit("?A1=A1**")).alias("g"),
        text.render("{q1} and {q2} {{x}}", q1=F.lit("a {q2}"), q2=F.lit("b")).alias("h"),
        text.render_by_key({"en": "E {q}", "es": "S {q}"}, F.lit("es"), q=F.lit("1")).alias("i"),
        text.token_estimate(F.lit("one two three"), "x {question} y").alias("j"),
        text.release_date(F.lit("2025-04-14")).cast("string").alias("k"),
        text.release_date(F.lit("soon")).alias("l"),
        text.starts_with_yes(F.lit("  YES - fine")).alias("m"),
        text.is_yes(F.lit(" Yes\n")).alias("n"),
        text.is_yes(F.lit("Yes.")).alias("o"),
        text.joined_replies(F.lit('{"response": "a"}\nbad\n{"x": 1}\n{"response": "b"}')).alias("p"),
        text.first_binding_values(
            F.lit('{"results": {"bindings": [{"x": {"value": "1"}, "y": {"value": "2"}}, {"y": {"value": "3"}}]}}')
        ).alias("q"),
    ).first()
    assert list(q) == [
        1, 1.0, 0.5, 0.0, "A4eqA1or3", "A3disjA4", "A1eqA1", "a {q2} and b {x}", "S 1", 7, "2025-04-14", None, True,
        True, False, "ab", ["1", "3"],
    ]


def test_reply_lines(spark):
    reply = "intro\nq2:  the same \nQ3:\n next line\nCorrected Q1: fixed\r\nq4:   "
    one = spark.createDataFrame([(reply,)], "x string")

    def line(label):
        return one.select(text.labelled_line(F.col("x"), label, F.lit("fallback"))).first()[0]

    assert line("q2") == "the same"
    assert line("q3") == "next line"
    assert line("corrected q1") == "fixed"
    assert line("q5") == "fallback"
    got = one.select(text.numbered_lines(F.lit(" 1. a | b\nnoise\n 12.  c\n3.d\n4. \n"))).first()[0]
    assert got == ["a | b", "c"]


def test_numbers(spark):
    assert apply(spark, [0.03125, 0.5, 2.5, -1.5], lambda c: numbers.round4(c, 0), "double") == [0.0, 0.0, 2.0, -2.0]
    assert apply(spark, [0.03125, 0.00005], numbers.round4, "double")[0] == 0.0312
    assert apply(spark, [None, 0.2, 0.05, 0.001, 0.0123], numbers.p_label, "double") == ["", "", "0.050", "≈0", "0.012"]
    assert apply(spark, ["70b", "1,5b", "300M", "12", "large", None, "b"], numbers.parse_size) == [
        70e9, 15e9, 300e6, 12.0, None, None, None,
    ]
    assert apply(spark, ["large", "tiny", "12.5", None], numbers.bucket_area) == [420.0, 200.0, 12.5, 200.0]
    assert apply(spark, [0, 25, 26, 51, 52, 701, 702, 18277, 18278], letter_code, "int") == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert apply(spark, [0.5, 0.04, 0.01, None], lambda c: numbers.confidence_label(c, 0.05, 0.02), "double") == [
        "", "0.040", "", "",
    ]
    row = spark.range(1).select(
        numbers.row_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)).alias("a"),
        numbers.row_mean(F.lit(None).cast("double")).alias("b"),
        numbers.rescale(F.lit(3.0), F.lit(3.0), F.lit(3.0), 10, 20).alias("c"),
        numbers.rescale(F.lit(3.0), F.lit(2.0), F.lit(4.0), 10, 20).alias("d"),
    ).first()
    assert list(row) == [1.5, None, 15.0, 15.0]


def exact_tail(k, n):
    return float(Fraction(sum(math.comb(n, i) for i in range(max(k, 0), n + 1)), 2**n))


def test_mcnemar_exact(spark):
    pairs = [(a, b) for a in range(0, 12) for b in range(0, 12)]
    pairs += [(620, 500), (50, 70), (400, 380), (31, 1), (300, 300)]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", stats.mcnemar_one_sided(F.col("a"), F.col("b")).alias("p"),
        stats.mcnemar_two_sided(F.col("a"), F.col("b")).alias("q"),
    )
    for r in df.collect():
        n = r.a + r.b
        assert r.p == pytest.approx(exact_tail(r.a, n) if n else 1.0, rel=1e-9), (r.a, r.b)
        two = min(1.0, 2 * exact_tail(max(r.a, r.b), n)) if n else 1.0
        assert r.q == pytest.approx(two, rel=1e-9)


def test_mcnemar_huge_counts(spark):
    r = spark.range(1).select(stats.mcnemar_one_sided(F.lit(500_020_000), F.lit(499_980_000))).first()[0]
    assert r == pytest.approx(0.5 * math.erfc(40_000 / math.sqrt(1e9) / math.sqrt(2)), rel=1e-3)


# Published correlations and p-values of 14 models.
PUBLISHED = [
    (0.3098346990915386, 0.2810238321290279),
    (0.3681836012677717, 0.19523167441615671),
    (0.400146926294826, 0.1562833029664567),
    (0.6232384011799537, 0.017256532072420318),
    (0.7999693475886274, 0.0005919140613124686),
    (0.6594905101372174, 0.010290781051269338),
    (0.4175533146277986, 0.13740105077037268),
    (-0.20051739597957002, 0.49186233411076435),
    (0.846603933186935, 0.00013401922696817877),
]


def test_pearson_p_reproduces_published_values():
    for r, p in PUBLISHED:
        assert stats.pearson_p_value(r, 14) == pytest.approx(p, rel=1e-10)


def test_set_functions(spark):
    df = spark.createDataFrame(
        [(["a", "b", "b"], ["b", "a"], ["a"]), ([], [], []), (["a", None], ["a"], [None])],
        "a array<string>, b array<string>, c array<string>",
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(
        sets.equal(a, b), sets.is_subset(c, a), sets.disjoint(b, c), sets.is_difference(a, b, c), sets.jaccard(a, b),
        sets.both_empty(a, b), sets.partitions(a, b, c), F.size(sets.to_set(a)),
    ).collect()
    assert list(got[0]) == [True, True, False, False, 1.0, False, False, 2]
    assert list(got[1]) == [True, True, True, True, 0.0, True, True, 0]
    assert list(got[2]) == [False, True, True, True, 0.5, False, True, 2]


def precise_tail(k, n):
    """P(X >= k) by 60-digit Stirling's series for the first term and all following ratios."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    pi2 = 2 * Decimal("3.14159265358979323846264338327950288419716939937510582097494459")

    def ln_factorial(m):
        if m < 400:
            return Decimal(math.factorial(m)).ln()
        x = Decimal(m)
        return (x + Decimal("0.5")) * x.ln() - x + pi2.ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)

    if 2 * k <= n:
        return 1.0 - precise_tail(n - k + 1, n)
    first = float((ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * Decimal(2).ln()).exp())
    term, total, j = 1.0, 1.0, k
    while j < n and term > 1e-18 * total:
        term *= (n - j) / (j + 1)
        total += term
        j += 1
    return first * total


def test_tails_in_constant_steps(spark):
    cells = []
    for n in (9_999, 10_000, 10_001, 54_321, 1_000_000, 30_000_000, 1_000_000_000):
        mean, sigma = n / 2, math.sqrt(n) / 2
        ks = {int(mean + u * sigma) for u in (-6, -1, 0, 0.01, 0.5, 1, 2.5, 5, 9, 14, 20, 30)} | {n // 2, n // 2 + 1}
        if n < 100_000:
            ks |= {int(0.55 * n), int(0.59 * n), int(0.6 * n), int(0.8 * n)}
        cells += [(k, n) for k in sorted(ks)]
    got = spark.createDataFrame(cells, "k long, n long").select("k", "n", stats.binomial_upper_tail(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        want = precise_tail(r.k, r.n)
        digits = 1e-10 * max(1.0, -math.log(max(want, 1e-300)) / 20)  # of the exponent, one part in so many is lost
        assert r.p == pytest.approx(want, rel=digits, abs=1e-290), (r.k, r.n)


def test_fixed_decimals_as_the_interpreter_writes_them(spark):
    import random

    from accordant.functions.numbers import fixed

    rng = random.Random(8)
    values = [i / 10_000 for i in range(10_001)] + [i / 16_384 for i in range(16_385)] + [rng.random() * 50 for _ in range(2000)]
    values += [0.0, 1.0, 0.9995, 0.9994999999999999, 12.0625, 0.0005, 0.00049999999999999999]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v")).alias("t"), fixed(F.col("v"), 1).alias("o"))
    bad = [(r.v, r.t, r.o) for r in rows.collect() if r.t != f"{r.v:.3f}" or r.o != f"{r.v:.1f}"]
    assert not bad, bad[:5]
