"""Analysis table against a plain-Python account of the rules, in both forms."""

import random

import pytest
from pyspark.sql import functions as F

from accordant import names
from accordant.operators.analysis import analyse, analyse_elements, to_elements
from accordant.operators.answers import complete_groups, enrich_answers
from accordant.operators.rollup import summarise

SCHEMA = (
    "q_id string, q_serie string, action string, task string, dataset string, lang string, llm string, "
    "answer array<string>, file_path string"
)
CELLS = [("Q1", "equal"), ("Q2", "equal"), ("Q3", "sup-sub"), ("Q4", "minus"),
         ("Q1", "sup-sub"), ("Q1", "minus"), ("Q3", "minus")]


def make_rows(seed=7):
    rng = random.Random(seed)
    rows = []
    for q in range(6):
        for llm in ("m1", "m2"):
            for ds in ("d1", "d2"):
                for action in ("zero-shot", "wikidata", "fixing", "classification"):
                    cells = CELLS[:4] if action in ("zero-shot", "wikidata") else CELLS
                    for serie, task in cells:
                        if rng.random() < 0.04:
                            continue
                        answer = rng.sample(["a", "b", "c", "idk"], rng.randint(0, 3))
                        if rng.random() < 0.1:
                            answer = answer + answer
                        rows.append((str(q), serie, action, task, ds, None, llm, answer, f"f_{serie}_{task}_{action}"))
                if rng.random() < 0.5:
                    rows.append((str(q), "Q1", "star", "equal", ds, None, llm, rng.sample("abc", 2), "s"))
    # a repeat with a later path must lose against the first
    first = rows[0]
    rows.append((*first[:7], ["zzz"], "~late"))
    # star answers of another series; the first series counts
    rows.append(("0", "Q2", "star", "equal", "d1", None, "m1", ["late", "a"], "a"))
    rows.append(("5", "Q3", "star", "minus", "d9", None, "m1", ["b"], "a"))
    rows += [("5", s, "zero-shot", t, "d9", None, "m1", ["b"], "f") for s, t in CELLS[:4]]
    return rows


def jac(a, b):
    return round(len(a & b) / len(a | b), 4) if a | b else 0.0


def expected(rows):
    cells, groups, star = {}, {}, {}
    for q, s, act, t, ds, _, llm, ans, _path in sorted(rows, key=lambda r: (r[1], r[8]) if r[2] == "star" else ("", "")):
        if act == "star":
            star.setdefault((q, ds, llm), set(ans))
            continue
        cells.setdefault((q, act, ds, llm, s, t), set(ans))
        groups.setdefault((q, act, ds, llm), set()).add(s)
    out = {}
    for key, series in groups.items():
        if len(series) < 4:
            continue
        g = {c: cells.get((*key, *c), set()) for c in CELLS}
        once = key[1] in ("zero-shot", "wikidata")
        a1, a2 = g["Q1", "equal"], g["Q2", "equal"]
        a3, a4 = g["Q3", "sup-sub"], g["Q4", "minus"]
        c1 = a1 if once else g["Q1", "sup-sub"]
        m1 = a1 if once else g["Q1", "minus"]
        m3 = a3 if once else g["Q3", "minus"]
        s = (star.get((key[0], key[2], key[3])) if key[1] == "zero-shot" else None) if once else c1
        p = None if once else m1
        out[key] = dict(
            eq_a1_a2=int(a1 == a2), eq_a1_a34=int(m1 == m3 | a4), sub_a3_a1=int(a3 <= c1), sub_a4_a1=int(a4 <= m1),
            disj_a3_a4=int(not m3 & a4), part_a1_a34=int(m1 == m3 | a4 and not m3 & a4),
            eq_a1_s=None if s is None else int(a1 == s), eq_a1_p=None if p is None else int(a1 == p),
            eq_s_p=None if p is None else int(s == p),
            jac_a1_a2=jac(a1, a2), jac_a1_a34=jac(m1, m3 | a4), jac_a3_a4=jac(m3, a4), jac_a4_diff=jac(a4, m1 - m3),
            jac_a1_s=None if s is None else jac(a1, s), jac_a1_p=None if p is None else jac(a1, p),
            jac_s_p=None if p is None else jac(s, p),
            **{f"idk_{n}": int(not x or "idk" in x) for n, x in dict(a1=a1, a2=a2, a3=a3, a4=a4).items()},
            **{f"idk_only_{n}": int(not x or x == {"idk"}) for n, x in dict(a1=a1, a2=a2, a3=a3, a4=a4).items()},
        )
    return out


@pytest.mark.parametrize("form", ["arrays", "elements"])
def test_analysis_matches_rules(spark, form):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    if form == "arrays":
        got_df = analyse(df)
    else:
        got_df = analyse_elements(to_elements(df))
    want = expected(rows)
    got = {(r.q_id, r.action, r.dataset, r.llm): r.asDict() for r in got_df.collect()}
    assert set(got) == set(want) and len(want) > 50
    for k, w in want.items():
        assert {c: got[k][c] for c in w} == w, k


def test_empty_sets(spark):
    rows = [("0", s, "zero-shot", t, "d", None, "m", [], "f") for s, t in CELLS[:4]]
    r = analyse(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.eq_a1_a2, r.sub_a3_a1, r.disj_a3_a4, r.part_a1_a34) == (1, 1, 1, 1)
    assert r.jac_a1_a2 == 0.0 and r.idk_a1 == 1 and r.eq_a1_s is None


def test_completeness_and_enrich(spark):
    rows = [("0", s, "fixing", "equal", "d", None, "m", ["a"], "f") for s in ("Q1", "Q2", "Q3", "Q4")]
    rows += [("1", s, "fixing", "equal", "d", None, "m", ["a"], "f") for s in ("Q1", "Q2", "Q3")]
    rows += [("0", "Q1", "fixing", "equal", "d", None, "m", None, "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.q_id for r in complete_groups(df).collect()] == ["0"]
    questions = spark.createDataFrame(
        [(0, "t1", "t2", "t3", "t4", "d", "en"), (0, "x1", "x2", "x3", "x4", "d", "es")],
        "q_index long, Q1 string, Q2 string, Q3 string, Q4 string, dataset string, lang string",
    )
    got = {(r.q_id, r.q_serie): (r.question, r.answer) for r in enrich_answers(df, questions).collect()}
    assert got["0", "Q1"] == ("t1", [])
    assert got["0", "Q4"] == ("t4", ["a"])
    assert got["1", "Q2"] == (None, ["a"])
    r = {r.q_id: r for r in analyse(df, questions).collect()}["0"]
    assert (r.q1, r.q4) == ("t1", "t4")


def test_summary_pools_and_blends(spark):
    pd_rows = expected(make_rows())
    s = {(r.dataset, r.action, r.llm): r for r in summarise(analyse(spark.createDataFrame(make_rows(), SCHEMA))).collect()}

    def mean(key, metric):
        ds, act, llm = key
        v = [w[metric] for k, w in pd_rows.items() if k[1] == act and k[3] == llm and ds in ("overall", k[2])]
        v = [x for x in v if x is not None]
        return sum(v) / len(v) if v else None

    for key, row in s.items():
        for m in ("eq_a1_a2", "jac_a1_a34", "disj_a3_a4", "jac_s_p"):
            w = mean(key, m)
            assert (row[m] is None) == (w is None)
            assert w is None or row[m] == pytest.approx(w, abs=5.1e-5)
    zs, cl = s["overall", "zero-shot", "m1"], s["overall", "classification", "m1"]
    raw = mean(("overall", "zero-shot", "m1"), "eq_a1_s")
    assert zs.eq_a1_s == pytest.approx((round(raw, 4) + cl.eq_a1_s) / 2, abs=1e-4)
    assert zs.eq_a1_ave == pytest.approx(raw, abs=1e-4)  # taken before the blend
    assert zs.idk == pytest.approx((zs.idk_a1 + zs.idk_a2 + zs.idk_a3 + zs.idk_a4) / 4)


def test_symbol_names_round_trip(spark):
    df = analyse(spark.createDataFrame(make_rows(), SCHEMA))
    sym = names.to_symbols(df)
    assert {"?A1=A2", "J(A4-A1|3)", "?A3∅A4", "A1**", "idk_A1", "Q_ID"} <= set(sym.columns)
    assert names.to_ascii(sym).columns == df.columns
    assert sym.select(F.avg("`?A1=A2`")).first()[0] is not None


@pytest.mark.parametrize("form", ["arrays", "elements"])
def test_actions_of_the_caller(spark, form):
    """Other action names give the same table under those names; one in neither list is an error, not a loss."""
    other = {"wikidata": "grounded", "fixing": "repair"}
    df = spark.createDataFrame(make_rows(), SCHEMA)
    renamed = spark.createDataFrame([(*r[:2], other.get(r[2], r[2]), *r[3:]) for r in make_rows()], SCHEMA)
    run = analyse if form == "arrays" else lambda x, **lists: analyse_elements(to_elements(x), **lists)
    lists = {"single": ["zero-shot", "grounded"], "repeat": ["classification", "repair"]}
    cols = ["q_id", "dataset", "llm", *names.FLAGS, *names.JACCARDS]
    rows_of = lambda t: sorted((other.get(r.action, r.action), *map(str, r[1:])) for r in t.select("action", *cols).collect())
    assert rows_of(run(renamed, **lists)) == rows_of(run(df))
    with pytest.raises(Exception, match="action in neither list: (grounded|repair)"):
        run(renamed).collect()
