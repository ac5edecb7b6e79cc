"""Tables that are dealt by question once."""

from accordant.operators import significance
from accordant.session import laid_out


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "q_id" in line.split("Exchange", 1)[1]]


def test_consumers_need_no_exchange_on_the_question(spark):
    rows = [
        (str(q), a, f"d{q % 3}", m, (q + len(m) + len(a)) % 2)
        for q in range(60) for a in ("zero-shot", "fixing") for m in ("m1", "m2x")
    ]
    plain = spark.createDataFrame(rows, "q_id string, action string, dataset string, llm string, eq_a1_a2 int")
    table = laid_out(plain, "test", ["dataset", "q_id"])
    kw = {"tested": ["eq_a1_a2"], "actions": ["zero-shot", "fixing"]}
    for make in (
        lambda df: significance.paired_counts(df, **kw),
        lambda df: significance.pairwise_counts(df, ["m1", "m2x"], **kw),
        lambda df: df.groupBy("dataset", "q_id", "llm").count(),
    ):
        assert exchanges(make(plain)) and not exchanges(make(table))
        assert sorted(map(tuple, make(plain).collect())) == sorted(map(tuple, make(table).collect()))
