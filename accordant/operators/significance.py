"""Exact McNemar tests: actions against a baseline, models against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import names
from accordant.functions import stats
from accordant.functions.numbers import round4
from accordant.operators.rollup import overall_level

_TESTED = names.TESTED


def flag_code(tested: list[str] = _TESTED) -> Column:
    """All tested flags of a row in one integer: per flag a bit for 'right' and one for 'wrong'."""
    return F.expr(" + ".join(
        f"CASE {f} WHEN 1 THEN {1 << (2 * i)} WHEN 0 THEN {2 << (2 * i)} ELSE 0 END" for i, f in enumerate(tested)
    ))


def rounded_p(p: Column) -> Column:
    """Four decimals, half to even; the last float bits are cut first so that ties are seen as ties."""
    return round4(F.round(p, 12))


def paired_counts(
    analysis: DataFrame,
    actions: list[str] = names.ACTIONS,
    baseline: str = "zero-shot",
    tested: list[str] = _TESTED,
) -> DataFrame:
    """Discordant pairs of every action against the baseline, per (dataset, llm) and overall.

    ``n10_<flag>`` counts questions the action has right and the baseline wrong, ``n01_<flag>``
    the reverse.  ``analysis`` has one row per (q_id, action, dataset, llm), so each question is
    reduced to one code per action by a single aggregation; no self-join takes place.
    """
    per_question = analysis.filter(F.col("action").isin(actions)).select(
        "dataset", "llm", "q_id", "action", flag_code(tested).alias("code")
    ).groupBy("dataset", "llm", "q_id").agg(
        *[F.bit_or(F.when(F.col("action") == a, F.col("code"))).alias(f"code_{i}") for i, a in enumerate(actions)]
    )
    base = F.col(f"code_{actions.index(baseline)}")
    cells = F.explode(F.filter(
        F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"code_{i}").alias("code")) for i, a in enumerate(actions)]),
        lambda s: s["code"].isNotNull(),
    )).alias("s")
    paired = per_question.filter(base.isNotNull()).select("dataset", "llm", base.alias("base"), cells)
    aggs = []
    for i, f in enumerate(tested):
        right, wrong = 1 << (2 * i), 2 << (2 * i)
        aggs.append(F.expr(f"count_if((s.code & {right}) != 0 AND (base & {wrong}) != 0)").alias(f"n10_{f}"))
        aggs.append(F.expr(f"count_if((s.code & {wrong}) != 0 AND (base & {right}) != 0)").alias(f"n01_{f}"))
    keys = ["dataset", "llm", "action"]
    fine = paired.groupBy("dataset", "llm", F.col("s.action").alias("action")).agg(*aggs)
    return overall_level(fine, keys, [f"{n}_{f}" for f in tested for n in ("n10", "n01")])


def action_p_values(
    analysis: DataFrame,
    actions: list[str] = names.ACTIONS,
    baseline: str = "zero-shot",
    tested: list[str] = _TESTED,
    two_sided: bool = False,
) -> DataFrame:
    """p-values of every action against the baseline, one column per flag.

    One-sided values are rounded to 4 decimals; two-sided ones are left as they are.
    """
    counts = paired_counts(analysis, actions, baseline, tested)
    pairs = F.array(*[F.struct(F.col(f"n10_{f}").alias("n10"), F.col(f"n01_{f}").alias("n01")) for f in tested])

    def test(s: Column) -> Column:
        if two_sided:
            return stats.mcnemar_two_sided(s["n10"], s["n01"])
        return rounded_p(stats.mcnemar_one_sided(s["n10"], s["n01"]))

    return counts.withColumn("p", F.transform(pairs, test)).select(
        "dataset", "llm", "action", *[F.col("p")[i].alias(f"p_{f}") for i, f in enumerate(tested)]
    )


# -- models against each other ---------------------------------------------------------------

def _bit_words(coded: DataFrame, group: list[str], own: list[str], tested: list[str]) -> DataFrame:
    """Answers of 64 questions in one row per model: per flag a word of right and a word of wrong bits.

    ``coded`` has the columns of ``group``, q_id, those of ``own`` (what tells the rows of a question
    apart) and code.  The questions of a group are numbered where they lie after the shuffle, in
    order, so that a task that is run again numbers them alike; words belong to one task.
    """
    entries = F.collect_list(F.struct(*own, "code")).alias("entries")
    questions = coded.groupBy(*group, "q_id").agg(entries).sortWithinPartitions(*group, "q_id")
    questions = questions.withColumn("at", F.monotonically_increasing_id())
    rows = questions.select(
        *group, F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"),
        F.explode("entries").alias("e"),
    )
    words = [
        F.bit_or(F.when(F.col("e.code").bitwiseAND(F.lit(side << (2 * i))) != 0, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"{kind}{i}")
        for i in range(len(tested)) for kind, side in (("right", 1), ("wrong", 2))
    ]
    return rows.groupBy(*group, "word", *[F.col(f"e.{c}").alias(c) for c in own]).agg(*words)


def _pair_sums(words: DataFrame, group: list[str], own: list[str], tested: list[str]) -> DataFrame:
    """Per group and pair of models: ``n10_<i>``, the questions that i has right and j wrong.

    The models of a word meet in its row, 64 questions at a time; what is counted is added up where
    it arises, and pairs without any discordant answer are no rows.  One row with i = j = -1 says
    that the group is there.
    """
    sides = [c for i in range(len(tested)) for c in (f"right{i}", f"wrong{i}")]
    met = words.groupBy(*group, "word").agg(F.collect_list(F.struct(*own, *sides)).alias("models"))
    met = met.select(*group, "models", F.explode("models").alias("x")).select(*group, "models", "x", F.explode("models").alias("y"))
    counts = [F.bit_count(F.col(f"x.right{i}").bitwiseAND(F.col(f"y.wrong{i}"))).cast("long").alias(f"n10_{i}") for i in range(len(tested))]
    # The first model with itself never counts, so its cell is free to stand for the group.
    there = F.lit(True)
    for c in own:
        there = there & (F.col(f"x.{c}") == F.col("models")[0][c]) & (F.col(f"y.{c}") == F.col("models")[0][c])
    cells = met.select(*group, there.alias("there"), F.col("x.idx").alias("i"), F.col("y.idx").alias("j"), *counts).filter(
        "there or " + " or ".join(f"n10_{i} > 0" for i in range(len(tested)))
    )
    place = [F.when(F.col("there"), F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("i", "j")]
    return cells.groupBy(*group, *place).agg(*[F.sum(f"n10_{i}").alias(f"n10_{i}") for i in range(len(tested))])


def pairwise_counts(
    analysis: DataFrame,
    models: list[str],
    actions: list[str] = names.ACTIONS,
    tested: list[str] = _TESTED,
    pool_by_id: bool = False,
) -> DataFrame:
    """Discordant pairs between all models: ``action, dataset, predicate, llm_i, llm_j, n10, n01``.

    Covers every dataset and 'overall' on the full grid of ``models``.  By default questions pair
    up on (dataset, q_id).  ``pool_by_id`` pairs the overall level on q_id alone, which multiplies
    the rows of equal ids across datasets.

    Right and wrong answers are bits; a pair is counted 64 questions at a time by the bits common
    to one model's right and the other's wrong answers, and only cells that are not zero are shuffled.
    """
    idx = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("llm")).cast("int") - 1
    coded = analysis.filter(F.col("action").isin(actions)).select(
        "action", "dataset", "q_id", idx.alias("idx"), flag_code(tested).alias("code")
    ).filter("idx >= 0")
    keys, sums = ["action", "dataset", "i", "j"], [f"n10_{i}" for i in range(len(tested))]
    group = ["action", "dataset"]
    words = _bit_words(coded, group, ["idx"], tested)
    fine = _pair_sums(words, group, ["idx"], tested)
    if pool_by_id:
        pooled = _pair_sums(_bit_words(coded, ["action"], ["dataset", "idx"], tested), ["action"], ["dataset", "idx"], tested)
        both = fine.unionByName(pooled.withColumn("dataset", F.lit("overall")))
    else:
        both = overall_level(fine, keys, sums)
    return _on_grid(both, models, tested)


def _on_grid(sums: DataFrame, models: list[str], tested: list[str]) -> DataFrame:
    """All pairs of models for every (action, dataset) that occurs, with both directions of each count."""
    counts = F.array(*[F.col(f"n10_{f}") for f in range(len(tested))])
    none = F.lit(None).cast("array<long>")

    def way(i: str, j: str, n10: Column, n01: Column) -> Column:
        return F.struct(F.col(i).alias("i"), F.col(j).alias("j"), n10.alias("n10"), n01.alias("n01"))

    # A count goes to its own cell and, as the other direction, to the mirrored one.
    group = F.col("i") < 0
    ways = F.when(group, F.array(way("i", "j", none, none))).otherwise(F.array(way("i", "j", counts, none), way("j", "i", none, counts)))
    every = sums.select("action", "dataset", F.explode(ways).alias("w")).select("action", "dataset", "w.*")
    # The row that stands for a group becomes its whole grid.
    numbers = F.sequence(F.lit(0), F.lit(len(models) - 1))
    for c in ("i", "j"):
        spread = F.explode(F.when(F.col(c) < 0, numbers).otherwise(F.array(F.col(c)))).alias(c)
        every = every.select(*[x for x in every.columns if x != c], spread)
    cell = every.groupBy("action", "dataset", "i", "j").agg(*[
        F.sum(F.coalesce(F.col(n)[f], F.lit(0).cast("long"))).alias(f"{n}_{f}") for n in ("n10", "n01") for f in range(len(tested))
    ])
    model = F.array(*[F.lit(m) for m in models])
    flags = F.explode(F.array(*[
        F.struct(F.lit(t).alias("predicate"), F.col(f"n10_{f}").alias("n10"), F.col(f"n01_{f}").alias("n01"))
        for f, t in enumerate(tested)
    ])).alias("f")
    return cell.select("action", "dataset", "i", "j", flags).select(
        "action", "dataset", "f.predicate", F.element_at(model, F.col("i") + 1).alias("llm_i"),
        F.element_at(model, F.col("j") + 1).alias("llm_j"), "f.n10", "f.n01",
    )


def pairwise_p_values(analysis: DataFrame, models: list[str], actions: list[str] = names.ACTIONS, **kw) -> DataFrame:
    """Long p-value matrix; the diagonal and pairs without common questions are 1."""
    counts = pairwise_counts(analysis, models, actions, **kw)
    p = rounded_p(stats.mcnemar_one_sided(F.col("n10"), F.col("n01")))
    return counts.withColumn("p", F.when(F.col("llm_i") == F.col("llm_j"), F.lit(1.0)).otherwise(p))


def pair_test(pairs: DataFrame, x: str, y: str, by: list[str], two_sided: bool = False) -> DataFrame:
    """Test two paired 0/1 columns of one table per group: n10, n01 and p."""
    counts = pairs.groupBy(*by).agg(
        F.count_if((F.col(x) == 1) & (F.col(y) == 0)).alias("n10"),
        F.count_if((F.col(x) == 0) & (F.col(y) == 1)).alias("n01"),
    )
    test = stats.mcnemar_two_sided if two_sided else stats.mcnemar_one_sided
    return counts.withColumn("p", test(F.col("n10"), F.col("n01")))
