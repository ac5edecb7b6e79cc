"""From answer rows to one row per (question, action, dataset, model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant import names
from accordant.functions import sets

ANSWER_KEYS = ["q_id", "q_serie", "action", "task", "dataset", "llm"]
GROUP_KEYS = ["q_id", "action", "dataset", "llm"]

# The (series, task) cell behind every answer set.
SLOTS = {
    "e1": ("Q1", "equal"),
    "e2": ("Q2", "equal"),
    "c1": ("Q1", "sup-sub"),
    "c3": ("Q3", "sup-sub"),
    "m1": ("Q1", "minus"),
    "m3": ("Q3", "minus"),
    "m4": ("Q4", "minus"),
}
# Actions that ask each question once, and actions that ask again per task.
SINGLE_ACTIONS = ["zero-shot", "wikidata"]
REPEAT_ACTIONS = ["classification", "fixing"]


def first_by_path(df: DataFrame, keys: list[str], order: str = "file_path", dealt: bool = False) -> DataFrame:
    """Keep one row per key, the one with the lowest ``order`` value.

    Rows are dealt by key and then sorted once, so no task sorts them before the shuffle too.  Rows that lie
    together by some of the keys (``dealt``) stay where they are.  Where all orders of a key are null, the
    other columns are null.
    """
    return _lowest(df if dealt else df.repartition(*keys), keys, order)


def _lowest(dealt: DataFrame, keys: list[str], order: str) -> DataFrame:
    """:func:`first_by_path` of rows that lie together by some of ``keys``; they stay there, in the order of ``keys``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()))
    first = dealt.withColumn("__rank", rank).filter("__rank = 1")
    rest = [c for c in dealt.columns if c not in keys]
    return first.select(*keys, *[F.when(F.col(order).isNotNull(), F.col(c)).alias(c) for c in rest])


def one_answer(answers: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """``keys, answer``: of repeated keys the row with the lowest file path, or the smallest answer where there is none.

    The keys hold ``dataset`` and ``q_id``.  Answers that lie together by some of them (``dealt``) stay where they are.
    """
    order = [c for c in ("file_path", "answer") if c in answers.columns]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = answers.select(*dict.fromkeys([*keys, *order]))
    # Dealt by id, the answers of a group stay side by side, which halves the shuffle.
    rows = rows if dealt else rows.repartition("dataset", "q_id")
    return rows.withColumn("__rank", rank).filter("__rank = 1").select(*keys, "answer")


def enrich_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Attach question texts to answer rows; repeated answers keep the lowest file path.

    Answers are dealt and sorted once, by dataset and id first, which serves both the repeats and
    the join; the question table has one row per id, with a text per series.  Neither side is
    hinted: Spark broadcasts the question table while its measured size is below the session's threshold.
    """
    dealt = answers.withColumn("join_id", F.col("q_id").cast("long")).repartition("dataset", "join_id")
    first = _lowest(dealt, ["dataset", "join_id", *[k for k in ANSWER_KEYS if k != "dataset"]], "file_path")
    texts = question_columns(questions).withColumnRenamed("q_index", "join_id")
    series = [c for c in names.SERIES if c in questions.columns]
    question = F.lit(None).cast("string")
    for c in series:
        question = F.when(F.col("q_serie") == c, F.col(c.lower())).otherwise(question)
    rest = [c for c in answers.columns if c not in ANSWER_KEYS]
    return (
        first.join(texts, ["dataset", "join_id"], "left")
        .select("dataset", "q_serie", *[k for k in ANSWER_KEYS if k not in ("dataset", "q_serie")], *rest, question.alias("question"))
        .withColumn("answer", sets.or_empty(F.col("answer")))
    )


def complete(series: Column = None) -> Column:
    """Aggregate condition: all four series occur in the group."""
    bits = F.bit_or(series_bit(F.col("q_serie") if series is None else series))
    return F.coalesce(bits, F.lit(0)) == (1 << len(names.SERIES)) - 1


def series_bit(serie: Column) -> Column:
    """Q1..Q4 as one bit each, anything else 0."""
    out = F.lit(0)
    for i, s in enumerate(names.SERIES):
        out = F.when(serie == s, F.lit(1 << i)).otherwise(out)
    return out


def q2_containment_as_q3(answers: DataFrame) -> DataFrame:
    """Count containment answers filed under Q2 as Q3.

    Some collection runs file the narrower question of the containment task under Q2.  Without
    this their A3 is the empty set, which every A1 contains.
    """
    moved = (F.col("q_serie") == "Q2") & (F.col("task") == "sup-sub")
    return answers.withColumn("q_serie", F.when(moved, "Q3").otherwise(F.col("q_serie")))


def complete_groups(answers: DataFrame) -> DataFrame:
    """Keys of the groups in which all four series were answered."""
    return (
        answers.filter(F.col("action") != "star").groupBy(*GROUP_KEYS)
        .agg(complete().alias("all_series")).filter("all_series").drop("all_series")
    )


def first_answer(condition: Column, order: str = "file_path") -> Column:
    """Aggregate: answer of the first matching row, the empty set if there is none."""
    return sets.or_empty(F.min_by(F.when(condition, F.col("answer")), F.when(condition, F.col(order))))


def slot_condition(slot: str) -> Column:
    serie, task = SLOTS[slot]
    return (F.col("q_serie") == serie) & (F.col("task") == task)


def known_actions(rows: DataFrame, single: list[str], repeat: list[str]) -> DataFrame:
    """``rows``; reading one whose action is in neither list, nor 'star', is an error."""
    fine = F.col("action").isin([*single, *repeat, "star"])
    message = F.concat(F.lit("action in neither list: "), F.coalesce("action", F.lit("null")))
    return rows.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def answer_slots(
    answers: DataFrame, single: list[str] = SINGLE_ACTIONS, repeat: list[str] = REPEAT_ACTIONS
) -> DataFrame:
    """One row per complete group with the answer set of every (series, task) cell.

    ``single`` are the actions that ask each question once, ``repeat`` those that ask again per
    task; any other action is an error.

    Repeated rows, missing cells, the completeness test and the look-up of the repeat ('star')
    answers are all part of one aggregation, hence one shuffle: a star row is counted into the
    zero-shot group it belongs to.
    """
    star = F.col("is_star")
    rows = known_actions(answers, single, repeat).withColumns({
        "is_star": F.col("action") == "star",
        "action": F.when(F.col("action") == "star", "zero-shot").otherwise(F.col("action")),
    })
    slots = [F.array_distinct(first_answer(~star & slot_condition(s))).alias(s) for s in SLOTS]
    star_answer = F.array_distinct(
        F.min_by(F.when(star, F.col("answer")), F.when(star, F.struct("q_serie", "file_path")))
    )
    return (
        rows.groupBy(*GROUP_KEYS)
        .agg(
            *slots,
            star_answer.alias("star"),
            complete(F.when(~star, F.col("q_serie"))).alias("all_series"),
        )
        .filter("all_series")
        .drop("all_series")
    )


def roles(slots: DataFrame, single: list[str] = SINGLE_ACTIONS) -> DataFrame:
    """Name the sets that each relation compares.

    Actions that ask once use the same A1 and A3 everywhere; actions that ask again per task use
    the A1 and A3 of that task.  ``s`` and ``p`` are the first and second repeat of A1.
    """
    once = F.col("action").isin(single)

    def pick(a: str, b: str) -> Column:
        return F.when(once, F.col(a)).otherwise(F.col(b))

    return slots.select(
        *GROUP_KEYS,
        F.col("e1").alias("a1"), F.col("e2").alias("a2"), F.col("c3").alias("a3"), F.col("m4").alias("a4"),
        pick("e1", "c1").alias("c1"), F.col("c3"),
        pick("e1", "m1").alias("m1"), pick("c3", "m3").alias("m3"), F.col("m4"),
        F.when(F.col("action") == "zero-shot", F.col("star")).when(~once, F.col("c1")).alias("s"),
        F.when(~once, F.col("m1")).alias("p"),
    )


def question_columns(questions: DataFrame) -> DataFrame:
    """(dataset, q_index) with the texts q1..q4, first row per key."""
    order = [c for c in ("lang", "file_path") if c in questions.columns]
    rank = F.struct(*order) if order else F.lit(0)
    return questions.groupBy("dataset", "q_index").agg(
        *[F.min_by(c, rank).alias(c.lower()) for c in names.SERIES if c in questions.columns]
    )


def attach_questions(df: DataFrame, questions: DataFrame | None) -> DataFrame:
    """Add q1..q4; without a question table they are empty strings."""
    if questions is None:
        return df.withColumns({c.lower(): F.lit("") for c in names.SERIES})
    texts = question_columns(questions).withColumnRenamed("q_index", "join_id")
    return df.withColumn("join_id", F.col("q_id").cast("long")).join(texts, ["dataset", "join_id"], "left").drop("join_id")
