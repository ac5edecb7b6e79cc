"""What is still to be asked: pending questions and answers that need a follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import sets


def id_range(questions: DataFrame, start: int = 0, end: int | None = None, column: str = "q_index") -> DataFrame:
    """Questions with ``start <= id < end``; without an end, all from ``start`` on."""
    c = F.col(column)
    return questions.filter(c >= start) if end is None else questions.filter((c >= start) & (c < end))


def pending(questions: DataFrame, answers: DataFrame, keys: list[str], require_nonempty: bool = True) -> DataFrame:
    """Questions without an answer (by default, without a non-empty one).

    Answered keys are reduced before the join, so a key with many answers costs one row.
    """
    done = answers.filter(F.size("answer") > 0) if require_nonempty else answers
    return questions.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_in_any(questions: DataFrame, answers: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """Questions that at least one of the given series has not answered."""
    bit = F.lit(0)
    for i, s in enumerate(series):
        bit = F.when(F.col("q_serie") == s, F.lit(1 << i)).otherwise(bit)
    done = (
        answers.filter(F.col("q_serie").isin(series)).groupBy(*keys)
        .agg(F.bit_or(bit).alias("seen")).filter(F.col("seen") == (1 << len(series)) - 1).drop("seen")
    )
    return questions.join(done, keys, "left_anti")


def needs_equal_follow_up(a1: Column, a2: Column, ask_if_empty: bool = False) -> Column:
    """The paraphrase disagrees; with ``ask_if_empty`` an empty second answer counts too."""
    need = sets.jaccard(a1, a2) < 1
    return need | (F.size(a2) == 0) if ask_if_empty else need


def needs_containment_follow_up(a1: Column, a3: Column) -> Column:
    """The narrower answer is empty or not contained in the wider one."""
    return ~sets.is_subset(a3, a1) | (F.size(a3) == 0)


def needs_difference_follow_up(a1: Column, a3: Column, a4: Column, ask_if_empty: bool = False) -> Column:
    """The rest does not equal the wide answer without the narrow one."""
    need = ~sets.is_difference(a1, a3, a4)
    return need | (F.size(a4) == 0) if ask_if_empty else need
