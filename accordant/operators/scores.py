"""Per-question scores of one task and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import sets
from accordant.functions.numbers import round4

SCORE_KEYS = ["dataset", "action", "llm", "q_id"]


def question_scores(answers: DataFrame, task: str, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Similarity, emptiness, equality and overlap flags per question of one task.

    ``equal`` compares Q1 with Q2, ``sup-sub`` Q1 with Q3 and Q4 together, ``minus`` Q4 with Q1
    without Q3.  Questions of the driving series are kept (Q1, for ``minus`` Q4); an answer
    missing on the other side is empty.  One aggregation aligns all series.
    """
    slots = {"q1": ("Q1", "equal"), "q2": ("Q2", "equal"), "q3": ("Q3", "sup-sub"), "q4": ("Q4", "minus")}

    def of(slot: str) -> Column:
        serie, t = slots[slot]
        return (F.col("q_serie") == serie) & (F.col("task") == t)

    needed = {"equal": ["q1", "q2"], "sup-sub": ["q1", "q3", "q4"], "minus": ["q4", "q1", "q3"]}[task]
    cells = of(needed[0])
    for s in needed[1:]:
        cells = cells | of(s)
    wanted = answers.filter(cells)  # rows of other cells are not shuffled
    wide = (
        wanted.groupBy(*keys)
        .agg(
            *[F.min_by(F.when(of(s), F.col("answer")), F.when(of(s), F.col("file_path"))).alias(s) for s in needed],
            F.count_if(of(needed[0])).alias("driving"),
        )
        .filter("driving > 0")
        .select(*keys, *[sets.or_empty(F.col(s)).alias(s) for s in needed])
    )
    a = {s: F.col(s) for s in needed}
    if task == "equal":
        left, right = a["q1"], a["q2"]
        empty, right_flag, apart = sets.both_empty(left, right), sets.equal(left, right), F.lit(False)
    elif task == "sup-sub":
        left, right = a["q1"], sets.union(a["q3"], a["q4"])
        empty = sets.both_empty(a["q1"], a["q3"])
        right_flag, apart = sets.is_subset(a["q3"], a["q1"]), sets.disjoint(a["q3"], a["q4"])
    else:
        left, right = a["q4"], sets.difference(a["q1"], a["q3"])
        empty, right_flag, apart = sets.both_empty(left, right), sets.equal(left, right), F.lit(False)
    return wide.select(
        *keys, F.lit(task).alias("task"), sets.jaccard(left, right).alias("jaccard"),
        sets.flag(empty).alias("is_empty"), sets.flag(right_flag).alias("binary_equal"),
        sets.flag(apart).alias("parts_disjoint"),
    )


def summarise_score_files(scores: DataFrame, by: list[str] = ("file",)) -> DataFrame:
    """Mean score, number of ones and number of entries per score file."""
    return scores.groupBy(*by).agg(
        round4(F.avg("score")).alias("average_score"),
        F.count_if(F.col("score") == 1).alias("count_ones"),
        F.count("*").alias("size"),
    )


def summarise_score_tables(
    scores: DataFrame,
    by: list[str] = ("task", "model", "action"),
    jaccard: str = "JaccardSimilarity",
    binary: str = "BinaryEqual",
    disjoint: str = "B_Intersected_C_EmptyCount",
) -> DataFrame:
    """Summary of per-question score tables; the empty ratio counts similarities of zero.

    Means lose their last float bits before they are rounded, so the order in which partitions
    are added up cannot change a result.
    """
    j = F.col(jaccard)
    return scores.groupBy(*by).agg(
        round4(F.round(F.avg(j), 12)).alias("average_all"),
        round4(F.count_if(j == 0) / F.count("*")).alias("ratio_empty"),
        round4(F.round(F.avg(F.when(j != 0, j)), 12)).alias("average_no_empty"),
        round4(F.count_if(F.col(binary) == 1) / F.count("*")).alias("binary_rate"),
        F.count_if(F.col(disjoint) == 1).alias("disjoint_count"),
    )
