"""Question rows out of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import text


def parse_question_pairs(df: DataFrame, reply: str, keep: list[str]) -> DataFrame:
    """Lines ``1. broad | narrow | query | query`` as (pos, narrow, broad, narrow_query, broad_query)."""
    rows = df.select(*keep, F.posexplode(text.numbered_lines(F.col(reply))).alias("pos", "line")).withColumn(
        "v", text.split_items(F.col("line"))
    )

    def item(i: int) -> Column:
        return F.coalesce(F.try_element_at("v", F.lit(i)), F.lit(""))

    return rows.select(
        *keep, "pos", item(2).alias("narrow"), item(1).alias("broad"), item(4).alias("narrow_query"),
        item(3).alias("broad_query"),
    )


def parse_remainder_questions(df: DataFrame, reply: str, q1: Column, q2: Column, keep: list[str]) -> DataFrame:
    """Lines ``1. Question C: text`` as (pos, q1, q2, q3) next to the questions they belong to."""
    rows = df.select(
        *keep, q1.alias("q1"), q2.alias("q2"), F.posexplode(text.numbered_lines(F.col(reply))).alias("pos", "line")
    )
    return rows.withColumn("q3", text.strip(F.replace("line", F.lit("Question C:"), F.lit("")))).drop("line")


def validated_questions(replies: DataFrame, keep: list[str] = ("uid",)) -> DataFrame:
    """Final Q1..Q4 of a question from its four replies.

    ``r1`` accepts or rejects Q1, ``r2`` holds the paraphrase, ``r3`` the two narrower questions,
    ``r4`` 'yes' or corrections.  Rejected questions and those without Q3 or Q4 drop out.
    """
    r1, r2, r3, r4 = (F.col(c) for c in ("r1", "r2", "r3", "r4"))
    drafts = (
        replies.filter(text.starts_with_yes(r1))
        .withColumns({
            "d1": F.col("q1"),
            "d2": text.labelled_line(r2, "q2", text.strip(r2)),
            "d3": text.labelled_line(r3, "q3", F.lit("")),
            "d4": text.labelled_line(r3, "q4", F.lit("")),
        })
        .filter((F.col("d3") != "") & (F.col("d4") != ""))
    )
    good = text.is_yes(r4)
    return drafts.select(
        *keep,
        *[
            F.when(good, F.col(f"d{i}")).otherwise(text.labelled_line(r4, f"corrected q{i}", F.col(f"d{i}"))).alias(f"Q{i}")
            for i in range(1, 5)
        ],
    )
