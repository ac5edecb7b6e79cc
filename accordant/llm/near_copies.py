"""One document of each group of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import whole, without_rows, written
from accordant.llm.jaccard import near_duplicates


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies, all columns unchanged, whatever their names.

    The row with the smallest id stays (a null id comes last); of rows that repeat the id the one with the
    smallest SHA-256 of its text, and of rows that repeat id and text one (any of them, where other
    columns differ).  Documents without words, null and empty texts among them, are near copies of
    nothing and all stay.  Texts of any length are read whole; an empty table stays empty.  Texts of
    rows that stay are not shuffled, except where a bounded filter cannot tell them from dropped ones.
    """
    digest = F.sha2(whole(text).cast("binary"), 256)
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), digest.alias("sha"))
    groups = near_duplicates(narrow, "id", "text", carried="sha").filter("n_shingles > 0")
    groups = written(groups.select("part", F.col("doc_id").alias("id"), "sha"), "groups")
    # Only components of several rows matter from here on.
    several = written(groups.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "several")
    rows = written(groups.join(several, "part").groupBy("part", "id", "sha").agg(F.count(F.lit(1)).alias("times")), "members")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    first = rows.groupBy("part").agg(F.min(order).alias("first")).select("part", F.col("first.id").alias("first_id"), F.col("first.sha").alias("first_sha"))
    marked = rows.join(written(first, "first"), "part").withColumn(
        "stays", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("first_sha"))
    )
    marked = written(marked.select("id", "sha", "times", "stays"), "marked")
    return without_rows(docs, key, digest, marked.filter("not stays"), marked.filter("stays and times > 1"))
