"""Row numbers over whole tables, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.session import materialise

_WITHIN = 33  # monotonically_increasing_id has the partition above so many bits


def _with_starts(rows: DataFrame, parts: list[str], counts: DataFrame) -> DataFrame:
    """Attach ``start``, the rows of all earlier parts; ``counts`` has one row per part, whatever a part holds."""
    before = Window.partitionBy(F.lit(0)).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*parts, *[c for c in counts.columns if c not in (*parts, "n")], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, parts)


def numbered(df: DataFrame, order: list[str | Column], into: str = "pos") -> DataFrame:
    """``df`` with 0-based positions in the order of ``order``, nulls first; rows that tie come in any order.

    Rows are dealt by ranges and sorted within them; a range's first position is the number of rows
    in the ranges before it.  The sorted rows are written once, so the positions do not change.
    """
    part, row = f"__part_{into}", f"__row_{into}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    stored = materialise(ranged, "ordered").withColumn(part, F.shiftright(row, _WITHIN))
    counts = stored.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    placed = _with_starts(stored, [part], counts)
    inside = F.col(row).bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return placed.withColumn(into, F.col("start") + inside).drop(part, row, "start")


def in_file_order(rows: DataFrame, into: str = "position") -> DataFrame:
    """A scan of files with 0-based positions in the order of file paths and of rows in the files.

    A row's position is its place within its split of a file plus the rows in the splits before it.
    """
    placed = rows.withColumns({
        "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id(),
    })
    counts = placed.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    found = _with_starts(placed, ["__file", "__block"], counts)
    return found.withColumn(into, F.col("start") + F.col("__at") - F.col("__first")).drop(
        "__file", "__block", "__at", "__first", "start"
    )
