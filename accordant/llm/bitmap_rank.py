"""Positions of ids within groups, by rank queries over bitmaps; the rows themselves are never sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.common import written

# A directory level has at most 2^16 children below one parent, so no window holds more rows than that.
DIGIT_BITS = 16
# Words are counted from the smallest 64-bit id; null ids come last, in a word beyond all others.
FIRST_WORD, LAST_WORD = -(1 << 57), 1 << 58
# Rows that repeat every ordering column are numbered apart in so many parts.
SALTS = 1 << 12


def word_of(col: str) -> Column:
    return F.coalesce(F.shiftright(F.col(col), 6) - F.lit(FIRST_WORD), F.lit(LAST_WORD))


def bit_of(col: str) -> Column:
    return F.coalesce(F.col(col).bitwiseAND(F.lit(63)), F.lit(0)).cast("int")


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bitmaps(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """One row per non-empty 64-bit word of a group's bitmap: ``word``, ``mask`` and ``n``, the number of rows.

    Empty words are not kept, which is the compression.  Partial bitmaps of the tasks are merged by
    ``bit_or`` before and after the shuffle.
    """
    return rows.groupBy(*group, word_of(key).alias("word")).agg(
        F.bit_or(_one(bit_of(key))).alias("mask"), F.count(F.lit(1)).alias("n")
    )


def _directory(words: DataFrame, group: list[str], low: int, high: int) -> DataFrame:
    """``words`` with ``before``, the rows in earlier words of the group, and ``total``, all its rows.

    Sums run over at most 2^16 words below one parent; the parents' own sums come from the level
    above, so the number of levels grows with the logarithm of the range of ids.
    """
    earlier = (Window.unboundedPreceding, -1)
    if low >> DIGIT_BITS == high >> DIGIT_BITS:
        whole = Window.partitionBy(*group)
        return words.withColumns({
            "before": F.coalesce(F.sum("n").over(whole.orderBy("word").rowsBetween(*earlier)), F.lit(0)),
            "total": F.sum("n").over(whole),
        })
    up = F.shiftright(F.col("word"), DIGIT_BITS)
    tops = words.groupBy(*group, up.alias("word")).agg(F.sum("n").alias("n"))
    tops = _directory(tops, group, low >> DIGIT_BITS, high >> DIGIT_BITS)
    tops = tops.select(*group, F.col("word").alias("up"), F.col("before").alias("base"), "total")
    within = Window.partitionBy(*group, "up").orderBy("word").rowsBetween(*earlier)
    return (
        words.withColumn("up", up).join(tops, [*group, "up"])
        .withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).drop("up", "base")
    )


def rank_index(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The bitmaps with their popcount directory, written to the shared folder.

    ``extra`` lists the bits of a word whose id occurs in several rows, with the number of further rows.
    """
    words = written(bitmaps(rows, group, key), "bitmaps")
    span = words.agg(F.min("word"), F.max("word")).first()
    low, high = span[0] or 0, span[1] or 0
    index = _directory(words, group, low, high)
    repeated = words.filter(F.col("n") > F.bit_count("mask")).select(*group, "word")
    none = F.lit(None).cast("array<struct<bit:int,more:long>>")
    if repeated.isEmpty():
        return written(index.withColumn("extra", none), "ranks")
    several = (
        rows.select(*group, word_of(key).alias("word"), bit_of(key).alias("bit"))
        .join(repeated, [*group, "word"], "left_semi")
        .groupBy(*group, "word", "bit").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
        .groupBy(*group, "word").agg(F.collect_list(F.struct("bit", "more")).alias("extra"))
    )
    return written(index.join(several, [*group, "word"], "left"), "ranks")


def placed(rows: DataFrame, group: list[str], order: list[str], row: str) -> DataFrame:
    """``rows`` with ``slot``, the 0-based position in the group by the columns ``order``, and ``total``, the group's rows.

    Group columns hold no nulls; order columns are 64-bit integers, nulls last; ``row`` numbers the
    rows of a stored table.  Rows alike in all order columns follow each other in any order.  The
    names slot, total, word, mask, n, before, extra, up and base must be free.

    A row's position is the popcount before it.  Only rows whose id repeats go on to the next
    order column, as a group of their own; an id with a large share of all rows is dealt over the
    tasks by that column, and by ``row`` at the end.
    """
    if not order:
        part = F.pmod(F.col(row), F.lit(SALTS))
        salted = rows.withColumn("word", part)
        counts = written(salted.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n")), "repeats")
        starts = _directory(counts, group, 0, SALTS - 1).select(*group, "word", "before", "total")
        inside = Window.partitionBy(*group, "word").orderBy(row)
        return (
            salted.join(starts, [*group, "word"])
            .withColumn("slot", F.col("before") + F.row_number().over(inside) - 1).drop("word", "before")
        )
    key, depth = order[0], len(group)
    index = rank_index(rows, group, key)
    found = rows.withColumn("word", word_of(key)).join(index, [*group, "word"])
    found = found.withColumn("bit", bit_of(key))
    below = F.bit_count(F.expr("mask & ~shiftleft(-1L, bit)")).cast("long")
    slot = F.col("before") + below
    if index.filter("extra is not null").isEmpty():
        return found.withColumn("slot", slot).drop("word", "bit", "mask", "n", "before", "extra")
    slot = slot + F.expr("aggregate(filter(coalesce(extra, array()), e -> e.bit < bit), 0L, (s, e) -> s + e.more)")
    tied = F.expr("exists(coalesce(extra, array()), e -> e.bit = bit)")
    found = found.withColumns({"slot": slot, "tied": tied}).drop("mask", "n", "before", "extra")
    alone = found.filter("not tied").drop("word", "bit", "tied")
    names = [f"word_{depth}", f"bit_{depth}"]
    again = written(
        found.filter("tied").withColumnsRenamed({
            "word": names[0], "bit": names[1], "slot": f"slot_{depth}", "total": f"total_{depth}",
        }).drop("tied"),
        "tied",
    )
    deeper = placed(again, [*group, *names], order[1:], row).withColumn("slot", F.col("slot") + F.col(f"slot_{depth}"))
    deeper = deeper.drop("total", f"slot_{depth}", *names).withColumnRenamed(f"total_{depth}", "total")
    return alone.unionByName(deeper)
