"""Records of separated files that are read in parallel, although quoted texts may hold line ends.

A split of a file cannot know whether it begins inside a quoted text.  So every split is read under
both assumptions: a line is a small function from the state before it (outside or inside a quoted
text) to the state after it, and a split is the composition of its lines.  A prefix over the splits
of a file, one row each, then says which assumption holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.sources.paths import decoded

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def read_lines(spark: SparkSession, path: str | list[str], glob: str, separator: str = "\n", encoded: bool = False) -> DataFrame:
    """What a separator parts, with ``file_path``, ``block`` (start of the split) and ``pos`` (the order in a split).

    An ``encoded`` path is left as Spark gives it, to be decoded where there are fewer rows.
    """
    file = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", separator)
        .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        .option("fs.file.impl.disable.cache", "true")
        .text(path)
        .select(
            (file if encoded else decoded(file)).alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), "value",
        )
    )


def open_after(line: Column, sep: str, before: bool) -> Column:
    """Whether a quoted text is open at the end of a line, given whether one was open before it.

    A quote opens a text at the beginning of a field only; inside, two quotes stand for one, and a
    single one closes the text.  What follows up to the separator is ordinary.
    """

    def step(inside: Column, field: Column) -> Column:
        opens = ~inside & field.startswith('"')
        text = F.when(opens, F.substr(field, F.lit(2))).otherwise(field)
        closes = F.replace(text, F.lit('""'), F.lit("")).contains('"')
        return (inside | opens) & ~closes

    quoted = F.aggregate(F.split(line, sep), F.lit(before), step)
    return F.when(line.contains('"'), quoted).otherwise(F.lit(before))


def _state(order: Window, frame: tuple[int, int], outside: Column, inside: Column) -> tuple[Column, Column]:
    """The state after all functions in the frame, from outside and from inside.

    A function either forgets the state before it, or swaps it, or keeps it.  So what counts are
    the last one that forgets, and how many swap after it.
    """
    fixed = outside == inside
    swaps = F.when(outside & ~inside, 1).otherwise(0)
    over = order.rowsBetween(*frame)
    upto = F.coalesce(F.sum(swaps).over(over), F.lit(0))
    running = F.sum(swaps).over(order.rowsBetween(*_UP_TO_HERE))
    return upto, F.struct(fixed.alias("fixed"), outside.alias("state"), running.alias("swaps"))


def _resolved(last: Column, upto: Column, start: Column) -> Column:
    since = upto - F.coalesce(last["swaps"], F.lit(0))
    return F.coalesce(last["state"], start) != (since % 2 == 1)


def prefix_states(rows: DataFrame, group: list[str], order: list[str], outside: str, inside: str) -> DataFrame:
    """Add ``from_outside`` and ``from_inside``: the state before each row of a group, by the state before the group."""
    by = Window.partitionBy(*group).orderBy(*order)
    upto, function = _state(by, _BEFORE, F.col(outside), F.col(inside))
    staged = rows.withColumns({"_upto": upto, "_function": function})
    forgets = F.when(F.col("_function.fixed"), F.col("_function"))
    staged = staged.withColumn("_last", F.last(forgets, ignorenulls=True).over(by.rowsBetween(*_BEFORE)))
    return staged.withColumns({
        "from_outside": _resolved(F.col("_last"), F.col("_upto"), F.lit(False)),
        "from_inside": _resolved(F.col("_last"), F.col("_upto"), F.lit(True)),
    }).drop("_upto", "_function", "_last")


def numbered_records(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """``file_path``, ``position`` (0-based, in the file) and ``record``, the record's text with its line ends.

    Blank lines between records are skipped, as is a carriage return at a record's end.  Lines of one
    split are brought in order by one shuffle on the split; a record of one line, the usual case, needs
    nothing more, and only records of several lines are put together in a second one.
    """
    c = F.col
    marked = lines.withColumns({
        "open_outside": open_after(c("value"), sep, False), "open_inside": open_after(c("value"), sep, True),
        "blank": F.trim(F.replace("value", F.lit("\r"), F.lit(""))) == "",
    })
    split = ["file_path", "block"]
    inside = prefix_states(marked, split, ["pos"], "open_outside", "open_inside")
    upto = Window.partitionBy(*split).orderBy("pos").rowsBetween(*_UP_TO_HERE)
    counted = inside.withColumns({
        f"begun_{s}": F.sum(F.when(~c(f"from_{s}") & ~c("blank"), 1).otherwise(0)).over(upto) for s in ("outside", "inside")
    })
    after = {
        s: F.max_by(F.when(c(f"from_{s}"), c("open_inside")).otherwise(c("open_outside")), "pos").alias(f"end_{s}")
        for s in ("outside", "inside")
    }
    splits = prefix_states(
        counted.groupBy(*split).agg(
            *after.values(), F.max("begun_outside").alias("n_outside"), F.max("begun_inside").alias("n_inside")
        ),
        ["file_path"], ["block"], "end_outside", "end_inside",
    )
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(*_BEFORE)
    begun = F.when(c("from_outside"), c("n_inside")).otherwise(c("n_outside"))
    splits = splits.withColumn("_n", begun).select(
        *split, c("from_outside").alias("starts_inside"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("offset")
    )

    def either(s: str) -> Column:
        return F.when(c("starts_inside"), c(f"{s}_inside")).otherwise(c(f"{s}_outside"))

    placed = counted.join(splits, split).select(
        *split, "pos", "value", "blank", either("from").alias("inside"),
        (c("offset") + either("begun") - 1).alias("position"),
        F.when(either("from"), c("open_inside")).otherwise(c("open_outside")).alias("open"),
    ).filter("inside or not blank")
    whole = placed.filter("not inside and not open").select("file_path", "position", c("value").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    joined = placed.filter("inside or open").groupBy("file_path", "position").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record")
    )
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
