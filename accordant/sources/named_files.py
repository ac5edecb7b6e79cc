"""Text files with given names, exactly one per key, committed in two phases.

Spark writes the files of all keys to a staging folder, one task a file, and commits them as it
commits any output: a task that dies leaves nothing.  Then each file is renamed to its place and
replaces what was there, so a reader finds the old file or the new one, never half of one.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions.text import file_safe_predicate
from accordant.operators.answers import one_answer
from accordant.operators.reshape import heatmap_cells, index_map, split_by_action

_FILE = "__file"


def write_named_files(
    rows: DataFrame, file: Column, order: list[str | Column], line: Column, path: str, head: str = "", tail: str = "", between: str = "",
) -> list[str]:
    """Write ``line`` of each row to the file that ``file`` names below ``path``; returns the names.

    Lines are in the order of ``order``; ``head`` goes before the first one, ``between`` behind all but the
    last and ``tail`` behind the last.  A file is streamed by one task and never held.  Files of
    other names stay as they are.  The driver moves the files, of which it holds the names.
    """
    spark = rows.sparkSession
    one = Window.partitionBy(_FILE).orderBy(*order)
    first, last = F.lag(F.lit(1)).over(one).isNull(), F.lead(F.lit(1)).over(one).isNull()
    named = rows.withColumn(_FILE, file)
    text = F.concat(F.when(first, F.lit(head)).otherwise(F.lit("")), line, F.when(last, F.lit(tail)).otherwise(F.lit(between)))
    lines = named.withColumn("__line", text).sortWithinPartitions(_FILE, *order).select(_FILE, F.col("__line").alias("value"))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    lines.write.partitionBy(_FILE).option("maxRecordsPerFile", 0).option("lineSep", "\n").text(staged)
    try:
        return _moved(spark, staged, path)
    finally:
        at, fs = _file_system(spark, staged)
        fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    # The plain local file system, which takes names with a colon; others are not touched by it.
    conf.set("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    conf.setBoolean("fs.file.impl.disable.cache", True)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf)


def _moved(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Rename every staged file to its place; one that is there already is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, fs = _file_system(spark, staged)
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.set("fs.AbstractFileSystem.file.impl", "org.apache.hadoop.fs.local.RawLocalFs")
    root = fs.makeQualified(hadoop.Path(path))
    files = hadoop.FileContext.getFileContext(root.toUri(), conf)
    replace = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    replace[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    names = []
    for folder in fs.listStatus(at):
        key = folder.getPath().getName()
        if not key.startswith(f"{_FILE}="):
            continue
        name = unquote(key.removeprefix(f"{_FILE}="))
        parts = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} parts of {name}")
        target = hadoop.Path(root.toUri().toString() + "/" + name)
        fs.mkdirs(target.getParent())
        files.rename(parts[0], target, replace)
        names.append(name)
    return sorted(names)


# Folder and name tag of each action's answer files.
ANSWER_FOLDERS = {
    "zero-shot": ("zero-shot", ""),
    "wikidata": ("zero-shot", "wikidata_"),
    "star": ("zero-shot", "star_"),
    "fixing": ("follow_up_fixing", "fixing_"),
    "classification": ("rel_classification_and_questions", "classAndAnswer_"),
}


def answer_file(language: str = "en") -> Column:
    """Name of the answer file of a row: ``<folder>/<dataset>/<task>/<Qn>_<task>_answers_<tag><llm>.json``.

    Files of another language than English begin with an asterisk.  An action without a folder is an error.
    """
    unknown = F.raise_error(F.concat(F.lit("no folder for action "), F.coalesce("action", F.lit("null"))))
    folder, tag = F.lit(None).cast("string"), F.lit("")
    known = F.col("action").isin(list(ANSWER_FOLDERS))
    for action, (f, t) in ANSWER_FOLDERS.items():
        folder = F.when(F.col("action") == action, F.lit(f)).otherwise(folder)
        tag = F.when(F.col("action") == action, F.lit(t)).otherwise(tag)
    star = F.lit("" if language == "en" else "*")
    return F.concat(
        F.when(known, folder).otherwise(unknown), F.lit("/"), "dataset", F.lit("/"), "task", F.lit("/"),
        star, "q_serie", F.lit("_"), "task", F.lit("_answers_"), tag, "llm", F.lit(".json"),
    )


def write_answer_files(answers: DataFrame, path: str, language: str = "en", dealt: bool = False) -> list[str]:
    """One JSON object ``{q_id: [answer, ...]}`` per (action, dataset, task, series, model), ids in order.

    A repeated id keeps the row with the lowest file path, or the smallest answer where there is none; ``dealt``
    is that of :func:`one_answer`.
    """
    # Rows are sorted by the id first, whose first characters tell most of them apart.
    keys = ["q_id", "action", "dataset", "task", "q_serie", "llm"]
    rows = one_answer(answers, keys, dealt)
    pair = F.to_json(F.create_map(F.col("q_id"), F.coalesce("answer", F.array().cast("array<string>"))))
    inside = F.concat(F.lit("    "), F.substr(pair, F.lit(2), F.length(pair) - 2))
    number = F.col("q_id").try_cast("long")
    return write_named_files(rows, answer_file(language), [number.asc_nulls_last(), "q_id"], inside, path, "{\n", "\n}", ",")


def _csv(columns: list[str]) -> Column:
    """A CSV line; text is quoted where it needs to be, null is empty."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[cell(f"`{c}`") for c in columns])


def write_action_files(summary: DataFrame, models: DataFrame, path: str, prefix: str = "summary", actions: list[str] | None = None) -> list[str]:
    """``<prefix>_<action>.csv``: overall rows of a summary with the model ID in front, sorted by it."""
    rows = split_by_action(summary, models, actions)
    name = F.concat(F.lit(f"{prefix}_"), "action", F.lit(".csv"))
    return write_named_files(rows, name, ["ID"], _csv(rows.columns), path, ",".join(rows.columns) + "\n")


def write_heatmap_files(
    matrix: DataFrame, models: list[str], path: str, action: str | None = None, dataset: str | None = None,
) -> list[str]:
    """``heatmap_<predicate>.csv`` of (i, j, val) per predicate, and ``model_index_map.csv``."""
    cells = heatmap_cells(matrix, models, action, dataset)
    name = F.concat(F.lit("heatmap_"), file_safe_predicate(F.col("predicate")), F.lit(".csv"))
    names = write_named_files(cells, name, ["i", "j"], _csv(["i", "j", "val"]), path, "i,j,val\n")
    index = index_map(matrix.sparkSession, models)
    return names + write_named_files(index, F.lit("model_index_map.csv"), ["idx"], _csv(index.columns), path, ",".join(index.columns) + "\n")
