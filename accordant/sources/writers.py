"""Writers.  Parquet is the native format; text formats serve exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import file_safe_predicate
from accordant.operators.answers import one_answer
from accordant.operators.reshape import heatmap_cells, index_map, split_by_action
from accordant.session import bucket_count, materialise


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None,
    sort_by: list[str] | None = None,
) -> None:
    """Write a result table as parquet, csv or tsv; arrays become JSON text in text formats.

    With ``sort_by`` rows are in order within files and from one file to the next.
    """
    if sort_by:
        df = df.orderBy(*sort_by)
    if fmt == "parquet":
        out = df.write.mode(mode)
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        return
    arrays = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() == "array"}
    out = (
        df.withColumns(arrays).write.mode(mode).option("header", "true")
        .option("sep", {"csv": ",", "tsv": "\t"}[fmt]).option("quote", '"').option("escape", '"')
    )
    (out.partitionBy(*partition_by) if partition_by else out).csv(path)


def _by_directory(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bring the rows of a directory together, so it gets few files; a large one is split."""
    return df.hint("rebalance", *keys)


def append_tsv(df: DataFrame, path: str) -> None:
    """Append rows; every part file carries the header once."""
    write_table(df, path, fmt="tsv", mode="append")


def write_answers(answers: DataFrame, path: str, mode: str = "error") -> None:
    """Answers as parquet, one directory per (action, dataset, task, q_serie, llm)."""
    keys = ["action", "dataset", "task", "q_serie", "llm"]
    _by_directory(answers, keys).write.mode(mode).partitionBy(*keys).parquet(path)


# Documents of a directory that are dealt together, and rows that a task deals with.
_TOGETHER = 64
_ROWS_PER_TASK = 2_000_000


def answer_documents(answers: DataFrame, ids_per_file: int = 1000, dealt: bool = False) -> DataFrame:
    """Answer rows as ``{q_id: [...]}`` documents of at most ``ids_per_file`` ids each.

    Ids are text; they are dealt to documents by hash, as many documents as the directory's count
    of ids asks for (so the bound holds on average).  A repeated id keeps the row with the lowest
    file path, or the smallest answer where there is none; ``dealt`` is that of :func:`one_answer`.  A reader
    takes all documents of a directory together.

    Answers are shuffled once, with a number for their directory, by directory and run of documents.  So the
    documents of a directory come out of few tasks, and those of a large one out of several.
    """
    keys = ["action", "dataset", "task", "q_serie", "llm"]
    # Written once: the count of ids and the documents both read it.
    first = materialise(one_answer(answers, [*keys, "q_id"], dealt), "first-answers")
    shards = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("ids"), F.ceil(F.count(F.lit(1)) / ids_per_file).cast("int").alias("shards"))
    # So is this, one row per directory, whose size Spark then knows: the answers are not shuffled for it.
    shards = materialise(shards.withColumn("place", F.monotonically_increasing_id()), "document-counts")
    ids = shards.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]
    parts = max(bucket_count(answers.sparkSession), -(-ids // _ROWS_PER_TASK))
    numbered = first.join(shards, keys).select(
        "place", F.pmod(F.xxhash64("q_id"), F.col("shards")).alias("shard"), "q_id", "answer"
    ).withColumn("run", F.floor(F.col("shard") / _TOGETHER))
    docs = numbered.repartition(parts, "place", "run").groupBy("place", "run", "shard").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("q_id", "answer"))))).alias("value"),
        F.count("*").alias("n_ids"),
    )
    return docs.join(shards.select("place", *keys), "place").select(*keys, "shard", "value", "n_ids")


def write_answer_documents(answers: DataFrame, path: str, ids_per_file: int = 1000, mode: str = "error", dealt: bool = False) -> None:
    """Answer documents as JSON lines below ``action=/dataset=/task=/q_serie=/llm=``."""
    keys = ["action", "dataset", "task", "q_serie", "llm"]
    docs = answer_documents(answers, ids_per_file, dealt).drop("shard", "n_ids")
    docs.write.mode(mode).partitionBy(*keys).text(path)


def write_by_action(summary: DataFrame, models: DataFrame, path: str, actions: list[str] | None = None, mode: str = "error") -> None:
    """Overall rows of a summary, one CSV directory per action, sorted by model ID."""
    split_by_action(summary, models, actions).write.mode(mode).option("header", "true").partitionBy("action").csv(path)


def write_heatmaps(
    matrix: DataFrame, models: list[str], path: str, action: str | None = None, dataset: str | None = None,
    mode: str = "error",
) -> None:
    """One CSV directory of (i, j, val) per predicate plus the index map."""
    cells = heatmap_cells(matrix, models, action, dataset)
    (
        cells.withColumn("predicate", file_safe_predicate(F.col("predicate")))
        .hint("rebalance", "predicate").sortWithinPartitions("predicate", "i", "j")
        .write.mode(mode).option("header", "true").partitionBy("predicate").csv(f"{path}/heatmaps")
    )
    index_map(matrix.sparkSession, models).coalesce(1).write.mode(mode).option("header", "true").csv(
        f"{path}/model_index_map"
    )
