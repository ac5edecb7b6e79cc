"""Incremental answer ingestion: new answer files are added to the answer table, each once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accordant.sources.paths import decoded
from accordant.sources.readers import parse_answers


def ingest_answers(
    spark: SparkSession, folder: str, table: str, checkpoint: str, llms: list[str], **vocabulary
) -> StreamingQuery:
    """Parse the answer files that are new since the last call and append their rows to ``table``.

    The checkpoint remembers which files are in, so an interrupted collection resumes where it
    stopped.  The query ends when all available files are in.
    """
    files = (
        spark.readStream.format("text").option("wholetext", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        .option("fs.file.impl.disable.cache", "true")
        .load(folder)
        .select(decoded(F.col("_metadata.file_path")).alias("file_path"), "value")
    )
    return (
        parse_answers(files, llms, **vocabulary).writeStream.format("parquet")
        .option("path", table).option("checkpointLocation", checkpoint)
        .partitionBy("action", "dataset", "task", "q_serie", "llm")
        .trigger(availableNow=True).outputMode("append").start()
    )
