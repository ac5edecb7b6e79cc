"""Summaries that grow with the answers: partial sums of each ingested batch, added up on reading.

A store is a folder with one directory per batch, ``batch=<id>``, that holds the batch's sums and counts
per (dataset, action, model).  Sums are whole numbers, so a summary does not depend on how the
questions were dealt to batches.  All rows of a question and action belong to one batch.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from accordant.operators.rollup import metric_columns, partial_sums, summary_of


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def add_batch(analysis: DataFrame, store: str, batch: str | int, metrics: list[str] | None = None) -> bool:
    """Add a batch's sums to the store; a batch that is in it already adds nothing.

    The sums are written beside the store and moved in by one rename, so a batch is in it whole or
    not at all; of two writers of one batch one wins.  Returns whether the batch was added.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", str(batch)):
        raise ValueError(f"batch name {batch!r}: letters, digits, dots, hyphens and underscores only")
    spark = analysis.sparkSession
    target, fs = _file_system(spark, f"{store}/batch={batch}")
    if fs.exists(target):
        return False
    staged = f"{store}/_staged/{batch}-{uuid.uuid4().hex}"
    partial_sums(analysis, metrics or metric_columns(analysis)).write.parquet(staged)
    source, _ = _file_system(spark, staged)
    fs.mkdirs(target.getParent())
    # A rename onto a directory that has come up meanwhile would move into it, so it is made sure again.
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        return False
    return True


def batches(spark: SparkSession, store: str) -> list[str]:
    """The batches in the store."""
    at, fs = _file_system(spark, store)
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n.removeprefix("batch=") for n in found if n.startswith("batch="))


def read_summary(spark: SparkSession, store: str) -> DataFrame:
    """The summary of all batches in the store; only their few sums are read."""
    sums = spark.read.option("mergeSchema", "true").parquet(f"{store}/batch=*")
    metrics = [c.removesuffix("__t") for c in sums.columns if c.endswith("__t") and not c.startswith("idk_")]
    return summary_of(sums, metrics)
