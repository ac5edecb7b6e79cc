"""Row and column selection on result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.session import materialise


def keep(df: DataFrame, **allowed) -> DataFrame:
    """Rows whose columns equal the given value or are among the given values."""
    for c, v in allowed.items():
        if v is not None:
            df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def drop_rows(df: DataFrame, **excluded) -> DataFrame:
    """Rows whose columns are not among the given values; NULL stays."""
    for c, v in excluded.items():
        if v:
            df = df.filter(F.col(c).isNull() | ~F.col(c).isin([v] if isinstance(v, str) else list(v)))
    return df


def predicate_values(df: DataFrame, predicate: str, dataset: str | None = None, actions: list[str] | None = None) -> DataFrame:
    """One metric as (dataset, action, llm, value)."""
    return keep(df, dataset=dataset, action=actions).select("dataset", "action", "llm", F.col(predicate).alias("value"))


def align_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select ``columns`` ({name: type}); those the table lacks are NULL."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()
    ])


def without_sentinel(df: DataFrame, columns: list[str], sentinel: float = -1) -> DataFrame:
    """Rows in which no column holds the sentinel; NULL is no sentinel."""
    ok = [F.col(c).isNull() | (F.col(c) != sentinel) for c in columns]
    return df.filter(reduce(lambda a, b: a & b, ok)) if ok else df


def columns_by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_after(df: DataFrame, column: str) -> list[str]:
    return df.columns[df.columns.index(column) + 1:]


def groups_with_signal(df: DataFrame, by: list[str], columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Rows of the groups that have at least one value at or below ``alpha``."""
    return _groups_with(df, by, reduce(lambda a, b: a | b, [F.coalesce(F.col(c) <= alpha, F.lit(False)) for c in columns]))


def groups_with_values(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows of the groups that have at least one value that is not NULL."""
    return _groups_with(df, by, reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))


def _groups_with(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """The input is written once: the groups are found in it, and its rows kept or not, without computing it twice."""
    rows = materialise(df.withColumn("__hit", hit), "groups")
    return rows.join(rows.filter("__hit").select(*by).distinct(), by, "left_semi").select(*df.columns)
