"""Result tables for charts: matrices, orders, indexes, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.numbers import bucket_area, parse_size, rescale, to_number
from accordant.functions.text import release_date
from accordant.operators.filters import keep
from accordant.operators.ordering import numbered
from accordant.operators.rollup import medians
from accordant.session import materialise

MATRIX_KEYS = ["action", "dataset", "predicate", "llm"]


def widen_matrix(long: DataFrame, models: list[str], value: str = "p") -> DataFrame:
    """Long pair table to one row per (action, dataset, predicate, llm), a column per model."""
    return (
        long.withColumnRenamed("llm_i", "llm").groupBy(*MATRIX_KEYS).pivot("llm_j", models).agg(F.first(value))
    )


def melt_matrix(wide: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Wide matrix to (keys, col_model, val); text that is no number is NULL."""
    ids = [c for c in ["ID", *MATRIX_KEYS] if c in wide.columns]
    models = models or [c for c in wide.columns if c not in ids]
    numeric = wide.select(*ids, *[to_number(F.col(f"`{m}`")).alias(m) for m in models])
    return numeric.unpivot(ids, [F.col(f"`{m}`") for m in models], "col_model", "val")


def order_position(order: list[str], column: Column) -> Column:
    """1-based position in ``order``; NULL if absent."""
    pos = F.array_position(F.array(*[F.lit(m) for m in order]), column)
    return F.when(pos > 0, pos.cast("int"))


def heatmap_cells(wide: DataFrame, order: list[str], action: str | None = None, dataset: str | None = None) -> DataFrame:
    """Matrix cells as (predicate, i, j, val) with 1-based indexes; incomplete cells are dropped."""
    long = melt_matrix(keep(wide, action=action, dataset=dataset), order)
    return long.select(
        "predicate", order_position(order, F.col("llm")).alias("i"),
        order_position(order, F.col("col_model")).alias("j"), "val",
    ).dropna(subset=["i", "j", "val"])


def letter_code(i: Column) -> Column:
    """0-based index to A..Z, AA..ZZ, AAA..: as columns of a spreadsheet are named."""
    out, rest, letters, below, count = F.lit(None).cast("string"), i.cast("long"), F.lit(""), 0, 1
    texts = []
    for _ in range(7):  # seven letters name every 32-bit index
        letters = F.concat(F.char(F.lit(65) + rest % 26), letters)
        rest = F.floor(rest / 26) - 1
        count *= 26
        below += count
        texts.append((below, letters))
    for below, letters in reversed(texts):
        out = F.when(i < below, letters).otherwise(out)
    return out


def index_map(spark: SparkSession, order: list[str]) -> DataFrame:
    """(idx, letter, llm) of an ordered model list."""
    rows = spark.range(len(order)).select(F.col("id").cast("int").alias("id"))
    return rows.select(
        (F.col("id") + 1).alias("idx"), letter_code(F.col("id")).alias("letter"),
        F.element_at(F.array(*[F.lit(m) for m in order]), F.col("id") + 1).alias("llm"),
    )


def model_order(df: DataFrame, row_id: str, alphabetical: bool = False) -> DataFrame:
    """Models by first appearance, (pos, llm); zero-shot rows decide if there are any."""
    first = materialise(df.groupBy("llm").agg(
        F.min(F.when(F.col("action") == "zero-shot", F.col(row_id))).alias("zs"), F.min(row_id).alias("any")
    ), "models")
    has_zs = F.coalesce(first.agg(F.max(F.col("zs").isNotNull()).alias("has")).scalar(), F.lit(False))
    there = first.withColumn("has_zs", has_zs).filter(~F.col("has_zs") | F.col("zs").isNotNull())
    key = F.col("llm") if alphabetical else F.when(F.col("has_zs"), F.col("zs")).otherwise(F.col("any"))
    return numbered(there.select("llm", key.alias("key")), ["key"]).select(F.col("pos").cast("int").alias("pos"), "llm")


def models_in_summary(models: DataFrame, summary: DataFrame) -> DataFrame:
    """Models of the dimension that occur in the summary, to be ordered by ``id``."""
    return models.join(summary.select("llm").distinct(), "llm", "left_semi")


def attach_models(df: DataFrame, models: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Attach model attributes; ``strict`` fails on a model the dimension lacks."""
    dim = models.select("llm", *columns, F.lit(True).alias("__known"))
    out = df.join(dim, "llm", "left")
    if strict:
        out = out.filter(F.assert_true(F.col("__known").isNotNull(), F.concat(F.lit("unknown model "), "llm")).isNull())
    return out.drop("__known")


# Actions that get their own table.
SPLIT_ACTIONS = ["zero-shot", "classification", "fixing"]


def split_by_action(df: DataFrame, models: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """Overall rows of the given actions with the model ID in front, sorted by action and ID."""
    rows = keep(df, dataset="overall", action=actions or SPLIT_ACTIONS)
    out = attach_models(rows, models.withColumnRenamed("id", "ID"), ["ID"], strict=True)
    return out.select("ID", *df.columns).orderBy("action", "ID")


def square_matrix(wide: DataFrame, order: list[str], action: str, dataset: str, predicate: str) -> DataFrame:
    """Rows and columns of one matrix in the given order (``pos``, ``llm``, models); absent is NULL."""
    sub = keep(wide, action=action, dataset=dataset, predicate=predicate)
    have = set(wide.columns)
    cols = [
        (to_number(F.col(f"`{m}`")) if m in have else F.lit(None).cast("double")).alias(m) for m in order
    ]
    rows = index_map(wide.sparkSession, order).select(F.col("idx").alias("pos"), "llm")
    return rows.join(sub.select("llm", *cols), "llm", "left").select("pos", "llm", *[F.col(f"`{m}`") for m in order])


def model_grid(spark: SparkSession, order: list[str]) -> DataFrame:
    """All (llm_i, llm_j) of a model list, made by index arithmetic."""
    n = len(order)
    arr = F.array(*[F.lit(m) for m in order])
    return spark.range(n * n).select(
        F.element_at(arr, (F.floor(F.col("id") / n) + 1).cast("int")).alias("llm_i"),
        F.element_at(arr, (F.col("id") % n + 1).cast("int")).alias("llm_j"),
    )


def fill_grid(long: DataFrame, order: list[str], value: str = "p", default: float = 1.0) -> DataFrame:
    """Pairs of one matrix on the full grid; absent pairs get ``default``."""
    return model_grid(long.sparkSession, order).join(long.select("llm_i", "llm_j", value), ["llm_i", "llm_j"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )


def transpose(df: DataFrame, columns: list[str], models: list[str], by: str = "action") -> DataFrame:
    """Per action: metrics become rows, models become columns."""
    long = df.select(by, "llm", *[to_number(F.col(c)).alias(c) for c in columns]).unpivot(
        [by, "llm"], columns, "metric", "val"
    )
    return long.groupBy(by, "metric").pivot("llm", models).agg(F.first("val"))


def aligned_values(df: DataFrame, order: list[str], action: str, value: str = "value") -> DataFrame:
    """Values of one action in model order; a model without value is NULL."""
    one = df.filter(F.col("action") == action).select("llm", value)
    rows = index_map(df.sparkSession, order).select(F.col("idx").alias("pos"), "llm")
    return rows.join(one, "llm", "left").select("pos", "llm", value)


def mean_over_actions(df: DataFrame, metrics: list[str], dataset: str, actions: list[str], order: list[str]) -> DataFrame:
    """Mean of metrics per model over the chosen actions, on the full model order."""
    means = keep(df, dataset=dataset, action=actions).groupBy("llm").agg(*[F.avg(m).alias(m) for m in metrics])
    rows = index_map(df.sparkSession, order).select(F.col("idx").alias("pos"), "llm")
    return rows.join(means, "llm", "left").select("pos", "llm", *metrics)


def combos(df: DataFrame, columns: list[str] = ("action", "dataset")) -> DataFrame:
    return df.select(*columns).distinct()


def bubble_areas(models: DataFrame, lo: float = 80.0, hi: float = 420.0) -> DataFrame:
    """Drawing area per model: sizes rescaled if all are numeric, named buckets otherwise.

    The extremes are scalar subqueries of the dimension table; the median is counted (see
    :func:`accordant.operators.rollup.medians`).
    """
    sized = models.withColumn("size_value", parse_size(F.col("size")))
    stats = sized.agg(
        F.min("size_value").alias("vmin"), F.max("size_value").alias("vmax"),
        F.count_if(F.col("size_value").isNull()).alias("bad"),
    )
    middle = medians(sized.select(F.lit("all").alias("of"), "size_value"), ["of"], ["size_value"])
    out = sized.withColumns({c: stats.select(c).scalar() for c in ("vmin", "vmax", "bad")})
    out = out.withColumn("vmed", middle.select("size_value").scalar())
    return out.select(
        *models.columns, "size_value", "vmin", "vmed", "vmax",
        F.when(F.col("bad") > 0, bucket_area(F.col("size")))
        .otherwise(rescale(F.col("size_value"), F.col("vmin"), F.col("vmax"), lo, hi)).alias("area"),
    )


def chart_series(summary: DataFrame, metrics: list[str], models: DataFrame | None = None) -> DataFrame:
    """Summary as (dataset, action, llm, metric, value), with id, company and date if models are given."""
    long = summary.select(
        "dataset", "action", "llm", *[F.col(m).cast("double").alias(m) for m in metrics]
    ).unpivot(["dataset", "action", "llm"], metrics, "metric", "value")
    if models is None:
        return long
    dim = models.select("llm", "id", F.coalesce("company", F.lit("Other")).alias("company"),
                        release_date(F.col("release_date")).alias("released"))
    return long.join(dim, "llm", "left")
