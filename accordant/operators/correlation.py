"""Correlation of a model's score with its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.numbers import row_mean, truthy
from accordant.functions.stats import pearson_p

# Result names and the metrics behind them; R_mean is the mean of R1..R5.
SCORED_METRICS = {
    "R1": "eq_a1_a2",
    "R2": "sub_a3_a1",
    "R3": "sub_a4_a1",
    "R4": "disj_a3_a4",
    "R5": "part_a1_a34",
    "R_mean": None,
    "JR1": "jac_a1_a2",
    "JR4": "jac_a3_a4",
    "JR5": "jac_a4_diff",
}


def correlate(df: DataFrame, x: Column, metrics: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """Pearson r of ``x`` with each metric, its two-sided p and a Yes/No at ``alpha``.

    One aggregation over the rows; only the result rows, one per metric, reach Python.
    """
    pairs = df.select(x.cast("double").alias("x"), *[c.cast("double").alias(n) for n, c in metrics.items()])
    one = pairs.agg(
        *[F.corr("x", n).alias(f"r_{n}") for n in metrics],
        *[F.count(F.when(F.col("x").isNotNull() & F.col(n).isNotNull(), 1)).alias(f"n_{n}") for n in metrics],
    )
    cells = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"r_{n}").alias("r"), F.col(f"n_{n}").alias("n")) for n in metrics
    ])
    rows = one.select(F.explode(cells).alias("c")).select("c.*")
    return rows.withColumn("p", pearson_p(F.col("r"), F.col("n"))).withColumn(
        "significant", F.when(F.col("p") < alpha, "Yes").otherwise("No")
    )


def score_correlations(summary: DataFrame, models: DataFrame, dataset: str = "overall", action: str = "zero-shot") -> DataFrame:
    """Model score against the summary metrics; models without a score do not count."""
    rows = summary.filter((F.col("dataset") == dataset) & (F.col("action") == action)).join(
        models.filter(truthy(F.col("score"))).select("llm", "score"), "llm"
    )
    five = [F.col(SCORED_METRICS[f"R{i}"]) for i in range(1, 6)]
    return correlate(
        rows, F.col("score"),
        {n: (F.col(m) if m else row_mean(*five)) for n, m in SCORED_METRICS.items()},
    )
