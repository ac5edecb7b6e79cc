"""Means per (dataset, action, model), the pooled overall level, stratified means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant import names
from accordant.functions.numbers import round4, row_mean
from accordant.session import materialise

OVERALL = "overall"


def overall_level(fine: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Per-dataset sums plus their pooled 'overall' level.

    ``fine`` holds one small row per key, so the second level costs an expand of result rows and
    not of input rows.
    """
    others = [k for k in keys if k != "dataset"]
    both = fine.groupingSets(
        [[F.col(k) for k in keys], [F.col(k) for k in others]], *keys
    ).agg(*[F.sum(s).alias(s) for s in sums], F.grouping("dataset").alias("is_overall"))
    return both.withColumn(
        "dataset", F.when(F.col("is_overall") == 1, F.lit(OVERALL)).otherwise(F.col("dataset"))
    ).drop("is_overall")


# Metrics that have four decimals at most; others are summed with more.
FOUR_DECIMALS = set(names.FLAGS + names.JACCARDS + names.IDKS + names.CONTRADICTIONS) | {
    c.replace("idk_", "idk_only_") for c in names.IDKS
}


def exact_sum(c: str, condition: Column | None = None) -> Column:
    """Sum of a metric in ten-thousandths, the same in whatever order rows are added.

    Flags and 4-decimal similarities become whole numbers; any other metric keeps sixteen decimals.
    """
    scaled = F.expr(f"BIGINT(round({c} * 10000))" if c in FOUR_DECIMALS else f"CAST(CAST({c} AS DECIMAL(33, 16)) * 10000 AS DECIMAL(33, 12))")
    return F.sum(scaled if condition is None else F.when(condition, scaled))


def mean_of(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total).cast("double") / (F.col(n) * F.lit(10000.0)))


def metric_columns(df: DataFrame) -> list[str]:
    """Metrics of an analysis table that a summary averages, in result order."""
    wanted = names.FLAGS + names.JACCARDS + [c for c in df.columns if c.startswith("p_value_")] + names.CONTRADICTIONS
    return [c for c in wanted if c in df.columns]


def _sources(columns: list[str], metrics: list[str]) -> dict[str, str]:
    """Summary column and the analysis column behind it; idk flags use the summary definition."""
    only = {c: c.replace("idk_", "idk_only_") for c in names.IDKS}
    return {**{m: m for m in metrics}, **{c: (o if o in columns else c) for c, o in only.items()}}


def partial_sums(analysis: DataFrame, metrics: list[str]) -> DataFrame:
    """Sums and counts of every metric per (dataset, action, model): what summaries are added up from."""
    source = _sources(analysis.columns, metrics)
    return analysis.groupBy("dataset", "action", "llm").agg(
        *[exact_sum(src).alias(f"{m}__t") for m, src in source.items()],
        *[F.count(src).alias(f"{m}__n") for m, src in source.items()],
        F.count("*").alias("n"),
    )


def summary_of(sums: DataFrame, metrics: list[str]) -> DataFrame:
    """The summary table from partial sums, which may come in several rows per key."""
    keys, source = ["dataset", "action", "llm"], [*metrics, *names.IDKS]
    both = overall_level(sums, keys, [f"{m}__{k}" for m in source for k in "tn"] + ["n"])
    out = both.select(*keys, "n", *[round4(mean_of(f"{m}__t", f"{m}__n")).alias(m) for m in source])
    if {"eq_a1_s", "eq_a1_p", "eq_s_p"} <= set(metrics):
        out = out.withColumn("eq_a1_ave", round4(row_mean(F.col("eq_a1_s"), F.col("eq_a1_p"), F.col("eq_s_p"))))
    if {"jac_a1_s", "jac_a1_p", "jac_s_p"} <= set(metrics):
        out = out.withColumn("jac_a1_ave", round4(row_mean(F.col("jac_a1_s"), F.col("jac_a1_p"), F.col("jac_s_p"))))
    out = blend_overall(out, [m for m in ("eq_a1_s", "jac_a1_s") if m in metrics])
    return out.withColumn("idk", row_mean(*[F.col(c) for c in names.IDKS]))


def summarise(analysis: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Summary table: rounded means per (dataset, action, model) and overall.

    The averages of the A1 repeats are taken before the overall zero-shot repeat metrics are
    blended with those of classification; idk flags use the summary definition.
    """
    metrics = metrics or metric_columns(analysis)
    return summary_of(partial_sums(analysis, metrics), metrics)


def blend_overall(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """Overall zero-shot repeat metrics become their mean with classification's, or that value.

    The partner row comes by a window over the few rows of a (dataset, model), which spares a
    self-join and with it a second computation of the summary.
    """
    w = Window.partitionBy("dataset", "llm")
    other = F.col("action") == "classification"
    here = (F.col("dataset") == OVERALL) & (F.col("action") == "zero-shot")
    has_other = F.max(other.cast("int")).over(w) == 1
    cols = {}
    for m in metrics:
        b = F.max(F.when(other, F.col(m))).over(w)
        mixed = F.when(F.col(m).isNull(), b).otherwise((F.col(m) + b) / 2)
        cols[m] = F.when(here & has_other, mixed).otherwise(F.col(m))
    return summary.withColumns(cols) if cols else summary


# Metrics averaged separately where a relation label is right (+) and wrong (-).
STRATA = {
    "r_12": ["eq_a1_a2", "jac_a1_a2"],
    "r_13": ["sub_a3_a1"],
    "r_14": ["sub_a4_a1", "jac_a1_a4"],
    "r_34": ["disj_a3_a4", "jac_a3_a4"],
    "r_134": ["eq_a1_a34", "jac_a1_a34"],
}


def stratified_means(analysis: DataFrame, actions: list[str] = ("zero-shot", "classification")) -> DataFrame:
    """Unrounded metric means over rows with a right and with a wrong label.

    A row without label is in neither part.  A metric the table does not have is skipped.
    """
    keys = ["dataset", "action", "llm"]
    todo = [
        (rel, m) for rel, ms in STRATA.items() for m in ms if rel in analysis.columns and m in analysis.columns
    ]
    aggs, sums = [], []
    for rel, m in todo:
        for side, cond in (("pos", F.col(rel) == names.TRUE_LABELS[rel]), ("neg", F.col(rel) != names.TRUE_LABELS[rel])):
            aggs += [
                exact_sum(m, cond).alias(f"{m}_{side}__t"),
                F.count(F.when(cond, F.col(m))).alias(f"{m}_{side}__n"),
            ]
            sums += [f"{m}_{side}__t", f"{m}_{side}__n"]
    fine = analysis.filter(F.col("action").isin(list(actions))).groupBy(*keys).agg(*aggs)
    both = overall_level(fine, keys, sums)
    return both.select(
        *keys,
        *[mean_of(f"{m}_{side}__t", f"{m}_{side}__n").alias(f"{m}_{side}") for _, m in todo for side in ("pos", "neg")],
    )


def add_stratified_means(summary: DataFrame, analysis: DataFrame, actions: list[str] = ("zero-shot", "classification")) -> DataFrame:
    """Summary with the stratified means written to the rows of the given actions."""
    return summary.join(stratified_means(analysis, actions), ["dataset", "action", "llm"], "left")


def add_p_values(summary: DataFrame, p_values: DataFrame) -> DataFrame:
    return summary.join(p_values, ["dataset", "action", "llm"], "left")


def metric_per_model(df: DataFrame, metrics: list[str], how: str = "mean") -> DataFrame:
    """Mean or exact median of metrics per model; text that is no number is skipped."""
    numeric = df.select("llm", *[F.col(m).try_cast("double").alias(m) for m in metrics])
    if how == "median":
        return medians(numeric, ["llm"], metrics)
    return numeric.groupBy("llm").agg(*[F.avg(m).alias(m) for m in metrics])


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact medians of numeric columns per group, by counting values; nulls are skipped, NaN is the largest.

    A group's distinct values are counted, and the counts added up over ranges of values first: eight
    to a power of two, so a group has some ten thousand ranges at most.  Only the ranges that hold the
    middle are looked at value by value.  No group's values are in one buffer.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("cell")
    group = [*by, "metric"]
    counted = df.select(*by, cells).select(*by, "cell.*").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.least(F.log2(F.abs("v")) * 8, F.lit(1e5))) + 9000
    span = F.when(F.isnan("v"), F.lit(1 << 20)).when(F.col("v") == 0, F.lit(0)).otherwise(F.signum("v") * size)
    counted = materialise(counted.withColumn("span", span.cast("int")), "values")
    values = counted.filter("v is not null")
    before = (Window.unboundedPreceding, -1)
    spans = values.groupBy(*group, "span").agg(F.sum("n").alias("k"))
    order, whole = Window.partitionBy(*group).orderBy("span"), Window.partitionBy(*group)
    spans = spans.select(
        *group, "span", "k", F.coalesce(F.sum("k").over(order.rowsBetween(*before)), F.lit(0)).alias("base"), F.sum("k").over(whole).alias("total")
    )
    # 0-based ranks of the two middle values, which are one if their number is odd.
    spans = spans.withColumns({"low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")})
    spans = spans.filter("(low >= base and low < base + k) or (high >= base and high < base + k)").drop("k", "total")
    inside = Window.partitionBy(*group, "span").orderBy("v").rowsBetween(*before)
    found = values.join(spans, [*group, "span"]).withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("first")) & (F.col(rank) < F.col("first") + F.col("n")), F.col("v")))

    middle = found.groupBy(*group).agg((at("low") * 0.5 + at("high") * 0.5).alias("median"))
    wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(c) for c in columns])
    return counted.select(*by).distinct().join(wide, by, "left")
