"""Result tables: models, orders, matrices, series, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import names
from accordant.functions import numbers
from accordant.functions.numbers import round4
from accordant.operators import correlation, reshape, rollup, scores
from accordant.plans.answer_queries import (
    ANSWERS, ELEMENTS, FROM_LINES, LINES, MATRIX_CTES, PVALUE_CTES, SLOTS, SUMMARY_CTES, flag, line_analysis, line_matrix,
    mcnemar_sql, mean4, row_mean_sql, s_disj, s_eq, s_jac, scaled,
)
from accordant.plans.catalog import query, with_ctes
from accordant.sources import tables

P = tables.PRIORITIES

MODELS = """model_rows AS (
  SELECT o_orderpriority AS llm, CAST(left(o_orderpriority, 1) AS INTEGER) AS id, CAST(count(*) % 97 AS DOUBLE) AS score,
    strftime(min(o_orderdate), '%Y-%m-%d') AS release_date,
    CASE WHEN o_orderpriority < '3' THEN 'north' END AS company, CAST(count(*) % 71 + 1 AS VARCHAR) || 'b' AS size
  FROM orders GROUP BY o_orderpriority)"""


def line_summary(spark, root, metrics=None):
    return rollup.summarise(line_analysis(spark, root), metrics)


# -- correlation -----------------------------------------------------------------------------

_R = {"R1": "eq_a1_a2", "R2": "sub_a3_a1", "R3": "sub_a4_a1", "R4": "disj_a3_a4", "R5": "part_a1_a34"}
_SCORED = {
    **_R, "R_mean": row_mean_sql(*_R.values()), "JR1": "jac_a1_a2", "JR4": "jac_a3_a4", "JR5": "jac_a4_diff",
}


@query("score_correlations", with_ctes(
    [*SUMMARY_CTES, MODELS,
     "rows AS (SELECT * FROM summary JOIN (SELECT llm, score FROM model_rows WHERE score <> 0) USING (llm) "
     "WHERE dataset = 'overall' AND action = 'zero-shot')",
     "found AS (" + " UNION ALL ".join(
         f"SELECT '{n}' AS metric, corr(score, {m}) AS r, count(*) AS n FROM rows" for n, m in _SCORED.items()
     ) + ")",
     "angles AS (SELECT *, atan(abs(r) * sqrt(3.0::DOUBLE / (1 - r * r)) / sqrt(3.0::DOUBLE)) AS a FROM found)"],
    """SELECT metric, n, round(r, 7) AS r, round(1 - 2 / pi() * (a + sin(a) * cos(a)), 7) AS p,
         CASE WHEN 1 - 2 / pi() * (a + sin(a) * cos(a)) < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM angles""",
))
def score_correlations(spark, root):
    """Five models, so Student's t with three degrees of freedom gives the same p in closed form."""
    c = correlation.score_correlations(line_summary(spark, root), tables.models(spark, root))
    return c.select("metric", "n", F.round("r", 7).alias("r"), F.round("p", 7).alias("p"), "significant")


# Student's t by its finite sums, for an even and an odd number of degrees of freedom; 1 - r^2 is the
# squared cosine of the angle whose sine is r.
_EVEN = ("1 - abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: "
         "exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5) + k * ln(1 - r * r))))")
_ODD = ("1 - 2 / pi() * (asin(abs(r)) + abs(r) * list_sum(list_transform(range(0, (n - 3) // 2), lambda k: "
        "exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + (k + 0.5) * ln(1 - r * r)))))")


@query("line_correlations", f"""
WITH found AS (SELECT 'price' AS metric, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'discount', count(*), corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'tax', count(*), corr(l_quantity, l_tax) FROM lineitem),
tested AS (SELECT *, CASE WHEN n % 2 = 0 THEN {_EVEN} ELSE {_ODD} END AS p FROM found)
SELECT metric, n, round(r, 7) AS r, round(greatest(p, 0), 7) + 0 AS p, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM tested""")
def line_correlations(spark, root):
    """Correlations over all order lines, where p has very many degrees of freedom."""
    li = tables.load(spark, root, "lineitem")
    c = correlation.correlate(
        li, F.col("l_quantity"),
        {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")},
    )
    return c.select("metric", "n", F.round("r", 7).alias("r"), F.round("p", 7).alias("p"), "significant")


# -- per model -------------------------------------------------------------------------------


_PER_MODEL = names.FLAGS + names.JACCARDS


@query("metric_mean_per_model", with_ctes(
    FROM_LINES, f"SELECT llm, {', '.join(f'round(avg({m}), 8) AS {m}' for m in _PER_MODEL)} FROM analysis GROUP BY llm",
))
def metric_mean_per_model(spark, root):
    means = rollup.metric_per_model(line_analysis(spark, root), _PER_MODEL)
    return means.select("llm", *[F.round(m, 8).alias(m) for m in _PER_MODEL])


@query("metric_median_per_model", with_ctes(
    FROM_LINES, f"SELECT llm, {', '.join(f'median({m})::DOUBLE AS {m}' for m in _PER_MODEL)} FROM analysis GROUP BY llm",
))
def metric_median_per_model(spark, root):
    """Medians of all metrics, from counts of their values."""
    return rollup.metric_per_model(line_analysis(spark, root), _PER_MODEL, "median")


_ORDER = "(VALUES " + ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate([*P, "absent"])) + ") AS o(pos, llm)"


@query("mean_over_actions", with_ctes(
    SUMMARY_CTES,
    f"""SELECT CAST(pos AS INTEGER) AS pos, o.llm, {', '.join(f'm.{m}' for m in _PER_MODEL)} FROM {_ORDER} LEFT JOIN (
          SELECT llm, {', '.join(f'round(avg({m}), 8) AS {m}' for m in _PER_MODEL)} FROM summary
          WHERE dataset = 'overall' AND action IN ('fixing', 'classification') GROUP BY llm) m USING (llm)""",
))
def mean_over_actions(spark, root):
    s = line_summary(spark, root, _PER_MODEL)
    means = reshape.mean_over_actions(s, _PER_MODEL, "overall", ["fixing", "classification"], [*P, "absent"])
    return means.select("pos", "llm", *[F.round(m, 8).alias(m) for m in _PER_MODEL])


@query("aligned_values", with_ctes(
    SUMMARY_CTES,
    f"""SELECT CAST(pos AS INTEGER) AS pos, o.llm, s.eq_a1_a2 AS value FROM {_ORDER} LEFT JOIN (
          SELECT * FROM summary WHERE dataset = 'overall' AND action = 'fixing') s USING (llm)""",
))
def aligned_values(spark, root):
    s = line_summary(spark, root, ["eq_a1_a2"]).filter("dataset = 'overall'")
    return reshape.aligned_values(s.withColumnRenamed("eq_a1_a2", "value"), [*P, "absent"], "fixing")


@query("bubble_areas", with_ctes(
    [MODELS, "sized AS (SELECT llm, CAST(rtrim(size, 'b') AS DOUBLE) * 1e9 AS v FROM model_rows)",
     "ends AS (SELECT min(v) AS vmin, max(v) AS vmax, median(v) AS vmed FROM sized)"],
    """SELECT llm, v AS size_value, vmin, vmed, vmax,
         CASE WHEN vmin = vmax THEN 250.0::DOUBLE ELSE 80.0::DOUBLE + (v - vmin) / (vmax - vmin) * 340.0::DOUBLE END AS area
       FROM sized, ends""",
))
def bubble_areas(spark, root):
    return reshape.bubble_areas(tables.models(spark, root)).select("llm", "size_value", "vmin", "vmed", "vmax", "area")


@query("model_dimension", with_ctes(
    [*SUMMARY_CTES, MODELS],
    """SELECT dataset, action, llm, n, id, score, company, CAST(release_date AS DATE) AS released
       FROM summary LEFT JOIN model_rows USING (llm)""",
))
def model_dimension(spark, root):
    s = line_summary(spark, root, ["eq_a1_a2"]).select("dataset", "action", "llm", "n")
    from accordant.functions.text import release_date

    out = reshape.attach_models(s, tables.models(spark, root), ["id", "score", "company", "release_date"], strict=True)
    return out.withColumn("released", release_date(F.col("release_date"))).drop("release_date")


@query("models_in_summary", with_ctes(
    [LINES, MODELS], "SELECT id, llm FROM model_rows WHERE llm IN (SELECT llm FROM lines WHERE action = 'fixing' AND dataset = 'BUILDING')",
))
def models_in_summary(spark, root):
    lines = tables.order_lines(spark, root).filter("action = 'fixing' AND dataset = 'BUILDING'")
    return reshape.models_in_summary(tables.models(spark, root), lines).select("id", "llm").orderBy("id")


@query("distinct_combos", with_ctes([LINES], "SELECT DISTINCT action, dataset FROM lines"))
def distinct_combos(spark, root):
    return reshape.combos(tables.order_lines(spark, root))


@query("model_order", """
WITH f AS (SELECT o_orderpriority AS llm, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS pos, llm FROM f""")
def model_order(spark, root):
    o = tables.load(spark, root, "orders").select(
        F.col("o_orderpriority").alias("llm"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "zero-shot").otherwise("fixing").alias("action"),
    )
    return reshape.model_order(o, "o_orderkey")


@query("index_letters", """
SELECT p_partkey, CASE WHEN i >= 702 THEN chr(65 + (i - 702) // 676 % 26) ELSE '' END
  || CASE WHEN i >= 26 THEN chr(65 + (i - 26) // 26 % 26) ELSE '' END || chr(65 + i % 26) AS letter
FROM (SELECT p_partkey, CAST(p_partkey * 7 % 18278 AS INTEGER) AS i FROM part)""")
def index_letters(spark, root):
    """Letters of one to three places."""
    p = tables.load(spark, root, "part")
    return p.select("p_partkey", reshape.letter_code((F.col("p_partkey") * 7 % 18278).cast("int")).alias("letter"))


# -- matrices --------------------------------------------------------------------------------

_PIVOT = ", ".join(f'any_value(p) FILTER (WHERE llm_j = \'{m}\') AS "{m}"' for m in P)
_WIDE = f"wide AS (SELECT action, dataset, predicate, llm_i AS llm, {_PIVOT} FROM p_matrix GROUP BY action, dataset, predicate, llm_i)"


@query("wide_matrix", with_ctes([*MATRIX_CTES, _WIDE], "SELECT * FROM wide"))
def wide_matrix(spark, root):
    return reshape.widen_matrix(line_matrix(spark, root), P)


@query("heatmap_cells", with_ctes(
    MATRIX_CTES,
    """SELECT predicate, CAST(left(llm_i, 1) AS INTEGER) AS i, CAST(left(llm_j, 1) AS INTEGER) AS j, p AS val FROM p_matrix
       WHERE action = 'zero-shot' AND dataset = 'overall'""",
))
def heatmap_cells(spark, root):
    return reshape.heatmap_cells(reshape.widen_matrix(line_matrix(spark, root), P), P, "zero-shot", "overall")


@query("square_matrix", with_ctes(
    [*MATRIX_CTES, _WIDE],
    f"""SELECT CAST(pos AS INTEGER) AS pos, o.llm, "5-LOW", "1-URGENT", CAST(NULL AS DOUBLE) AS absent FROM
          (VALUES (1, '5-LOW'), (2, '1-URGENT'), (3, 'absent')) AS o(pos, llm) LEFT JOIN (
          SELECT * FROM wide WHERE action = 'fixing' AND dataset = 'BUILDING' AND predicate = 'eq_a1_a2') w USING (llm)""",
))
def square_matrix(spark, root):
    wide = reshape.widen_matrix(line_matrix(spark, root), P)
    return reshape.square_matrix(wide, ["5-LOW", "1-URGENT", "absent"], "fixing", "BUILDING", "eq_a1_a2")


_TRANSPOSED = " UNION ALL ".join(
    f"SELECT action, llm, 'p_{f}' AS metric, round_even(round({mcnemar_sql(f'n10_{f}', f'n01_{f}')}, 12), 4) AS v "
    "FROM paired_all WHERE dataset = 'overall'" for f in names.TESTED
)


@query("transposed_p_values", with_ctes(
    [*PVALUE_CTES, f"ps AS ({_TRANSPOSED})"],
    "SELECT action, metric, " + ", ".join(f'any_value(v) FILTER (WHERE llm = \'{m}\') AS "{m}"' for m in P)
    + " FROM ps GROUP BY action, metric",
))
def transposed_p_values(spark, root):
    from accordant.operators.significance import action_p_values

    p = action_p_values(line_analysis(spark, root), tables.ACTIONS)
    return reshape.transpose(p.filter("dataset = 'overall'"), [f"p_{f}" for f in names.TESTED], P)


@query("full_grid", with_ctes(
    [*MATRIX_CTES, "names AS (SELECT llm FROM models UNION ALL SELECT 'absent')"],
    """SELECT a.llm AS llm_i, b.llm AS llm_j, coalesce(p, 1.0::DOUBLE) AS p FROM names a, names b LEFT JOIN p_matrix m
         ON m.llm_i = a.llm AND m.llm_j = b.llm AND action = 'zero-shot' AND dataset = 'overall' AND predicate = 'sub_a4_a1'""",
))
def full_grid(spark, root):
    one = line_matrix(spark, root).filter("action = 'zero-shot' AND dataset = 'overall' AND predicate = 'sub_a4_a1'")
    return reshape.fill_grid(one, [*P, "absent"])


_CHARTED = [*_PER_MODEL, "eq_a1_ave", "jac_a1_ave", "idk"]


@query("chart_series", with_ctes(
    [*SUMMARY_CTES, MODELS],
    """SELECT dataset, action, llm, metric, value, id, coalesce(company, 'Other') AS company, CAST(release_date AS DATE) AS released
       FROM (""" + " UNION ALL ".join(f"SELECT dataset, action, llm, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM summary" for m in _CHARTED)
    + ") LEFT JOIN model_rows USING (llm)",
))
def chart_series(spark, root):
    """All metrics of the summary."""
    return reshape.chart_series(line_summary(spark, root), _CHARTED, tables.models(spark, root))


@query("overall_by_action", with_ctes(
    [*SUMMARY_CTES, MODELS],
    f"""SELECT id AS "ID", dataset, action, llm, {', '.join(_CHARTED)} FROM summary JOIN model_rows USING (llm)
       WHERE dataset = 'overall' AND action IN ('zero-shot', 'fixing')""",
))
def overall_by_action(spark, root):
    s = line_summary(spark, root).select("dataset", "action", "llm", *_CHARTED)
    return reshape.split_by_action(s, tables.models(spark, root), ["zero-shot", "fixing"])


# -- score summaries -------------------------------------------------------------------------


@query("score_table_summary", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS,
     f"""scored AS (SELECT action, llm AS model, dataset AS task, {s_jac('e1', 'e2')} AS j, {flag(s_eq('e1', 'e2'))} AS b,
       {flag(s_disj('c3', 'm4'))} AS d FROM slots)"""],
    f"""SELECT task, model, action, {mean4('sum(' + scaled('j') + ')', 'count(*)')} AS average_all,
         {mean4('(10000 * count(*) FILTER (WHERE j = 0))', 'count(*)')} AS ratio_empty,
         {mean4('sum(' + scaled('j') + ')', 'count(*) FILTER (WHERE j <> 0)')} AS average_no_empty,
         {mean4('(10000 * count(*) FILTER (WHERE b = 1))', 'count(*)')} AS binary_rate,
         count(*) FILTER (WHERE d = 1) AS disjoint_count
       FROM scored GROUP BY task, model, action""",
))
def score_table_summary(spark, root):
    from accordant.functions import sets
    from accordant.operators.answers import answer_slots

    slots = answer_slots(tables.answers(spark, root))
    scored = slots.select(
        "action", F.col("llm").alias("model"), F.col("dataset").alias("task"),
        round4(sets.jaccard(F.col("e1"), F.col("e2"))).alias("JaccardSimilarity"),
        sets.flag(sets.equal(F.col("e1"), F.col("e2"))).alias("BinaryEqual"),
        sets.flag(sets.disjoint(F.col("c3"), F.col("m4"))).alias("B_Intersected_C_EmptyCount"),
    )
    return scores.summarise_score_tables(scored)


@query("score_file_summary", """
SELECT CAST(user_id AS VARCHAR) AS file, round_even(avg(s), 4) AS average_score, count(*) FILTER (WHERE s = 1) AS count_ones,
  count(*) AS size
FROM (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS s FROM events)
GROUP BY user_id""")
def score_file_summary(spark, root):
    """Scores 0, 0.5 and 1; an entry that is no number counts towards the size only."""
    e = tables.load(spark, root, "events")
    raw = (
        F.when(F.col("event_id") % 4 == 0, "1").when(F.col("event_id") % 4 == 1, "0.5").when(F.col("event_id") % 4 == 2, "0")
        .otherwise('["x"]')
    )
    s = e.select(F.col("user_id").cast("string").alias("file"), numbers.to_number(raw).alias("score"))
    return scores.summarise_score_files(s)
