"""Answer sets, analysis, summary and significance on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import names
from accordant.functions import sets
from accordant.functions.numbers import idk_any, idk_only, round4
from accordant.operators import analysis as an
from accordant.operators import answers as ans
from accordant.operators import relations as rel
from accordant.operators import rollup, scores, significance, workqueue
from accordant.plans.catalog import query, with_ctes
from accordant.session import laid_out
from accordant.sources import tables

# -- SQL building blocks ---------------------------------------------------------------------

LINES = """lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS q_id, c_mktsegment AS dataset, o_orderpriority AS llm,
    CASE WHEN l_linestatus = 'O' THEN 'zero-shot' WHEN l_suppkey % 2 = 0 THEN 'fixing' ELSE 'classification' END AS action,
    CASE WHEN l_partkey % 3 = 0 THEN 'idk' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS element,
    l_quantity <= 45 AS e1, l_discount >= 0.01::DOUBLE AS e2, l_tax <= 0.07::DOUBLE AS c1, l_returnflag = 'R' AS c3,
    l_extendedprice <= 85000 AS m1, (l_returnflag = 'R' AND l_tax <= 0.06::DOUBLE) AS m3, l_returnflag <> 'R' AS m4,
    l_linenumber <= 6 AS star
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

_CELLS = [
    ("e1", "Q1", "equal", False), ("e2", "Q2", "equal", False), ("c3", "Q3", "sup-sub", False),
    ("m4", "Q4", "minus", False), ("c1", "Q1", "sup-sub", True), ("m1", "Q1", "minus", True),
    ("m3", "Q3", "minus", True),
]

# The same lines with a question per nation and a part as element.
WIDE_LINES = LINES.replace("CAST(o_custkey AS VARCHAR) AS q_id", "CAST(c_nationkey AS VARCHAR) AS q_id").replace(
    "l_partkey % 3 = 0", "l_partkey % 50 = 0").replace("CAST(l_partkey % 3 AS VARCHAR)", "CAST(l_partkey AS VARCHAR)")

ELEMENTS = "elements AS (\n" + "\n  UNION ALL ".join(
    f"SELECT q_id, '{s}' AS q_serie, action, '{t}' AS task, dataset, llm, element FROM lines WHERE {slot}"
    + (" AND action <> 'zero-shot'" if repeat else "")
    for slot, s, t, repeat in _CELLS
) + """
  UNION ALL SELECT q_id, 'Q1', 'star', 'equal', dataset, llm, element FROM lines WHERE star AND action = 'zero-shot')"""

ANSWERS = """answers AS (
  SELECT q_id, q_serie, action, task, dataset, llm, list_sort(list(DISTINCT element)) AS answer
  FROM elements GROUP BY q_id, q_serie, action, task, dataset, llm)"""


def _slot(serie: str, task: str) -> str:
    return f"coalesce(any_value(answer) FILTER (WHERE q_serie = '{serie}' AND task = '{task}'), []::VARCHAR[])"


SLOTS = f"""slots AS (
  SELECT q_id, action, dataset, llm,
    {_slot('Q1', 'equal')} AS e1, {_slot('Q2', 'equal')} AS e2, {_slot('Q1', 'sup-sub')} AS c1,
    {_slot('Q3', 'sup-sub')} AS c3, {_slot('Q1', 'minus')} AS m1, {_slot('Q3', 'minus')} AS m3,
    {_slot('Q4', 'minus')} AS m4
  FROM answers WHERE action <> 'star' GROUP BY q_id, action, dataset, llm
  HAVING count(DISTINCT q_serie) = 4)"""

STARRED = """starred AS (
  SELECT s.*, t.answer AS star_answer FROM slots s LEFT JOIN answers t
  ON t.action = 'star' AND s.action = 'zero-shot' AND t.q_id = s.q_id AND t.dataset = s.dataset AND t.llm = s.llm)"""


def roles_cte(source: str) -> str:
    return f"""roles AS (
  SELECT q_id, action, dataset, llm, e1 AS a1, e2 AS a2, c3 AS a3, m4 AS a4,
    CASE WHEN action = 'zero-shot' THEN e1 ELSE c1 END AS c1, c3,
    CASE WHEN action = 'zero-shot' THEN e1 ELSE m1 END AS m1,
    CASE WHEN action = 'zero-shot' THEN c3 ELSE m3 END AS m3, m4,
    CASE WHEN action = 'zero-shot' THEN star_answer ELSE c1 END AS s,
    CASE WHEN action = 'zero-shot' THEN NULL ELSE m1 END AS p
  FROM {source})"""


def s_union(a, b):
    return f"list_distinct(list_concat({a}, {b}))"


def s_minus(a, b):
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def s_sub(a, b):
    return f"list_has_all({b}, {a})"


def s_eq(a, b):
    return f"({s_sub(a, b)} AND {s_sub(b, a)})"


def s_disj(a, b):
    return f"(NOT list_has_any({a}, {b}))"


def s_jac(a, b):
    return (
        f"round_even(CASE WHEN len({s_union(a, b)}) = 0 THEN 0.0::DOUBLE "
        f"ELSE len(list_intersect({a}, {b}))::DOUBLE / len({s_union(a, b)}) END, 4)"
    )


def flag(x):
    return f"CAST(CASE WHEN {x} THEN 1 ELSE 0 END AS INTEGER)"


def maybe(need, x):
    return f"CASE WHEN {need} THEN {x} END"


_FLAG_SQL = {
    "eq_a1_a2": flag(s_eq("a1", "a2")),
    "eq_a1_a34": flag(s_eq("m1", s_union("m3", "m4"))),
    "sub_a3_a1": flag(s_sub("c3", "c1")),
    "sub_a4_a1": flag(s_sub("m4", "m1")),
    "disj_a3_a4": flag(s_disj("m3", "m4")),
    "part_a1_a34": flag(f"{s_eq('m1', s_union('m3', 'm4'))} AND {s_disj('m3', 'm4')}"),
    "eq_a1_s": maybe("s IS NOT NULL", flag(s_eq("a1", "s"))),
    "eq_a1_p": maybe("p IS NOT NULL", flag(s_eq("a1", "p"))),
    "eq_s_p": maybe("s IS NOT NULL AND p IS NOT NULL", flag(s_eq("s", "p"))),
}
_JAC_SQL = {
    "jac_a1_a2": s_jac("a1", "a2"),
    "jac_a1_a34": s_jac("m1", s_union("m3", "m4")),
    "jac_a3_a4": s_jac("m3", "m4"),
    "jac_a4_diff": s_jac("m4", s_minus("m1", "m3")),
    "jac_a1_s": maybe("s IS NOT NULL", s_jac("a1", "s")),
    "jac_a1_p": maybe("p IS NOT NULL", s_jac("a1", "p")),
    "jac_s_p": maybe("s IS NOT NULL AND p IS NOT NULL", s_jac("s", "p")),
}
_IDK_SQL = {
    **{f"idk_a{i}": flag(f"len(a{i}) = 0 OR list_contains(a{i}, 'idk')") for i in range(1, 5)},
    **{f"idk_only_a{i}": flag(f"len(a{i}) = 0 OR a{i} = ['idk']") for i in range(1, 5)},
}
METRIC_SQL = {**_FLAG_SQL, **_JAC_SQL, **_IDK_SQL}
METRICS = list(METRIC_SQL)

ANALYSIS = "analysis AS (SELECT q_id, action, dataset, llm,\n" + ",\n".join(
    f"{e} AS {n}" for n, e in METRIC_SQL.items()
) + "\nFROM roles)"

FROM_ANSWERS = [LINES, ELEMENTS, ANSWERS, SLOTS, STARRED, roles_cte("starred"), ANALYSIS]
FROM_LINES = FROM_ANSWERS


def tail_sql(k: str, n: str) -> str:
    """P(X >= k), X ~ Binomial(n, 1/2)."""
    return (
        f"least(1.0::DOUBLE, list_sum(list_transform(range({k}, {n} + 1), lambda i: "
        f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE)))))"
    )


def mcnemar_sql(n10: str, n01: str) -> str:
    return f"CASE WHEN {n10} + {n01} = 0 OR {n10} = 0 THEN 1.0::DOUBLE ELSE {tail_sql(n10, f'({n10} + {n01})')} END"


def mcnemar2_sql(n10: str, n01: str) -> str:
    big = f"greatest({n10}, {n01})"
    return (
        f"CASE WHEN {n10} + {n01} = 0 THEN 1.0::DOUBLE "
        f"ELSE least(1.0::DOUBLE, 2 * {tail_sql(big, f'({n10} + {n01})')}) END"
    )


def mean4(total: str, n: str) -> str:
    """Half-even quotient of whole numbers, as ten-thousandths."""
    q, r = f"({total} // {n})", f"({total} % {n})"
    return (
        f"CASE WHEN {n} > 0 THEN ({q} + CASE WHEN 2 * {r} > {n} THEN 1 WHEN 2 * {r} < {n} THEN 0 "
        f"ELSE {q} % 2 END) / 10000.0::DOUBLE END"
    )


def scaled(m: str) -> str:
    return f"CAST(round({m} * 10000) AS BIGINT)"


def row_mean_sql(*cols: str) -> str:
    return (
        "(" + " + ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in cols) + ") / nullif("
        + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols) + ", 0)"
    )


_SUMMED = {**{m: m for m in names.FLAGS + names.JACCARDS}, **{f"idk_a{i}": f"idk_only_a{i}" for i in range(1, 5)}}


def levels_cte(name: str, source: str) -> str:
    """Rows of ``source`` once under their dataset and once under 'overall'."""
    return f"{name} AS (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('overall' AS dataset) FROM {source})"


def means_cte(metrics: dict[str, str], source: str) -> str:
    return "means AS (SELECT dataset, action, llm, count(*) AS n,\n" + ",\n".join(
        f"CAST(sum({scaled(src)}) AS BIGINT) AS {m}_t, count({src}) AS {m}_n" for m, src in metrics.items()
    ) + f"\nFROM {source} GROUP BY dataset, action, llm)"


_ROUNDED = "rounded AS (SELECT dataset, action, llm, n, " + ", ".join(
    f"{mean4(f'{m}_t', f'{m}_n')} AS {m}" for m in _SUMMED
) + " FROM means)"
_AVERAGED = (
    "averaged AS (SELECT *, "
    f"round_even({row_mean_sql('eq_a1_s', 'eq_a1_p', 'eq_s_p')}, 4) AS eq_a1_ave, "
    f"round_even({row_mean_sql('jac_a1_s', 'jac_a1_p', 'jac_s_p')}, 4) AS jac_a1_ave FROM rounded)"
)
_BLENDED = """blended AS (SELECT z.* REPLACE (
    CASE WHEN z.dataset = 'overall' AND z.action = 'zero-shot' AND c.llm IS NOT NULL
      THEN CASE WHEN z.eq_a1_s IS NULL THEN c.eq_a1_s ELSE (z.eq_a1_s + c.eq_a1_s) / 2 END ELSE z.eq_a1_s END AS eq_a1_s,
    CASE WHEN z.dataset = 'overall' AND z.action = 'zero-shot' AND c.llm IS NOT NULL
      THEN CASE WHEN z.jac_a1_s IS NULL THEN c.jac_a1_s ELSE (z.jac_a1_s + c.jac_a1_s) / 2 END ELSE z.jac_a1_s END AS jac_a1_s)
  FROM averaged z LEFT JOIN (SELECT * FROM averaged WHERE dataset = 'overall' AND action = 'classification') c
    ON c.llm = z.llm)"""
SUMMARY_CTES = [
    *FROM_LINES, levels_cte("levels", "analysis"), means_cte(_SUMMED, "levels"), _ROUNDED, _AVERAGED, _BLENDED,
    f"summary AS (SELECT *, {row_mean_sql('idk_a1', 'idk_a2', 'idk_a3', 'idk_a4')} AS idk FROM blended)",
]

# -- answers ---------------------------------------------------------------------------------


def line_analysis(spark, root):
    return an.analyse_masks(tables.element_masks(spark, root))


@query("complete_groups", with_ctes(
    [LINES, ELEMENTS],
    """SELECT q_id, action, dataset, llm FROM elements WHERE action <> 'star'
       GROUP BY q_id, action, dataset, llm HAVING count(DISTINCT q_serie) = 4""",
))
def complete_groups(spark, root):
    return ans.complete_groups(tables.answer_elements(spark, root))


_SHOW = {s: f"array_to_string(list_sort({s}), ',') AS {s}" for s in ("e1", "e2", "c1", "c3", "m1", "m3", "m4")}


@query("answer_slots", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS, STARRED],
    "SELECT q_id, action, dataset, llm, " + ", ".join(_SHOW.values())
    + ", array_to_string(list_sort(star_answer), ',') AS star FROM starred",
))
def answer_slots(spark, root):
    slots = ans.answer_slots(tables.answers(spark, root))
    return slots.select(
        *ans.GROUP_KEYS, *[F.array_join(F.array_sort(s), ",").alias(s) for s in [*_SHOW, "star"]]
    )


@query("answer_dedup", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    """SELECT q_id, q_serie, dataset, llm, array_to_string(answer, ',') AS answer, file_path FROM (
         SELECT *, '/data/answers/' || action || '/' || dataset || '/' || task || '/' || q_serie || '/' || llm AS file_path,
           row_number() OVER (PARTITION BY q_id, q_serie, dataset, llm
             ORDER BY '/data/answers/' || action || '/' || dataset || '/' || task || '/' || q_serie || '/' || llm) AS rn
         FROM answers) WHERE rn = 1""",
))
def answer_dedup(spark, root):
    """Repeats of a key keep the row with the lowest file path."""
    rows = tables.answers(spark, root).select("q_id", "q_serie", "dataset", "llm", "answer", "file_path")
    first = ans.first_by_path(rows, ["q_id", "q_serie", "dataset", "llm"], dealt=True)
    return first.withColumn("answer", F.array_join("answer", ","))


@query("enrich_answers", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    """SELECT q_id, q_serie, action, task, dataset, llm, array_to_string(answer, ',') AS answer,
         q_serie || ': ' || c_name AS question
       FROM answers LEFT JOIN customer ON c_custkey = CAST(q_id AS BIGINT) AND c_mktsegment = dataset
         AND c_acctbal >= 0""",
))
def enrich_answers(spark, root):
    """Question text per answer; texts of questions that are not in the table stay NULL."""
    known = tables.questions(spark, root, "c_acctbal >= 0")
    rich = ans.enrich_answers(tables.answers(spark, root), known)
    return rich.select(*ans.ANSWER_KEYS, F.array_join("answer", ",").alias("answer"), "question")


@query("question_texts_per_group", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS],
    """SELECT q_id, action, dataset, llm, 'Q1: ' || c_name AS q1, 'Q2: ' || c_name AS q2, 'Q3: ' || c_name AS q3,
         'Q4: ' || c_name AS q4
       FROM slots LEFT JOIN customer ON c_custkey = CAST(q_id AS BIGINT) AND c_mktsegment = dataset""",
))
def question_texts_per_group(spark, root):
    slots = ans.answer_slots(tables.answers(spark, root)).select(*ans.GROUP_KEYS)
    return ans.attach_questions(slots, tables.questions(spark, root)).select(*ans.GROUP_KEYS, "q1", "q2", "q3", "q4")


# -- set algebra -----------------------------------------------------------------------------

_SHOWN = "q_id, action, dataset, llm"


_ALGEBRA = f"""SELECT {_SHOWN}, array_to_string(list_sort({s_union('c3', 'm4')}), ',') AS union_34,
          array_to_string(list_sort({s_minus('e1', 'c3')}), ',') AS rest_1_3,
          {s_eq('e1', 'e2')} AS equal_12, {s_sub('c3', 'e1')} AS sub_31, {s_disj('c3', 'm4')} AS disjoint_34,
          {s_eq(s_minus('e1', 'c3'), 'm4')} AS is_difference_134, {s_jac('e1', 'e2')} AS jaccard_12,
          (len(e1) = 0 AND len(m4) = 0) AS both_empty_14,
          ({s_eq('e1', s_union('c3', 'm4'))} AND {s_disj('c3', 'm4')}) AS partition_134
        FROM slots"""


def _algebra(slots):
    e1, e2, c3, m4 = (F.col(c) for c in ("e1", "e2", "c3", "m4"))
    return slots.select(
        *ans.GROUP_KEYS,
        F.array_join(F.array_sort(sets.union(c3, m4)), ",").alias("union_34"),
        F.array_join(F.array_sort(sets.difference(e1, c3)), ",").alias("rest_1_3"),
        sets.equal(e1, e2).alias("equal_12"), sets.is_subset(c3, e1).alias("sub_31"),
        sets.disjoint(c3, m4).alias("disjoint_34"), sets.is_difference(e1, c3, m4).alias("is_difference_134"),
        round4(sets.jaccard(e1, e2)).alias("jaccard_12"), sets.both_empty(e1, m4).alias("both_empty_14"),
        sets.partitions(e1, c3, m4).alias("partition_134"),
    )


@query("set_algebra", with_ctes([LINES, ELEMENTS, ANSWERS, SLOTS], _ALGEBRA))
def set_algebra(spark, root):
    return _algebra(ans.answer_slots(tables.answers(spark, root)))


@query("set_algebra_of_wide_sets", with_ctes([WIDE_LINES, ELEMENTS, ANSWERS, SLOTS], _ALGEBRA))
def set_algebra_of_wide_sets(spark, root):
    """Sets of many elements each, in no order."""
    return _algebra(ans.answer_slots(tables.wide_answers(spark, root)))


@query("idk_flags", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    f"""SELECT q_id, q_serie, action, task, dataset, llm,
          {flag("len(answer) = 0 OR list_contains(answer, 'idk')")} AS idk_any,
          {flag("len(answer) = 0 OR answer = ['idk']")} AS idk_only FROM answers""",
))
def idk_flags(spark, root):
    return tables.answers(spark, root).select(
        *ans.ANSWER_KEYS, idk_any(F.col("answer")).alias("idk_any"), idk_only(F.col("answer")).alias("idk_only")
    )


# -- analysis --------------------------------------------------------------------------------

_ANALYSIS_OUT = ["q_id", "action", "dataset", "llm", *METRICS]


@query("analysis", with_ctes(FROM_LINES, f"SELECT {', '.join(_ANALYSIS_OUT)} FROM analysis"))
def analysis(spark, root):
    """Element form over all order lines."""
    return line_analysis(spark, root).select(*_ANALYSIS_OUT)


@query("analysis_from_arrays", with_ctes(FROM_ANSWERS, f"SELECT {', '.join(_ANALYSIS_OUT)} FROM analysis"))
def analysis_from_arrays(spark, root):
    return an.analyse(tables.answers(spark, root)).select(*_ANALYSIS_OUT)


@query("analysis_from_elements", with_ctes(FROM_ANSWERS, f"SELECT {', '.join(_ANALYSIS_OUT)} FROM analysis"))
def analysis_from_elements(spark, root):
    return an.analyse_elements(tables.answer_elements(spark, root)).select(*_ANALYSIS_OUT)


FROM_WIDE = [WIDE_LINES, ELEMENTS, ANSWERS, SLOTS, STARRED, roles_cte("starred"), ANALYSIS]


@query("analysis_of_wide_sets", with_ctes(FROM_WIDE, f"SELECT {', '.join(_ANALYSIS_OUT)} FROM analysis"))
def analysis_of_wide_sets(spark, root):
    """Array form over sets of many elements."""
    return an.analyse(tables.wide_answers(spark, root)).select(*_ANALYSIS_OUT)


@query("analysis_of_wide_elements", with_ctes(FROM_WIDE, f"SELECT {', '.join(_ANALYSIS_OUT)} FROM analysis"))
def analysis_of_wide_elements(spark, root):
    """Element form over sets of many elements, from files: every answer is also there under a later path, in part."""
    rows = tables.answer_elements(spark, root, tables.WIDE).withColumn(
        "file_path", F.concat_ws("/", F.lit("/a"), "action", "dataset", "task", "q_serie", "llm")
    )
    later = rows.filter("length(element) > 3").withColumn("file_path", F.concat(F.lit("/b"), "file_path"))
    return an.analyse_elements(rows.unionByName(later)).select(*_ANALYSIS_OUT)


@query("repeat_consistency", with_ctes(
    FROM_LINES,
    """SELECT dataset, llm, action, CAST(sum(eq_a1_s) AS BIGINT) AS same_s, CAST(sum(eq_a1_p) AS BIGINT) AS same_p,
         CAST(sum(eq_s_p) AS BIGINT) AS same_sp, count(eq_a1_s) AS n_s, count(eq_a1_p) AS n_p,
         CAST(sum(CAST(round(jac_a1_s * 10000) AS BIGINT)) AS BIGINT) AS jac_s_10k
       FROM analysis GROUP BY dataset, llm, action""",
))
def repeat_consistency(spark, root):
    return line_analysis(spark, root).groupBy("dataset", "llm", "action").agg(
        F.sum("eq_a1_s").alias("same_s"), F.sum("eq_a1_p").alias("same_p"), F.sum("eq_s_p").alias("same_sp"),
        F.count("eq_a1_s").alias("n_s"), F.count("eq_a1_p").alias("n_p"),
        rollup.exact_sum("jac_a1_s").alias("jac_s_10k"),
    )


# -- summary ---------------------------------------------------------------------------------

_SUMMARY_OUT = ["dataset", "action", "llm", "n", *_SUMMED, "eq_a1_ave", "jac_a1_ave", "idk"]


@query("summary", with_ctes(SUMMARY_CTES, f"SELECT {', '.join(_SUMMARY_OUT)} FROM summary"))
def summary(spark, root):
    return rollup.summarise(line_analysis(spark, root)).select(*_SUMMARY_OUT)


@query("overall_blend", with_ctes(
    SUMMARY_CTES, "SELECT llm, action, eq_a1_s, jac_a1_s, eq_a1_ave, jac_a1_ave FROM summary WHERE dataset = 'overall'",
))
def overall_blend(spark, root):
    s = rollup.summarise(line_analysis(spark, root), ["eq_a1_s", "eq_a1_p", "eq_s_p", "jac_a1_s", "jac_a1_p", "jac_s_p"])
    return s.filter("dataset = 'overall'").select("llm", "action", "eq_a1_s", "jac_a1_s", "eq_a1_ave", "jac_a1_ave")


# -- relation labels joined to the analysis ---------------------------------------------------

_PHRASES = "phrases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {'NULL' if p is None else chr(39) + p + chr(39)}, '{c}')" for i, (p, c) in enumerate(tables.PHRASES)
) + ") AS v(i, phrase, canonical))"
_PAIRS = """pairs AS (
  SELECT DISTINCT o_custkey, CAST(o_custkey AS VARCHAR) AS q_id, c_mktsegment AS dataset, o_orderpriority AS llm
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _labels_cte(name: str, shift: int, column: str, keep: list[str]) -> str:
    picks = ", ".join(
        f"(SELECT {column} FROM phrases WHERE i = (o_custkey + length(llm) + {3 * k + shift}) % 20) AS {c}"
        if c in keep else f"CAST(NULL AS VARCHAR) AS {c}"
        for k, c in enumerate(tables.RELATION_COLUMNS)
    )
    return f"{name} AS (SELECT q_id, dataset, llm, {picks} FROM pairs)"


LABELLED_CTES = [
    *FROM_LINES, _PHRASES, _PAIRS,
    _labels_cte("zs_labels", 0, "phrase", tables.RELATION_COLUMNS),
    _labels_cte("cl_labels", 5, "canonical", ["r_12", "r_13", "r_134"]),
    """labelled AS (
  SELECT a.*, r.* EXCLUDE (q_id, dataset, llm, action) FROM analysis a LEFT JOIN (
    SELECT *, 'zero-shot' AS action FROM zs_labels UNION ALL SELECT *, 'classification' FROM cl_labels) r
  USING (q_id, dataset, llm, action))""",
    "contradicted AS (SELECT *, " + ", ".join(
        f"CASE WHEN {r} IS NOT NULL AND lower({r}) <> 'none' THEN "
        f"{flag(f'coalesce({f}, 0) = CASE WHEN {r} = {chr(39)}{t}{chr(39)} THEN 1 ELSE 0 END')} END AS {n}"
        for n, f, r, t in rel.CONTRADICTION_SPEC
    ) + " FROM labelled)",
]


def labelled_analysis(spark, root):
    zero_shot = tables.order_relations(spark, root)
    classified = rel.normalise_relations(
        tables.order_relations(spark, root, 5), ["r_12", "r_13", "r_134"], in_place=True
    ).drop("r_14", "r_34")
    return rel.merge_relations_by_action(line_analysis(spark, root), zero_shot, classified)


_LABELLED_OUT = ["q_id", "action", "dataset", "llm", *tables.RELATION_COLUMNS, *names.CONTRADICTIONS]


@query("relations_by_action", with_ctes(LABELLED_CTES, f"SELECT {', '.join(_LABELLED_OUT)} FROM contradicted"))
def relations_by_action(spark, root):
    return labelled_analysis(spark, root).select(*_LABELLED_OUT)


@query("contradiction_summary", with_ctes(
    [*LABELLED_CTES, levels_cte("levels", "contradicted"), means_cte({c: c for c in names.CONTRADICTIONS}, "levels")],
    "SELECT dataset, action, llm, n, " + ", ".join(f"{mean4(f'{m}_t', f'{m}_n')} AS {m}" for m in names.CONTRADICTIONS)
    + " FROM means",
))
def contradiction_summary(spark, root):
    s = rollup.summarise(labelled_analysis(spark, root), names.CONTRADICTIONS)
    return s.select("dataset", "action", "llm", "n", *names.CONTRADICTIONS)


_STRATA = [
    (m, side, f"{r} {op} '{names.TRUE_LABELS[r]}'")
    for r, ms in rollup.STRATA.items() for m in ms if m in METRICS for side, op in (("pos", "="), ("neg", "<>"))
]
_STRATA_SQL = ", ".join(
    f"sum({scaled(m)}) FILTER (WHERE {cond}) / (nullif(count({m}) FILTER (WHERE {cond}), 0) * 10000.0::DOUBLE) AS {m}_{side}"
    for m, side, cond in _STRATA
)
_STRATA_OUT = [f"{m}_{side}" for m, side, _ in _STRATA]


@query("stratified_means", with_ctes(
    [*LABELLED_CTES, levels_cte("levels", "labelled")],
    f"SELECT dataset, action, llm, {_STRATA_SQL} FROM levels WHERE action IN ('zero-shot', 'classification') "
    "GROUP BY dataset, action, llm",
))
def stratified_means(spark, root):
    return rollup.stratified_means(labelled_analysis(spark, root)).select("dataset", "action", "llm", *_STRATA_OUT)


@query("summary_with_strata", with_ctes(
    [*LABELLED_CTES, levels_cte("levels", "labelled"), means_cte({"eq_a1_a2": "eq_a1_a2"}, "levels"),
     f"""strata AS (SELECT dataset, action, llm, {_STRATA_SQL} FROM levels
       WHERE action IN ('zero-shot', 'classification') GROUP BY dataset, action, llm)"""],
    f"""SELECT dataset, action, llm, n, {mean4('eq_a1_a2_t', 'eq_a1_a2_n')} AS eq_a1_a2, {', '.join(_STRATA_OUT)}
        FROM means LEFT JOIN strata USING (dataset, action, llm)""",
))
def summary_with_strata(spark, root):
    """Rows of other actions keep NULL in the stratified columns; the analysis is computed and laid out once."""
    labelled = laid_out(labelled_analysis(spark, root), "labelled", ["dataset", "q_id"])
    s = rollup.add_stratified_means(rollup.summarise(labelled, ["eq_a1_a2"]), labelled)
    return s.select("dataset", "action", "llm", "n", "eq_a1_a2", *_STRATA_OUT)


# -- significance ----------------------------------------------------------------------------

TESTED = names.TESTED
_PAIRED = "paired AS (SELECT z.dataset, z.llm, a.action, " + ", ".join(
    f"count(*) FILTER (WHERE a.{f} = 1 AND z.{f} = 0) AS n10_{f}, count(*) FILTER (WHERE a.{f} = 0 AND z.{f} = 1) AS n01_{f}"
    for f in TESTED
) + """ FROM (SELECT *, dataset AS d FROM analysis WHERE action = 'zero-shot') z
  JOIN analysis a ON a.q_id = z.q_id AND a.dataset = z.dataset AND a.llm = z.llm GROUP BY z.dataset, z.llm, a.action)"""
_PAIRED_ALL = "paired_all AS (SELECT * FROM paired UNION ALL SELECT 'overall', llm, action, " + ", ".join(
    f"CAST(sum({n}_{f}) AS BIGINT)" for f in TESTED for n in ("n10", "n01")
) + " FROM paired GROUP BY llm, action)"
PVALUE_CTES = [*FROM_LINES, _PAIRED, _PAIRED_ALL]


@query("paired_counts", with_ctes(PVALUE_CTES, "SELECT * FROM paired_all"))
def paired_counts(spark, root):
    return significance.paired_counts(line_analysis(spark, root), tables.ACTIONS)


@query("action_p_values", with_ctes(
    PVALUE_CTES,
    "SELECT dataset, llm, action, "
    + ", ".join(f"round_even(round({mcnemar_sql(f'n10_{f}', f'n01_{f}')}, 12), 4) AS p_{f}" for f in TESTED) + " FROM paired_all",
))
def action_p_values(spark, root):
    return significance.action_p_values(line_analysis(spark, root), tables.ACTIONS)


@query("action_p_values_two_sided", with_ctes(
    PVALUE_CTES,
    "SELECT dataset, llm, action, "
    + ", ".join(f"round_even(round({mcnemar2_sql(f'n10_{f}', f'n01_{f}')}, 12), 6) AS p_{f}" for f in TESTED) + " FROM paired_all",
))
def action_p_values_two_sided(spark, root):
    p = significance.action_p_values(line_analysis(spark, root), tables.ACTIONS, two_sided=True)
    return p.select("dataset", "llm", "action", *[round4(F.round(F.col(f"p_{f}"), 12), 6).alias(f"p_{f}") for f in TESTED])


@query("summary_with_p_values", with_ctes(
    [*PVALUE_CTES, levels_cte("levels", "analysis"), means_cte({"eq_a1_a2": "eq_a1_a2"}, "levels")],
    f"""SELECT m.dataset, m.action, m.llm, n, {mean4('eq_a1_a2_t', 'eq_a1_a2_n')} AS eq_a1_a2,
          round_even(round({mcnemar_sql('n10_eq_a1_a2', 'n01_eq_a1_a2')}, 12), 4) AS p_eq_a1_a2
        FROM means m LEFT JOIN paired_all p USING (dataset, action, llm)""",
))
def summary_with_p_values(spark, root):
    a = laid_out(line_analysis(spark, root), "analysis", ["dataset", "q_id"])
    s = rollup.summarise(a, ["eq_a1_a2"])
    p = significance.action_p_values(a, tables.ACTIONS, tested=["eq_a1_a2"])
    return rollup.add_p_values(s, p).select("dataset", "action", "llm", "n", "eq_a1_a2", "p_eq_a1_a2")


@query("paired_label_test", f"""
WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n10,
             count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS n01
           FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n10, n01, round_even({mcnemar_sql('n10', 'n01')}, 10) AS p_one_sided,
  round_even({mcnemar2_sql('n10', 'n01')}, 10) AS p_two_sided FROM c""")
def paired_label_test(spark, root):
    docs = tables.load(spark, root, "documents").select("doc_id", "lang")
    joined = tables.load(spark, root, "labels").join(docs, "doc_id")
    one = significance.pair_test(joined, "quality", "toxic", ["lang"])
    from accordant.functions.stats import mcnemar_two_sided

    return one.select(
        "lang", "n10", "n01", round4(F.col("p"), 10).alias("p_one_sided"),
        round4(mcnemar_two_sided(F.col("n10"), F.col("n01")), 10).alias("p_two_sided"),
    )


_GRID = "SELECT unnest(['" + "', '".join(tables.PRIORITIES) + "'])"
_UNPIVOTED = (
    "tested AS (" + " UNION ALL ".join(
        f"SELECT action, dataset, q_id, llm, '{f}' AS predicate, {f} AS v FROM analysis" for f in TESTED
    ) + ")"
)


def _matrix_ctes(overall_join: str) -> list[str]:
    count = (
        "count(*) FILTER (WHERE i.v = 1 AND j.v = 0) AS n10, count(*) FILTER (WHERE i.v = 0 AND j.v = 1) AS n01"
    )
    return [
        *FROM_LINES, _UNPIVOTED, f"models(llm) AS ({_GRID})",
        f"""found AS (
  SELECT i.action, i.dataset, i.predicate, i.llm AS llm_i, j.llm AS llm_j, {count}
  FROM tested i JOIN tested j ON i.action = j.action AND i.predicate = j.predicate AND i.q_id = j.q_id
    AND i.dataset = j.dataset AND i.llm <> j.llm GROUP BY ALL
  UNION ALL
  SELECT i.action, 'overall', i.predicate, i.llm, j.llm, {count}
  FROM tested i JOIN tested j ON i.action = j.action AND i.predicate = j.predicate AND i.q_id = j.q_id
    {overall_join} AND i.llm <> j.llm GROUP BY ALL)""",
        """grid AS (
  SELECT action, dataset, predicate, mi.llm AS llm_i, mj.llm AS llm_j
  FROM (SELECT DISTINCT action, dataset, predicate FROM tested
        UNION SELECT DISTINCT action, 'overall', predicate FROM tested), models mi, models mj)""",
        """matrix AS (
  SELECT g.*, coalesce(n10, 0) AS n10, coalesce(n01, 0) AS n01 FROM grid g
  LEFT JOIN found f USING (action, dataset, predicate, llm_i, llm_j))""",
        f"""p_matrix AS (SELECT *, CASE WHEN llm_i = llm_j THEN 1.0::DOUBLE
    ELSE round_even(round({mcnemar_sql('n10', 'n01')}, 12), 4) END AS p FROM matrix)""",
    ]


MATRIX_CTES = _matrix_ctes("AND i.dataset = j.dataset")
_MATRIX_OUT = "SELECT action, dataset, predicate, llm_i, llm_j, n10, n01, p FROM p_matrix"


def line_matrix(spark, root, **kw):
    return significance.pairwise_p_values(line_analysis(spark, root), tables.PRIORITIES, tables.ACTIONS, **kw)


@query("pairwise_p_values", with_ctes(MATRIX_CTES, _MATRIX_OUT))
def pairwise_p_values(spark, root):
    return line_matrix(spark, root)


@query("pairwise_p_values_pooled_ids", with_ctes(_matrix_ctes(""), _MATRIX_OUT))
def pairwise_p_values_pooled_ids(spark, root):
    """The overall level pairs rows on the question id alone."""
    return line_matrix(spark, root, pool_by_id=True)


# -- per-question scores ---------------------------------------------------------------------

_ONE = {"q1": ("Q1", "equal"), "q2": ("Q2", "equal"), "q3": ("Q3", "sup-sub"), "q4": ("Q4", "minus")}


def _aligned(driving: str, others: list[str]) -> str:
    def side(s):
        serie, task = _ONE[s]
        return f"(SELECT dataset, action, llm, q_id, answer FROM answers WHERE q_serie = '{serie}' AND task = '{task}')"

    joins = " ".join(f"LEFT JOIN {side(o)} {o} USING (dataset, action, llm, q_id)" for o in others)
    cols = ", ".join([f"{driving}.answer AS {driving}"] + [f"coalesce({o}.answer, []::VARCHAR[]) AS {o}" for o in others])
    return f"aligned AS (SELECT dataset, action, llm, q_id, {cols} FROM {side(driving)} {driving} {joins})"


def _scores_sql(task: str, driving: str, others: list[str], left: str, right: str, empty: str, equal: str, apart: str) -> str:
    return with_ctes(
        [LINES, ELEMENTS, ANSWERS, _aligned(driving, others)],
        f"""SELECT dataset, action, llm, q_id, '{task}' AS task, {s_jac(left, right)} AS jaccard, {flag(empty)} AS is_empty,
              {flag(equal)} AS binary_equal, {flag(apart)} AS parts_disjoint FROM aligned""",
    )


def _scored(spark, root, task):
    s = scores.question_scores(tables.answers(spark, root), task)
    return s.withColumn("jaccard", round4(F.col("jaccard")))


@query("question_scores_equal", _scores_sql(
    "equal", "q1", ["q2"], "q1", "q2", "len(q1) = 0 AND len(q2) = 0", s_eq("q1", "q2"), "false",
))
def question_scores_equal(spark, root):
    return _scored(spark, root, "equal")


@query("question_scores_containment", _scores_sql(
    "sup-sub", "q1", ["q3", "q4"], "q1", s_union("q3", "q4"), "len(q1) = 0 AND len(q3) = 0", s_sub("q3", "q1"),
    s_disj("q3", "q4"),
))
def question_scores_containment(spark, root):
    return _scored(spark, root, "sup-sub")


@query("question_scores_difference", _scores_sql(
    "minus", "q4", ["q1", "q3"], "q4", s_minus("q1", "q3"), f"len(q4) = 0 AND len({s_minus('q1', 'q3')}) = 0",
    s_eq("q4", s_minus("q1", "q3")), "false",
))
def question_scores_difference(spark, root):
    return _scored(spark, root, "minus")


# -- follow-ups ------------------------------------------------------------------------------


@query("follow_up_equal", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS],
    f"""SELECT q_id, action, dataset, llm, (len(e2) = 0) AS second_empty FROM slots
        WHERE NOT {s_eq('e1', 'e2')} OR (len(e1) = 0 AND len(e2) = 0)""",
))
def follow_up_equal(spark, root):
    slots = ans.answer_slots(tables.answers(spark, root))
    need = workqueue.needs_equal_follow_up(F.col("e1"), F.col("e2"))
    return slots.filter(need).select(*ans.GROUP_KEYS, (F.size("e2") == 0).alias("second_empty"))


@query("follow_up_containment", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS],
    f"SELECT q_id, action, dataset, llm FROM slots WHERE NOT {s_sub('c3', 'e1')} OR len(c3) = 0",
))
def follow_up_containment(spark, root):
    slots = ans.answer_slots(tables.answers(spark, root))
    return slots.filter(workqueue.needs_containment_follow_up(F.col("e1"), F.col("c3"))).select(*ans.GROUP_KEYS)


@query("follow_up_difference", with_ctes(
    [LINES, ELEMENTS, ANSWERS, SLOTS],
    f"""SELECT q_id, action, dataset, llm, NOT {s_eq(s_minus('e1', 'c3'), 'm4')} AS differs FROM slots
        WHERE NOT {s_eq(s_minus('e1', 'c3'), 'm4')} OR len(m4) = 0""",
))
def follow_up_difference(spark, root):
    slots = ans.answer_slots(tables.answers(spark, root))
    e1, c3, m4 = F.col("e1"), F.col("c3"), F.col("m4")
    need = workqueue.needs_difference_follow_up(e1, c3, m4, ask_if_empty=True)
    return slots.filter(need).select(
        *ans.GROUP_KEYS, workqueue.needs_difference_follow_up(e1, c3, m4).alias("differs")
    )
