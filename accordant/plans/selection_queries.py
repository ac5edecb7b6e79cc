"""Row and column selection, pending work, significance cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import names
from accordant.functions import numbers
from accordant.operators import filters, rollup, significance, workqueue
from accordant.plans.answer_queries import (
    ANSWERS, ELEMENTS, LINES, MATRIX_CTES, PVALUE_CTES, SUMMARY_CTES, line_analysis, line_matrix, mcnemar_sql,
)
from accordant.plans.catalog import query, with_ctes
from accordant.sources import paths, readers, tables

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]

_PATHS = """files AS (
  SELECT o_orderkey, c_mktsegment, o_orderpriority,
    CASE o_orderkey % 3 WHEN 0 THEN 'equal' WHEN 1 THEN 'sup-sub' ELSE 'minus' END AS task,
    CASE o_orderkey % 4 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'fixing' WHEN 2 THEN 'star' END AS act,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Relation' ELSE 'Q' || CAST(o_orderkey % 4 + 1 AS VARCHAR) END AS head
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _path_files(spark, root):
    o = tables.load(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = tables.load(spark, root, "customer").select("c_custkey", "c_mktsegment")
    task = F.when(F.col("o_orderkey") % 3 == 0, "equal").when(F.col("o_orderkey") % 3 == 1, "sup-sub").otherwise("minus")
    act = (
        F.when(F.col("o_orderkey") % 4 == 0, "wikidata_").when(F.col("o_orderkey") % 4 == 1, "fixing_")
        .when(F.col("o_orderkey") % 4 == 2, "star_").otherwise("")
    )
    head = F.when(F.col("o_orderkey") % 11 == 0, "Relation").otherwise(
        F.concat(F.lit("Q"), (F.col("o_orderkey") % 4 + 1).cast("string"))
    )
    path = F.concat(
        F.lit("/data/answers/some_dir/"), F.col("c_mktsegment"), F.lit("/"), task, F.lit("/"), head, F.lit("_"), task,
        F.lit("_answers_"), act, F.col("o_orderpriority"), F.lit(".json"),
    )
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", path.alias("file_path"))


@query("path_keys", with_ctes(
    [_PATHS],
    f"""SELECT o_orderkey, head AS q_serie, coalesce(act, 'zero-shot') AS action, task, c_mktsegment AS dataset,
          o_orderpriority AS llm FROM files
        WHERE head <> 'Relation' AND c_mktsegment IN ({', '.join(f"'{s}'" for s in _SEGMENTS)})""",
))
def path_keys(spark, root):
    """Keys of answer files from their paths; files with an unknown key are dropped."""
    files = _path_files(spark, root).filter(paths.file_name(F.col("file_path")).startswith("Q"))
    vocabularies = {
        "q_serie": names.SERIES, "action": names.ACTIONS, "task": names.TASKS, "dataset": _SEGMENTS, "llm": tables.PRIORITIES,
    }
    k = paths.path_keys(F.col("file_path"), vocabularies, list(vocabularies), {"action": "zero-shot"})
    return files.select("o_orderkey", k.alias("k")).filter(F.col("k").isNotNull()).select("o_orderkey", "k.*")


@query("file_name_keys", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'equal' ELSE 'sup-sub' END AS task, c_mktsegment AS model,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'fixing' END AS action FROM customer""")
def file_name_keys(spark, root):
    c = tables.load(spark, root, "customer")
    name = F.concat(
        F.when(F.col("c_nationkey") % 2 == 0, "equal").otherwise("sup-sub"), F.lit("_"), F.col("c_mktsegment"), F.lit("_"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x_fixing"), F.lit(".tsv"),
    )
    return c.select("c_custkey", *[v.alias(k) for k, v in paths.name_parts(name).items()])


@query("kept_and_dropped_rows", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW', '3-MEDIUM')""")
def kept_and_dropped_rows(spark, root):
    o = tables.load(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return filters.drop_rows(filters.keep(o, o_orderstatus=["O", "F"]), o_orderpriority=["5-LOW", "3-MEDIUM"])


@query("predicate_values", with_ctes(
    SUMMARY_CTES, "SELECT dataset, action, llm, eq_a1_a34 AS value FROM summary WHERE dataset = 'overall' AND action <> 'fixing'",
))
def predicate_values(spark, root):
    s = rollup.summarise(line_analysis(spark, root), ["eq_a1_a34"])
    return filters.predicate_values(s, "eq_a1_a34", "overall", ["zero-shot", "classification"])


@query("aligned_columns", """
SELECT CAST(p_partkey AS VARCHAR) AS q_id, p_type AS dataset, CAST(NULL AS VARCHAR) AS r_14, CAST(NULL AS INTEGER) AS extra FROM part""")
def aligned_columns(spark, root):
    p = tables.part_relations(spark, root).drop("r_14")
    return filters.align_columns(p, {"q_id": "string", "dataset": "string", "r_14": "string", "extra": "int"})


@query("rows_without_sentinel", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS t FROM lineitem
WHERE l_quantity <> 1 AND (l_linenumber = 7 OR l_tax <> 0)""")
def rows_without_sentinel(spark, root):
    """Rows with -1 in a similarity column are dropped, rows with NULL stay."""
    li = tables.load(spark, root, "lineitem")
    marked = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 7, None).when(F.col("l_tax") == 0, -1.0).otherwise(F.col("l_tax")).alias("t"),
        F.when(F.col("l_quantity") == 1, -1.0).otherwise(F.col("l_quantity")).alias("q"),
    )
    return filters.without_sentinel(marked, ["t", "q"]).drop("q")


@query("columns_by_name", """
SELECT CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS p_size, count(p_retailprice) AS p_retailprice FROM part""")
def columns_by_name(spark, root):
    """Columns after p_type, and those with a prefix, are the ones that are aggregated."""
    p = tables.load(spark, root, "part")
    after = filters.columns_after(p, "p_type")
    retail = filters.columns_by_prefix(p, "p_retail")
    return p.agg(*[
        (F.count(c) if c in retail else F.sum(c)).alias(c) for c in after
    ])


@query("numeric_rows", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_partkey % 4 <> 0 AND p_size % 10 <> 0""")
def numeric_rows(spark, root):
    """Text that is no number becomes NULL and drops out; zero is no score."""
    p = tables.load(spark, root, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_size") % 10 == 0, "0.0").otherwise(
        F.col("p_size").cast("string")
    )
    v = p.select("p_partkey", numbers.to_number(raw).alias("v")).dropna(subset=["v"])
    return v.filter(numbers.truthy(F.col("v")))


# -- pending work ----------------------------------------------------------------------------


@query("id_range", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100 AND c_custkey < 700")
def id_range(spark, root):
    c = tables.load(spark, root, "customer").select("c_custkey", "c_name")
    return workqueue.id_range(c, 100, 700, "c_custkey")


@query("pending_questions", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    """SELECT c_custkey AS q_index, c_mktsegment AS dataset FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM answers WHERE q_id = CAST(c_custkey AS VARCHAR) AND action = 'fixing'
         AND q_serie = 'Q3' AND task = 'minus' AND llm = '5-LOW' AND len(answer) > 0)""",
))
def pending_questions(spark, root):
    q = tables.questions(spark, root).select("q_index", "dataset", F.col("q_index").cast("string").alias("q_id"))
    a = filters.keep(tables.answers(spark, root), action="fixing", q_serie="Q3", task="minus", llm="5-LOW")
    return workqueue.pending(q, a, ["q_id", "dataset"]).drop("q_id")


@query("pending_in_any_series", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    """SELECT q_index, dataset, llm FROM (SELECT DISTINCT o_custkey AS q_index, c_mktsegment AS dataset, o_orderpriority AS llm
         FROM orders JOIN customer ON o_custkey = c_custkey) p
       WHERE (SELECT count(DISTINCT q_serie) FROM answers a WHERE a.q_id = CAST(p.q_index AS VARCHAR) AND a.llm = p.llm
         AND a.dataset = p.dataset AND action = 'fixing' AND task = 'minus' AND q_serie IN ('Q1', 'Q3', 'Q4')) < 3""",
))
def pending_in_any_series(spark, root):
    """A question is done only if all three outputs of the task hold it."""
    r = tables.order_relations(spark, root).select("q_id", "dataset", "llm")
    a = filters.keep(tables.answers(spark, root), action="fixing", task="minus")
    left = workqueue.pending_in_any(r, a, ["q_id", "dataset", "llm"], ["Q1", "Q3", "Q4"])
    return left.select(F.col("q_id").cast("long").alias("q_index"), "dataset", "llm")


# -- significance cells ----------------------------------------------------------------------

_P = " UNION ALL ".join(
    f"SELECT dataset, llm, action, '{f}' AS flag, round_even(round({mcnemar_sql(f'n10_{f}', f'n01_{f}')}, 12), 4) AS p FROM paired_all"
    for f in names.TESTED
)


@query("p_value_cells", with_ctes(
    [*PVALUE_CTES, f"p AS ({_P})"],
    """SELECT dataset, llm, action, flag, CASE WHEN p > 0.05 THEN '' WHEN p <= 0.001 THEN '≈0' ELSE printf('%.3f', p) END AS cell,
         p > 0.05 AS hidden, CASE WHEN 1 - p > 0.95 OR 1 - p <= 0.5 THEN '' ELSE printf('%.3f', 1 - p) END AS confidence,
         1 - p < 0.95 AS low FROM p""",
))
def p_value_cells(spark, root):
    """Cells of all tested flags."""
    p = significance.action_p_values(line_analysis(spark, root), tables.ACTIONS)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"p_{f}").alias("p")) for f in names.TESTED])).alias("c")
    p = p.select("dataset", "llm", "action", cells).select("dataset", "llm", "action", "c.*")
    v = F.col("p")
    conf = numbers.one_minus(v)
    return p.select(
        "dataset", "llm", "action", "flag", numbers.p_label(v).alias("cell"), numbers.p_hidden(v).alias("hidden"),
        numbers.confidence_label(conf, 0.95, 0.5).alias("confidence"), numbers.confidence_hidden(conf, 0.95).alias("low"),
    )


@query("significant_groups", with_ctes(
    MATRIX_CTES,
    """SELECT action, dataset, predicate, llm_i, llm_j, p FROM p_matrix
       QUALIFY min(p) OVER (PARTITION BY action, dataset, predicate) <= 0.05""",
))
def significant_groups(spark, root):
    m = line_matrix(spark, root)
    return filters.groups_with_signal(m, ["action", "dataset", "predicate"], ["p"]).drop("n10", "n01")


@query("groups_with_values", """
SELECT o_custkey, o_orderkey FROM orders o WHERE EXISTS (
  SELECT 1 FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderstatus = 'P')""")
def groups_with_values(spark, root):
    """Groups in which every value is missing drop out."""
    o = tables.load(spark, root, "orders")
    v = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("v"))
    return filters.groups_with_values(v, ["o_custkey"], ["v"]).drop("v")


@query("answers_of_documents", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    "SELECT q_id, q_serie, action, task, dataset, llm, array_to_string(answer, ',') AS answer FROM answers",
))
def answers_of_documents(spark, root):
    """Answers packed into JSON documents of 100 ids and parsed back."""
    from accordant.sources.writers import answer_documents

    docs = answer_documents(tables.answers(spark, root), ids_per_file=100, dealt=True)
    path = F.concat_ws("/", F.lit("/data/answers"), "action", "dataset", "task", F.concat_ws("_", "q_serie", "task", "llm", "n_ids"))
    packed = docs.select(F.concat(path, F.lit(".json")).alias("file_path"), "value")
    segments = [*_SEGMENTS, "MACHINERY"]
    back = readers.parse_answers(packed, tables.PRIORITIES, datasets=segments)
    return back.select(
        "q_id", "q_serie", "action", "task", "dataset", "llm", F.array_join(F.array_sort("answer"), ",").alias("answer")
    )
