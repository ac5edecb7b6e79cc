"""Round trips through files: Spark writes what it derives from the tables and reads it back.

Files go to fresh folders below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import reshape, rollup, scores, significance
from accordant.operators import relations as rel
from accordant.operators.ordering import in_file_order
from accordant.plans.answer_queries import (
    _PHRASES, _SUMMARY_OUT, ANSWERS, ELEMENTS, FROM_LINES, LINES, MATRIX_CTES, SUMMARY_CTES, _PAIRS, _labels_cte, line_analysis,
    line_matrix, mean4,
)
from accordant.plans import label_queries  # noqa: F401  (its SQL is used below)
from accordant.plans.catalog import SQL, query, with_ctes
from accordant.plans.result_queries import MODELS
from accordant.session import laid_out, scratch_path
from accordant.sources import readers, tables, writers
from accordant.sources.named_files import write_answer_files
from accordant.streaming import summary_store

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
P = tables.PRIORITIES


@query("question_files", """
SELECT dataset, lang, "Q1", "Q2", "Q3", "Q4", CAST(row_number() OVER (PARTITION BY dataset, lang ORDER BY c_custkey) - 1 AS BIGINT) AS q_index
FROM (SELECT c_custkey, c_mktsegment AS dataset, CASE WHEN c_custkey % 3 = 0 THEN 'es' ELSE 'en' END AS lang, c_name AS "Q1",
  'say "' || c_name || '"' AS "Q2", c_mktsegment AS "Q3", CASE WHEN c_nationkey = 3 THEN NULL ELSE 'x' END AS "Q4" FROM customer)
WHERE dataset <> 'MACHINERY'""")
def question_files(spark, root):
    """Question TSVs of two languages, one file per dataset, read with their row positions."""
    path = scratch_path(spark, "questions")
    rows = tables.load(spark, root, "customer").select(
        "c_custkey", F.col("c_name").alias("Q1"), F.concat(F.lit('say "'), "c_name", F.lit('"')).alias("Q2"),
        F.col("c_mktsegment").alias("Q3"), F.when(F.col("c_nationkey") != 3, "x").alias("Q4"),
        F.when(F.col("c_custkey") % 3 == 0, "es").otherwise("en").alias("lang"), F.col("c_mktsegment").alias("dataset"),
    )
    # A file's rows come together in one task and in order, so that their positions are known.
    rows.repartition("lang", "dataset").sortWithinPartitions("lang", "dataset", "c_custkey").drop("c_custkey").write.partitionBy(
        "lang", "dataset"
    ).option("header", "true").option("sep", "\t").option("escape", '"').csv(path)
    datasets = [d for d in SEGMENTS if d != "MACHINERY"]
    back = readers.read_questions(spark, path, datasets, ["en", "es"], glob="*.csv")
    return back.select("dataset", "lang", "Q1", "Q2", "Q3", "Q4", "q_index")


@query("question_texts_files", """
SELECT 'd' || doc_id // 10000 AS dataset, 'en' AS lang, "text" AS "Q1", 'say "' || source || '"' || chr(10) || lang AS "Q2",
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE chr(9) || lang || ' ' END AS "Q3", source AS "Q4",
  CAST(row_number() OVER (PARTITION BY doc_id // 10000 ORDER BY doc_id) - 1 AS BIGINT) AS q_index FROM documents""")
def question_texts_files(spark, root):
    """Question TSVs whose texts are whole documents, with line ends, quotes and separators in them."""
    path = scratch_path(spark, "question-texts")
    dataset = F.concat(F.lit("d"), F.expr("doc_id div 10000"))
    rows = tables.load(spark, root, "documents").select(
        "doc_id", F.col("text").alias("Q1"), F.concat(F.lit('say "'), "source", F.lit('"\n'), "lang").alias("Q2"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("\t"), "lang", F.lit(" "))).alias("Q3"), F.col("source").alias("Q4"),
        F.lit("en").alias("lang"), dataset.alias("dataset"),
    )
    # A file's 10,000 rows come together in one task and in order, so that their positions are known.
    rows.repartition("dataset").sortWithinPartitions("dataset", "doc_id").drop("doc_id").write.partitionBy("lang", "dataset").options(
        header="true", sep="\t", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
    back = readers.read_questions(spark, path, glob="*.csv")
    return back.select("dataset", "lang", "Q1", "Q2", "Q3", "Q4", "q_index")


@query("answer_files", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    "SELECT q_id, q_serie, action, task, dataset, CAST(NULL AS VARCHAR) AS lang, llm, array_to_string(answer, ',') AS answer FROM answers",
))
def answer_files(spark, root):
    """Answer documents in a directory tree, scanned by path keys."""
    path = scratch_path(spark, "answers")
    writers.write_answer_documents(tables.answers(spark, root), path, ids_per_file=500, dealt=True)
    back = readers.read_answer_documents(spark, path, P, datasets=SEGMENTS)
    return back.select(
        "q_id", "q_serie", "action", "task", "dataset", "lang", "llm",
        F.array_join(F.array_sort("answer"), ",").alias("answer"),
    )


@query("named_answer_files", SQL["answer_files"])
def named_answer_files(spark, root):
    """One JSON file per key under the names that readers expect, each read back by several tasks."""
    path = scratch_path(spark, "named-answers")
    write_answer_files(tables.answers(spark, root), path, dealt=True)
    back = readers.read_answers(spark, path, P, in_parts=True, datasets=SEGMENTS)
    return back.select(
        "q_id", "q_serie", "action", "task", "dataset", "lang", "llm",
        F.array_join(F.array_sort("answer"), ",").alias("answer"),
    )


@query("answer_table", with_ctes(
    [LINES, ELEMENTS, ANSWERS],
    """SELECT q_id, llm, array_to_string(answer, ',') AS answer FROM answers
       WHERE action = 'fixing' AND dataset = 'BUILDING' AND task = 'minus' AND q_serie = 'Q4'""",
))
def answer_table(spark, root):
    """Native answer table; the filter prunes its directories."""
    path = scratch_path(spark, "answer-table")
    writers.write_answers(tables.answers(spark, root).drop("lang"), path)
    t = spark.read.parquet(path).filter(
        "action = 'fixing' AND dataset = 'BUILDING' AND task = 'minus' AND q_serie = 'Q4'"
    )
    return t.select("q_id", "llm", F.array_join("answer", ",").alias("answer"))


def _write_documents(rows, keys, value, path, name):
    """``{id: value}`` documents of at most 500 ids in directories named by ``keys``."""
    shard = F.floor(F.col("q_id").cast("long") / 500).alias("shard")
    docs = rows.groupBy(*keys, shard).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("q_id"), value)))).alias("value")
    )
    docs.withColumn("name", F.lit(name)).drop("shard").write.partitionBy("name", *keys).text(path)


@query("relation_files", with_ctes(
    [_PHRASES, _PAIRS, _labels_cte("found", 0, "phrase", tables.RELATION_COLUMNS)], "SELECT * FROM found",
))
def relation_files(spark, root):
    """Documents of five labels per question."""
    path = scratch_path(spark, "relations")
    _write_documents(
        tables.order_relations(spark, root), ["dataset", "llm"], F.array(*tables.RELATION_COLUMNS), path, "Relation"
    )
    back = readers.read_relations(spark, path, P, "*.txt", True, datasets=SEGMENTS, name_prefix="part")
    return back.drop("file_path")


@query("classification_files", with_ctes(
    [_PHRASES, _PAIRS, _labels_cte("found", 5, "canonical", ["r_12", "r_13", "r_134"])],
    "SELECT q_id, dataset, llm, r_12, r_13, r_134, 'classification' AS action FROM found",
))
def classification_files(spark, root):
    """One label document per task, plain strings or lists, merged to one row per question."""
    path = scratch_path(spark, "classification")
    r = tables.order_relations(spark, root, 5)
    cells = F.explode(F.array(
        F.struct(F.lit("equal").alias("task"), F.col("r_12").alias("label")),
        F.struct(F.lit("sup-sub").alias("task"), F.col("r_13").alias("label")),
        F.struct(F.lit("minus").alias("task"), F.col("r_134").alias("label")),
    )).alias("c")
    long = r.select("q_id", "dataset", "llm", cells).select("q_id", "dataset", "llm", "c.*")
    as_list = long.filter("task = 'minus'").withColumn("label", F.array(F.coalesce("label", F.lit("unknown"))))
    plain = long.filter("task <> 'minus'").withColumn("label", F.coalesce("label", F.lit("unknown")))
    _write_documents(as_list, ["dataset", "llm", "task"], F.col("label"), path + "/a", "Containment")
    _write_documents(plain, ["dataset", "llm", "task"], F.col("label"), path + "/b", "Containment")
    return readers.read_classified_relations(spark, path, P, "*.txt", True, datasets=SEGMENTS)


@query("score_files", """
SELECT c_mktsegment AS dataset, round_even(avg(CASE c_custkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END), 4) AS average_score,
  count(*) FILTER (WHERE c_custkey % 3 = 0) AS count_ones, count(*) AS size FROM customer GROUP BY c_mktsegment""")
def score_files(spark, root):
    """Score documents; a list value counts towards the size only."""
    path = scratch_path(spark, "scores")
    c = tables.load(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("q_id"), F.col("c_mktsegment").alias("dataset"),
        F.when(F.col("c_custkey") % 3 == 0, "1").when(F.col("c_custkey") % 3 == 1, "0.5").otherwise('["x"]').alias("raw"),
    )
    shard = F.floor(F.col("q_id").cast("long") / 500).alias("shard")
    docs = c.groupBy("dataset", shard).agg(F.concat(
        F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "q_id", F.lit('": '), "raw")), ", "), F.lit("}")
    ).alias("value"))
    docs.drop("shard").write.partitionBy("dataset").text(path)
    back = readers.parse_scores(readers.read_documents(spark, path, "*.txt", one_per_line=True))
    named = back.withColumn("dataset", F.regexp_extract("file_path", "dataset=([^/]+)/", 1))
    return scores.summarise_score_files(named, ["dataset"])


@query("score_table_files", with_ctes(
    FROM_LINES,
    f"""SELECT dataset AS task, llm AS model, action,
          {mean4('CAST(sum(CAST(round(jac_a1_a2 * 10000) AS BIGINT)) AS BIGINT)', 'count(*)')} AS average_all,
          {mean4('(10000 * count(*) FILTER (WHERE jac_a1_a2 = 0))', 'count(*)')} AS ratio_empty,
          {mean4('CAST(sum(CAST(round(jac_a1_a2 * 10000) AS BIGINT)) AS BIGINT)', 'count(*) FILTER (WHERE jac_a1_a2 <> 0)')} AS average_no_empty,
          {mean4('(10000 * count(*) FILTER (WHERE eq_a1_a2 = 1))', 'count(*)')} AS binary_rate,
          CAST(sum(disj_a3_a4) AS BIGINT) AS disjoint_count
        FROM analysis GROUP BY dataset, llm, action""",
))
def score_table_files(spark, root):
    """Per-question score TSVs; task, model and action come back from the file path."""
    path = scratch_path(spark, "score-tables")
    a = line_analysis(spark, root)
    rows = a.select(
        F.col("q_id").cast("int").alias("QuestionID"), F.col("jac_a1_a2").alias("JaccardSimilarity"),
        F.col("idk_a1").alias("IsEmptySet"), F.col("eq_a1_a2").alias("BinaryEqual"),
        F.col("disj_a3_a4").alias("B_Intersected_C_EmptyCount"),
        F.concat_ws("_", "dataset", "llm", F.lit(""), "action").alias("name"),
    )
    rows.write.partitionBy("name").option("header", "true").option("sep", "\t").csv(path)
    back = readers.read_score_tables(spark, path, "*.csv")
    keyed = back.select(
        *readers.SCORE_TABLE_SCHEMA.fieldNames(),
        *[v.alias(k) for k, v in readers.name_parts(F.regexp_extract("file_path", "name=([^/]+)/", 1)).items()],
    )
    return scores.summarise_score_tables(keyed)


@query("model_files", with_ctes([MODELS], "SELECT llm, id, score, release_date, company, size FROM model_rows"))
def model_files(spark, root):
    path = scratch_path(spark, "models")
    m = tables.models(spark, root)
    info = F.struct(F.col("id").alias("ID"), "score", "release_date", "company", "size")
    m.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("llm", info)))).alias("value")).write.text(path)
    return readers.parse_models(readers.read_documents(spark, path, "*.txt"))


@query("question_bank_files", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey ELSE 'no_uid_' || CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END END AS uid,
  c_name AS question, CASE WHEN c_nationkey < 12 THEN NULL ELSE 'select ' || c_custkey END AS sparql FROM customer""")
def question_bank_files(spark, root):
    """Documents that are a list (its first item has no question) or one item."""
    c = tables.load(spark, root, "customer")
    uid = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("u"), "c_custkey"))
    one = F.struct(uid.alias("uid"), F.col("c_name").alias("question"), F.concat(F.lit("select "), "c_custkey").alias("sparql"))
    pair = F.array(
        F.struct(F.lit("z").alias("uid"), F.lit(None).cast("string").alias("question")),
        F.struct(uid.alias("uid"), F.col("c_name").alias("question")),
    )
    path = scratch_path(spark, "bank")
    docs = c.select(F.when(F.col("c_nationkey") < 12, F.to_json(pair)).otherwise(F.to_json(one)).alias("value"))
    docs.write.text(path)
    return readers.read_question_bank(spark, path, "*.txt", True).drop("file_path")


@query("summary_files", with_ctes(SUMMARY_CTES, f"SELECT {', '.join(_SUMMARY_OUT)} FROM summary"))
def summary_files(spark, root):
    """CSV sink and typed scan under the symbol names of the result table."""
    from accordant.names import to_ascii, to_symbols

    out = to_symbols(rollup.summarise(line_analysis(spark, root)).select(*_SUMMARY_OUT))
    path = scratch_path(spark, "summary")
    writers.write_table(out, path, "csv")
    return to_ascii(readers.read_result_table(spark, path, out.schema))


@query("summary_of_batches", with_ctes(SUMMARY_CTES, f"SELECT {', '.join(_SUMMARY_OUT)} FROM summary"))
def summary_of_batches(spark, root):
    """The summary from a store of three batches, one of which comes twice."""
    analysis = laid_out(line_analysis(spark, root), "analysis", ["dataset", "q_id"])
    store = scratch_path(spark, "summary-store")
    for batch in (0, 1, 2, 1):
        summary_store.add_batch(analysis.filter(F.pmod(F.col("q_id").cast("long"), F.lit(3)) == batch), store, batch)
    return summary_store.read_summary(spark, store).select(*_SUMMARY_OUT)


@query("appended_files", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1""")
def appended_files(spark, root):
    """Two appends to one TSV folder; headers are not read as rows."""
    c = tables.load(spark, root, "customer")
    path = scratch_path(spark, "appended")
    writers.append_tsv(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), path)
    writers.append_tsv(c.filter("c_custkey % 2 = 1").select("c_custkey", F.col("c_mktsegment").alias("c_name")), path)
    return readers.read_result_table(spark, path, "c_custkey long, c_name string", sep="\t")


@query("action_files", with_ctes(
    [*SUMMARY_CTES, MODELS],
    f"""SELECT id AS "ID", {', '.join(_SUMMARY_OUT)} FROM summary JOIN model_rows USING (llm)
       WHERE dataset = 'overall' AND action IN ('zero-shot', 'classification', 'fixing')""",
))
def action_files(spark, root):
    """One CSV folder per action, with all metrics."""
    s = rollup.summarise(line_analysis(spark, root)).select(*_SUMMARY_OUT)
    path = scratch_path(spark, "by-action")
    writers.write_by_action(s, tables.models(spark, root), path)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields if f.name != "action"]
    return readers.read_result_table(spark, path, ", ".join(["ID int", *fields, "action string"]))


@query("heatmap_files", with_ctes(
    MATRIX_CTES,
    """SELECT predicate, CAST(left(llm_i, 1) AS INTEGER) AS i, CAST(left(llm_j, 1) AS INTEGER) AS j, p AS val,
         chr(64 + CAST(left(llm_i, 1) AS INTEGER)) AS letter FROM p_matrix
       WHERE action = 'zero-shot' AND dataset = 'overall'""",
))
def heatmap_files(spark, root):
    """One CSV folder per predicate plus the index map."""
    path = scratch_path(spark, "heatmaps")
    writers.write_heatmaps(reshape.widen_matrix(line_matrix(spark, root), P), P, path, "zero-shot", "overall")
    cells = readers.read_result_table(spark, f"{path}/heatmaps", "i int, j int, val double, predicate string")
    index = readers.read_result_table(spark, f"{path}/model_index_map", "idx int, letter string, llm string")
    return cells.join(index.select(F.col("idx").alias("i"), "letter"), "i")


@query("confusion_files", SQL["confusion_table"])
def confusion_files(spark, root):
    """Relation summary of all relations and levels written as CSV and read back."""
    t = rel.confusion_table(tables.part_relations(spark, root))
    path = scratch_path(spark, "confusion")
    writers.write_table(t, path, "csv")
    return readers.read_result_table(spark, path, t.schema)


@query("sorted_p_values", f"""
SELECT *, CAST(row_number() OVER (ORDER BY dataset, llm, action) - 1 AS BIGINT) AS position FROM ({SQL["action_p_values"]})""")
def sorted_p_values(spark, root):
    """p-values written in order of dataset, model and action, read back with their places."""
    p = significance.action_p_values(line_analysis(spark, root), tables.ACTIONS)
    path = scratch_path(spark, "p-values")
    writers.write_table(p, path, "csv", sort_by=["dataset", "llm", "action"])
    back = readers.read_result_table(spark, path, p.schema)
    return in_file_order(back)
