"""Text functions over whole texts of the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import labels, numbers, text
from accordant.operators import questions as qs
from accordant.plans.catalog import query
from accordant.sources import readers, tables

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _items(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split({x}, '|'), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"
    )


@query("response_lists", f"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'idk' WHEN doc_id % 50 = 1 THEN 'no answer'
             ELSE replace(text, '.', '|') END AS reply FROM documents),
l AS (SELECT doc_id, CASE WHEN reply = 'idk' THEN ['idk'] WHEN reply = 'no answer' THEN []::VARCHAR[]
        ELSE {_items('reply')} END AS items FROM r)
SELECT doc_id, CAST(len(items) AS INTEGER) AS n_items, md5(array_to_string(items, '¦')) AS digest FROM l""")
def response_lists(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source")
    reply = (
        F.when(F.col("doc_id") % 50 == 0, "idk").when(F.col("doc_id") % 50 == 1, "no answer")
        .otherwise(F.replace("text", F.lit("."), F.lit("|")))
    )
    lists = d.select("doc_id", text.response_to_list(reply).alias("items"))
    return lists.select("doc_id", F.size("items").alias("n_items"), F.md5(F.array_join("items", "¦")).alias("digest"))


@query("response_lists_es", f"""
WITH r AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'no sé' ELSE replace(text, ',', '|') END AS reply
           FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN reply = 'no sé' THEN []::VARCHAR[] ELSE {_items('reply')} END AS items FROM r)
SELECT conv_id, turn, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items, '¦') AS items FROM l""")
def response_lists_es(spark, root):
    c = tables.load(spark, root, "conversations")
    reply = F.when(F.col("turn") == 3, "no sé").otherwise(F.replace("text", F.lit(","), F.lit("|")))
    lists = c.select("conv_id", "turn", text.response_to_list_es(reply).alias("items"))
    return lists.select("conv_id", "turn", F.size("items").alias("n_items"), F.array_join("items", "¦").alias("items"))


@query("label_scores", """
SELECT p_partkey, CAST(p_size % 3 <> 0 AS INTEGER) AS same,
  CASE p_size % 3 WHEN 2 THEN 0.0::DOUBLE ELSE CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS direction
FROM part""")
def label_scores(spark, root):
    p = tables.load(spark, root, "part")
    brand = F.concat(F.lit(" \n"), F.upper("p_brand"), F.lit("\t"))
    truth = F.when(F.col("p_size") % 3 == 0, "Brand#0").otherwise(F.col("p_brand"))
    named = (
        F.when(F.col("p_size") % 3 == 0, "Containment\n").when(F.col("p_size") % 3 == 1, " contención")
        .otherwise("contained")
    )
    side = F.when(F.col("p_partkey") % 2 == 0, " B").otherwise("a")
    return p.select(
        "p_partkey", text.label_score(brand, truth).alias("same"), text.directional_score(named, side).alias("direction")
    )


_CLEAN = (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(text, '\(.*?\)', '', 'g'), '[-_]+', '-', 'g'), '\s+', ' ', 'g'), {_BLANKS})"
)


@query("clean_texts", f"SELECT doc_id, CAST(length({_CLEAN}) AS INTEGER) AS n, md5({_CLEAN}) AS digest FROM documents")
def clean_texts(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source").select("doc_id", labels.clean_label(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("token_estimates", r"""
SELECT doc_id, CAST(floor(len(list_filter(string_split_regex('Answer this: ' || text || ' now', '\s+'), lambda w: w <> '')) * 1.5)
  AS INTEGER) AS tokens FROM documents""")
def token_estimates(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source")
    return d.select("doc_id", text.token_estimate(F.col("text"), "Answer this: {question} now").alias("tokens"))


@query("prompts", """
SELECT conv_id, turn, md5('Task for ' || role || ': ' || text || chr(10) || '{fixed} ' || text) AS digest FROM conversations""")
def prompts(spark, root):
    c = tables.load(spark, root, "conversations")
    filled = text.render("Task for {who}: {q1}\n{{fixed}} {q1}", who=F.col("role"), q1=F.col("text"))
    return c.select("conv_id", "turn", F.md5(filled).alias("digest"))


@query("prompts_by_language", """
SELECT doc_id, lang, md5(CASE lang WHEN 'en' THEN 'Question: ' || text WHEN 'es' THEN 'Pregunta: ' || text END) AS digest
FROM documents""")
def prompts_by_language(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source")
    filled = text.render_by_key({"en": "Question: {q}", "es": "Pregunta: {q}"}, F.col("lang"), q=F.col("text"))
    return d.select("doc_id", "lang", F.md5(filled).alias("digest"))


_REPLY = (
    "text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'q2:  ' || source || ' ' || chr(10) END "
    "|| 'Corrected Q1: ' || lang || ' one'"
)


@query("labelled_lines", rf"""
WITH r AS (SELECT doc_id, source, lang, {_REPLY} AS reply FROM documents)
SELECT doc_id,
  md5(CASE WHEN regexp_matches(reply, '(?im)^q2:\s*(.+)') THEN trim(regexp_extract(reply, '(?im)^q2:\s*(.+)', 1)) ELSE trim(reply, {_BLANKS}) END) AS q2,
  trim(regexp_extract(reply, '(?im)^corrected q1:\s*(.+)', 1)) AS corrected,
  CASE WHEN regexp_matches(reply, '(?im)^q4:\s*(.+)') THEN trim(regexp_extract(reply, '(?im)^q4:\s*(.+)', 1)) ELSE 'none' END AS q4
FROM r""")
def labelled_lines(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source")
    reply = F.concat(
        "text", F.lit("\n"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("q2:  "), "source", F.lit(" \n"))),
        F.lit("Corrected Q1: "), "lang", F.lit(" one"),
    )
    r = d.select("doc_id", reply.alias("reply"))
    return r.select(
        "doc_id", F.md5(text.labelled_line(F.col("reply"), "q2", text.strip(F.col("reply")))).alias("q2"),
        text.labelled_line(F.col("reply"), "corrected q1", F.lit("")).alias("corrected"),
        text.labelled_line(F.col("reply"), "q4", F.lit("none")).alias("q4"),
    )


@query("yes_replies", """
WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'YES, ' || text WHEN 1 THEN ' yes ' || chr(10) ELSE text END AS reply
           FROM conversations)
SELECT conv_id, turn, starts_with(lower(trim(reply, ' ' || chr(10))), 'yes') AS accepted,
  lower(trim(reply, ' ' || chr(10))) = 'yes' AS exact FROM r""")
def yes_replies(spark, root):
    c = tables.load(spark, root, "conversations")
    reply = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("YES, "), "text")).when(F.col("turn") % 3 == 1, " yes \n")
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", text.starts_with_yes(reply).alias("accepted"), text.is_yes(reply).alias("exact"))


@query("validated_questions", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE 'new ' || c_name END AS "Q1",
  CASE WHEN c_custkey % 4 = 0 THEN 'same as ' || c_name ELSE 'also ' || c_name END AS "Q2", 'narrow ' || c_mktsegment AS "Q3",
  CASE WHEN c_nationkey % 2 = 0 THEN 'rest ' || c_mktsegment ELSE 'fixed rest' END AS "Q4"
FROM customer WHERE c_acctbal >= 0 AND c_custkey % 7 <> 0""")
def validated_questions(spark, root):
    c = tables.load(spark, root, "customer")
    replies = c.select(
        "c_custkey", F.col("c_name").alias("q1"),
        F.when(F.col("c_acctbal") >= 0, "Yes").otherwise("No - too wide").alias("r1"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("same as "), "c_name", F.lit(" \n")))
        .otherwise(F.concat(F.lit("Here:\nq2: also "), "c_name")).alias("r2"),
        F.concat(
            F.lit("Q3: narrow "), "c_mktsegment",
            F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("\nQ4:  rest "), "c_mktsegment")),
        ).alias("r3"),
        F.when(F.col("c_nationkey") % 2 == 0, " yes\n")
        .otherwise(F.concat(F.lit("No.\nCorrected Q1: new "), "c_name", F.lit("\nCorrected Q4: fixed rest"))).alias("r4"),
    )
    return qs.validated_questions(replies, ["c_custkey"])


@query("numbered_question_lines", """
WITH r AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split(
             replace(replace(text, chr(10), ' '), '.', '|'), '|'), lambda s: trim(s)), lambda s: s <> '') AS v FROM conversations)
SELECT conv_id, turn, 0 AS pos, coalesce(v[2], '') AS narrow, coalesce(v[1], '') AS broad, coalesce(v[4], '') AS narrow_query,
  coalesce(v[3], '') AS broad_query FROM r WHERE len(v) > 0
UNION ALL SELECT conv_id, turn, CASE WHEN len(v) > 0 THEN 1 ELSE 0 END, role, 'second', '', '' FROM r""")
def numbered_question_lines(spark, root):
    c = tables.load(spark, root, "conversations")
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("."), F.lit(" |"))
    reply = F.concat(F.lit("Sure:\n 1. "), flat, F.lit("\n2.  second | "), "role", F.lit("\n\n3.none"))
    return qs.parse_question_pairs(c.withColumn("reply", reply), "reply", ["conv_id", "turn"])


@query("remainder_questions", """
SELECT c_custkey, 0 AS pos, c_name AS q1, c_mktsegment AS q2, 'all of ' || c_name || ' but ' || c_mktsegment AS q3 FROM customer""")
def remainder_questions(spark, root):
    c = tables.load(spark, root, "customer")
    reply = F.concat(F.lit("1. Question C: all of "), "c_name", F.lit(" but "), "c_mktsegment", F.lit("\nend"))
    return qs.parse_remainder_questions(
        c.withColumn("reply", reply), "reply", F.col("c_name"), F.col("c_mktsegment"), ["c_custkey"]
    )


@query("file_safe_predicates", r"""
SELECT p_partkey, trim(regexp_replace(
  replace(replace(replace(replace(replace('?' || p_name || '=' || p_type || '|>' || p_size, '?', ''), '=', 'eq'), '>', 'gt'), '+', 'plus'), '|', 'or'),
  '[^\w]+', '_', 'g'), '_') AS file_name FROM part""")
def file_safe_predicates(spark, root):
    p = tables.load(spark, root, "part")
    name = F.concat(F.lit("?"), "p_name", F.lit("="), "p_type", F.lit("|>"), F.col("p_size").cast("string"))
    return p.select("p_partkey", text.file_safe_predicate(name).alias("file_name"))


@query("release_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS released FROM orders""")
def release_dates(spark, root):
    o = tables.load(spark, root, "orders")
    s = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", text.release_date(s).alias("released"))


@query("model_sizes", """
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN p_size * 1e9::DOUBLE WHEN 1 THEN (p_size + 1000) * 1e6::DOUBLE WHEN 2 THEN CAST(p_size AS DOUBLE) END AS size_value,
  CASE p_partkey % 4 WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN 420.0::DOUBLE ELSE 200.0::DOUBLE END AS area
FROM part""")
def model_sizes(spark, root):
    p = tables.load(spark, root, "part")
    n = F.col("p_size").cast("string")
    size = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), n, F.lit("B")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.format_number(F.col("p_size") + 1000, 0), F.lit("m")))
        .when(F.col("p_partkey") % 4 == 2, n).otherwise("Large")
    )
    return p.select("p_partkey", numbers.parse_size(size).alias("size_value"), numbers.bucket_area(size).alias("area"))


@query("joined_replies", "SELECT doc_id, md5(text || source) AS digest FROM documents")
def joined_replies(spark, root):
    d = tables.load(spark, root, "documents").select("doc_id", "text", "lang", "source")
    body = F.concat(
        F.to_json(F.struct(F.col("text").alias("response"))), F.lit('\nnot json\n\n{"done": true}\n'),
        F.to_json(F.struct(F.col("source").alias("response"))),
    )
    return d.select("doc_id", F.md5(text.joined_replies(body)).alias("digest"))


@query("binding_values", """
SELECT c_custkey, c_name || '|' || c_mktsegment AS found FROM customer""")
def binding_values(spark, root):
    c = tables.load(spark, root, "customer")

    def value(x):
        return F.struct(F.lit("literal").alias("type"), F.col(x).alias("value"))

    body = F.to_json(F.struct(F.struct(F.array(
        F.struct(value("c_name").alias("x"), value("c_mktsegment").alias("y")),
        F.struct(F.lit(None).cast("struct<type:string,value:string>").alias("x"), value("c_mktsegment").alias("y")),
    ).alias("bindings")).alias("results")))
    return c.select("c_custkey", F.array_join(text.first_binding_values(body), "|").alias("found"))


@query("event_scores", """
SELECT event_id, 'k' AS q_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def event_scores(spark, root):
    e = tables.load(spark, root, "events")
    docs = e.select(F.concat(F.lit("/x/"), F.col("event_id").cast("string")).alias("file_path"), F.col("props").alias("value"))
    return readers.parse_scores(docs).select(F.col("file").cast("long").alias("event_id"), "q_id", "score")
