"""Relation labels: canonical mapping, confusion tables, label shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import names
from accordant.functions import labels
from accordant.operators import relations as rel
from accordant.plans.answer_queries import _PHRASES, mean4
from accordant.plans.catalog import query, with_ctes
from accordant.sources import tables

_R = tables.RELATION_COLUMNS


def _part_labels(column: str) -> str:
    picks = ", ".join(
        f"(SELECT {column} FROM phrases WHERE i = (p_partkey + {7 * k} + p_size * {k}) % 20) AS {c}" for k, c in enumerate(_R)
    )
    return f"part_labels AS (SELECT CAST(p_partkey AS VARCHAR) AS q_id, p_type AS dataset, p_brand AS llm, {picks} FROM part)"


@query("canonical_labels", with_ctes([_PHRASES, _part_labels("canonical")], "SELECT * FROM part_labels"))
def canonical_labels(spark, root):
    parts = tables.part_relations(spark, root).drop("file_path")
    return rel.normalise_relations(parts, in_place=True)


_CANON = ", ".join(f"'{c}'" for c in names.CANONICAL_LABELS)


def _strict(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN trim({x}) IN ({_CANON}) THEN trim({x}) ELSE 'Else' END"


@query("strict_labels", with_ctes(
    [_PHRASES, _part_labels("phrase")],
    "SELECT q_id, " + ", ".join(f"{_strict(c)} AS {c}" for c in _R)
    + ", r_12 IN ('unknown', 'none') AS unknown_token FROM part_labels",
))
def strict_labels(spark, root):
    parts = tables.part_relations(spark, root)
    return parts.select(
        "q_id", *[labels.strict_label(F.col(c)).alias(c) for c in _R],
        labels.is_unknown_token(labels.casefold(F.col("r_12"))).alias("unknown_token"),
    )


# The mapping rules in SQL, over whole texts (no look-ahead needed: the pairs are two conditions).
_TEXT_LABEL = r"""CASE
  WHEN s IN (%s) THEN s
  WHEN l IN ('unknown','unk','n/a','na','none','null','nil','idk','unsure','uncertain','ambiguous') THEN 'Unknown'
  WHEN regexp_matches(l, '\bnot\s+disjoint\b|\bnon[-\s]?disjoint\b') THEN 'Overlap'
  WHEN regexp_matches(l, '\bnot\s+overlap(ping)?\b') THEN 'Disjoint'
  WHEN regexp_matches(l, '\beq(uiv(alent|alence)?)\b|\bequal(s)?\b|\bsame(\s+set)?\b|a\s*=\s*b|≡|↔') THEN 'Equivalence'
  WHEN regexp_matches(l, '⊃|⊇|\bsuper\s*set\b|\bsuperset\s+of\b|\bcontain(s|ment)?\b|\bincludes?\b') THEN 'Contains'
  WHEN regexp_matches(l, '⊂|⊆|\bsub\s*set\b|\bcontained\s*by\b|\bis\s+in\b|\bbelongs\s+to\b') THEN 'ContainedBy'
  WHEN (contains(l, '∩') AND (contains(l, '∅') OR contains(l, '= 0')))
    OR regexp_matches(l, '\bdis[-\s]?joint\b|\bno\s+(overlap|intersection)\b|\bmutual(ly)?\s+exclusive\b|\bnon[-\s]?overlap(ping)?\b') THEN 'Disjoint'
  WHEN (contains(l, '∩') AND (contains(l, '≠') OR contains(l, '!= ')))
    OR regexp_matches(l, '\boverlap(ping)?\b|\bintersect(s|ion)?\b|\b(non[-\s]?empty|some)\s+intersection\b|\bshare(s)?\s+(elements|items|members)\b') THEN 'Overlap'
  WHEN contains(l, 'unknown') THEN 'Unknown' ELSE 'Else' END""" % _CANON


@query("canonical_labels_of_texts", with_ctes(
    [
        _PHRASES,
        r"""cleaned AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
  text || ' ' || coalesce(phrase, '-') || ' end', '\(.*?\)', '', 'g'), '[-_]+', '-', 'g'), '\s+', ' ', 'g')) AS s
  FROM documents JOIN phrases ON i = doc_id % 20)""",
        "folded AS (SELECT doc_id, s, lower(s) AS l FROM cleaned)",
    ],
    f"SELECT doc_id, {_TEXT_LABEL} AS label FROM folded",
))
def canonical_labels_of_texts(spark, root):
    """Whole documents followed by a relation phrase."""
    d = tables.load(spark, root, "documents").select("doc_id", "text")
    reply = F.concat_ws(" ", "text", F.coalesce(tables.phrase(F.col("doc_id")), F.lit("-")), F.lit("end"))
    return rel.with_canonical_labels(d.select("doc_id", reply.alias("label")), {"label": "label"})


def _case_counts(column: str) -> str:
    return ", ".join(f'count(*) FILTER (WHERE lab = \'{c}\') AS "{c}"' for c in names.CANONICAL_LABELS)


_CONFUSION = [
    _PHRASES,
    _part_labels("phrase"),
    "long AS (" + " UNION ALL ".join(
        f"SELECT llm, dataset, '{c}' AS relation, '{names.TRUE_LABELS[c]}' AS true_label, {_strict(c)} AS lab FROM part_labels"
        for c in _R
    ) + ")",
    "levels AS (SELECT * FROM long UNION ALL SELECT * REPLACE ('overall' AS dataset) FROM long)",
    f"counts AS (SELECT llm, dataset, relation, true_label, {_case_counts('lab')}, count(*) AS size, "
    "count(*) FILTER (WHERE lab = true_label) AS hits FROM levels GROUP BY llm, dataset, relation, true_label)",
]


def _ratio(c: str) -> str:
    return mean4(f"({c} * 10000)", "size")


@query("confusion_counts", with_ctes(_CONFUSION, "SELECT * EXCLUDE (size, hits) FROM counts"))
def confusion_counts(spark, root):
    return rel.confusion_counts(tables.part_relations(spark, root))


@query("confusion_ratios", with_ctes(
    _CONFUSION,
    f"SELECT llm, dataset, relation, true_label, size, {_ratio('hits')} AS accuracy, "
    + ", ".join(f'{_ratio(chr(34) + c + chr(34))} AS "{c}"' for c in names.CANONICAL_LABELS) + " FROM counts",
))
def confusion_ratios(spark, root):
    return rel.confusion_ratios(rel.confusion_counts(tables.part_relations(spark, root)))


def _cell(c: str) -> str:
    return f"format('{{:.4f}}({{}})', {_ratio(c)}, {c})"


@query("confusion_table", with_ctes(
    _CONFUSION,
    f"SELECT llm, dataset, relation, true_label, size, {_cell('hits')} AS accuracy, "
    + ", ".join(f'{_cell(chr(34) + c + chr(34))} AS "{c}"' for c in names.CANONICAL_LABELS) + " FROM counts",
))
def confusion_table(spark, root):
    return rel.confusion_table(tables.part_relations(spark, root))


@query("relation_accuracy", with_ctes(
    [_PHRASES, _part_labels("phrase"),
     "levels AS (SELECT * FROM part_labels UNION ALL SELECT * REPLACE ('overall' AS dataset) FROM part_labels)"],
    "SELECT dataset, llm, count(*) AS size, "
    + ", ".join(
        f"{mean4(f'(count(*) FILTER (WHERE {c} = {chr(39)}{t}{chr(39)}) * 10000)', 'count(*)')} AS {c}"
        for c, t in names.TRUE_LABELS.items()
    ) + " FROM levels GROUP BY dataset, llm",
))
def relation_accuracy(spark, root):
    return rel.relation_accuracy(tables.part_relations(spark, root))


@query("label_shapes", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_type
  WHEN 3 THEN CASE WHEN p_size >= 30 THEN p_brand ELSE 'other' END ELSE p_name END AS label FROM part""")
def label_shapes(spark, root):
    """Lists, label objects, score objects, key-only objects and plain strings."""
    p = tables.load(spark, root, "part")
    name = F.col("p_name")
    shapes = [
        F.to_json(F.array(F.lit(" "), F.concat(F.lit(" "), name), F.lit("x"))),
        F.to_json(F.struct(F.lit("v").alias("other"), name.alias("label"))),
        F.to_json(F.struct(F.col("p_type").alias("relation"), name.alias("pred"))),
        F.concat(F.lit('{"other": 29.5, "'), F.col("p_brand"), F.lit('": '), F.col("p_size").cast("string"), F.lit("}")),
    ]
    value = name
    for k, shape in enumerate(shapes):
        value = F.when(F.col("p_partkey") % 5 == k, shape).otherwise(value)
    return p.select("p_partkey", labels.label_text(value).alias("label"))


@query("best_label", """
WITH m AS (SELECT p_partkey, p_size AS a, CAST(p_partkey % 50 AS INTEGER) AS b, 25 AS c FROM part)
SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'Disjoint' WHEN b >= c THEN 'Overlap' ELSE 'Contains' END AS label FROM m""")
def best_label(spark, root):
    p = tables.load(spark, root, "part")
    scores = F.create_map(
        F.lit("Disjoint"), F.col("p_size").cast("double"), F.lit("Overlap"), (F.col("p_partkey") % 50).cast("double"),
        F.lit("Contains"), F.lit(25.0),
    )
    return p.select("p_partkey", labels.best_key(scores).alias("label"))
