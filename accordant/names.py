"""Column names.

Inside the engine every column has an ASCII name.  The symbol names of the result tables are
applied once, at the sink, by :func:`to_symbols`; :func:`to_ascii` undoes it after a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Result-table column names, ASCII name first.
FLAG_SYMBOLS = {
    "eq_a1_a2": "?A1=A2",
    "eq_a1_a34": "?A1=A3+A4",
    "sub_a3_a1": "?A1>A3",
    "sub_a4_a1": "?A1>A4",
    "disj_a3_a4": "?A3∅A4",
    "part_a1_a34": "?A4=A1|3",
    "eq_a1_s": "?A1=A1*",
    "eq_a1_p": "?A1=A1**",
    "eq_s_p": "?A1*=A1**",
}
JACCARD_SYMBOLS = {
    "jac_a1_a2": "J(A1-A2)",
    "jac_a1_a34": "J(A1-A34)",
    "jac_a3_a4": "J(A3-A4)",
    "jac_a4_diff": "J(A4-A1|3)",
    "jac_a1_s": "J(A1-A1*)",
    "jac_a1_p": "J(A1-A1**)",
    "jac_s_p": "J(A1*-A1**)",
}
RELATION_SYMBOLS = {
    "r_12": "R(1-2)",
    "r_13": "R(1-3)",
    "r_14": "R(1-4)",
    "r_34": "R(3-4)",
    "r_134": "R(1-34)",
}
CONTRADICTION_SYMBOLS = {
    "sc_a1_a2": "?SC(A1=A2)",
    "sc_a1_a3": "?SC(A1>A3)",
    "sc_a1_a4": "?SC(A1>A4)",
    "sc_a3_a4": "?SC(A3∅A4)",
    "sc_a1_a34": "?SC(A4=A1|3)",
}
PVALUE_SYMBOLS = {
    "p_eq_a1_a2": "p(A1=A2)",
    "p_eq_a1_a34": "p(A1=A3+A4)",
    "p_sub_a3_a1": "p(A1>A3)",
    "p_sub_a4_a1": "p(A1>A4)",
    "p_disj_a3_a4": "p(A3∅A4)",
    "p_part_a1_a34": "p(A4=A1|3)",
}
STRATIFIED_SYMBOLS = {
    "eq_a1_a2_pos": "?A1=A2(+)",
    "eq_a1_a2_neg": "?A1=A2(-)",
    "jac_a1_a2_pos": "J(1-2)+",
    "jac_a1_a2_neg": "J(1-2)-",
    "sub_a3_a1_pos": "?A1>A3(+)",
    "sub_a3_a1_neg": "?A1>A3(-)",
    "sub_a4_a1_pos": "?A1>A4(+)",
    "sub_a4_a1_neg": "?A1>A4(-)",
    "jac_a1_a4_pos": "J(1-4)+",
    "jac_a1_a4_neg": "J(1-4)-",
    "disj_a3_a4_pos": "?A3∅A4(+)",
    "disj_a3_a4_neg": "?A3∅A4(-)",
    "jac_a3_a4_pos": "J(3-4)+",
    "jac_a3_a4_neg": "J(3-4)-",
    "eq_a1_a34_pos": "?A1=A3+A4(+)",
    "eq_a1_a34_neg": "?A1=A3+A4(-)",
    "jac_a1_a34_pos": "J(1-34)+",
    "jac_a1_a34_neg": "J(1-34)-",
}
OTHER_SYMBOLS = {
    "q_id": "Q_ID",
    "q_serie": "Q_serie",
    "a1": "A1",
    "a2": "A2",
    "a3": "A3",
    "a4": "A4",
    "a1_s": "A1*",
    "a1_p": "A1**",
    "q1": "Q1",
    "q2": "Q2",
    "q3": "Q3",
    "q4": "Q4",
    "idk_a1": "idk_A1",
    "idk_a2": "idk_A2",
    "idk_a3": "idk_A3",
    "idk_a4": "idk_A4",
    "eq_a1_ave": "?A1=A1(ave)",
    "jac_a1_ave": "J_A1_ave",
}

SYMBOLS = {
    **FLAG_SYMBOLS,
    **JACCARD_SYMBOLS,
    **RELATION_SYMBOLS,
    **CONTRADICTION_SYMBOLS,
    **PVALUE_SYMBOLS,
    **STRATIFIED_SYMBOLS,
    **OTHER_SYMBOLS,
}

FLAGS = list(FLAG_SYMBOLS)
JACCARDS = list(JACCARD_SYMBOLS)
RELATIONS = list(RELATION_SYMBOLS)
CONTRADICTIONS = list(CONTRADICTION_SYMBOLS)
IDKS = ["idk_a1", "idk_a2", "idk_a3", "idk_a4"]

# Flags that are tested for significance.
TESTED = ["eq_a1_a2", "eq_a1_a34", "sub_a3_a1", "sub_a4_a1", "disj_a3_a4", "part_a1_a34"]

# The seven relation labels and the true label of every relation column.
CANONICAL_LABELS = ["Equivalence", "Contains", "ContainedBy", "Overlap", "Disjoint", "Unknown", "Else"]
TRUE_LABELS = {
    "r_12": "Equivalence",
    "r_13": "Contains",
    "r_14": "Contains",
    "r_34": "Disjoint",
    "r_134": "Equivalence",
}

# Default vocabularies of the path keys.
DATASETS = ["spinach", "qawiki", "synthetic", "lc-quad"]
ACTIONS = ["wikidata", "fixing", "classification", "star", "zero-shot"]
TASKS = ["equal", "sup-sub", "minus"]
SERIES = ["Q1", "Q2", "Q3", "Q4"]
LANGUAGES = ["en"]


def to_symbols(df: DataFrame) -> DataFrame:
    """Rename ASCII columns to the symbol names used in result tables."""
    return df.withColumnsRenamed({c: SYMBOLS[c] for c in df.columns if c in SYMBOLS})


def to_ascii(df: DataFrame) -> DataFrame:
    """Inverse of :func:`to_symbols`."""
    back = {v: k for k, v in SYMBOLS.items()}
    return df.withColumnsRenamed({c: back[c] for c in df.columns if c in back})
