"""Relation labels against observed sets: label fill, contradictions, confusion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant import names
from accordant.functions import labels
from accordant.functions.numbers import round4

RELATION_KEYS = ["q_id", "dataset", "llm"]


def with_canonical_labels(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Map free-text label columns to canonical ones; ``columns`` is {target: source}.

    Composing, squeezing, folding and matching are staged, so no text is cleaned once per rule.
    Folding case and squeezing do not disturb each other, so Python is asked once for both forms.
    """
    out = df.withColumns({f"__forms_{t}": labels.composed_and_folded(F.col(s)) for t, s in columns.items()})
    out = out.withColumns({f"__clean_{t}": labels.squeezed(F.col(f"__forms_{t}.composed")) for t in columns})
    out = out.withColumns({
        f"__fold_{t}": F.coalesce(labels.squeezed(F.col(f"__forms_{t}.folded")), labels.lower_fold(F.col(f"__clean_{t}")))
        for t in columns
    })
    out = out.withColumns(
        {t: labels.match_label(F.col(f"__clean_{t}"), F.col(f"__fold_{t}")) for t in columns}
    )
    return out.drop(*[f"__{k}_{t}" for t in columns for k in ("forms", "clean", "fold")])


def normalise_relations(df: DataFrame, columns: list[str] = names.RELATIONS, suffix: str = "_norm", in_place: bool = False) -> DataFrame:
    """Canonical labels of several columns, in place or as new columns with ``suffix``."""
    return with_canonical_labels(df, {c if in_place else c + suffix: c for c in columns})


def align_relations(df: DataFrame) -> DataFrame:
    """Keys plus all five relation columns; absent ones are NULL."""
    return df.select(
        *RELATION_KEYS,
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names.RELATIONS],
        F.col("file_path") if "file_path" in df.columns else F.lit("").alias("file_path"),
    )


def merge_relations_by_action(analysis: DataFrame, relations: DataFrame, classified: DataFrame) -> DataFrame:
    """Fill labels by action: zero-shot rows from one table, classification rows from the other.

    Both right tables go into one join, tagged with the action they serve, and repeated keys
    are reduced before it.  Reduction and join use the analysis keys in the same order, so both
    sides arrive partitioned for the join.
    """
    tagged = align_relations(relations).withColumn("action", F.lit("zero-shot")).unionByName(
        align_relations(classified).withColumn("action", F.lit("classification"))
    )
    keys = ["q_id", "action", "dataset", "llm"]
    first = (
        tagged.groupBy(*keys)
        .agg(F.min_by(F.struct(*names.RELATIONS), "file_path").alias("r"))
        .select(*keys, "r.*")
    )
    bare = analysis.drop(*names.RELATIONS)
    return contradictions(bare.join(first, keys, "left").select(*bare.columns, *names.RELATIONS))


# Contradiction flag, the observed flag, the label column and its true label.
CONTRADICTION_SPEC = [
    ("sc_a1_a2", "eq_a1_a2", "r_12", "Equivalence"),
    ("sc_a1_a3", "sub_a3_a1", "r_13", "Contains"),
    ("sc_a1_a4", "sub_a4_a1", "r_14", "Contains"),
    ("sc_a3_a4", "disj_a3_a4", "r_34", "Disjoint"),
    ("sc_a1_a34", "part_a1_a34", "r_134", "Equivalence"),
]


def contradictions(df: DataFrame) -> DataFrame:
    """1 where stated relation and observed relation agree, 0 where not, NULL without a label."""
    cols = {}
    for name, flag, rel, truth in CONTRADICTION_SPEC:
        labelled = F.col(rel).isNotNull() & (F.lower(F.col(rel)) != "none")
        observed = F.coalesce(F.col(flag).try_cast("int"), F.lit(0))
        stated = (F.col(rel) == truth).cast("int")
        cols[name] = F.when(labelled, (observed == stated).cast("int"))
    return df.withColumns(cols)


def confusion_counts(relations: DataFrame, include_overall: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Label counts per (llm, dataset, relation) in long rows with one column per label.

    All relations are counted in one pass over the rows, without unpivoting them; the overall
    level is added up from the per-dataset counts.
    """
    rels = columns or list(names.TRUE_LABELS)
    strict = relations.select("llm", "dataset", *[labels.strict_label(F.col(r)).alias(r) for r in rels])
    fine = strict.groupBy("llm", "dataset").agg(
        *[F.count_if(F.col(r) == lab).alias(f"{r}__{lab}") for r in rels for lab in names.CANONICAL_LABELS]
    )
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(r).alias("relation"), F.lit(names.TRUE_LABELS[r]).alias("true_label"),
            *[F.col(f"{r}__{lab}").alias(lab) for lab in names.CANONICAL_LABELS],
        )
        for r in rels
    ])).alias("cell")
    long = fine.select("llm", "dataset", cells).select("llm", "dataset", "cell.*")
    if not include_overall:
        return long
    keys = ["llm", "relation", "true_label"]
    sums = [F.sum(lab).alias(lab) for lab in names.CANONICAL_LABELS]
    both = long.groupingSets(
        [[F.col("llm"), F.col("dataset"), F.col("relation"), F.col("true_label")], [F.col(k) for k in keys]],
        "llm", "dataset", "relation", "true_label",
    ).agg(*sums, F.grouping("dataset").alias("is_overall"))
    return both.withColumn(
        "dataset", F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("dataset"))
    ).drop("is_overall")


def confusion_ratios(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Row-normalised counts plus the ratio of the true label as ``accuracy``."""
    size = sum((F.col(lab) for lab in names.CANONICAL_LABELS[1:]), F.col(names.CANONICAL_LABELS[0]))
    ratio = {lab: round4(F.col(lab) / size, digits) for lab in names.CANONICAL_LABELS}
    return counts.select(
        "llm", "dataset", "relation", "true_label", size.alias("size"),
        _of_true_label(ratio).alias("accuracy"),
        *[v.alias(lab) for lab, v in ratio.items()],
    )


def _of_true_label(per_label: dict):
    out = F.lit(None)
    for lab, v in per_label.items():
        out = F.when(F.col("true_label") == lab, v).otherwise(out)
    return out


def confusion_table(relations: DataFrame, include_overall: bool = True, digits: int = 4, columns: list[str] | None = None) -> DataFrame:
    """Confusion table with ``ratio(count)`` cells, accuracy and size."""
    counts = confusion_counts(relations, include_overall, columns)
    size = sum((F.col(lab) for lab in names.CANONICAL_LABELS[1:]), F.col(names.CANONICAL_LABELS[0]))
    text = {
        lab: F.format_string(f"%.{digits}f(%d)", round4(F.col(lab) / size, digits), F.col(lab))
        for lab in names.CANONICAL_LABELS
    }
    return counts.select(
        "llm", "dataset", "relation", "true_label",
        _of_true_label(text).alias("accuracy"), size.alias("size"),
        *[v.alias(lab) for lab, v in text.items()],
    )


def relation_accuracy(relations: DataFrame) -> DataFrame:
    """Share of exactly right labels per (dataset, llm) and overall; a missing label is wrong."""
    fine = relations.groupBy("dataset", "llm").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(r) == t).alias(r) for r, t in names.TRUE_LABELS.items()],
    )
    both = fine.groupingSets([[F.col("dataset"), F.col("llm")], [F.col("llm")]], "dataset", "llm").agg(
        F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in names.TRUE_LABELS],
        F.grouping("dataset").alias("is_overall"),
    )
    return both.select(
        F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("dataset")).alias("dataset"), "llm",
        *[round4(F.col(r) / F.col("n")).alias(r) for r in names.TRUE_LABELS],
        F.col("n").alias("size"),
    )
