"""Files of the published shapes, generated, so these checks always run (see test_files.py for the published ones)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from accordant.functions.labels import label_text
from accordant.operators import scores
from accordant.operators.relations import with_canonical_labels
from accordant.sources import readers

# Raw labels of the published label files, how often they occur, and the label each stands for.
RAW_LABELS = [
    ("contains", 4684, "Contains"), ("overlap", 1281, "Overlap"), ("equivalence", 125, "Equivalence"), ("containedby", 85, "ContainedBy"),
    ("unknown", 73, "Unknown"), ("disjoint", 63, "Disjoint"), ("contains (q1 ⊃ q2)", 32, "Contains"), ("", 14, "Else"),
    ("containment", 12, "Contains"), ("equivalent", 2, "Equivalence"), ("containedby (q1 ⊂ q2)", 1, "ContainedBy"), ("overlaps", 1, "Else"),
]


def label_files(root):
    """The labels dealt over files of two tasks and three models, some as lists; (task, model, id, raw) of each."""
    rng = random.Random(1)
    labels = [raw for raw, n, _ in RAW_LABELS for _ in range(n)]
    rng.shuffle(labels)
    placed, files = [], [(t, m) for t in ("equal", "sup-sub", "minus") for m in ("llama3.1:8b", "gpt-x", "m")]
    for k, (task, model) in enumerate(files):
        mine = labels[k::len(files)]
        data = {str(i): [raw] if k == 4 and raw else raw for i, raw in enumerate(mine)}
        folder = root / "rel_classification_and_questions" / "spinach" / task
        folder.mkdir(parents=True, exist_ok=True)
        name = {"equal": "Equivalence_equal_relation", "sup-sub": "Containment_sup-sub_relation", "minus": "Relation_minus_answers_classAndAnswer"}[task]
        (folder / f"{name}_{model}.json").write_text(json.dumps(data, ensure_ascii=False, indent=4), encoding="utf-8")
        placed += [(task, model, str(i), raw) for i, raw in enumerate(mine)]
    return placed


@pytest.mark.parametrize("in_parts", [False, True])
def test_label_histogram(spark, tmp_path, in_parts):
    label_files(tmp_path)
    rows = readers.entries(readers.read_documents(spark, str(tmp_path), in_parts=in_parts))
    lab = with_canonical_labels(rows.withColumn("label", label_text(F.col("raw"))), {"label": "label"})
    got = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}
    assert got == {"Contains": 4728, "Overlap": 1281, "Equivalence": 127, "ContainedBy": 86, "Unknown": 73, "Disjoint": 63, "Else": 15}


def test_classified_relations(spark, tmp_path):
    placed = label_files(tmp_path)
    canonical = {raw: c for raw, _, c in RAW_LABELS}
    column = {"equal": "r_12", "sup-sub": "r_13", "minus": "r_134"}
    got = readers.read_classified_relations(spark, str(tmp_path), ["llama3.1:8b", "gpt-x", "m"]).collect()
    cells = {(r.llm, r.q_id, c): r[c] for r in got for c in column.values() if r[c] is not None}
    assert cells == {(m, i, column[t]): canonical[raw] for t, m, i, raw in placed}


def half_even(x, digits=4):
    from decimal import ROUND_HALF_EVEN, Decimal

    return float(Decimal(repr(round(x, 12))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def test_score_table_summaries(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for task in ("equal", "sup-sub", "minus"):
        for model in ("gpt-4.1-2025-04-14", "deepseek-r1:1.5b"):
            for action in ("", "wikidata", "fixing"):
                rows = [(q, rng.choice([0.0, 1.0, round(rng.random(), 4)]), *[rng.randrange(2) for _ in range(3)]) for q in range(rng.choice([97, 150]))]
                text = "QuestionID\tJaccardSimilarity\tIsEmptySet\tBinaryEqual\tB_Intersected_C_EmptyCount\n"
                text += "".join("\t".join(map(str, r)) + "\n" for r in rows)
                (tmp_path / f"{task}_{model}_{action}.tsv").write_text(text)
                j, some = [r[1] for r in rows], [r[1] for r in rows if r[1]]
                want[task, model, action] = (
                    half_even(sum(j) / len(j)), half_even(j.count(0.0) / len(j)), half_even(sum(some) / len(some)),
                    half_even(sum(r[3] for r in rows) / len(rows)), sum(r[4] for r in rows),
                )
    got = scores.summarise_score_tables(readers.read_score_tables(spark, str(tmp_path))).collect()
    assert {(r.task, r.model, r.action): (r.average_all, r.ratio_empty, r.average_no_empty, r.binary_rate, r.disjoint_count) for r in got} == want


@pytest.mark.parametrize("in_parts", [False, True])
def test_score_documents(spark, tmp_path, in_parts):
    """Numbers, and lists that count towards the size only."""
    rng, want = random.Random(3), {}
    for f in range(6):
        values = {str(i): rng.choice([0, 0.5, 1, 1.0]) if f < 4 else ["Contains"] for i in range(rng.randrange(1, 60))}
        (tmp_path / f"Equivalence_m{f}.json").write_text(json.dumps(values))
        numbers = [v for v in values.values() if not isinstance(v, list)]
        want[f"Equivalence_m{f}.json"] = (half_even(sum(numbers) / len(numbers)) if numbers else None, sum(v == 1 for v in numbers), len(values))
    got = scores.summarise_score_files(readers.read_scores(spark, str(tmp_path), in_parts=in_parts)).collect()
    assert {r.file: (r.average_score, r.count_ones, r.size) for r in got} == want
