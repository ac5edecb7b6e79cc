"""Files under given names: one per key, replaced whole."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from accordant.operators import reshape
from accordant.sources import named_files, readers

LLMS = ["llama3.1:8b", "grok-4-0709"]


def answers(spark):
    rows = [
        (str(q), serie, action, task, "spinach", llm, [f'a "{q}"', "é\n", llm] if q % 3 else [], f"/f{q}")
        for q in range(25) for serie, task in (("Q1", "equal"), ("Q3", "sup-sub"))
        for action in ("zero-shot", "wikidata", "fixing", "classification") for llm in LLMS
    ]
    rows += [("3", "Q1", "zero-shot", "equal", "spinach", LLMS[0], ["later"], "/z"), ("x", "Q1", "zero-shot", "equal", "spinach", LLMS[0], None, "/z")]
    return spark.createDataFrame(
        rows, "q_id string, q_serie string, action string, task string, dataset string, llm string, answer array<string>, file_path string"
    ).repartition(5)


def test_answer_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "answers")
    names = named_files.write_answer_files(answers(spark), path)
    assert len(names) == 16 and "zero-shot/spinach/equal/Q1_equal_answers_wikidata_llama3.1:8b.json" in names
    found = sorted(str(p.relative_to(path)) for p in tmp_path.joinpath("answers").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert found == names
    one = json.loads((tmp_path / "answers/zero-shot/spinach/equal/Q1_equal_answers_llama3.1:8b.json").read_text("utf-8"))
    assert list(one) == [*map(str, range(25)), "x"] and one["1"] == ['a "1"', "é\n", LLMS[0]] and one["3"] == one["x"] == []
    back = readers.read_answers(spark, path, LLMS).drop("lang", "file_path")
    want = answers(spark).filter("file_path <> '/z'").drop("file_path")
    missing = want.exceptAll(back.select(*want.columns))
    extra = back.select(*want.columns).exceptAll(want).collect()
    assert missing.isEmpty() and [(r.q_id, r.answer) for r in extra] == [("x", [])]


def test_a_rerun_replaces_and_a_failure_changes_nothing(spark, tmp_path):
    path, a = str(tmp_path / "answers"), answers(spark)
    named_files.write_answer_files(a, path)
    file = tmp_path / "answers/zero-shot/spinach/equal/Q1_equal_answers_grok-4-0709.json"
    before = file.read_text()
    broken = a.withColumn("q_id", F.when(F.col("q_id") == "20", F.raise_error(F.lit("dies"))).otherwise(F.col("q_id")))
    with pytest.raises(Exception, match="dies"):
        named_files.write_answer_files(broken, path)
    assert file.read_text() == before
    named_files.write_answer_files(a.filter("q_id = '7' and llm like 'grok%' and action = 'zero-shot'"), path)
    assert list(json.loads(file.read_text())) == ["7"]
    assert (tmp_path / "answers/zero-shot/spinach/equal/Q1_equal_answers_llama3.1:8b.json").exists()
    with pytest.raises(Exception, match="no folder for action other"):
        named_files.write_answer_files(a.withColumn("action", F.lit("other")), path)


def test_heatmap_and_action_files(spark, tmp_path):
    order = [f"m{i},\"x\"" for i in range(12)]
    long = reshape.model_grid(spark, order).select(
        F.lit("zero-shot").alias("action"), F.lit("overall").alias("dataset"), F.explode(F.array(F.lit("?A1=A2"), F.lit("?A1>A3"))).alias("predicate"),
        "llm_i", "llm_j", F.when(F.col("llm_i") == F.col("llm_j"), 1.0).otherwise(0.25).alias("p"),
    )
    path = str(tmp_path / "heat")
    names = named_files.write_heatmap_files(reshape.widen_matrix(long, order), order, path)
    assert names == ["heatmap_A1eqA2.csv", "heatmap_A1gtA3.csv", "model_index_map.csv"]
    with open(f"{path}/heatmap_A1eqA2.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["i", "j", "val"] and [tuple(map(float, r)) for r in rows[1:]] == [
        (i, j, 1.0 if i == j else 0.25) for i in range(1, 13) for j in range(1, 13)
    ]
    with open(f"{path}/model_index_map.csv", newline="") as f:
        index = list(csv.reader(f))
    assert index[1] == ["1", "A", order[0]] and len(index) == 13
    summary = spark.createDataFrame(
        [("overall", a, m, 0.5 + i) for a in ("zero-shot", "fixing", "wikidata") for i, m in enumerate(("b", "a"))] + [("d1", "fixing", "a", 0.0)],
        "dataset string, action string, llm string, eq double",
    )
    models = spark.createDataFrame([("a", 2), ("b", 1)], "llm string, id int")
    assert named_files.write_action_files(summary, models, path) == ["summary_fixing.csv", "summary_zero-shot.csv"]
    assert open(f"{path}/summary_fixing.csv").read() == "ID,dataset,action,llm,eq\n1,overall,fixing,b,0.5\n2,overall,fixing,a,1.5\n"
