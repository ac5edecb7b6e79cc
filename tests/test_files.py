"""File formats, the evaluation of a file tree, and round trips of written files.

``ACCORDANT_SAMPLES`` may name a folder of published score tables, label and answer files; the
tests against their published figures are skipped without it.
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from accordant import names
from accordant.operators import relations, reshape, scores
from accordant.operators.relations import with_canonical_labels
from accordant.functions.labels import label_text
from accordant.plans import evaluation
from accordant.sources import readers
from accordant.streaming.ingest import ingest_answers

DATA = os.environ.get("ACCORDANT_SAMPLES", "")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no published samples")


@needs_data
def test_score_tables_reproduce_published_summaries(spark):
    compared, missing = 0, []
    for ds in ("qawiki", "spinach", "synthetic"):
        got = {
            (r.task, r.model, r.action): r
            for r in scores.summarise_score_tables(readers.read_score_tables(spark, f"{DATA}/evaluation_results/{ds}")).collect()
        }
        gold = spark.read.option("header", "true").option("sep", "\t").csv(f"{DATA}/evaluation_results/summary_{ds}.tsv")
        for g in gold.collect():
            r = got.get((g.Task, g.Model, g.Action or ""))
            if r is None:
                missing.append((ds, g.Task, g.Model, g.Action))
                continue
            compared += 1
            for mine, theirs in (
                ("average_all", "Average_All"), ("ratio_empty", "Ratio_empty"), ("average_no_empty", "Average_NoEmpty"),
                ("binary_rate", "Binary_count"), ("disjoint_count", "B_Intersected_C_EmptyCount"),
            ):
                assert r[mine] == pytest.approx(float(g[theirs]), abs=1e-9), (ds, g, mine)
    assert compared == 141 and len(missing) == 3


@needs_data
def test_label_histogram(spark):
    docs = readers.read_documents(spark, f"{DATA}/answers/rel_classification_and_questions")
    rows = readers.entries(docs.filter(~F.element_at(F.split("file_path", "/"), -1).startswith("Q")))
    lab = with_canonical_labels(rows.withColumn("label", label_text(F.col("raw"))), {"label": "label"})
    got = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}
    assert got == {
        "Contains": 4728, "Overlap": 1281, "Equivalence": 127, "ContainedBy": 86, "Unknown": 73, "Disjoint": 63, "Else": 15,
    }


@needs_data
def test_classified_relations_by_vocabulary(spark):
    llms = sorted({
        f.rsplit("_", 1)[1][:-5]
        for _, _, fs in os.walk(f"{DATA}/answers/rel_classification_and_questions") for f in fs if f.endswith(".json")
    })
    t = readers.read_classified_relations(spark, f"{DATA}/answers/rel_classification_and_questions", llms)
    cells = t.select(F.explode(F.array("r_12", "r_13", "r_134")).alias("l")).filter("l is not null")
    got = {r.l: r["count"] for r in cells.groupBy("l").count().collect()}
    assert got == {
        "Contains": 3653, "Overlap": 938, "Equivalence": 102, "ContainedBy": 67, "Disjoint": 56, "Unknown": 43, "Else": 14,
    }
    assert "llama3.1:8b" in {r.llm for r in t.select("llm").distinct().collect()}


@needs_data
def test_score_documents(spark):
    s = readers.read_scores(spark, [f"{DATA}/answers/zero-shot/{d}/relation-classification" for d in ("qawiki", "spinach", "synthetic")])
    out = scores.summarise_score_files(s, ["file_path"]).collect()
    assert len(out) == 44 and all(r.size > 0 for r in out)
    assert sum(r.average_score is None for r in out) == 2  # the two files that hold lists


@needs_data
def test_answer_files_scan(spark):
    a = readers.read_answers(spark, f"{DATA}/answers", ["grok-4-0709", "deepseek-reasoner", "deepseek-r1:1.5b", "llama3.3:8b"])
    got = {(r.llm, r.action, r.q_serie): r.n for r in a.groupBy("llm", "action", "q_serie").agg(F.count("*").alias("n")).collect()}
    assert got[("grok-4-0709", "zero-shot", "Q1")] > 0
    assert got[("deepseek-reasoner", "star", "Q1")] > 0
    assert got[("deepseek-r1:1.5b", "fixing", "Q2")] > 0


def test_heatmap_round_trip(spark):
    order = [f"model-{i}.{i % 3}:b" for i in range(30)]
    index = reshape.index_map(spark, order).orderBy("idx").collect()
    assert [(r.idx, r.llm) for r in index] == list(enumerate(order, 1))
    assert [r.letter for r in index][:2] == ["A", "B"] and index[25].letter == "Z" and index[26].letter == "AA"
    long = reshape.model_grid(spark, order).select(
        F.lit("zero-shot").alias("action"), F.lit("overall").alias("dataset"), F.lit("x").alias("predicate"), "llm_i", "llm_j",
        F.when(F.col("llm_i") == F.col("llm_j"), 1.0).otherwise(F.length(F.concat("llm_i", "llm_j")) / 100).alias("p"),
    )
    wide = reshape.widen_matrix(long, order)
    back = reshape.heatmap_cells(wide, order, "zero-shot", "overall").collect()
    assert len(back) == 900
    assert all(r.val == (1.0 if r.i == r.j else len(order[r.i - 1] + order[r.j - 1]) / 100) for r in back)
    square = reshape.square_matrix(wide, order, "zero-shot", "overall", "x").collect()
    assert len(square) == 30 and all(r[r.llm] == 1.0 for r in square)


def test_question_numbering(spark, tmp_path):
    folder = tmp_path / "en"
    folder.mkdir()
    for ds, n in (("a", 5000), ("b", 3)):
        with open(folder / f"{ds}.tsv", "w", encoding="utf-8") as f:
            f.write("Q1\tQ2\tQ3\tQ4\n")
            f.writelines(f'{ds}{i}\t"two\nlines {i}"\tx\ty\n' if ds == "b" else f"{ds}{i}\tq\tx\ty\n" for i in range(n))
    got = readers.read_questions(spark, str(tmp_path), ["a", "b"], ["en"]).collect()
    assert len(got) == 5003
    assert all(r.Q1 == f"{r.dataset}{r.q_index}" and r.lang == "en" for r in got)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of one file
    try:
        split = readers.read_questions(spark, str(folder / "a.tsv"), multiline=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(split) == 5000 and all(r.Q1 == f"a{r.q_index}" for r in split)


def write_tree(root):
    sets = {"Q1": {"0": ["a", "b"], "1": ["idk"], "2": []}, "Q2": {"0": ["b", "a"], "1": ["x"], "2": []},
            "Q3": {"0": ["a"], "1": [], "2": []}, "Q4": {"0": ["b"], "1": [], "2": "not a list"}}
    tasks = {"Q1": ["equal", "sup-sub", "minus"], "Q2": ["equal"], "Q3": ["sup-sub", "minus"], "Q4": ["minus"]}
    once = {"Q1": ["equal"], "Q2": ["equal"], "Q3": ["sup-sub"], "Q4": ["minus"]}
    for llm in ("m1:7b", "m2"):
        for action, folder, where, tag in (
            ("zero-shot", "zero-shot", once, ""), ("fixing", "follow_up_fixing", tasks, "fixing_"),
        ):
            for q, ts in where.items():
                for t in ts:
                    d = root / "answers" / folder / "spinach" / t
                    d.mkdir(parents=True, exist_ok=True)
                    data = dict(sets[q])
                    if llm == "m2" and q == "Q2" and action == "zero-shot":
                        data["0"] = ["other"]
                    (d / f"{q}_{t}_answers_{tag}{llm}.json").write_text(json.dumps(data))
        d = root / "answers" / "zero-shot" / "spinach" / "relation-classification"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"Relation_{llm}.json").write_text(json.dumps({
            "0": ["Equivalence", "Contains", "Contains", "Disjoint", "Equivalence"],
            "1": ["Overlap", "Contains", "contains", "none", None],
        }))
        d = root / "answers" / "rel_classification_and_questions" / "spinach" / "equal"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"Equivalence_equal_relation_{llm}.json").write_text(json.dumps({"0": "equivalent", "1": ["overlap"]}))
    (root / "models.json").write_text(json.dumps({
        "m1:7b": {"ID": 1, "score": 10.0, "release_date": "2024-01-01", "company": "c", "size": "7b"},
        "m2": {"ID": 2, "score": None, "release_date": "2025-01-01", "company": "d", "size": 12},
    }))
    q = root / "Dataset" / "en"
    q.mkdir(parents=True)
    (q / "spinach.tsv").write_text("Q1\tQ2\tQ3\tQ4\n" + "".join(f"a{i}\tb{i}\tc{i}\td{i}\n" for i in range(3)))


def test_evaluation_of_a_file_tree(spark, tmp_path):
    write_tree(tmp_path)
    out = str(tmp_path / "out")
    r = evaluation.evaluate_files(spark, str(tmp_path / "answers"), str(tmp_path / "models.json"), str(tmp_path / "Dataset"), out=out)
    a = {(x.q_id, x.action, x.llm): x for x in r.analysis.collect()}
    assert len(a) == 12
    assert (a["0", "zero-shot", "m1:7b"].eq_a1_a2, a["0", "zero-shot", "m2"].eq_a1_a2) == (1, 0)
    assert a["0", "zero-shot", "m2"].sc_a1_a2 == 0 and a["2", "zero-shot", "m2"].sc_a1_a2 is None
    assert a["1", "zero-shot", "m2"].sc_a3_a4 is None and a["1", "zero-shot", "m1:7b"].q3 == "c1"
    assert a["2", "fixing", "m2"].a4 == []
    s = {(x.dataset, x.action, x.llm): x for x in r.summary.collect()}
    assert s["overall", "zero-shot", "m2"].eq_a1_a2 == pytest.approx(1 / 3, abs=1e-4)
    assert s["spinach", "zero-shot", "m2"].eq_a1_a2_pos == 0.0
    assert s["overall", "fixing", "m2"].p_eq_a1_a2 == 0.5 and s["overall", "zero-shot", "m2"].p_eq_a1_a2 == 1.0
    p = {(x.action, x.predicate, x.llm_i, x.llm_j): x for x in r.pairwise.filter("dataset = 'overall'").collect()}
    assert p["zero-shot", "eq_a1_a2", "m1:7b", "m2"].p == 0.5 and p["zero-shot", "eq_a1_a2", "m2", "m1:7b"].p == 1.0
    back = spark.read.option("header", "true").csv(f"{out}/summary")
    assert {"?A1=A2", "J(1-34)+", "p(A3∅A4)", "J_A1_ave"} <= set(back.columns)
    assert spark.read.option("header", "true").csv(f"{out}/heatmaps/heatmaps").count() == 6 * 4
    acc = {(x.llm, x.relation): x for x in r.relation_table.filter("dataset = 'overall'").collect()}
    assert acc["m2", "r_14"].accuracy == "0.5000(1)" and acc["m2", "r_14"]["Else"] == "0.5000(1)"
    assert acc["m2", "r_134"]["Unknown"] == "0.5000(1)"


def test_incremental_ingest(spark, tmp_path):
    write_tree(tmp_path)
    args = (spark, str(tmp_path / "answers" / "zero-shot"), str(tmp_path / "table"), str(tmp_path / "cp"), ["m1:7b", "m2"])
    ingest_answers(*args).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "table")).count()
    assert n == 2 * 4 * 3
    ingest_answers(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == n
    late = tmp_path / "answers" / "zero-shot" / "qawiki" / "equal"
    late.mkdir(parents=True)
    (late / "Q1_equal_answers_m2.json").write_text('{"7": ["z"]}')
    ingest_answers(*args).awaitTermination()
    t = spark.read.parquet(str(tmp_path / "table"))
    assert t.count() == n + 1 and t.filter("q_id = '7'").first().dataset == "qawiki"


def test_optional_path_rules(spark):
    docs = spark.createDataFrame(
        [("/x/zero-shot/LC-QuAD/equal/Q1_equal_answers_m.json", '{"0": ["a"]}'),
         ("/x/zero-shot/spinach/equal/*Q2_equal_answers_wikidata_m.json", '{"1": ["b"]}')],
        "file_path string, value string",
    )
    assert readers.parse_answers(docs, ["m"]).count() == 0
    assert [(r.q_id, r.dataset) for r in readers.parse_answers(docs, ["m"], ignore_case=True).collect()] == [("0", "lc-quad")]
    r = readers.parse_answers(docs, ["m"], starred_language="es").collect()
    assert [(x.q_id, x.q_serie, x.action, x.lang) for x in r] == [("1", "Q2", "wikidata", "es")]


def test_containment_filed_under_q2(spark):
    from accordant.operators.answers import answer_slots, q2_containment_as_q3

    rows = [("0", s, "classification", t, "d", "m", [e], "f") for s, t, e in (
        ("Q1", "equal", "a"), ("Q2", "equal", "b"), ("Q2", "sup-sub", "c"), ("Q3", "minus", "d"), ("Q4", "minus", "e"))]
    df = spark.createDataFrame(
        rows, "q_id string, q_serie string, action string, task string, dataset string, llm string, answer array<string>, file_path string"
    )
    assert answer_slots(df).first().c3 == []
    fixed = answer_slots(q2_containment_as_q3(df)).first()
    assert (fixed.c3, fixed.e2) == (["c"], ["b"])


def test_labels_cover_the_vocabulary():
    assert set(names.TRUE_LABELS.values()) <= set(names.CANONICAL_LABELS)
    assert set(relations.CONTRADICTION_SPEC[0]) == {"sc_a1_a2", "eq_a1_a2", "r_12", "Equivalence"}


def test_malformed_documents_stop_the_job(spark, tmp_path):
    folder = tmp_path / "zero-shot" / "qawiki" / "equal"
    folder.mkdir(parents=True)
    good, bad = folder / "Q1_equal_answers_m1.json", folder / "Q2_equal_answers_m1.json"
    good.write_text(json.dumps({"0": ["a"], "1": "no list", "2": []}))
    rows = readers.read_answers(spark, str(tmp_path), ["m1"])
    assert sorted((r.q_id, tuple(r.answer)) for r in rows.collect()) == [("0", ("a",)), ("1", ()), ("2", ())]
    for text in ('{"0": ["a"], "1": [', " ", "[1]"):
        bad.write_text(text)
        with pytest.raises(Exception, match="(?i)malformed|no JSON document"):
            readers.read_answers(spark, str(tmp_path), ["m1"]).collect()
    bad.write_text("{}")
    assert rows.count() == 3
    (folder / "Relation_m1.json").write_text(json.dumps({"0": ["a", "b", "c", "d"]}))
    with pytest.raises(Exception, match="fewer than five labels"):
        readers.read_relations(spark, str(tmp_path), ["m1"]).collect()


def test_answer_documents_take_text_ids_and_repeats(spark):
    from accordant.sources.writers import answer_documents

    key = ("fixing", "equal", "qawiki", "Q1", "m1")
    rows = [(f"id-{i}", *key, [str(i)], "p2") for i in range(50)] + [("id-3", *key, ["first"], "p1"), ("id-3", *key, ["3"], "p2")]
    df = spark.createDataFrame(rows, "q_id string, action string, task string, dataset string, q_serie string, llm string, answer array<string>, file_path string")
    docs = answer_documents(df, ids_per_file=10).collect()
    got = {k: v for d in docs for k, v in json.loads(d.value).items()}
    assert got == {f"id-{i}": ["first"] if i == 3 else [str(i)] for i in range(50)}
    assert len(docs) == 5 and sum(d.n_ids for d in docs) == 50
