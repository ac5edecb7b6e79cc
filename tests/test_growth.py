"""Plans that must not shuffle or sort more than the data asks for."""

from accordant.operators import answers as ans
from accordant.sources import tables

KEYS = "q_id string, q_serie string, action string, task string, dataset string, llm string, answer array<string>, file_path string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, path, n=40):
    def save(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    save([(i, f"C{i}", i % 3, "BUILDING") for i in range(4)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string", "customer")
    save([(i, i % 4, "5-LOW") for i in range(10)], "o_orderkey long, o_custkey long, o_orderpriority string", "orders")
    rows = [
        (i % 10, None if i % 9 == 0 else i % 5, i, None if i % 7 == 0 else float(i + 10), 0.05, 0.02 * (i % 5), "RNA"[i % 3], "OF"[i % 2], 100.0, i % 7 + 1)
        for i in range(n)
    ]
    save(rows, (
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_extendedprice double, l_linenumber int"
    ), "lineitem")


def test_order_lines_are_shuffled_with_their_rules_as_one_number(spark, tmp_path):
    _lines(spark, str(tmp_path))
    df = tables.order_lines(spark, str(tmp_path))
    assert df.count() == 40
    rows = {r.e1 for r in df.select("e1").collect()}
    assert rows == {True, False}  # an unknown quantity is in no set
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join")[1]
    assert "AS rules" in below and plan.count("Join") == 2


def test_wide_answers_are_dealt_once_for_elements_sets_and_slots(spark, tmp_path):
    _lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        slots = ans.answer_slots(tables.wide_answers(spark, str(tmp_path)))
        assert _plan(slots).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_repeats_and_questions_of_answers_share_one_shuffle(spark):
    rows = [
        ("1", "Q1", "fixing", "equal", "d", "m", ["b"], "/b"), ("1", "Q1", "fixing", "equal", "d", "m", ["a"], "/a"),
        ("2", "Q2", "fixing", "equal", "d", "m", None, "/a"), ("3", "Q4", "fixing", "equal", "d", "m", ["z"], None),
        (None, "Q1", "fixing", "equal", "d", "m", ["n"], "/n"),
    ]
    df = spark.createDataFrame(rows, KEYS)
    questions = spark.createDataFrame([(1, "t1", None, "d"), (2, "u1", "u2", "d")], "q_index long, Q1 string, Q2 string, dataset string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rich = ans.enrich_answers(df, questions)
        assert _plan(rich).count("Exchange hashpartitioning") == 2  # one of the answers, one of the questions
        got = {r.q_id: (r.question, r.answer) for r in rich.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {"1": ("t1", ["a"]), "2": ("u2", []), "3": (None, []), None: (None, ["n"])}


def test_first_by_path_sorts_after_the_shuffle_only(spark):
    df = spark.createDataFrame([("1", "/b", 2), ("1", "/a", 1), ("2", None, 3)], "k string, file_path string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = ans.first_by_path(df, ["k"])
        below = _plan(first).split("Exchange hashpartitioning")[1]
        assert "Sort" not in below
        assert sorted(map(tuple, first.collect())) == [("1", "/a", 1), ("2", None, None)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_first_rows_join_the_lowest_paths_by_broadcast(spark):
    from accordant.operators.analysis import first_rows

    cols = "q_id string, q_serie string, action string, task string, dataset string, llm string, element string, file_path string"
    df = spark.createDataFrame([("1", "Q1", "fixing", "equal", "d", "m", e, p) for e, p in (("x", "/a"), ("y", "/b"), ("z", "/a"))], cols)
    rows = first_rows(df)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan
    assert sorted(r.element for r in rows.collect()) == ["x", "z"]


def test_answer_documents_do_not_shuffle_answers_to_count_them(spark):
    from accordant.sources.writers import answer_documents

    rows = [(str(i), "Q1", "fixing", "equal", "d", "m", ["b"], "/b") for i in range(30)]
    docs = answer_documents(spark.createDataFrame(rows, KEYS), ids_per_file=10)
    assert "BroadcastHashJoin" in docs._jdf.queryExecution().sparkPlan().toString()
    assert sum(r.n_ids for r in docs.collect()) == 30


def test_pieces_of_members_are_looked_at_once(spark):
    from accordant.sources.members import members

    text = '{"a": ["x, y", "{"], "b": null}'
    pieces = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(text.split('"'))], "file_path string, block long, pos long, value string")
    df = members(pieces)
    assert "regexp_replace(value" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.select("q_id", "raw").collect())) == [("a", '["x, y","{"]'), ("b", None)]


def test_sets_are_shuffled_as_numbers_and_repeats_stay_where_they_lie(spark, tmp_path):
    _lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tables.answers(spark, str(tmp_path))
        first = ans.first_by_path(rows, ["q_id", "q_serie", "dataset", "llm"], dealt=True)
        plan = _plan(first)
        # Lines and orders by order, then orders and customers by question: nothing of the sets.
        assert plan.count("Exchange hashpartitioning") == 4 and plan.count("REPARTITION_BY_NUM") == 1
        below = plan.split("REPARTITION_BY_NUM")[1]
        assert "answer" not in below and "file_path" not in below
        assert first.count() == rows.select("q_id", "q_serie", "dataset", "llm").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_answers_of_repeated_keys_and_unknown_parts_are_the_sets_of_their_lines(spark, tmp_path):
    path = str(tmp_path)
    _lines(spark, path)
    for t in ("customer", "orders"):  # every key twice
        df = spark.read.parquet(f"{path}/{t}.parquet")
        spark.createDataFrame(df.collect() * 2, df.schema).write.parquet(f"{path}/twice/{t}.parquet")
    spark.read.parquet(f"{path}/lineitem.parquet").write.parquet(f"{path}/twice/lineitem.parquet")
    lines = [r.asDict() for r in tables.order_lines(spark, path).collect()]
    want = {}
    for r in lines:
        once = r["action"] == "zero-shot"
        for s, (serie, task, other) in tables.CELLS.items():
            asked = once if s == "star" else not once or s in ("e1", "e2", "c3", "m4")
            if r[s] and asked:
                key = (r["q_id"], serie, other or r["action"], task, r["dataset"], r["llm"])
                want.setdefault(key, set()).add(r["element"] or "1")
    for root in (path, f"{path}/twice"):
        rows = tables.answers(spark, root).collect()
        assert {tuple(r[c] for c in ans.ANSWER_KEYS): set(r.answer) for r in rows} == want
        assert len(rows) == len(want) and all(len(set(r.answer)) == len(r.answer) for r in rows)


def test_parts_grow_with_the_files(spark, tmp_path):
    from accordant.session import bucket_count, parts_for

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"0" * (9 << 20))
    assert parts_for(spark, [str(tmp_path / "a")], 64) == bucket_count(spark)
    assert parts_for(spark, [str(tmp_path / "a"), str(tmp_path / "a" / "x")], 1) == max(18, bucket_count(spark))


def test_wide_answers_hash_and_sort_no_line_by_its_element(spark, tmp_path):
    _lines(spark, str(tmp_path))
    df = tables.wide_answers(spark, str(tmp_path))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "element" not in "".join(x.split("functions=")[0] for x in plan.split("\n") if "Aggregate(key" in x)
    got = {tuple(r[c] for c in ans.ANSWER_KEYS): sorted(r.answer) for r in df.collect()}
    want = {}
    for r in tables.answer_elements(spark, str(tmp_path), tables.WIDE).collect():
        found = want.setdefault(tuple(r[c] for c in ans.ANSWER_KEYS), [])
        found += [r.element] if r.element is not None else []
    assert got == {k: sorted(v) for k, v in want.items()}


def test_answer_documents_deal_rows_once_by_directory_and_run(spark):
    from accordant.sources import writers

    rows = [(str(i), "Q1", "fixing", "equal", "d", f"m{i % 2}", ["b"], "/b") for i in range(400)]
    docs = writers.answer_documents(spark.createDataFrame(rows, KEYS), ids_per_file=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        exchanges = [x for x in _plan(docs).split("\n") if "Exchange hashpartitioning" in x]
        assert len(exchanges) == 1 and "run" in exchanges[0] and "llm" not in exchanges[0]
        # A directory of 100 documents is two runs of at most 64, so a large one is dealt to several tasks.
        assert docs.groupBy("llm").agg({"n_ids": "sum"}).count() == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = docs.collect()
    assert sum(r.n_ids for r in found) == 400 and max(r.shard for r in found) >= writers._TOGETHER
