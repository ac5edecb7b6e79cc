import os

import pytest

import corpus_pipeline
from accordant.llm.queries import QUERIES, SQL

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], ROOT).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_takes_effect_on_its_input(spark, stages):
    from accordant.llm import toxicity
    from test_exact_dedup import norm
    from test_jaccard import expected
    from test_mixing import targets

    docs, clean, distinct, single, mixed, packed = stages
    columns = docs.columns
    assert all(s.columns == columns for s in stages[:-1])
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, "t").select("doc_id", "t.score").collect()
    assert ids(clean) == sorted(r.doc_id for r in scored if r.score < 0.5) and 0 < clean.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    first = {}
    for i, t in rows:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert ids(distinct) == sorted(first.values())
    rows = [(r.doc_id, r.text) for r in distinct.collect()]
    assert ids(single) == sorted({c if n else i for i, n, c in expected(rows)[0]})
    sizes, taken, of = {}, {}, {}
    for r in single.collect():
        of[r.doc_id] = (r.source, len(r.text.split()))
        sizes[r.source] = sizes.get(r.source, 0) + of[r.doc_id][1]
    for i in ids(mixed):
        taken[of[i][0]] = taken.get(of[i][0], 0) + of[i][1]
    for s, t in targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= max(n for x, n in of.values() if x == s)
    assert set(ids(packed)) == set(ids(mixed))
    assert packed.filter("start = 0").count() == mixed.count()


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, ROOT)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    from oracle_check import compare, connect

    ok, message, _ = compare(spark, connect(ROOT), QUERIES[name], SQL[name], ROOT)
    assert ok, message


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) == {n for n in QUERIES if n.split("_")[0] in ("op3", "op6", "op9", "op10", "op11", "op12")}
