"""Members of JSON objects against a plain reader, with splits that fall anywhere."""

import json
import random

import pytest

from accordant.sources.members import read_members


def value(rng, deep=3):
    kind = rng.randrange(8)
    if kind < 3 and deep:
        return [value(rng, deep - 1) for _ in range(rng.randrange(4))]
    if kind == 3 and deep:
        return {rng.choice(['k"', "a,b", "{", "\\"]) + str(i): value(rng, deep - 1) for i in range(rng.randrange(3))}
    if kind == 4:
        return rng.choice([None, True, 0.5, -3, 10**12])
    return "".join(rng.choice(['"', "\\", '\\"', ",", "{", "}", "[", "]", ":", "é", "\n", "\t", "a", " ", "\U0001F600"]) for _ in range(rng.randrange(8)))


@pytest.mark.parametrize("size", [32, 300, 1 << 20])
def test_members_against_a_plain_reader(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for f, (indent, ascii_only) in enumerate([(None, True), (4, False), (None, False), (2, True)]):
        data = {rng.choice(["", 'q"', "\\", "x,y", "{"]) + str(i): value(rng) for i in range(60)}
        (tmp_path / f"f{f}.json").write_text(json.dumps(data, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
        want |= {(f"f{f}.json", k): v for k, v in data.items()}
    (tmp_path / "empty.json").write_text(" { \n} ")
    (tmp_path / "compact.json").write_text('{"a":1,"b":[],"c":{},"d":"","e":[[],{"f":[1,2]}],"g":null}\n')
    want |= {("compact.json", k): v for k, v in {"a": 1, "b": [], "c": {}, "d": "", "e": [[], {"f": [1, 2]}], "g": None}.items()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = read_members(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == len(want)
    for r in rows:
        v = want[r.file_path.rsplit("/", 1)[1], r.q_id]
        if isinstance(v, str):
            assert r.raw == v
        else:
            assert (None if r.raw is None else json.loads(r.raw)) == v


@pytest.mark.parametrize("text", ['{"a": 1', "[1, 2]", '{"a": 1, "b": }', '{"a": "x}', "7", '{"a": 1} x'])
def test_what_is_no_object_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json|MALFORMED"):
        read_members(spark, str(tmp_path)).collect()


def test_answer_files_in_parts(spark, tmp_path):
    """The rows of the whole files, from splits much smaller than a file."""
    from accordant.sources import named_files, readers
    from test_named_files import LLMS, answers

    named_files.write_answer_files(answers(spark), str(tmp_path))
    (tmp_path / "zero-shot/spinach/equal/Q9_other_answers_nobody.json").write_text("not read")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        parts = sorted(map(str, readers.read_answers(spark, str(tmp_path), LLMS, in_parts=True).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "zero-shot/spinach/equal/Q9_other_answers_nobody.json").unlink()
    assert parts == sorted(map(str, readers.read_answers(spark, str(tmp_path), LLMS).collect())) and len(parts) > 300


def test_members_larger_than_a_chunk(spark, tmp_path, monkeypatch):
    """Members that begin, end and lie whole in chunks, some over many chunks; pieces that come in any order."""
    import random

    from pyspark.sql import functions as F

    from accordant.sources import members

    monkeypatch.setattr(members, "_CHUNK", 16)
    rng = random.Random(1)
    data = {f"k{i}": value(rng) for i in range(40)} | {"big": ["é\\\\\"\\" * 30, list(range(50)), "a:b,c" * 20]} | {f"m{i}": value(rng) for i in range(40)}
    text = json.dumps(data, ensure_ascii=False)
    for separator in '":':
        rows = [("f", 0, i, v) for i, v in enumerate(text.split(separator))]
        pieces = spark.createDataFrame(rows, "file_path string, block long, pos long, value string").repartition(3, F.col("pos") % 7)
        found = {r.q_id: r.raw for r in members.members(pieces, separator).collect()}
        assert list(found) != [] and found.keys() == data.keys()
        assert all((r if isinstance(data[k], str) else None if r is None else json.loads(r)) == data[k] for k, r in found.items())


@pytest.mark.parametrize("text", ['{"a":1,,"b":[2],\n, "c":{},}', '{ ,"a":1,"b":[2],"c":{}}'])
def test_blank_members_are_left_out(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    assert sorted(map(tuple, read_members(spark, str(tmp_path)).select("q_id", "raw").collect())) == [("a", "1"), ("b", "[2]"), ("c", "{}")]


def test_a_member_that_closes_its_object_is_no_reason_to_lose_the_next(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"z":0,"a":1,"b":2} {"c":3,"d":4,"e":5,"f":6}')
    assert {r.q_id for r in read_members(spark, str(tmp_path)).collect()} == {"z", "a", "b", "d", "e", "f"}


def test_whole_members_are_not_shuffled_piece_by_piece(spark, tmp_path):
    """A file's members stay documents of many, whose path is looked at once; a repeated id stays repeated."""
    from accordant.sources.members import read_member_documents

    (tmp_path / "f.json").write_text("{" + ",".join(f'"{i % 900}":["{i}:x"]' for i in range(1000)) + "}")
    documents = read_member_documents(spark, str(tmp_path))
    found = documents.collect()
    assert sum(r["__members"] for r in found) == 1000 and len(found) < 20
    rows = read_members(spark, str(tmp_path)).collect()
    assert len(rows) == 1000 and {(r.q_id, r.raw) for r in rows} == {(str(i % 900), f'["{i}:x"]') for i in range(1000)}
