"""Records with quoted line ends, read from files that are split anywhere."""

import csv
import io
import random

import pytest

from accordant.sources import readers
from accordant.sources.records import numbered_records, read_lines

HEADER = "Q1\tQ2\tQ3\tQ4"


def records_of(text):
    """A plain reading, character by character: records with their line ends, blank ones left out."""
    out, now, state = [], "", "start"
    for ch in text:
        if state in ("start", "bare", "closed") and ch == "\n":
            out.append(now)
            now, state = "", "start"
            continue
        now += ch
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "\t" else "bare"
        elif state == "quoted":
            state = "closed" if ch == '"' else "quoted"
        elif state == "closed":
            state = "quoted" if ch == '"' else "start" if ch == "\t" else "bare"
        elif ch == "\t":
            state = "start"
    if now:
        out.append(now.removesuffix("\n"))  # a text that is never closed ends with the file
    strip = [r[:-1] if r.endswith("\r") else r for r in out]
    return [r for r in strip if r.strip(" \r")]


def read(spark, path, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return numbered_records(read_lines(spark, str(path), "*.tsv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [16, 200, 1 << 20])
def test_records_against_a_plain_reading(spark, tmp_path, size):
    rng = random.Random(size)
    field = lambda: "".join(rng.choice(['"', '""', "\n", "\r\n", "a", "bc", " ", "é", "x\ty", '"z"']) for _ in range(rng.randrange(6)))
    want = {}
    for f in range(4):
        rows = []
        for _ in range(60):
            cells = [
                '"' + field().replace('"', '""') + '"' if rng.random() < 0.6 else field().replace("\n", "").replace("\r", "").replace("\t", "")
                for _ in range(4)
            ]
            rows.append("\t".join(cells) + rng.choice(["\n", "\r\n", "\n\n", "\n  \n"]))
        text = HEADER + "\n" + "".join(rows)
        (tmp_path / f"d{f}.tsv").write_bytes(text.encode())
        want[f"d{f}.tsv"] = records_of(text)
    got = {}
    for r in read(spark, tmp_path, size):
        got.setdefault(r.file_path.rsplit("/", 1)[1], {})[r.position] = r.record
    assert {f: [rs[i] for i in range(len(rs))] for f, rs in got.items()} == want


def test_one_text_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i}\t" + '""' * (i % 3) for i in range(500))
    (tmp_path / "a.tsv").write_text(f'{HEADER}\nfirst\t"{long}"\tx\ty\n\nlast\tb\tc\td', encoding="utf-8")
    got = {r.position: r.record for r in read(spark, tmp_path, 64)}
    assert sorted(got) == [0, 1, 2] and got[1] == f'first\t"{long}"\tx\ty' and got[2].startswith("last")


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_questions_as_a_csv_reader_sees_them(spark, tmp_path, size):
    rng = random.Random(3)
    folder = tmp_path / "es"
    folder.mkdir()
    rows = [
        [f"{i}", *["".join(rng.choice(["a\nb", "c\r\nd", "\r", 'say "x"', "\t", " lead", "é", "tail "]) for _ in range(rng.randrange(1, 5))) for _ in range(3)]]
        for i in range(300)
    ]
    text = io.StringIO()
    w = csv.writer(text, delimiter="\t", lineterminator="\n")
    w.writerow(HEADER.split("\t"))
    w.writerows(rows)
    (folder / "many.tsv").write_bytes(text.getvalue().encode())
    (folder / "other.tsv").write_bytes((HEADER + '\n"\n').encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = readers.read_questions(spark, str(tmp_path), ["many"], ["es"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 300
    for r in got:
        assert [r.Q1, r.Q2, r.Q3, r.Q4] == rows[r.q_index] and (r.dataset, r.lang) == ("many", "es")


def test_empty_fields_and_files(spark, tmp_path):
    folder = tmp_path / "en"
    folder.mkdir()
    (folder / "none.tsv").write_text("")
    (folder / "head.tsv").write_text(HEADER + "\n")
    (folder / "gaps.tsv").write_text(HEADER + '\na\t\t""\td\n\t\t\t\nz\n')
    got = {r.q_index: r for r in readers.read_questions(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].Q2 is None and got[0].Q1 == "a" and got[0].Q4 == "d"
    assert got[1].Q1 is None and got[1].Q4 is None and got[2].Q1 == "z" and got[2].Q2 is None
