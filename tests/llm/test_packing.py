import random
import zlib

import numpy as np
import pytest

from accordant.llm.packing import first_fit_decreasing, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start int, length string, sequence_id string, at int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], SCHEMA).repartition(parts)


def test_tree_equals_plain_first_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 120))]
        where, offset = first_fit_decreasing(np.array(sizes), 50)
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, used in enumerate(bins) if used + sizes[i] <= 50), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += sizes[i]
        assert {i: (int(where[i]), int(offset[i])) for i in range(len(sizes))} == want


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    some = ["the", "quick", "Brown", "fox!", "don't", "é́", "　x", "<|endoftext|>", "日本", "\x1c", "12,5", "a b", "I'LL"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(some, k=rng.choice([0, 1, 5, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (3, "again"), (3, "again")]
    got = pack(frame(spark, rows), PATH, length=512).collect()
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    starts, left = {}, []
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert 0 < r.length <= 512 and r.start % 512 == 0
        starts.setdefault((r.doc_id, r.start), []).append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 512):
            crc = zlib.crc32(np.array(ids[s:s + 512], "<u4").tobytes())
            match = next(r for r in starts[i, s] if r.ids_crc32 == crc and r.doc_tokens == len(ids) and r.length == len(ids[s:s + 512]))
            starts[i, s].remove(match)
            left.append(match)
    assert len(left) == len(got) and sum(r.length for r in got) == sum(map(len, want))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in sequences.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 512
    padding = sum(512 - sum(n for _, n in s) for s in sequences.values())
    assert padding < 512 + 0.02 * sum(map(len, want))


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH).collect() == []
