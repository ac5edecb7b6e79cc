"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import whole, written

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 16_384  # pieces that are packed together, about
BATCH_BYTES = 1 << 22  # text encoded at once
WORD_END = "</w>"  # what the vocabulary puts behind the last token of a word
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Free room of bins as a tournament: the root knows the largest, and the first bin that fits is found from it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Take ``length`` from the first bin with room for it; its number, or -1."""
        free, at = self.free, 1
        if free[1] < length:
            return -1
        while at < self.size:
            at *= 2
            if free[at] < length:
                at += 1
        free[at] -= length
        found = at - self.size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: items by falling length (ties in order), each in the first bin with room."""
    order = np.argsort(-lengths, kind="stable")
    # First fit leaves no two bins half empty, so twice the sum is enough room.
    tree = TournamentTree(max(1, min(len(lengths), 2 * int(lengths.sum()) // capacity + 2)), capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: dict[int, int] = {}
    for i in order.tolist():
        n = int(lengths[i])
        b = tree.place(n)
        if b < 0:
            raise ValueError("an item is longer than a bin")
        where[i], offset[i] = b, used.get(b, 0)
        used[b] = offset[i] + n
    return where, offset


def _kind_table() -> np.ndarray:
    """Per byte: 1 white space, 2 ASCII letter, 3 ASCII sign that no letter can belong with, 0 anything else."""
    kinds = np.zeros(256, np.uint8)
    kinds[[32, *range(9, 14)]] = 1
    kinds[[*range(65, 91), *range(97, 123)]] = 2
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
    return kinds


KINDS = _kind_table()


def units_of(raw: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units in a buffer of texts, lower-cased in ASCII, and per text the number of the first one (one more at the end).

    Units are words, cut between an ASCII letter and a sign where the vocabulary cuts as well; words stay
    whole in a buffer that may hold the vocabulary's special texts, which begin with ``<|``.  ``edges``
    are the places in the buffer where texts begin, and its end.
    """
    kinds = KINDS[raw]
    solid = kinds != 1
    begins = solid.copy()
    if len(raw) > 1:
        joined = solid[:-1].copy()
        if b"<|" not in raw.tobytes():
            joined &= kinds[1:] + kinds[:-1] != 5  # a letter next to a sign
        begins[1:] &= ~joined
    inner = edges[:-1][edges[:-1] < len(raw)]
    begins[inner] = solid[inner]  # a text begins a unit of its own
    starts = np.flatnonzero(begins)
    kept = raw[solid]
    kept = kept + ((kept >= 65) & (kept <= 90)).astype(np.uint8) * np.uint8(32)
    sizes = np.add.reduceat(solid, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(kept)]
    )
    return units, np.searchsorted(starts, edges, side="left")


class Encoder:
    """Ids of whole texts.

    The vocabulary lower-cases, drops white space and never joins text across it, or across the edge of
    letters and signs; so a text's ids are those of its units one after the other.  The distinct units
    of a batch are encoded once, many in one call, and their ids are gathered by index; nothing is kept
    from batch to batch but the vocabulary.
    """

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The encoder of this worker process, whose tasks load the vocabulary once."""
        state = sys.modules.setdefault("_packing_worker", types.ModuleType("_packing_worker"))
        held = vars(state).setdefault("encoders", {})
        if path not in held:
            held.clear()
            held[path] = cls(path)
        return held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.encode_fast = tokenizer.encode, tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and how many each word has.

        A word of letters has one id that ends a word, its last, so many such words are encoded as
        one text; where the number of ends is not that of the words, and for all other words, the
        encoder says which id is whose.
        """
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for kind in (True, False):
            own = np.flatnonzero(plain == kind)
            for lo in range(0, len(own), 2048):
                some = own[lo:lo + 2048]
                part = [words[i] for i in some]
                ids = np.asarray(self.encode_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32) if kind else None
                last = np.flatnonzero(self.ends[ids]) if kind else None
                if kind and len(last) == len(part) and last[-1] == len(ids) - 1:
                    counts[some] = np.diff(last, prepend=-1)
                else:
                    e = self.encode(part, is_pretokenized=True, add_special_tokens=False)
                    ids = np.asarray(e.ids, np.uint32)
                    counts[some] = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(part))
                found.append((some, ids))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for some, ids in found:
            n = counts[some]
            out[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def texts(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and per text the place of its first one (one more at the end)."""
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8)
        units, first = units_of(raw, edges - edges[0])
        if not len(units):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = units.dictionary_encode()
        known, counts = self.ids_of(coded.dictionary.cast(pa.large_string()).to_pylist())
        begin = np.cumsum(counts) - counts
        unit = coded.indices.to_numpy()
        n = counts[unit]
        upto = np.r_[0, np.cumsum(n)]
        ids = known[np.repeat(begin[unit] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[first]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document's ids (its end id included): full pieces first, then the rest."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        for b in batches:
            texts = b.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(texts):  # as many texts as fit the batch, one at least
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, side="right")))
                ids, at = encoder.texts(texts.slice(lo, hi - lo).cast(pa.large_string()))  # not all at once
                out: list[tuple[int | None, int, int, int, int]] = []
                for doc, a, z in zip(b.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), length):
                        part = own[start:start + length]
                        out.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                lo = hi
        pa.default_memory_pool().release_unused()  # the worker lives on, its next task may be another's

    return docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, seed: int = 23
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are cut into full sequences and one rest; the rests of a random group of
    documents are packed by first-fit decreasing.  Every id lies in one piece, and the pieces of a
    sequence follow each other from 0 without gaps.  A null or empty text is one piece with the end id alone.  Rows that
    repeat an id, or have none, are documents of their own.  Other columns are not read; an empty
    table gives no rows.
    """
    cut = pieces(docs, tokenizer, key, text, length, end_id).withColumn("at", F.monotonically_increasing_id())
    cut = written(cut.withColumn("draw", F.xxhash64("at", "doc_id", F.lit(seed))), "pieces")
    rests = cut.filter(F.col("length") < length)
    groups = max(1, round(rests.count() / GROUP_PIECES))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "at"], kind="stable")
        where, offset = first_fit_decreasing(pdf["length"].to_numpy(np.int64), length)
        # The first piece of a bin names the sequence: its row number is unique.
        first = pdf["at"].to_numpy(np.int64)[offset == 0]
        name = np.zeros(where.max() + 1, np.int64)
        name[where[offset == 0]] = first
        return pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": name[where], "offset": offset})

    packed = rests.withColumn("pack", F.pmod("draw", F.lit(groups))).groupBy("pack").applyInPandas(
        fill, PIECES + ", sequence_id long, offset long"
    )
    full = cut.filter(F.col("length") == length).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("at").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed)
