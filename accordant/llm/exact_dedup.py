"""Exact de-duplication by counting quotient filters and byte verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import SPACES, Membership, whole, without_rows, written

# Fingerprints per block of the merged filter, and the share of a filter's slots that are filled.
BLOCK_ROWS, LOAD = 1 << 16, 0.95
FILTER_SCHEMA = "block long, slots int, width long, marks binary, remainders binary, repeated binary, counts binary"


def _bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits each, packed without gaps."""
    planes = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8)).tobytes()


def _numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out |= planes[:, i].astype(np.uint64) << np.uint64(i)
    return out


def encoded(values: np.ndarray, n: np.ndarray, bits: int) -> dict:
    """A counting quotient filter of sorted distinct ``values`` below ``2^bits`` with their counts.

    A value's quotient by the slots' width is the slot it wants; only its remainder is stored.  A slot
    that is taken shifts the value to the next, and three marks per slot (occupied: some value wants
    it; continuation: the run of a quotient goes on; shifted: the value wants another slot) say
    which remainder belongs to which quotient.  Counts above one are kept apart.
    """
    slots = max(4, int(np.ceil(len(values) / LOAD)))
    width = -(-(1 << bits) // slots)
    want = (values // np.uint64(width)).astype(np.int64)
    at = np.arange(len(values))
    at = np.maximum.accumulate(want - at) + at
    slots = max(slots, int(at[-1]) + 1)
    marks = np.zeros((3, slots), bool)
    marks[0, want] = True
    marks[1, at[1:]] = want[1:] == want[:-1]
    marks[2, at] = at != want
    remainders = np.zeros(slots, np.uint64)
    remainders[at] = values % np.uint64(width)
    several = np.flatnonzero(n > 1)
    return {
        "slots": slots, "width": width, "marks": np.packbits(marks).tobytes(), "remainders": _bits(remainders, (width - 1).bit_length()),
        "repeated": several.astype("<u4").tobytes(), "counts": n[several].astype("<u8").tobytes(),
    }


def decoded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The values of a filter in order, and their counts; nothing is lost."""
    slots, width = row["slots"], row["width"]
    occupied, goes_on, shifted = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=3 * slots).reshape(3, slots).astype(bool)
    filled = np.flatnonzero(occupied | goes_on | shifted)
    # Runs lie in the order of their quotients, so the k-th run belongs to the k-th occupied slot.
    quotient = np.flatnonzero(occupied)[np.cumsum(~goes_on[filled]) - 1].astype(np.uint64)
    remainders = _numbers(row["remainders"], slots, (width - 1).bit_length())[filled]
    n = np.ones(len(filled), np.uint64)
    n[np.frombuffer(row["repeated"], "<u4")] = np.frombuffer(row["counts"], "<u8")
    return quotient * np.uint64(width) + remainders, n


def _packed(fp: np.ndarray, n: np.ndarray, block_bits: int) -> Iterator[dict]:
    """Blocks of one filter from sorted distinct fingerprints ``fp`` with their counts."""
    rest = 64 - block_bits
    block = fp >> np.uint64(rest) if block_bits else np.zeros(len(fp), np.uint64)
    inside = fp & np.uint64((1 << rest) - 1)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(fp) else []
    for lo, hi in zip(starts, np.r_[starts[1:], len(fp)] if len(fp) else []):
        yield {"block": int(block[lo]), **encoded(inside[lo:hi], n[lo:hi], rest)}


def _summed(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal fingerprints made one, in order, with their counts added."""
    order = np.argsort(fp, kind="stable")
    fp, n = fp[order], n[order]
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, int)
    return fp[first], (np.add.reduceat(n, first) if len(fp) else n)


def quotient_filters(prints: DataFrame, col: str, block_bits: int) -> DataFrame:
    """One counting quotient filter per partition, as rows of blocks by the fingerprints' high bits (see :func:`encoded`)."""
    arrow = pa.schema([
        ("block", pa.int64()), ("slots", pa.int32()), ("width", pa.int64()), *[(c, pa.binary()) for c in ("marks", "remainders", "repeated", "counts")],
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        waiting: list[np.ndarray] = []
        size = 0

        def take() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([fp, *waiting]), np.r_[n, np.ones(sum(map(len, waiting)), np.uint64)])

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += b.num_rows
            if size >= 1 << 20:  # a full buffer becomes filter rows; filters add up without loss
                fp, n = take()
                if len(fp) >= 1 << 21:
                    rows = list(_packed(fp, n, block_bits))
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    fp, n = fp[:0], n[:0]
                waiting, size = [], 0
        fp, n = take()
        rows = list(_packed(fp, n, block_bits))
        for lo in range(0, len(rows), 512):
            yield pa.RecordBatch.from_pylist(rows[lo:lo + 512], schema=arrow)

    return prints.select(col).mapInArrow(build, FILTER_SCHEMA)


def repeated_prints(filters: DataFrame, block_bits: int) -> DataFrame:
    """Merge filters block by block on sorted remainders; fingerprints with a count above one."""
    rest = 64 - block_bits

    def merge(t: pa.Table) -> pa.Table:
        block = np.uint64(t.column("block")[0].as_py())
        parts = [decoded(r) for r in t.to_pylist()]
        fp, n = _summed(np.concatenate([v for v, _ in parts]), np.concatenate([k for _, k in parts]))
        many = n > 1
        fp = fp[many] | (block << np.uint64(rest) if block_bits else np.uint64(0))
        return pa.table({"fp": fp.view(np.int64), "n": n[many].astype(np.int64)})

    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space.  A null text
    is empty, and empty texts are equal to each other.  Of equal texts the smallest id stays (a
    null id comes last); of rows that repeat the id as well, exactly one stays.  Other columns are
    not read, so their names do not matter; an empty table gives no rows.

    Fingerprints are counted in quotient filters, one per partition, merged by sorted remainders.
    Only texts whose fingerprint has a count above one are shuffled, one per task and text, and
    compared byte by byte; a bounded filter keeps the others in place.
    """
    norm = F.regexp_replace(whole(text), SPACES, " ")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), norm.alias("norm"))
    digests = written(
        rows.select(
            "doc_id", F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    bits = min(24, max(0, math.ceil(math.log2(max(1, digests.count()) / BLOCK_ROWS))))
    repeated = written(repeated_prints(quotient_filters(digests, "fp", bits), bits), "repeated")
    seen = Membership(repeated, "fp", repeated.count())
    suspects = seen.mark(rows.withColumn("fp", F.xxhash64("norm")), "fp", "hit").filter("hit")
    verified = (
        suspects.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
        .select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keepers = (
        seen.mark(digests, "fp", "hit").filter("hit").groupBy("fp", "text_sha256").agg(first)
        .join(verified, ["fp", "text_sha256"])
        .select("fp", "text_sha256", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    )
    out = digests.join(written(keepers, "keepers"), ["fp", "text_sha256"], "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged, whatever their names.

    The rules are those of :func:`exact_duplicates`: a null text is empty, the smallest id stays, a null
    id comes last, and of rows that repeat id and text one stays (any of them, where other columns
    differ).  Texts of any length are compared whole; an empty table stays empty.
    """
    marks = exact_duplicates(docs, key, text).filter("group_size > 1").select(
        F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("own"), "kept"
    )
    marks = written(marks, "marks")
    digest = F.sha2(F.regexp_replace(whole(text), SPACES, " ").cast("binary"), 256)
    return without_rows(docs, key, digest, marks.filter("not own"), marks.filter("own and not kept"))
