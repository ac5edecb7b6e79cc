"""Compression of vectors to codes of eight parts, over Hilbert-sorted blocks and in exact integers."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import written

# Rows of one block, and numbers of one chunk: a chunk is sorted and cut into blocks within one task.
BLOCK, CHUNK_NUMBERS = 128, 1 << 22
# Bits of a component that the Hilbert order looks at.
HILBERT_BITS = 4
# Numbers below it keep squares of a part of up to WIDE components in 64 bits; else Python's integers are used.
SMALL, WIDE = 1 << 24, 1 << 12
LIMB = 32


def hilbert_words(points: np.ndarray, bits: int = HILBERT_BITS) -> np.ndarray:
    """Positions of small non-negative integer points on a Hilbert curve, as big-endian bytes per point.

    The transform between axes and the transposed index goes bit by bit over all points at once.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = [((x[i] >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1) for i in range(d)]
    return np.packbits(np.stack(planes, axis=1), axis=1)


def hilbert_order(part: np.ndarray, bits: int = HILBERT_BITS) -> np.ndarray:
    """The order of a part's rows along the curve, each component scaled to the rows' own range."""
    low, high = part.min(axis=0), part.max(axis=0)
    width = (high - low).astype(np.float64)
    scaled = (part - low).astype(np.float64) / np.where(width > 0, width, 1.0)
    keys = hilbert_words(np.minimum((scaled * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)
    return np.lexsort(keys.T[::-1])


def _exact(x: float, scale: int) -> int:
    return math.floor(Fraction(x) * scale)


def _integers(flat: np.ndarray, at: np.ndarray, width: int, scale: int) -> np.ndarray:
    """Vectors as rows of ``width`` integers ``floor(scale * x)``; shorter ones go on with zeros."""
    n, wide = len(at) - 1, flat.astype(np.float64)
    lengths = np.diff(at)
    rows = np.repeat(np.arange(n), lengths)
    cols = np.arange(len(flat)) - np.repeat(at[:-1], lengths)
    if len(wide) and np.abs(wide).max() * scale >= SMALL:
        out = np.zeros((n, width), object)
        out[rows, cols] = [_exact(float(v), scale) for v in wide]
        return out
    out = np.zeros((n, width), np.int64)
    out[rows, cols] = np.floor(wide * scale).astype(np.int64)
    return out


def _stored(values: np.ndarray) -> tuple[str, bytes]:
    """An integer array as its narrowest type and bytes; Python integers as JSON text."""
    if values.dtype == object:
        return "json", json.dumps([int(v) for v in values.ravel()]).encode()
    top = int(np.abs(values).max()) if values.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4"
    return kind, values.astype(kind).tobytes()


def _restored(kind: str, raw: bytes, width: int) -> np.ndarray:
    if kind == "json":
        return np.array(json.loads(raw), object).reshape(-1, width)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(-1, width)


class Blocks:
    """One part position of a chunk: rows in Hilbert order, with a box, a sum and a count per block."""

    def __init__(self, part: np.ndarray):
        self.rows = part
        self.starts = np.arange(0, len(part), BLOCK)
        self.low = np.minimum.reduceat(part, self.starts)
        self.high = np.maximum.reduceat(part, self.starts)
        self.sums = np.add.reduceat(part, self.starts)
        self.counts = np.diff(np.r_[self.starts, len(part)])

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """Per block and entry whether the entry can be a row's nearest.

        An entry whose least distance to the box exceeds another's greatest one is nearest to no row.
        """
        low, high = self.low[:, None, :], self.high[:, None, :]
        below, above = low - entries, entries - high
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(high - entries, entries - low)
        return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1, keepdims=True)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of its nearest entry (ties to the lower) and the squared distance."""
        where = np.empty(len(self.rows), np.int64)
        error = np.empty(len(self.rows), self.rows.dtype)
        for start, count, may in zip(self.starts, self.counts, self.shortlists(entries)):
            some = np.flatnonzero(may)
            apart = self.rows[None, start:start + count] - entries[some][:, None, :]
            d = (apart * apart).sum(axis=2)
            best = d.argmin(axis=0)
            where[start:start + count] = some[best]
            error[start:start + count] = d[best, np.arange(count)]
        return where, error

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the sum and the number of its rows; a block with one entry left gives its stored sum."""
        sums = np.zeros(entries.shape, self.rows.dtype)
        counts = np.zeros(len(entries), np.int64)
        for b, may in enumerate(self.shortlists(entries)):
            some = np.flatnonzero(may)
            if len(some) == 1:
                sums[some[0]] += self.sums[b]
                counts[some[0]] += self.counts[b]
                continue
            rows = self.rows[self.starts[b]:self.starts[b] + self.counts[b]]
            apart = rows[None] - entries[some][:, None, :]
            best = (apart * apart).sum(axis=2).argmin(axis=0)
            for i in np.unique(best):
                mine = rows[best == i]
                sums[some[i]] += mine.sum(axis=0)
                counts[some[i]] += len(mine)
        return sums, counts


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number as signed pieces of 32 bits, so sums over any number of tasks stay within 64 bits."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        piece = value & ((1 << LIMB) - 1)
        if piece:
            yield k, sign * piece
        value, k = value >> LIMB, k + 1


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds a null, NaN or infinite component."""
    return vectors.filter(F.col(vector).isNotNull()).filter(
        ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )


class VectorCodec:
    """Codebooks of one integer per component for every part position, and codes of all vectors.

    Null vectors and those that hold null or non-finite components are left out.  A component x
    becomes the integer ``floor(scale * x)``, exactly, however large.  All vectors are as wide as the
    longest, rounded up to a multiple of ``parts``; shorter ones (empty ones too) go on with zeros.
    Codebooks start as the parts of the ``entries`` smallest ids, null ids last, equal ids by their
    components; fewer vectors give fewer entries.  An error beyond 64 bits is null.  Other columns are
    not read, so their names do not matter; an empty table gives no rows.

    Every task cuts its rows into chunks.  A chunk's parts are sorted along a Hilbert curve and kept as
    flat blocks with boxes, sums and counts.  In a round, boxes leave each block a short list of
    entries; integer kernels look at those only, or at none where one entry is left.  What leaves a
    task is one sum per entry and component.  Vectors are never shuffled.
    """

    def __init__(
        self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
        parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    ):
        self.parts, self.rounds, self.scale = parts, rounds, scale
        self.label_type = vectors.schema[label].dataType
        rows = usable(vectors, vector).select(
            F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
        )
        longest = rows.agg(F.max(F.size("v"))).first()[0]
        self.wide = max(1, -(-(longest or 0) // parts)) * parts
        self.each = self.wide // parts
        self.chunks = written(self._chunked(rows), "chunks")
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        start = np.array([[_exact(x, scale) for x in r.v] + [0] * (self.wide - len(r.v)) for r in first], object).reshape(-1, self.wide)
        self.codebooks = [start[:, p * self.each:(p + 1) * self.each] for p in range(parts)]
        for _ in range(rounds if first else 0):
            self.codebooks = self._improved()

    def _chunked(self, rows: DataFrame) -> DataFrame:
        parts, wide, each, scale = self.parts, self.wide, self.each, self.scale
        size = max(1, CHUNK_NUMBERS // wide)
        kind = self.label_type.simpleString()
        schema = f"ids array<long>, labels array<{kind}>, kind string, numbers binary, orders binary"

        def chunk(ids: pa.Array, labels: pa.Array, values: pa.ListArray) -> pa.RecordBatch:
            flat = values.flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            numbers = _integers(flat, at, wide, scale)
            orders = [hilbert_order(numbers[:, p * each:(p + 1) * each]).astype("<i4") for p in range(parts)]
            name, raw = _stored(numbers)
            span = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(span, ids), pa.ListArray.from_arrays(span, labels), pa.array([name]),
                    pa.array([raw], pa.binary()), pa.array([b"".join(o.tobytes() for o in orders)], pa.binary()),
                ],
                names=["ids", "labels", "kind", "numbers", "orders"],
            )

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n = [], 0
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    piece = b.slice(lo, size)
                    waiting.append(piece)
                    n += piece.num_rows
                    if n >= size:
                        yield joined(waiting)
                        waiting, n = [], 0
            if n:
                yield joined(waiting)

        def joined(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = [pa.concat_arrays([b.column(i) for b in waiting]) for i in range(3)]
            return chunk(*whole)

        return rows.mapInArrow(build, schema)

    def _improved(self) -> list[np.ndarray]:
        """The codebooks after one round."""
        parts, each, wide, books = self.parts, self.each, self.wide, self.codebooks

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(b.shape, object) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                for blocks_of in _parts_of(batch, wide, each, parts):
                    for p, (blocks, entries) in enumerate(blocks_of(books)):
                        s, c = blocks.totals(entries)
                        sums[p] += s.astype(object)
                        counts[p] += c
            out = [(p, e, -1, 0, int(n)) for p in range(parts) for e, n in enumerate(counts[p]) if n]
            for p in range(parts):
                for (e, i), v in np.ndenumerate(sums[p]):
                    out += [(p, e, i, k, piece) for k, piece in _limbs(int(v))]
            names = ["part", "entry", "place", "limb", "amount"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

        schema = "part long, entry long, place long, limb long, amount long"
        found = self.chunks.select("kind", "numbers", "orders").mapInArrow(work, schema)
        counts = [np.zeros(len(b), object) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        # At most entries x width x limbs rows, whatever the number of vectors.
        for r in found.groupBy("part", "entry", "place", "limb").agg(F.sum("amount").alias("amount")).collect():
            if r.place < 0:
                counts[r.part][r.entry] = r.amount
            else:
                sums[r.part][r.entry, r.place] += r.amount << (LIMB * r.limb)
        return [np.where((n > 0)[:, None], s // np.where(n > 0, n, 1)[:, None], b) for n, s, b in zip(counts, sums, books)]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, as decimal text joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.codebooks for v in b.ravel()).encode()).hexdigest()

    def encoded(self) -> DataFrame:
        """One row per vector: vec_id, label, code, error."""
        parts, each, wide, books = self.parts, self.each, self.wide, self.codebooks
        label_type = self.label_type.simpleString()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, blocks_of in enumerate(_parts_of(batch, wide, each, parts)):
                    ids, labels = batch.column("ids"), batch.column("labels")
                    lo, hi = ids.offsets[row].as_py(), ids.offsets[row + 1].as_py()
                    codes = np.empty((hi - lo, parts), np.uint8)
                    error = np.zeros(hi - lo, object)
                    orders = np.frombuffer(batch.column("orders")[row].as_buffer(), "<i4").reshape(parts, -1)
                    for p, (blocks, entries) in enumerate(blocks_of(books)):
                        where, apart = blocks.nearest(entries)
                        codes[orders[p], p] = where
                        error[orders[p]] += apart.astype(object)
                    raw = codes.tobytes().hex()
                    start = labels.offsets[row].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.values.slice(lo, hi - lo), labels.values.slice(start, hi - lo),
                            pa.array([raw[i:i + 2 * parts] for i in range(0, len(raw), 2 * parts)], pa.string()),
                            pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64()),
                        ],
                        names=["vec_id", "label", "code", "error"],
                    )

        return self.chunks.mapInArrow(work, f"vec_id long, label {label_type}, code string, error long")


def _parts_of(batch: pa.RecordBatch, wide: int, each: int, parts: int):
    """Per chunk of a batch, a function from codebooks to its (blocks, entries) by part."""
    for kind, numbers, orders in zip(batch.column("kind"), batch.column("numbers"), batch.column("orders")):
        values = _restored(kind.as_py(), numbers.as_buffer().to_pybytes() if kind.as_py() == "json" else numbers.as_buffer(), wide)
        order = np.frombuffer(orders.as_buffer(), "<i4").reshape(parts, -1)

        def of(books: list[np.ndarray], values=values, order=order):
            for p in range(parts):
                # Small numbers on both sides keep to 64 bits, anything else to Python's integers.
                big = values.dtype == object or each > WIDE or max((abs(int(v)) for v in books[p].ravel()), default=0) >= SMALL
                part = values[order[p], p * each:(p + 1) * each]
                kind = object if big else np.int64
                yield Blocks(part.astype(kind)), books[p].astype(kind)

        yield of


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256 (see :class:`VectorCodec`).

    ``label_error`` adds the errors up over equal labels, nulls together; it is null where an error or
    the sum is beyond 64 bits.
    """
    codec = VectorCodec(vectors, key, vector, label, **options)
    codes = written(codec.encoded(), "codes")
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count(F.lit(1))) & (exact <= F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.when(fits, exact).cast("long").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256")
    )
