"""Embedding near-duplicates by an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import written
from accordant.llm.components import components

SIMILARITY = 0.95
SAMPLE = 8_192  # distinct vectors the codebooks are fitted on, at most about so many
CELL_ROWS = 64  # vectors a cell of the product grid should hold
MAX_WORDS = 512  # codewords of one codebook at most, so codebooks and cell counts are bounded
TARGET_RECALL = 0.995
LENGTHS = 64  # lengths of vectors that get an index however few vectors they have
BLOCK_ROWS = 4_000  # indexed vectors of one block; a fuller cell is cut into blocks, its queries into as many parts


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of ``k`` groups of ``points`` (Lloyd's rounds from random points)."""
    if not points.shape[1]:  # half of a vector with one component
        return points[:1]
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(distances(points, centres), 1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None])


def traverse(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Multi-sequence order: cells of the product grid by growing sum of the halves' distances."""
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    queue, pushed = [(float(left[by_left[0]] + right[by_right[0]]), 0, 0)], {(0, 0)}
    while queue:
        d, i, j = heapq.heappop(queue)
        yield int(by_left[i]), int(by_right[j]), d
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(by_left) and b < len(by_right) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(queue, (float(left[by_left[a]] + right[by_right[b]]), a, b))


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of double-precision unit vectors."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1))[:, None]


class MultiIndex:
    """Two codebooks, whose product is a grid of cells, and how many of them a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, depth: int = 1):
        self.books, self.depth = (first, second), depth
        self.half = first.shape[1]

    def squared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.squared(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """The ``depth`` nearest cells of each row, in multi-sequence order."""
        a, b = self.squared(x)
        for i in range(len(x)):
            cells = itertools.islice(traverse(a[i], b[i]), self.depth)
            yield [u * len(self.books[1]) + v for u, v, _ in cells]

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Position of the cell of each row of ``y`` in the traversal of the same row of ``x``."""
        a, b = self.squared(x)
        d = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        own = d[np.arange(len(x)), self.cells(y)]
        return (d < own[:, None]).sum(1)


def needed_depth(index: MultiIndex, x: np.ndarray, similarity: float, target: float, seed: int = 11) -> int:
    """Cells a query must visit so that the target share of its farthest neighbours is in one of them.

    The neighbours are drawn at the very similarity that still links, in random directions, so they
    are the hardest to find and need not occur in the sample.
    """
    x = x[:2000]
    rng = np.random.default_rng(seed)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1)[:, None] * x
    norm = np.sqrt((e * e).sum(1))[:, None]
    y = similarity * x + math.sqrt(max(0.0, 1 - similarity * similarity)) * np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)
    ranks = np.concatenate([index.ranks(x[lo:lo + 200], y[lo:lo + 200]) for lo in range(0, len(x), 200)])
    return int(np.quantile(ranks, target, method="higher")) + 1


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes of 0..n-1 as all of ``a``-``b`` do, at most n - 1 of them."""
    label = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        la, lb = label[a], label[b]
        live = la != lb
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        if not len(a):
            break
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        by = np.lexsort((lo, hi))
        first = np.flatnonzero(np.r_[True, hi[by][1:] != hi[by][:-1]])
        pick = by[first]  # one link per label to hang it below a smaller one
        out.append((a[pick], b[pick]))
        parent = np.arange(n)
        parent[hi[pick]] = lo[pick]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    if not out:
        return a, b
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def fit_index(vectors: DataFrame, count: int, similarity: float = SIMILARITY) -> MultiIndex:
    """Codebooks from a bounded sample (``SAMPLE``) of the distinct vectors, drawn by hash."""
    share = min(1.0, SAMPLE / max(1, count))
    drawn = vectors.filter(F.pmod("id", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
    got = drawn.select("vector").toArrow().column("vector").combine_chunks()
    if not len(got):
        got = vectors.limit(1).select("vector").toArrow().column("vector").combine_chunks()
    x = _unit(got)
    k = max(1, min(MAX_WORDS, len(x), math.ceil(math.sqrt(count / CELL_ROWS))))
    half = x.shape[1] // 2
    index = MultiIndex(codebook(x[:, :half], k), codebook(x[:, half:], k))
    index.depth = needed_depth(index, x, similarity, TARGET_RECALL)
    return index


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link when their cosine in double precision reaches ``similarity``.  Null, empty and zero
    vectors and those with null or non-finite components link with nothing; so do vectors of
    different lengths.  Equal vectors are one entry of the index that counts with its copies (they
    link with each other).  A null id takes part; its component is the smallest id of the others
    (null when alone).  Rows that repeat an id are vectors of their own.  There may be any number of
    different lengths.  An empty table gives no rows.

    Every distinct vector is indexed in its cell of the product grid of two codebooks, and is a query:
    it visits the nearest cells in multi-sequence order, as many as the target recall needs, and is
    compared exactly with what they hold.  A full cell is cut into blocks, and its queries into parts.
    A block returns counts per query and a spanning forest of the links found, so a dense group gives
    no quadratic output.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0.0), F.lit(False)
    )
    rows = written(
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(fine, v).alias("vector"))
        .withColumn("id", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))),
        "vectors",
    )
    known = rows.filter("id is not null").withColumn("width", F.size("vector"))
    distinct = written(known.groupBy("id", "width", "vector").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    # A length of many vectors has an index of its own, and so have the most frequent ones; of any other
    # length all vectors fit a block, and the blocks of all these lengths are compared in one pass.
    lengths = distinct.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    some = lengths.orderBy(F.desc("n"), "width").limit(LENGTHS).union(lengths.filter(F.col("n") > BLOCK_ROWS))
    widths = sorted({r.width for r in some.collect()})
    found = [_links(distinct.filter(F.col("width") == w), similarity) for w in widths]
    if len(widths) >= LENGTHS:
        found.append(_links_of_blocks(distinct.filter(~F.col("width").isin(widths)), similarity))
    if not found:
        none = F.lit(0).cast("long").alias("n_links")
        return rows.select("vec_id", none, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, links = found[0]
    for c, l in found[1:]:
        counts, links = counts.unionByName(c), links.unionByName(l)
    parts = components(links).select(F.col("node").alias("id"), F.col("component_id").alias("part"))
    ids = rows.filter("id is not null").groupBy("id").agg(F.min("vec_id").alias("least"))
    member = ids.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    least = member.groupBy("part").agg(F.min("least").alias("component_id"))
    per_id = written(member.join(least, "part").join(counts, "id", "left").select("id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked")
    out = rows.select("vec_id", "id").join(per_id, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of_blocks(distinct: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What :func:`_links` gives, for lengths of at most a block of vectors each."""

    def compare(t: pa.Table) -> pa.Table:
        x = _unit(t.column("vector").combine_chunks())
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        linked = x @ x.T >= similarity
        np.fill_diagonal(linked, False)
        total = linked @ copies
        a, b = _forest(len(ids), *np.nonzero(linked))
        some = np.flatnonzero(total)
        none = np.r_[np.ones(len(some), bool), np.zeros(len(a), bool)]
        return pa.table({
            "id": np.r_[ids[some], ids[a]], "other": pa.array(np.r_[np.zeros(len(some), np.int64), ids[b]], mask=none),
            "n": np.r_[total[some], np.zeros(len(a), np.int64)].astype(np.int64),
        })

    compared = written(distinct.groupBy("width").applyInArrow(compare, "id long, other long, n long"), "compared")
    return _counted(distinct, compared)


def _counted(vectors: DataFrame, compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links per vector, its copies counted, and the links that were kept."""
    found = compared.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    counts = vectors.select("id", "copies").join(found, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return counts, compared.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))


def _links(distinct: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(id, n_links)`` with copies counted, and links ``(a, b)`` that join the same vectors as all links."""
    spark = distinct.sparkSession
    count = distinct.count()
    index = fit_index(distinct, count, similarity)
    held = spark.sparkContext.broadcast((*index.books, index.depth))  # arrays of a bounded size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*held.value)
        for b in batches:
            cell = pa.array(index.cells(_unit(b.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), cell], ["id", "vector", "copies", "cell"])

    placed = written(
        distinct.select("id", "vector", "copies").mapInArrow(place, "id long, vector array<double>, copies long, cell long"), "placed"
    )
    # Cells are at most MAX_WORDS squared; those that need more than one block are fewer still.
    fill = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cut = {r.cell: -(-r.n // BLOCK_ROWS) for r in fill.filter(F.col("n") > BLOCK_ROWS).collect()}
    blocks = spark.sparkContext.broadcast((cut, {r.cell for r in fill.select("cell").collect()}))
    schema = pa.schema([
        ("cell", pa.int64()), ("block", pa.int64()), ("indexed", pa.bool_()), ("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cuts, filled), index = blocks.value, MultiIndex(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids, own = part.column(0).to_numpy(), part.column(3).to_numpy()
                at, cell, block, indexed = [], [], [], []
                for i, visit in enumerate(index.visits(_unit(part.column(1)))):
                    for c, own_row in [(int(own[i]), True), *((c, False) for c in visit if c in filled)]:
                        n = cuts.get(c, 1)
                        mine = int(ids[i]) % n
                        for k in range(n):  # block of the index, part of the queries
                            at.append(i)
                            cell.append(c)
                            block.append(mine * n + k if own_row else k * n + mine)
                            indexed.append(own_row)
                    if len(at) >= 20_000 or i == part.num_rows - 1:
                        take = pa.array(at, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell, pa.int64()), pa.array(block, pa.int64()), pa.array(indexed, pa.bool_()), part.column(0).take(take),
                             part.column(2).take(take), part.column(1).take(take)], schema=schema,
                        )
                        at, cell, block, indexed = [], [], [], []

    dealt = placed.mapInArrow(deal, "cell long, block long, indexed boolean, id long, copies long, vector array<double>")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        mine = t.column("indexed").to_numpy(zero_copy_only=False)
        x = _unit(t.column("vector").combine_chunks())
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        rows, cols = np.flatnonzero(~mine), np.flatnonzero(mine)
        total = np.zeros(len(rows), np.int64)
        node = {int(i): k for k, i in enumerate(np.unique(ids))}
        place = np.array([node[int(i)] for i in ids], np.int64)
        a, b = [], []
        for lo in range(0, len(rows), 2000):
            q = rows[lo:lo + 2000]
            linked = x[q] @ x[cols].T >= similarity
            linked &= ids[q][:, None] != ids[cols][None]
            total[lo:lo + 2000] = linked @ copies[cols]
            i, j = np.nonzero(linked)
            fa, fb = _forest(len(node), place[q[i]], place[cols[j]])
            a.append(fa)
            b.append(fb)
        fa, fb = _forest(len(node), np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        name = np.array(sorted(node, key=node.get), np.int64)
        some = np.flatnonzero(total)
        return pa.table({
            "id": np.r_[ids[rows[some]], name[fa]], "other": pa.array(np.r_[np.zeros(len(some), np.int64), name[fb]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(fa), bool)]),
            "n": np.r_[total[some], np.zeros(len(fa), np.int64)],
        })

    compared = written(dealt.groupBy("cell", "block").applyInArrow(compare, "id long, other long, n long"), "compared")
    return _counted(placed, compared)
