"""Shards of near equal bytes: a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.bitmap_rank import placed
from accordant.llm.common import whole, written

DIMENSIONS = ["by_id", "by_chars", "by_size", "by_source", "by_lang"]
# Intervals that a cell's value range is cut into in one counting pass.
INTERVALS = 1 << 10
NULL_ID = (1 << 63) - 1


@dataclass
class Cell:
    """A node of the tree: the shards below it and how it is split.

    Rows below ``cut`` (dimension value, id, row) in lexicographic order go left.
    """

    first: int
    shards: int
    bytes: int = 0
    rows: int = 0
    dimension: int = -1
    cut: tuple[int, int, int] = (0, 0, 0)
    left: float = 0.0  # bytes that should go left
    stage: int = 0  # 0: dimension value, 1: id, 2: row
    fixed: list[int] = field(default_factory=list)  # values settled by earlier stages
    low: int = 0
    high: int = 0
    before: int = 0  # bytes known to lie left of the interval
    done: bool = False

    @property
    def open(self) -> bool:
        """Whether the place of the cut is still looked for."""
        return self.shards > 1 and self.rows > 0 and not self.done


def _metadata(docs: DataFrame, key: str, text: str, lang: str, source: str, n_chars: str) -> DataFrame:
    def code(c: str):
        # Names have no order of their own; a hash keeps equal ones together.
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 40))

    size = F.octet_length(whole(text)).cast("long") + 1
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), size.alias("size"), F.crc32(whole(text).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("by_id"),
        F.coalesce(F.col(n_chars).cast("long"), F.lit(-1)).alias("by_chars"), size.alias("by_size"),
        code(source).alias("by_source"), code(lang).alias("by_lang"), F.monotonically_increasing_id().alias("row"),
    )


def _of_cell(values: list[int], cell: str = "cell") -> Column:
    """The value of a row's cell; a constant array with one entry per cell, of which there are at most as many as shards."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")[F.col(cell)]


def _own(dimensions: list[int]) -> Column:
    """A row's value in its cell's dimension."""
    return F.expr(f"array({', '.join(DIMENSIONS)})")[_of_cell(dimensions).cast("int")]


def _widest(rows: DataFrame, cells: list[Cell], spread: list[tuple[int, int]]) -> None:
    """Measure the cells that are still split and choose each one's widest dimension, relative to the whole table."""
    edges = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *edges).collect():
        cell = cells[r.cell]
        cell.bytes, cell.rows = r.bytes, r.rows
        ranges = [(r[f"low_{d}"], r[f"high_{d}"]) for d in DIMENSIONS]
        if not spread:
            spread.extend(ranges)
        shares = [(hi - lo) / max(1, top - bottom) for (lo, hi), (bottom, top) in zip(ranges, spread)]
        cell.dimension = max(range(len(shares)), key=lambda i: (shares[i], -i))
        cell.left = cell.bytes * (cell.shards // 2) / cell.shards
        cell.low, cell.high = ranges[cell.dimension]


def _shift(cell: Cell) -> int:
    """Low bits to drop so that the interval has at most about ``INTERVALS`` steps."""
    s = 0
    while (cell.high >> s) - (cell.low >> s) >= INTERVALS:
        s += 1
    return s


def _narrow(rows: DataFrame, cells: list[Cell]) -> None:
    """One counting pass: bytes per step of every open cell's interval, and the step that the median lies in."""
    fixed = [[*cell.fixed, 0, 0] for cell in cells]
    at = rows.filter(_of_cell([int(cell.open) for cell in cells]) == 1).select(
        "cell", "size", "by_id", "row", _own([max(0, cell.dimension) for cell in cells]).alias("dim"),
        _of_cell([cell.stage for cell in cells]).alias("stage"), _of_cell([f[0] for f in fixed]).alias("value"),
        _of_cell([f[1] for f in fixed]).alias("id"), _of_cell([cell.low for cell in cells]).alias("low"),
        _of_cell([cell.high for cell in cells]).alias("high"),
        _of_cell([_shift(cell) for cell in cells]).cast("int").alias("shift"),
    )
    at = at.filter("(stage < 1 or dim = value) and (stage < 2 or by_id = id)").withColumn(
        "own", F.expr("case stage when 0 then dim when 1 then by_id else row end")
    ).filter("own between low and high")
    step = F.expr("shiftright(own, shift) - shiftright(low, shift)").cast("int")
    # At most INTERVALS + 1 rows per cell come back, whatever the number of documents.
    counted = at.groupBy("cell", step.alias("step")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{n}_{c}") for c in ("own", "by_id", "row") for n, f in (("low", F.min), ("high", F.max))],
    ).collect()
    found: dict[int, list] = {}
    for r in counted:
        found.setdefault(r.cell, []).append(r)
    for c, steps in found.items():
        cell, upto = cells[c], cells[c].before
        for r in sorted(steps, key=lambda r: r.step):
            if upto + r.bytes >= cell.left:
                break
            upto += r.bytes
        if r.rows == 1:  # a single row: it goes to the side that misses the aim by less
            takes = upto + r.bytes - cell.left < cell.left - upto
            _settle(cell, r.high_own + 1 if takes else r.low_own)
            continue
        cell.before = upto
        if r.low_own < r.high_own:
            cell.low, cell.high = r.low_own, r.high_own
        else:  # one value, several rows: the next column of the order decides
            cell.fixed.append(r.low_own)
            cell.stage += 1
            cell.low, cell.high = (r.low_by_id, r.high_by_id) if cell.stage == 1 else (r.low_row, r.high_row)


def _settle(cell: Cell, edge: int) -> None:
    """The cut lies before ``edge`` in the present column of the order."""
    least = -(1 << 63)
    cell.cut = tuple([*cell.fixed, edge, least, least][:3])
    if edge > NULL_ID:  # beyond all 64-bit numbers: behind the largest, whose rows share it
        cell.cut = tuple([*cell.fixed, NULL_ID, NULL_ID, NULL_ID][:3])
    cell.done = True


def kd_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, list[Cell]]:
    """``rows`` (a stored table) with their ``shard``, and the inner nodes of the tree.

    A level's result is stored, so a counting pass is one scan and one small aggregation.
    """
    cells, spread, tree = [Cell(0, shards)], [], []
    rows = rows.withColumn("cell", F.lit(0))
    while any(cell.shards > 1 for cell in cells):
        _widest(rows, cells, spread)
        while any(cell.open for cell in cells):
            _narrow(rows, cells)
        after, left, right = [], [], []
        for cell in cells:
            left.append(len(after))
            if cell.shards == 1 or not cell.rows:  # without rows there is nothing to cut
                after.append(Cell(cell.first, 1))
                right.append(left[-1])
                continue
            tree.append(cell)
            half = cell.shards // 2
            after += [Cell(cell.first, half), Cell(cell.first + half, cell.shards - half)]
            right.append(left[-1] + 1)
        staged = rows.withColumns({
            "own": _own([max(0, cell.dimension) for cell in cells]),
            **{f"cut_{i}": _of_cell([cell.cut[i] for cell in cells]) for i in range(3)},
            "left": _of_cell(left), "right": _of_cell(right),
        })
        goes_left = F.expr("own < cut_0 or (own = cut_0 and (by_id < cut_1 or (by_id = cut_1 and row < cut_2)))")
        kept = [c for c in rows.columns if c != "cell"]
        rows = written(staged.select(*kept, F.when(goes_left, F.col("left")).otherwise(F.col("right")).cast("int").alias("cell")), "cells")
        cells = after
    return rows.withColumn("shard", _of_cell([cell.first for cell in cells]).cast("int")).drop("cell"), tree


def sharded(
    docs: DataFrame, shards: int = 16, target_bytes: int | None = None, key: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source", n_chars: str = "n_chars",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus one; a null text counts as empty.  With ``target_bytes`` the
    number of shards is what the total needs.  Cells are cut along the widest of id, n_chars, size,
    source and lang, each relative to the whole table (names by hash, null ids last, other nulls as
    a value of their own), at the weighted median, until a cell is one shard.  Rows that share the median's value are
    cut by id, and rows of one id by their place in the stored table, so each cut misses its aim by
    less than one document, whatever is repeated, and shards are near equal in bytes.  Equal texts
    are not kept together.  Slots follow the id in a shard, gapless; rows that repeat an id follow each other.
    Fewer rows than shards leave shards empty, an empty table gives no rows, and names of other
    columns do not matter.

    Medians come from counting passes: a pass cuts every open interval into up to 1024 steps, and only
    the bytes per step reach the driver.  Texts are read once.
    """
    rows = written(_metadata(docs, key, text, lang, source, n_chars), "metadata")
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    dealt, _ = kd_tree(rows, shards)
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "row", "shard"), "dealt")
    found = placed(dealt, ["shard"], ["doc_id"], "row")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
