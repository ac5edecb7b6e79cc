"""Merkle manifest of a table of documents, with leaf coordinates from bitmap ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.bitmap_rank import placed
from accordant.llm.common import fold, written

# Levels that one slot array is reduced by in one step, for three children a node.
ARITY, STEP = 3, 7


def _field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its bytes' number, a colon and its text."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256))


def _depth(n: int, arity: int) -> int:
    """Levels between ``n`` nodes and one."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def _levels(digests: list[bytes], depth: int, arity: int) -> list[list[bytes]]:
    """The digests (hex) and ``depth`` levels above them."""
    out = [digests]
    for _ in range(depth):
        last = out[-1]
        out.append([
            hashlib.sha256(b"".join(last[i:i + arity])).hexdigest().encode() for i in range(0, len(last), arity)
        ])
    return out


def _split(raw: bytes, n: int = 32) -> list[bytes]:
    return [raw[i:i + n].hex().encode() for i in range(0, len(raw), n)]


def _path(levels: list[list[bytes]], i: int, arity: int) -> list[tuple[bytes, bytes]]:
    """Per level the siblings to the left and to the right of node ``i``'s ancestor, joined as hex text."""
    out = []
    for nodes in levels[:-1]:
        lo = i - i % arity
        out.append((b"".join(nodes[lo:i]), b"".join(nodes[i + 1:lo + arity])))
        i //= arity
    return out


def _packed(path: list[tuple[bytes, bytes]]) -> bytes:
    return b";".join(left + b"," + right for left, right in path)


def _unpacked(raw: bytes) -> list[tuple[bytes, bytes]]:
    return [tuple(p.split(b",")) for p in raw.split(b";")] if raw else []


def _slot_arrays(nodes: DataFrame, arity: int, carried: dict[str, str]) -> DataFrame:
    """Nodes ``(gkey, slot, total, digest, carried..)`` as slot arrays: one row per ``arity^STEP`` consecutive slots.

    A digest is stored at its slot, so nothing is sorted.  ``top`` is the array's node ``STEP`` levels
    up, or the group's root if that is nearer.
    """
    span = arity ** STEP
    lists = "".join(f", {c} array<{t}>" for c, t in carried.items())
    schema = f"gkey string, block long, total long, digests binary, top binary{lists}"

    def build(t: pa.Table) -> pa.Table:
        block, total = t.column("block")[0].as_py(), t.column("total")[0].as_py()
        at = t.column("slot").to_numpy() - block * span
        given = t.column("digest").to_pylist()
        own = [b""] * len(given)
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        for i, d in zip(at, given):
            own[i] = d
        whole = b"".join(own)
        top = _levels(_split(whole), min(STEP, _depth(total, arity)), arity)[-1][0]
        columns = {
            "gkey": pa.array([t.column("gkey")[0].as_py()]), "block": pa.array([block]), "total": pa.array([total]),
            "digests": pa.array([whole], pa.binary()), "top": pa.array([bytes.fromhex(top.decode())], pa.binary()),
        }
        for c in carried:
            column = t.column(c).combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.take(pa.array(back)))
        return pa.table(columns)

    narrow = nodes.select("gkey", F.expr(f"slot div {span}").alias("block"), "slot", "total", "digest", *carried)
    return written(narrow.groupBy("gkey", "block").applyInArrow(build, schema), "slots")


def _tree(nodes: DataFrame, arity: int, carried: dict[str, str]) -> list[DataFrame]:
    """Slot arrays of all nodes, then of their tops, until every group has one array."""
    span = arity ** STEP
    arrays = [_slot_arrays(nodes, arity, carried)]
    most = arrays[0].agg(F.max("total")).first()[0] or 0
    while most > span:
        up = arrays[-1].filter(F.col("total") > span).select(
            "gkey", F.col("block").alias("slot"), F.expr(f"(total + {span - 1}) div {span}").alias("total"), F.col("top").alias("digest")
        )
        arrays.append(_slot_arrays(up, arity, {}))
        most = -(-most // span)
    return arrays


def _paths_down(arrays: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``(gkey, block, subroot, path)``: the way from every slot array of the lowest level to the root.

    ``tops`` is ``(gkey, path)``, the way from a group's root upwards.
    """
    span = arity ** STEP

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                levels = _levels(_split(r["digests"]), min(STEP, _depth(r["total"], arity)), arity)
                n = len(levels[0])
                paths = [_packed(_path(levels, i, arity) + _unpacked(r["path"])) for i in range(n)]
                yield pa.RecordBatch.from_pydict({
                    "gkey": [r["gkey"]] * n, "block": [r["block"] * span + i for i in range(n)],
                    "subroot": [r["subroot"]] * n, "path": paths,
                }, schema=pa.schema([("gkey", pa.string()), ("block", pa.int64()), ("subroot", pa.binary()), ("path", pa.binary())]))

    above = None
    for k in range(len(arrays) - 1, -1, -1):
        here = arrays[k].filter(F.col("total") <= span).select("gkey", "block", F.col("top").alias("subroot")).join(tops, "gkey")
        if above is not None:
            inner = arrays[k + 1].select("gkey", "block", "total", "digests").join(above, ["gkey", "block"])
            here = here.unionByName(inner.mapInArrow(down, "gkey string, block long, subroot binary, path binary"))
        above = written(here, "paths")
    return above


def _numbered(tops: DataFrame) -> DataFrame:
    """Groups in the byte order of their keys: ``slot`` from range partitions and their offsets."""
    parted = tops.repartitionByRange("gkey").sortWithinPartitions("gkey").withColumn("row", F.monotonically_increasing_id())
    parted = written(parted, "sorted").withColumn("part", F.shiftright("row", 33))
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per range partition, not per group
    starts = counts.select(
        "part", F.sum("n").over(whole).alias("total"),
        F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(starts, "part").withColumn("slot", F.col("start") + inside).drop("part", "row", "start")


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    text: str = "text", arity: int = ARITY, tampered: Column | None = None,
) -> DataFrame:
    """A Merkle tree over all rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes its row's five fields; a null field counts as ``-``, an empty text as ``0:``.  Leaves of a
    source ascend by id, null ids last; rows of one id by their leaf digest (its first 60 bits), and
    rows equal in all fields follow each other.  Sources ascend by bytes, null first.  ``tampered`` is the text
    as it is found when a leaf is checked (default: line feeds deleted where the CRC-32 of the id's
    decimal text, empty for a null id, is even); a null text stays null.  Texts of any length are hashed whole.  Other columns
    are not read, so their names do not matter; an empty table gives no rows.

    Coordinates come from bitmap ranks (:mod:`accordant.llm.bitmap_rank`).  Digests are dealt into slot
    arrays of ``arity^7`` leaves, which are reduced seven levels at a time, and the way to the root
    comes down the same arrays; no task holds more than one array and its way up.
    """
    if tampered is None:
        tampered = F.when(fold(F.col(key)) % 2 == 0, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    src = F.col(source).cast("string")
    before = [F.col(key).cast("long").cast("string"), src, F.col(lang).cast("string"), F.col(n_chars).cast("long").cast("string")]
    leaf = leaf_digest([*before, F.col(text)])
    changed = F.when(~tampered.eqNullSafe(F.col(text)), leaf_digest([*before, tampered]))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), src), F.lit("")).alias("gkey"), F.col(key).cast("long").alias("doc_id"),
        leaf.alias("digest"), changed.alias("changed"),
    )
    tie = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    rows = written(rows.withColumns({"tie": tie, "row": F.monotonically_increasing_id()}), "leaves")
    found = placed(rows, ["gkey"], ["doc_id", "tie"], "row")
    arrays = _tree(found, arity, {"doc_id": "long", "changed": "binary"})

    span = arity ** STEP
    subroots = None
    for a in arrays:
        some = a.filter(F.col("total") <= span).select("gkey", F.col("top").alias("digest"))
        subroots = some if subroots is None else subroots.unionByName(some)
    upper = _numbered(subroots).select(F.lit("").alias("gkey"), "slot", "total", "digest", F.col("gkey").alias("member"))
    above = _tree(upper, arity, {"member": "string"})
    spark = docs.sparkSession
    start = spark.createDataFrame([("", bytearray())], "gkey string, path binary")
    ways = _paths_down(above, start, arity)

    def of_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                levels = _levels(_split(r["digests"]), min(STEP, _depth(r["total"], arity)), arity)
                up = _unpacked(r["path"])
                yield pa.RecordBatch.from_pydict({
                    "gkey": r["member"], "path": [_packed(_path(levels, i, arity) + up) for i in range(len(levels[0]))],
                    "root": [r["subroot"]] * len(levels[0]),
                }, schema=pa.schema([("gkey", pa.string()), ("path", pa.binary()), ("root", pa.binary())]))

    tops = written(above[0].drop("top").join(ways, ["gkey", "block"]).mapInArrow(of_members, "gkey string, path binary, root binary"), "tops")
    low = _paths_down(arrays, tops.select("gkey", "path"), arity)
    root = tops.select("root").first()
    root = bytes(root[0]).hex() if root else ""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            ("verified", pa.bool_()),
        ])
        for b in batches:
            for r in b.to_pylist():
                levels = _levels(_split(r["digests"]), min(STEP, _depth(r["total"], arity)), arity)
                up = _unpacked(r["path"])
                upper_text = b"".join(left + right for left, right in up)
                n = len(levels[0])
                proofs, folded = [], []
                for i in range(n):
                    path = _path(levels, i, arity)
                    proof = hashlib.sha256(b"".join(left + right for left, right in path))
                    proof.update(upper_text)
                    proofs.append(proof.hexdigest())
                    at = r["changed"][i]
                    at = levels[0][i] if at is None else at.hex().encode()
                    for left, right in (*path, *up):
                        at = hashlib.sha256(left + at + right).hexdigest().encode()
                    folded.append(at.decode())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": r["doc_id"], "leaf": [d.decode() for d in levels[0]], "subroot": [r["subroot"].hex()] * n,
                    "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
                }, schema=schema)

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return arrays[0].drop("top").join(low, ["gkey", "block"]).mapInArrow(prove, out)
