"""Members of large JSON objects ``{id: value}``, read in parallel from within one file.

A file is read as the pieces between its colons, of which every member has one, so Spark splits it anywhere.
The pieces of a split are put together again to chunks of bounded size.  A chunk cannot know whether it
begins inside a string, nor how deep, so its quotation marks, brackets and commas are read once under both
assumptions; a prefix over the chunks of a file, one row each, says which one holds and at what depth
the chunk begins.  Members are what the commas at depth one part: those between the first and the last
such comma of a chunk are whole, and stay one document; only what lies around them is shuffled, to be put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.session import bucket_count, materialise
from accordant.sources.paths import decoded
from accordant.sources.records import read_lines

_BEFORE = (Window.unboundedPreceding, -1)
# Bytes of a chunk, and bytes of chunks that a task parses.
_CHUNK = 1 << 20
_PER_TASK = 16 << 20

_SEEN = "struct<change:int,cuts:array<struct<depth:int,at:array<int>,n:int>>>"
_CHUNKS = f"file_path string, block long, pos long, part int, size int, turns boolean, outside {_SEEN}, inside {_SEEN}, text binary"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_NOTHING_BETWEEN = re.compile(rb",\s*,")
_QUOTE, _COMMA = 3, 2
_KINDS = np.zeros(256, np.int8)
for _sign, _kind in (("[", 1), ("{", 1), ("]", -1), ("}", -1), (",", _COMMA), ('"', _QUOTE)):
    _KINDS[ord(_sign)] = _kind


def read_members(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """One row per member of the top-level objects of all files: ``file_path``, ``q_id``, ``raw`` (JSON text; null for null).

    No task holds more than one split and one member.  Files must hold one JSON object each; its values may be
    anything.  A member that is no valid JSON stops the job and names its file; so does a file that
    ends inside a string or an object, or that holds something else than an object.
    """
    return _rows(read_member_documents(spark, path, glob))


def read_member_documents(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """The members of :func:`read_members` as documents: ``file_path``, ``value`` (an object of some members), ``__members`` (how many)."""
    return member_documents(read_lines(spark, path, glob, separator=":", encoded=True), ":", encoded=True)


def members(pieces: DataFrame, separator: str = '"') -> DataFrame:
    """:func:`read_members` over pieces ``file_path, block, pos, value``, which the separator parts."""
    return _rows(member_documents(pieces, separator))


def member_map(message: Column) -> Column:
    """The members of a document of :func:`member_documents` as a map from ids to JSON text.

    The map is bound once, so a text is parsed once whatever the optimizer does with the expression around it.
    """
    found = F.array(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))
    return F.transform(found, lambda m: F.when(F.size(m) == F.col("__members"), m).otherwise(F.raise_error(message)))[0]


def _no_object() -> Column:
    return F.concat(F.lit("no JSON object of the expected form in "), F.col("file_path"))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("file_path", F.explode(member_map(_no_object())).alias("q_id", "raw"))


def member_documents(pieces: DataFrame, separator: str = '"', encoded: bool = False) -> DataFrame:
    """:func:`read_member_documents` over pieces ``file_path, block, pos, value``; ``encoded`` paths are decoded in the result."""
    c, key = F.col, ["file_path", "block", "pos", "part"]
    # Written, as are the few numbers that follow from it, so that texts are looked at once.
    chunks = materialise(pieces.select("file_path", "block", "pos", "value").mapInArrow(_chunker(separator.encode()), _CHUNKS), "json-chunks")
    by = Window.partitionBy("file_path").orderBy("block", "pos", "part")

    def before(n: Column) -> Column:
        return F.coalesce(F.sum(n).over(by.rowsBetween(*_BEFORE)), F.lit(0))

    seen = chunks.drop("text").withColumn("starts_inside", before(c("turns").cast("int")) % 2 == 1)
    seen = seen.withColumn("seen", F.when(c("starts_inside"), c("inside")).otherwise(c("outside")))
    seen = seen.withColumn("depth", before(c("seen.change")))
    found = seen.withColumn("cut", F.try_element_at(F.filter("seen.cuts", lambda x: x["depth"] == 1 - c("depth")), F.lit(1)))
    cuts = materialise(found.select(
        *key, "size", "cut.at", "cut.n", before(F.when(c("cut").isNotNull(), 1).otherwise(0)).alias("member"),
        F.lead(F.lit(1)).over(by).isNull().alias("last"),
    ), "json-cuts")
    size = cuts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(bucket_count(pieces.sparkSession), -(-size // _PER_TASK))
    placed = chunks.select(*key, "text").repartition(parts, *key).join(cuts.drop("size"), key)
    # Nothing is parted behind the last piece of a file.
    placed = placed.withColumn("text", F.when(c("last"), F.expr(f"substring(text, 1, length(text) - {len(separator)})")).otherwise(c("text")))
    bodies = F.expr("transform(slice(at, 1, size(at) - 1), (a, i) -> cast(substring(text, a + 2, at[i + 1] - a - 1) AS string))")
    whole = placed.filter("size(at) > 1").select("file_path", c("n").alias("__members"), F.explode(bodies).alias("body"))
    # What lies before the first comma ends a member that begins in an earlier chunk, what lies behind the last one begins another.
    around = F.when(c("at").isNull(), F.array(
        F.struct(c("member"), c("last"), c("text"))
    )).otherwise(F.array(
        F.struct(c("member"), F.lit(False).alias("last"), F.expr("substring(text, 1, at[0])").alias("text")),
        F.struct((c("member") + 1).alias("member"), c("last"), F.expr("substring(text, element_at(at, -1) + 2)").alias("text")),
    ))
    ends = placed.select(*key, F.explode(around).alias("p")).groupBy("file_path", "p.member").agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "part", c("p.text").cast("string").alias("text")))).alias("pieces"),
        F.bool_or("p.last").alias("last"),
    ).withColumn("text", F.array_join(F.transform("pieces", lambda x: x["text"]), ""))
    return _documents(whole, ends, decoded(c("file_path")) if encoded else c("file_path"))


def _documents(whole: DataFrame, ends: DataFrame, path: Column) -> DataFrame:
    """Members as objects; of ``ends`` a file's first has the object's opening brace and its last the closing one."""
    c, last = F.col, F.col("last")
    whole, ends = whole.withColumn("file_path", path), ends.withColumn("file_path", path)
    body = F.when(c("member") == 0, F.regexp_replace("text", r"\A[\s\x{FEFF}]*\{", "")).otherwise(c("text"))
    shut = F.when(last, body.rlike(r"\}\s*\z")).otherwise(F.lit(True))
    began = F.when(c("member") == 0, c("text").rlike(r"\A[\s\x{FEFF}]*\{")).otherwise(F.lit(True))
    body = F.when(last, F.regexp_replace(body, r"\}\s*\z", "")).otherwise(body)
    checked = ends.select("file_path", F.lit(1).alias("__members"), F.when(began & shut, body).otherwise(F.raise_error(_no_object())).alias("body"))
    blank = (c("__members") == 1) & (F.trim(F.regexp_replace("body", r"\s", "")) == "")
    return whole.unionByName(checked).filter(~blank).select(
        "file_path", F.concat(F.lit("{"), "body", F.lit("}")).alias("value"), "__members"
    )


def _chunker(separator: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of the pieces that follow one another, each with the separator behind it, and what :func:`_seen` finds in them."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.struct([("change", pa.int32()), ("cuts", pa.list_(pa.struct([("depth", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.int32())])))])
        kinds = [("part", pa.int32()), ("size", pa.int32()), ("turns", pa.bool_()), ("outside", seen), ("inside", seen), ("text", pa.binary())]
        for batch in batches:
            values = batch.column("value").cast(pa.binary())
            pos, block = batch.column("pos").to_numpy(), batch.column("block").to_numpy()
            file = pc.dictionary_encode(batch.column("file_path")).indices.to_numpy()
            new = (np.diff(pos) != 1) | (np.diff(block) != 0) | (np.diff(file) != 0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()] if len(pos) else []
            at, rows = [], [[] for _ in kinds]
            for start, end in zip(starts, [*starts[1:], len(pos)], strict=False):
                text = separator.join(values.slice(start, end - start).to_pylist()) + separator
                for part, piece in enumerate(_slices(text)):
                    at.append(start)
                    for row, value in zip(rows, (part, len(piece), *_seen(piece), piece), strict=True):
                        row.append(value)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in ("file_path", "block", "pos")]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(r, t) for r, (_, t) in zip(rows, kinds, strict=True)], names=["file_path", "block", "pos", *[k for k, _ in kinds]]
            )

    return chunks


def _slices(text: bytes) -> Iterator[bytes]:
    """A text as parts of bounded size, none of which ends within a character or behind the backslash of an escape."""
    start = 0
    while len(text) - start > _CHUNK:
        end = start + _CHUNK
        while text[end] & 0xC0 == 0x80:
            end -= 1
        run = end - start - len(text[start:end].rstrip(b"\\"))
        end -= run % 2
        yield text[start:end]
        start = end
    yield text[start:]


def _seen(text: bytes) -> tuple[bool, dict, dict]:
    """Whether a string is open behind the text if none is before it, or the reverse; then change of depth and cuts from outside and from inside.

    A quotation mark opens a string, or closes it unless an odd number of backslashes stands before it.
    """
    if b"\\" in text:
        text = _ESCAPED.sub(b"\0\0", text)
    kinds = _KINDS[np.frombuffer(text, np.uint8)]
    places = np.flatnonzero(kinds)
    kinds = kinds[places]
    quotes = kinds == _QUOTE
    inside = np.cumsum(quotes) & 1
    gaps = _NOTHING_BETWEEN.search(text) is not None
    both = []
    for start in (0, 1):
        counted = (inside == start) & ~quotes
        both.append(_cuts(text, kinds[counted], places[counted], gaps))
    return bool(inside[-1]) if len(inside) else False, *both


def _cuts(text: bytes, kinds: np.ndarray, places: np.ndarray, gaps: bool) -> dict:
    """Change of depth, and for each depth up to one, as counted from the text's start: its commas and the members between two of them.

    Of the commas the first and the last will do, with all members between them, as long as none is blank and none
    closes more than it opens.
    """
    if not len(kinds):
        return {"change": 0, "cuts": []}
    comma = kinds == _COMMA
    depth = np.cumsum(np.where(comma, 0, kinds), dtype=np.int32)
    lowest = np.minimum.accumulate(depth)
    commas = np.flatnonzero(comma & (depth <= 1))
    order = np.argsort(depth[commas], kind="stable")
    commas = commas[order]
    levels = depth[commas]
    ends = [*(np.flatnonzero(np.diff(levels)) + 1).tolist(), len(levels)] if len(levels) else []
    cuts, start = [], 0
    for end in ends:
        own, level = commas[start:end], int(levels[start])
        start = end
        at, n = places[own], len(own) - 1
        if n > 1:
            # Only the file's own object is opened in the text itself: then what precedes the first comma does not count.
            low = depth[own[0]:own[-1]].min() if level == 1 else lowest[own[-1]]
            if low < level or gaps and any(not text[a + 1:b].strip() for a, b in zip(at[:-1].tolist(), at[1:].tolist())):
                n = 1
            else:
                at = at[[0, -1]]
        cuts.append({"depth": level, "at": at.tolist(), "n": n})
    return {"change": int(depth[-1]), "cuts": cuts}
