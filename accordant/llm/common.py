"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import materialise

# White space of every contract here: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A membership filter has at most this many bits, so its broadcast is bounded (8 MB of words).
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; its lineage ends there."""
    return materialise(df, name)


def discarded(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more.

    Shuffle files of plans that nobody holds go when the driver collects its garbage, so that is asked
    for as well: the disk that rounds of a long job take is then that of one round.
    """
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def fold(key: Column) -> Column:
    """A remainder of the id's text by CRC-32; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def column_name(taken: list[str], name: str) -> str:
    """``name``, made longer until none of ``taken`` equals it (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


class Membership:
    """A bounded bit filter over 64-bit hashes: a hash that was added always hits.

    The words of the bit array are a DataFrame that is broadcast; their number is at most
    ``FILTER_BITS / 64`` whatever the data.  When more hashes are added than the filter has room
    for, more rows hit, and the exact step behind the filter does more work; nothing is lost.
    """

    def __init__(self, hashes: DataFrame, col: str, count: int):
        bits = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(max(count, 1) * 64))))
        self.words = bits // 64
        h = F.col(col)
        self.table = hashes.groupBy(self._word(h).alias("_word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 as int))")).alias("_bits")
        )

    def _word(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.words - 1).cast("long"))

    def mark(self, df: DataFrame, col: str, into: str) -> DataFrame:
        """``df`` with a boolean column ``into``: whether the hash in ``col`` may have been added."""
        word, bits = column_name([*df.columns, into], "_word"), column_name([*df.columns, into], "_bits")
        at = column_name([*df.columns, into, word, bits], "_at")
        words = F.broadcast(self.table.select(F.col("_word").alias(word), F.col("_bits").alias(bits)))
        marked = df.withColumn(at, self._word(F.col(col))).join(words, F.col(at) == F.col(word), "left")
        hit = F.expr(f"(shiftrightunsigned(coalesce(`{bits}`, 0L), cast(`{col}` & 63 as int)) & 1L) = 1L")
        return marked.withColumn(into, hit).drop(word, bits, at)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` as column names that are neither taken nor alike."""
    out: list[str] = []
    for name in wanted:
        out.append(column_name([*taken, *out], name))
    return out


def without_rows(docs: DataFrame, key: str, digest: Column, gone: DataFrame, once: DataFrame) -> DataFrame:
    """``docs`` without the rows listed in ``gone``, and with one row of each listed in ``once``.

    Both lists have the columns id (long, may be null) and sha (the row's ``digest``).  Rows that miss a
    bounded filter stay where they are; of the others id and digest are compared, so no row goes by a
    hash alone, and whole texts do not move for a few dropped rows.
    """
    listed = gone.select("id", "sha", F.lit(True).alias("gone")).union(once.select("id", "sha", F.lit(False).alias("gone")))
    listed = written(listed.distinct(), "listed")
    n = listed.count()
    if not n:
        return docs
    some_once = not listed.filter("not gone").isEmpty()
    mark, hit, i, d, i2, d2, out, row = free_names(docs.columns, "_mark", "_hit", "_id", "_digest", "_id2", "_digest2", "_gone", "_row")

    def hashed(a: str, b: str) -> Column:
        return F.xxhash64(F.col(a).isNull(), F.col(a), F.col(b))

    rows = docs.withColumns({i: F.col(key).cast("long"), d: digest}).withColumn(mark, hashed(i, d))
    rows = Membership(listed.withColumn("hash", hashed("id", "sha")), "hash", n).mark(rows, mark, hit)
    stay = rows.filter(~F.col(hit)).select(*docs.columns)
    known = listed.select(F.col("id").alias(i2), F.col("sha").alias(d2), F.col("gone").alias(out))
    doubt = rows.filter(F.col(hit)).join(known, F.col(i).eqNullSafe(F.col(i2)) & (F.col(d) == F.col(d2)), "left")
    doubt = doubt.filter(~F.coalesce(F.col(out), F.lit(False)))
    if some_once:
        own = F.when(F.col(out).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
        doubt = doubt.withColumn(row, own).dropDuplicates([i, d, row])
    return stay.unionByName(doubt.select(*docs.columns))
