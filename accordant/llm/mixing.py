"""Mixing sources to target weights: budgets by weight, filled by a subset-sum choice of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.common import WORDS, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
SHARES = 4096  # parts of a group of equal sizes, by hash; only one of them is ranked
BROADCAST_PLAN = 100_000  # rows of the plan (source and size) up to which it is broadcast
DP_WORDS = 1 << 18  # budget that is left to the dynamic programme


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_REPEATS) -> DataFrame:
    """``(source_key, source_size, target)`` from ``(source_key, source, source_size)``, one row per source.

    Sources in code-point order (null last) take the weights in turn; the targets share all words,
    and what exceeds ``limit`` times a source's size is shared again by weight among the others.
    The order comes from a range partitioning with partition offsets, so no task holds all sources.
    """
    spark = sizes.sparkSession
    n = sizes.count()
    parts = max(1, min(n // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = written(
        sizes.repartitionByRange(parts, F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    # One number per partition, not per source.
    offset, seen = {}, 0
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).orderBy("part").collect():
        offset[r.part] = seen - r.at
        seen += r.n
    shift = F.create_map(*[F.lit(x) for kv in (offset or {0: 0}).items() for x in kv])
    rank = F.col("at") + shift[F.col("part")]
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.withColumn("weight", F.get(weight, F.pmod(rank, F.lit(len(weights))).cast("int")))
    cap = F.col("source_size") * F.lit(float(limit))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, over = 0.0, -1  # target of an uncapped source = level * weight
    while True:
        capped = F.col("weight") * F.lit(level) > cap
        r = ranked.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.coalesce(F.sum(capped.cast("long")), F.lit(0)).alias("over"),
        ).first()
        if r.over == over or r.weights == 0:
            break
        over, level = r.over, (total - r.held) / r.weights
    target = F.when(capped, cap).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source_key", "source_size", target.alias("target"))


def _fill(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``spare`` documents of each size to take so that their words come nearest below ``budget``.

    Bounded knapsack by bit sets: bit b of a layer says that b words can be reached with the sizes
    so far; counts are split into powers of two.  The choice is read back through the layers.
    """
    taken = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):  # a budget beyond the table is first run down greedily
        if budget <= DP_WORDS:
            break
        taken[i] = min(spare[i], (budget - DP_WORDS) // sizes[i] + 1, budget // sizes[i])
        budget -= int(taken[i] * sizes[i])
    mask, reach = (1 << (budget + 1)) - 1, 1
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        left, k, size = min(int(spare[i] - taken[i]), budget // int(sizes[i])), 1, int(sizes[i])
        while left > 0 and not reach >> budget:
            k = min(k, left)
            items.append((int(i), k, reach))
            reach |= (reach << (k * size)) & mask
            left -= k
            k *= 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(items):
        if not before >> at & 1:
            taken[i] += k
            at -= k * int(sizes[i])
    return taken


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats and extra documents per size, for one source's counts of sizes."""
    pdf = pdf.sort_values("size", kind="stable")
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    repeats, extra = 0, np.zeros(len(sizes), np.int64)
    if total > 0:
        repeats = int(target / total + 1e-9)
        budget = max(0, int(target - repeats * total + 1e-6))
        some = sizes > 0
        share = budget / total
        extra[some] = np.floor(counts[some] * share)  # every size by its share, so the mix keeps the source's profile
        left = budget - int((extra * sizes).sum())
        extra[some] += _fill(sizes[some], counts[some] - extra[some], left)
    return pd.DataFrame({
        "source_key": pdf["source_key"].to_numpy(), "size": sizes, "n": counts, "source_size": total, "target": target,
        "repeats": repeats, "extra": extra,
    })


def _rows(docs: DataFrame, key: str, text: str, source: str, seed: int, keep: list[str] | None) -> DataFrame:
    """Working columns beside the given ones, which travel in a struct so that names cannot clash."""
    src = F.col(source).cast("string")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(
        F.struct(*(keep or docs.columns)).alias("row"), F.col(key).cast("long").alias("doc_id"), src.alias("source"),
        F.coalesce(F.concat(F.lit("="), src), F.lit("")).alias("source_key"), words.alias("size"),
        F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)).alias("mark"), F.xxhash64(F.col(text)).alias("tie"),
    ).withColumn("part", F.pmod("mark", F.lit(SHARES)).cast("int"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """One row per (source, size): the source's size and target, whole repeats, and which hashes are taken once more.

    ``edge`` is the hash part in which the number of extra documents is reached and ``within`` how
    many of that part are taken; parts below go whole (-1: none at all).
    """
    counts = written(rows.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sums = counts.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sums, weights, limit), "targets")
    plan = written(
        counts.select("source_key", "size", "n").join(targets, "source_key").groupBy("source_key").applyInPandas(
            _choose, "source_key string, size long, n long, source_size long, target double, repeats long, extra long"
        ),
        "plan",
    )
    some = plan.filter("extra > 0 and extra < n").select("source_key", "size", "extra")
    by_part = rows.select("source_key", "size", "part").join(some, ["source_key", "size"]).groupBy("source_key", "size", "extra", "part")
    upto = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        by_part.agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(upto))
        .filter("upto >= extra and upto - k < extra")
        .select("source_key", "size", "part", (F.col("extra") - F.col("upto") + F.col("k")).alias("within"))
        .withColumnRenamed("part", "edge")
    )
    whole = F.when(F.col("extra") == F.col("n"), F.lit(SHARES)).otherwise(F.lit(-1))
    plan = plan.join(edge, ["source_key", "size"], "left")
    return written(plan.withColumn("edge", F.coalesce("edge", whole)).drop("n", "extra"), "choice")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's figures and ``times``, how often the mix takes the row."""
    if plan.count() <= BROADCAST_PLAN:
        plan = F.broadcast(plan)
    joined = rows.join(plan, ["source_key", "size"])
    clear = joined.filter("part <> edge").withColumn("more", F.col("part") < F.col("edge"))
    # Only the part of a group in which its count is reached is ranked, so no group is sorted whole.
    order = Window.partitionBy("source_key", "size").orderBy("mark", "doc_id", "tie")
    ranked = joined.filter("part = edge").withColumn("more", F.row_number().over(order) <= F.col("within"))
    return clear.unionByName(ranked).withColumn("times", F.col("repeats") + F.col("more").cast("long"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_REPEATS, seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted).

    Size is the number of words; a null or empty text has none and takes none.  A null source is a
    source of its own, after all others.  Each source gets whole repeats of all its documents and,
    for the rest of its budget, a subset whose sizes add up to it: sizes are counted, every size
    gives its share, a bounded knapsack over the counts closes the gap, and within a size the
    documents with the smallest seeded hashes are taken.  Rows that repeat id and text are documents
    of their own.  The choice depends on rows and seed only, so reruns agree.  An empty table gives
    no rows; other columns are not read.
    """
    rows = written(_rows(docs, key, text, source, seed, [key]).drop("row"), "sizes")
    out = _taken(rows, mix_plan(rows, weights, limit))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_REPEATS, seed: int = 17,
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, all columns unchanged.

    Documents without words weigh nothing and stay once.  The plan is made from ids and sizes alone;
    texts are not shuffled while it is small enough to broadcast, but for the few rows at a group's edge.
    """
    narrow = written(_rows(docs, key, text, source, seed, [key]).drop("row"), "sizes")
    out = _taken(_rows(docs, key, text, source, seed, None), mix_plan(narrow, weights, limit))
    times = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("times"))
    out = out.select("row", times.alias("times")).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
