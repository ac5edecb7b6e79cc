"""Labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import fold, written

FOLDS = 5


def held_out(key: str):
    """Whether a document's label may not be learned from: its id's CRC-32 leaves no remainder."""
    return fold(F.col(key)) % FOLDS == 0


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text", seed: int = 3
) -> DataFrame:
    """``(text, label)`` of labelled documents outside the held-out fold, written to the shared folder.

    At most about ``bound`` of them: above it, a share by hash.  Rows with a null id, label or text
    are left out; of several labels of one id the largest counts.  The chosen labels are bounded in
    number, so they are broadcast and no text is shuffled.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    )
    known = written(known, "labels")
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text")).filter("text is not null")
    return written(rows.join(F.broadcast(known), "_id").select("text", "label"), "labelled")
