"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component_id)`` for every node of ``links``; the id is the smallest node reachable.

    Each round points a node at the node with the smallest salted hash within two links of it, and
    contracts the links to the targets.  The hash changes with the round, so chains contract by a
    constant share too, and the number of rounds grows with the logarithm of a component's width.
    Rounds are written to the shared folder; only their row counts come to the driver.
    Null ends are ignored; self-links make a node of its own.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    start = links.select(x.alias("a"), y.alias("b")).filter("a is not null and b is not null")
    edges = written(start.distinct(), "links")
    steps: list[DataFrame] = []
    left = edges.filter("a <> b")
    n = left.count()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if n == 0:
        return nodes.select("node", F.col("node").alias("component_id"))
    while n:
        salt = len(steps)
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def key(c: str):
            # The hash orders, the id below it tells equal hashes apart.
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("to"))

        near = both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least(F.col("m"), key("a"))["to"].alias("n"))
        # The smallest within two steps: all leaves of a star find the same target at once.
        far = both.join(near.select(F.col("a").alias("b"), "n"), "b").groupBy("a").agg(F.min(key("n")).alias("m"))
        step = written(far.select(F.col("a").alias("x"), F.col("m")["to"].alias("to")), "step")
        steps.append(step)
        left = written(
            left.join(step.select(F.col("x").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("x").alias("b"), F.col("to").alias("tb")), "b")
            .filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            "links",
        )
        n = left.count()
    at = nodes.select("node", F.col("node").alias("root"))
    for step in steps:
        at = at.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("to", "root").alias("root"))
    at = written(at, "roots")
    least = at.groupBy("root").agg(F.min("node").alias("component_id"))
    return at.join(least, "root").select("node", "component_id")
