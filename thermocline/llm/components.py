"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import stored

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every larger neighbour of a node meets the least of its neighbourhood; small: the others.

    ``edges`` has u > v. Work per round is a grouping and a join on the node, so a hub's edges are split by adaptive
    execution and its least neighbour is found by partial aggregation.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v")).union(
            least.select("u", F.col("_m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``edges`` (``a``, ``b`` of one ordered type).

    Loops are ignored and null ends dropped. Each round is written to the shared folder; the number of rounds grows with the
    logarithm of a component's size.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    for _ in range(MOST_ROUNDS):
        now = stored(_star(stored(_star(now, True), label), False), label)
        found = mark(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("The components did not settle.")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
