"""Connected components of a graph of 64-bit nodes, by large and small stars.

Nothing is gathered on the driver but two numbers a round; minima come from
partial aggregates and hubs go through joins that Spark can split, so a node
with very many links burdens no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portloom.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node that it sees."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't the least of its component.

    Loops (u = v), repeated edges and an empty table are fine.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        sums = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("s")).first()
        if tuple(sums) == before or not sums["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(sums)
        e = stored(_small_star(_large_star(e)), "stars")
