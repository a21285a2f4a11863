"""Connected components of a graph given as a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


#: Links for each task; a table of few links needs few tasks, whatever the session's number of shuffle partitions.
LINKS_A_TASK = 100_000


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).coalesce(tasks)
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    moved = e.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Rounds go on until the links no longer change; then each node links to its component's smallest node.  Links are
    grouped by node with a minimum, which is pre-aggregated before the shuffle; then they meet their node's one row in an inner
    join, in which Spark splits a node with very many links (adaptive skew join).  Each round is written to the shared folder,
    which cuts the lineage.  No links: no rows.
    """
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    e = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    was, k = None, 0
    while (now := sign(e)) != was and now[0]:
        was, k, tasks = now, k + 1, max(1, -(-now[0] // LINKS_A_TASK))
        e = stash(_small_star(_large_star(e, tasks), tasks), f"{name}_{k}")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
