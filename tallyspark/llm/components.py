"""Connected components of a graph by large-star and small-star rounds, with a checkpoint after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

ROWS = 200_000  # edges in a partition, where there are so many


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges in partitions of ROWS or more, and what tells one set of them from another: how many, and the XOR of their hashes."""
    mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    return edges.coalesce(max(1, -(-mark[0] // ROWS))), mark


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v of any one ordered type. Returns node, root: the least node that can be reached.

    Nodes without edges aren't in the result. Each round makes every node's larger (then smaller) neighbours neighbours of
    its least one, so long chains shorten geometrically, and `rounds` (an error beyond) is never near. No group is gathered:
    only minima and joins are used.
    """
    now, mark = _marked(durable(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    for _ in range(rounds):
        if not mark[0]:
            break
        both = _both(now)
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge goes from the larger node (u) to a smaller one (v)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = durable(small.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before, (now, mark) = mark, _marked(now)
        if mark == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
