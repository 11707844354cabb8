"""Connected components of links between integers, by alternating large and small stars.

Every round writes its links to the shared folder, whatever their number, and the round before is removed. The least
neighbour of a node is summed up before it travels, and the join that spreads it can split a hot node's links,
so the centre of a star that a third of all nodes belong to is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

ROUNDS = 60


def _spread(pairs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs with the least neighbour of u. As a table it has a shuffle of its own in the join, so that adaptive execution can split a hot u."""
    least = tables.put(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).select("u", "v", "m")


def large_star(links: DataFrame, tables: Tables) -> DataFrame:
    """Each node's larger neighbours, linked with the least of its neighbours and itself; may repeat links."""
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
    stars = _spread(both, tables).select("v", "u", F.least("u", "m").alias("m"))
    return stars.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame, tables: Tables) -> DataFrame:
    """Each node and its smaller neighbours, linked with the least of them; links have u > v."""
    stars = _spread(links, tables)
    return stars.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link. links: u, v, neither null.

    The result is a table among ``tables``. Links that need over ``ROUNDS`` rounds (each about halves the longest path) raise an error.
    """
    down = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links, was = tables.put(down.distinct()), None
    for _ in range(ROUNDS):
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if not now[0] or now == was:
            break
        was = now
        with tables.until_later() as later:
            links = later(small_star(tables.put(large_star(links, tables)), tables), links)
    else:
        raise RuntimeError(f"components are not stable after {ROUNDS} rounds")
    centres = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
