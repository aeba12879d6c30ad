"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import durable


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = durable(both.groupBy("node").agg(F.least(F.min("root"), "node").alias("least")))
    return (both.join(least, "node").where(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.col("least").alias("root")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = durable(links.groupBy("node").agg(F.min("root").alias("least")))
    joined = links.join(least, "node")
    return (joined.where(F.col("root") != F.col("least"))
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
            .union(least.select("node", F.col("least").alias("root"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    `links` has `node` > `root`, both of one orderable type. Every round is cut off by a reliable
    checkpoint; the minima are checkpointed too, which leaves both joins open to skew splitting for
    a node with very many links. The number of rounds grows with the logarithm of the size of the
    largest component. The driver sees one count and one checksum per round.
    """
    links = durable(links.distinct())
    seen = _signature(links)
    if not seen[0]:
        return links
    while True:
        links = durable(_small_star(durable(_large_star(links))))
        now = _signature(links)
        if now == seen:
            return links
        seen = now
