"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import gathered, stored

BROADCAST_NODES, LINKS_PER_TASK = 1 << 17, 50_000


def stars(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b) but the components' own: the least node it is joined with.

    Alternates large and small stars until every node has one smaller neighbour and that one has none: every node hands
    its larger neighbours, then its smaller ones, to the least of them. A round is two aggregations and joins; rounds grow
    with the logarithm of the number of nodes. Every round is written to the shared folder. What an earlier call returned
    stands for its links in the next one.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    rounds = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = F.when(F.col("b") < F.col("a"), F.col("b"))
        ends = both.groupBy("a").agg(F.min(smaller).alias("low"), F.max(smaller).alias("high"), F.max("b").alias("top"), F.count("*").alias("n"))
        nodes, twice, open_ = ends.agg(F.count("*"), F.sum("n"), F.count_if(F.expr("low != high or low is not null and top > a"))).first()
        if not open_:
            return (edges if rounds else edges.distinct()).select(F.col("a").alias("node"), F.col("b").alias("component"))
        # every round has these nodes or fewer: few of them go to the edges, not the edges to them
        few = F.broadcast if nodes <= BROADCAST_NODES else lambda table: table
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(few(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        small = large.join(few(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges, rounds = stored(gathered(small, twice // 2, LINKS_PER_TASK), "links"), rounds + 1


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b): component is the least node it is joined with."""
    found = stars(links)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
