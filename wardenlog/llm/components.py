"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import written


def _stars(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Link what stands around each node u (pairs u, v) to the smallest of u and its neighbours; u itself too where `members` has it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return members.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Columns node, root for links (a, b): root is the smallest node that is reachable. Nodes without links have no row.

    Each round is written to shared storage. A node with many neighbours is combined in the map tasks; the join back to
    its neighbours has its own exchange, which adaptive execution may split. `rows`: about how many links there are, if known.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows)
    state, n = None, edges.count()
    while True:
        # Large stars: every larger neighbour of u goes to u's smallest neighbour or u.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both, both.filter("v > u"))
        # Small stars: every smaller neighbour of u, and u, go to u's smallest neighbour.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # A round makes no more links than it has.
        down = written(down, "large-stars", n)
        edges = written(_stars(down, down.unionByName(down.select("u", F.col("u").alias("v")).distinct())), "small-stars", n)
        row = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if tuple(row) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n = tuple(row), row[0]
