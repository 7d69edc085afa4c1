"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long); root is one node of the component.

    Each round every node points to the neighbour (or itself) of the least hash and the graph
    is contracted along these pointers, which takes a number of rounds logarithmic in the
    size whatever the order of ids. Only aggregates that combine before a shuffle and
    joins that adaptive execution can split are used, so a node with very many links is no
    bottleneck. Loops and repeated links are allowed; nulls are not links.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges = materialize(edges, "cc-links", narrow=True)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    steps = []
    edges = edges.where("a <> b")
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        to = both.groupBy("a").agg(least).select(F.col("a").alias("from"), F.least(F.col("m"), own)["v"].alias("to"))
        to = materialize(to, "cc-steps", narrow=True)
        steps.append(to)
        ends = edges.join(to, edges["a"] == to["from"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(to, ends["b"] == to["from"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links", narrow=True)
    # Every round's pointers are tables, so following them one after the other is a plan of joins, eight at a time.
    roots = nodes.select("node", F.col("node").alias("root"))
    for n, to in enumerate(steps):
        if n and n % 8 == 0:
            roots = materialize(roots, "cc-roots", narrow=True)
        roots = roots.join(to, roots["root"] == to["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(roots, "cc-roots", narrow=True)
