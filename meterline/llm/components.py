"""Connected components of an edge list, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of ``edges`` (a, b).

    Alternating large-star and small-star rounds: every round links nodes to the
    smallest neighbour of a neighbourhood, and stops when no edge changes. The
    number of edges never grows, each round is one aggregation with map-side
    combine and one join whose hot keys adaptive execution splits, and its result
    is a written table. An empty edge list gives an empty result; self loops and
    repeated edges are harmless. Nodes are of any orderable type, never null.
    """
    links = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "links",
    )
    before = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("node > least")
        links = large.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        links = cut(_small(links), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _star(both: DataFrame) -> DataFrame:
    """(node, least): the larger neighbours of each centre with the centre's smallest."""
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    # the centre's own smaller neighbours keep their own links
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("node"), "least")
    )


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours and the centre itself go to the centre's smallest neighbour."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and an order-free checksum: equal marks mean that no edge changed."""
    mixed = F.xxhash64("a", "b")
    return tuple(
        links.agg(
            F.count("*"),
            F.sum(F.shiftrightunsigned(mixed, 20)),
            F.sum(mixed.bitwiseAND(F.lit((1 << 40) - 1))),
        ).first()
    )
