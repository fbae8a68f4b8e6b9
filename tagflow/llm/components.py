"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every round links each node to
the smallest node it knows, until only stars are left.  Edges are kept as
(larger, smaller) node.  A round is two aggregates with map-side combining and
two joins of the edges with what the aggregates found.  Those results are
written before the join, so both of its sides are shuffled for it and the
edges of a node with very many neighbours can be split.  The edges are written
after every round: the lineage stays short and a lost executor costs one round.
Number of rounds: logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge to another node.

    ``component`` is the smallest node reachable.  Loops and rows with a null
    end are no edges; repeated edges count once.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    cur, before = staged(e, "edges"), None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        low = staged(cur.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = cur.join(low.select(u.alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = staged(large.distinct(), "edges")
        # Small star: the smaller neighbours of a node, and the node, are linked to the smallest.
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        nxt = staged(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(cur, low, large, low2)
        cur = nxt
        if mark == before:
            roots = cur.select(v.alias("node"), v.alias("component")).distinct()
            return cur.select(u.alias("node"), v.alias("component")).unionByName(roots)
        before = mark
