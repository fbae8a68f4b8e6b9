"""Modularity classes: multi-level modularity optimisation of a weighted graph.

Each level moves nodes between communities while the modularity rises, then
makes every community one node of the next level's graph.  Moves of a round
happen in parallel under a rule that keeps every one of them a gain:

* Every node that gains by a move names its best one.  A community gives nodes
  in a round if the best of the moves out of it beats the best of those into it,
  else it takes nodes; moves from giving to taking communities are considered.
  The best move of all is always one of them.
* With ``2m`` the total weight (both directions), ``k`` a node's degree, ``w_D``
  its weight into a community and ``t_D`` that community's degree, a move from C
  to D changes the modularity by ``g / 2m^2``,
  ``g = 2m (w_D - w_C) - k (t_D - t_C + k)``.
* Movers into the same D, or out of the same C, are ordered by a level: first a
  move that is the best of both, then by the leading zeros of a hash.  Whatever
  moves earlier, a mover's gain shrinks by no more than ``k`` times their degrees
  (weights between movers only help), so it is accepted if ``g`` exceeds ``k``
  times the degrees of all others of its level and above.  The sums are
  aggregates by (community, level), at most 32 rows a community, so a community
  that millions want to join is never gathered.

Modularity therefore never falls, from round to round and level to level.
Rounds are joins and aggregates of written tables, whose sizes the planner reads
from their files; nothing is collected but the total weight and counts.  Ties go
to the smallest community.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .graph import symmetric_edges

RANGE = 1 << 31
#: An odd multiplier of the hash and what a round adds to it (even, so that it stays odd).
TURN, TURN_STEP = 843314861, 2 * 7368787
TOP_LEVEL = 31


def level_of(node: Column, turn: int) -> Column:
    """Leading zeros of a 31-bit hash: half the nodes at 0, a quarter at 1, and so on, at most 30."""
    mixed = ((node % RANGE + 1) * (TURN + TURN_STEP * turn)) % RANGE
    return F.lit(31) - F.length(F.bin(mixed))


def options(edges: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """Id, c, k, d, g: the best move of every node that gains by one, from c to d."""
    at = state.select(F.col("Id").alias("dst"), F.col("c").alias("d"))
    into = edges.where("src <> dst").join(at, "dst").groupBy("src", "d").agg(F.sum("w").alias("w"))
    degree = state.groupBy(F.col("c").alias("d")).agg(F.sum("k").alias("t"))
    own = state.select(F.col("Id").alias("src"), "c", "k")
    other, value = F.col("d") != F.col("c"), m2 * F.col("w") - F.col("k") * F.col("t")
    best = into.join(degree, "d").join(own, "src").groupBy(F.col("src").alias("Id"), "c", "k").agg(
        F.sum(F.when(~other, F.col("w")).otherwise(0.0)).alias("w_own"),
        F.max(F.when(other, F.struct(value.alias("v"), (-F.col("d")).alias("neg")))).alias("top"))
    best = best.join(degree.withColumnRenamed("d", "c"), "c")
    gain = F.col("top.v") - (m2 * F.col("w_own") - F.col("k") * (F.col("t") - F.col("k")))
    return best.select("Id", "c", "k", (-F.col("top.neg")).alias("d"), gain.alias("g")).where("g > 0")


def accepted(opts: DataFrame, turn: int) -> DataFrame:
    """Id and d of the moves that are gains whatever else is accepted."""
    opts = opts.withColumn("rank", F.struct("g", (-F.col("Id")).alias("neg")))
    out = opts.groupBy("c").agg(F.max("rank").alias("out"))
    into = opts.groupBy("d").agg(F.max("rank").alias("into"))
    j = (opts.join(out, "c").join(into, "d")
         .join(into.select(F.col("d").alias("c"), F.col("into").alias("into_c")), "c", "left")
         .join(out.select(F.col("c").alias("d"), F.col("out").alias("out_d")), "d", "left"))
    movers = j.where((F.col("into_c").isNull() | (F.col("out") > F.col("into_c")))
                     & (F.col("out_d").isNull() | (F.col("into") > F.col("out_d"))))
    best = (F.col("rank") == F.col("out")) & (F.col("rank") == F.col("into"))
    movers = movers.select("Id", "c", "d", "k", "g",
                           F.when(best, TOP_LEVEL).otherwise(level_of(F.col("Id"), turn)).alias("lv"))

    def above(side: str, name: str) -> DataFrame:
        per = movers.groupBy(side, "lv").agg(F.sum("k").alias("s"))
        w = Window.partitionBy(side).orderBy(F.col("lv").desc())
        return per.select(side, "lv", F.sum("s").over(w).alias(name))

    j = movers.join(above("d", "s_in"), ["d", "lv"]).join(above("c", "s_out"), ["c", "lv"])
    return j.where(F.col("g") > F.col("k") * (F.col("s_in") + F.col("s_out") - 2 * F.col("k"))).select("Id", "d")


def local_moves(edges: DataFrame, nodes: DataFrame, m2: float, max_rounds: int) -> tuple[DataFrame, int]:
    """``(Id, c)`` after moving nodes until no move is a gain, and the number of rounds that moved some."""
    degree = edges.groupBy(F.col("src").alias("Id")).agg(F.sum("w").alias("k"))
    state = stage(nodes.select("Id").join(degree, "Id", "left")
                  .select("Id", F.col("Id").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")), "communities")
    for turn in range(1, max_rounds + 1):
        opts = stage(options(edges, state, m2), "moves")
        if not opts.limit(1).count():
            break
        state = stage(state.join(accepted(opts, turn), "Id", "left")
                      .select("Id", F.coalesce("d", "c").alias("c"), "k"), "communities")
    # a community is called by the smallest of its nodes
    names = state.groupBy("c").agg(F.min("Id").alias("name"))
    return stage(state.join(names, "c").select("Id", F.col("name").alias("c")), "communities"), turn - 1


def modularity_classes(nodes: DataFrame, weighted: DataFrame, max_rounds: int = 100, max_levels: int = 20) -> DataFrame:
    """``(Id, level, cluster)``: the communities of every level, from 1; a cluster is named by its smallest Id.

    ``nodes`` has ``Id``, ``weighted`` one row ``(Source, Target, Weight)`` per
    undirected edge with weights above zero; self-loops are left out.  Levels end
    when one moves nothing; ``max_rounds`` bounds a level's rounds (whatever is
    reached by then is a valid labelling, since modularity only rises).  A node
    without edges stays alone.
    """
    edges = stage(symmetric_edges(weighted).groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
    m2 = edges.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    top, members, found = nodes.select("Id"), nodes.select("Id", F.col("Id").alias("at")), []
    for level in range(1, max_levels + 1):
        labels, moved = local_moves(edges, top, m2, max_rounds)
        if not moved and found:
            break
        to = labels.select(F.col("Id").alias("at"), F.col("c").alias("to"))
        members = stage(members.join(to, "at").select("Id", F.col("to").alias("at")), "members")
        found.append(members.select("Id", F.lit(level).alias("level"), F.col("at").alias("cluster")))
        if not moved:
            break
        src = labels.select(F.col("Id").alias("src"), F.col("c").alias("a"))
        dst = labels.select(F.col("Id").alias("dst"), F.col("c").alias("b"))
        edges = stage(edges.join(src, "src").join(dst, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
                      .agg(F.sum("w").alias("w")), "edges")
        top = stage(labels.select(F.col("c").alias("Id")).distinct(), "nodes")
    return reduce(DataFrame.unionByName, found)


def last_level(classes: DataFrame) -> DataFrame:
    """``(Id, cluster)`` of the highest level."""
    return classes.groupBy("Id").agg(F.max_by("cluster", "level").alias("cluster"))
