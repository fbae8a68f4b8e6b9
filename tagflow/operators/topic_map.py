"""A map of topics: Jensen-Shannon distances of their words, and principal coordinates.

The divergence of two distributions p and q is half of what each gains over
their mean m.  A word that only one of them has adds p ln 2 / 2, so only words
that both have are paired: 2 JS = 2 ln 2 + sum over shared words of
p ln(p / 2m) + q ln(q / 2m), as p ln(p / m) - p ln 2 = p ln(p / 2m).  A word is
held by at most as many groups as there are; their pairs are emitted from one
row per word, in blocks of groups, and summed before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUPS = 2048     # groups of a map: a matrix of so many rows is all that reaches the driver
SLICE = 64            # groups of a word that one row holds


def shares_of(counts: DataFrame, group: str = "topic", term: str = "idx", n: str = "n") -> DataFrame:
    """``(a, term, p)``: each term's share of its group; terms without weight go."""
    c = counts.where(F.col(n) > 0).groupBy(F.col(group).alias("a"), F.col(term).alias("term")).agg(F.sum(n).alias("n"))
    total = c.groupBy("a").agg(F.sum("n").alias("all"))
    return c.join(total, "a").select("a", "term", (F.col("n") / F.col("all")).alias("p"))


def distances(shares: DataFrame) -> DataFrame:
    """``(a, b, shared, divergence)`` for all pairs a < b of groups that share a term.

    ``divergence`` is the Jensen-Shannon divergence with natural logarithms;
    groups without a common term have ln 2 and no row.
    """
    block = F.pmod(F.xxhash64("a"), F.lit(SLICE)).alias("block")
    lists = shares.groupBy("term", block).agg(F.collect_list(F.struct("a", "p")).alias("l"))
    one = lists.select("term", F.col("block").alias("i"), F.col("l").alias("x"))
    two = lists.select("term", F.col("block").alias("j"), F.col("l").alias("y"))
    both = one.join(two, "term").where("i <= j")
    pairs = both.select("i", "j", F.explode("x").alias("x"), "y").select("i", "j", "x", F.explode("y").alias("y"))
    pairs = pairs.where((F.col("i") < F.col("j")) | (F.col("x.a") < F.col("y.a")))
    p, q = F.col("x.p"), F.col("y.p")
    gain = p * F.log(p / (p + q)) + q * F.log(q / (p + q))
    out = pairs.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"), gain.alias("g"))
    return out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum("g").alias("g")).select(
        "a", "b", "shared", F.greatest(F.lit(0.0), F.log(F.lit(2.0)) + F.col("g") / 2).alias("divergence"))


def principal_coordinates(d: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates whose squared distances come closest to the squares of ``d``; of each axis the largest entry is positive."""
    k = len(d)
    centre = np.eye(k) - 1 / k
    values, vectors = np.linalg.eigh(-centre @ (d ** 2) @ centre / 2)
    take = np.argsort(-values, kind="stable")[:dims]
    out = np.zeros((k, dims))
    out[:, :len(take)] = vectors[:, take] * np.sqrt(np.maximum(values[take], 0))
    top = out[np.abs(out).argmax(axis=0), np.arange(dims)]
    return out * np.where(top < 0, -1, 1)


def topic_map(counts: DataFrame, group: str = "topic", term: str = "idx", n: str = "n") -> DataFrame:
    """``(topic, share, x, y, rank)``: groups by their share of all counts, placed by the divergences of their words.

    At most ``MAX_GROUPS`` groups; more are refused.
    """
    spark = counts.sparkSession
    sums = counts.where(F.col(n) > 0).groupBy(F.col(group).alias("a")).agg(F.sum(n).alias("n"))
    rows = sorted(map(tuple, sums.limit(MAX_GROUPS + 1).collect()))
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"a map takes at most {MAX_GROUPS} groups")
    at = {a: i for i, (a, _) in enumerate(rows)}
    d = np.full((len(rows), len(rows)), np.log(2.0))
    np.fill_diagonal(d, 0)
    for a, b, v in distances(shares_of(counts, group, term, n)).select("a", "b", "divergence").collect():
        d[at[a], at[b]] = d[at[b], at[a]] = v
    xy = principal_coordinates(d) if rows else []
    total = float(sum(c for _, c in rows))
    placed = [(a, float(c) / total, float(p[0]), float(p[1])) for (a, c), p in zip(rows, xy)]
    kind = sums.schema["a"].dataType.simpleString()
    table = spark.createDataFrame(placed, f"topic {kind}, share double, x double, y double")
    # One row per group, MAX_GROUPS at most.
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("share").desc(), F.col("topic"))))
