"""Tag graph: co-occurrence edges, label propagation clusters, modularity.

Where the tags of a tweet come as one array, its pairs are built inside the
row (``cooccur_in_rows``): no shuffle, no join.  For a long incidence table,
co-occurrence is a self-join on the tweet id.  The per-tweet de-duplication is
an aggregate on (tweet, tag) -- partial aggregation first, and a tweet with
very many tags is spread over tasks -- and the self-join's own shuffle on the
tweet id is one the planner inserts, so AQE may split a skewed tweet (it does
not split shuffles a user asked for with ``repartition``).  Either way each
undirected pair comes once and without self-loops; each output row is a
result row (one edge per tweet and pair).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, with_constants
from ..session import stage


def cooccur_pairs(incidence: DataFrame) -> DataFrame:
    """``(tweet_id, tag_a, tag_b)`` with tag_a < tag_b, distinct per tweet."""
    d = incidence.select("tweet_id", "tag").distinct()
    a, b = d.alias("a"), d.alias("b")
    return (a.join(b, (F.col("a.tweet_id") == F.col("b.tweet_id")) & (F.col("a.tag") < F.col("b.tag")))
             .select(F.col("a.tweet_id").alias("tweet_id"), F.col("a.tag").alias("tag_a"),
                     F.col("b.tag").alias("tag_b")))


def cooccur_in_rows(tagged: DataFrame, id_col: str = "id", tags_col: str = "hashtags") -> DataFrame:
    """``cooccur_pairs`` of a table with one array of normalised tags per tweet."""
    tags = F.array_sort(F.array_distinct(F.col(tags_col)))
    heads = F.transform(tags, lambda a, i: F.transform(
        F.slice(tags, i + 2, F.size(tags)), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b"))))
    return tagged.select(F.col(id_col).alias("tweet_id"), F.explode(F.flatten(heads)).alias("p")).select(
        "tweet_id", "p.tag_a", "p.tag_b")


def popular_edges(pairs: DataFrame, nodes: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """One edge per pair of which both tags are nodes: ``TweetID, Source, Target, Type, Weight=1``."""
    e = _with_ids(pairs, nodes, n_nodes, "inner")
    return e.select(F.col("tweet_id").alias("TweetID"), "Source", "Target",
                    F.lit("Undirected").alias("Type"), F.lit(1).alias("Weight"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Edges summed over tweets: ``Source, Target, Type, Weight``."""
    return edges.groupBy("Source", "Target").agg(F.sum("Weight").cast("long").alias("Weight")).select(
        "Source", "Target", F.lit("Undirected").alias("Type"), "Weight")


def _with_ids(pairs: DataFrame, nodes: DataFrame, n_nodes: int | None, how: str = "left") -> DataFrame:
    ids = nodes.select(F.col("Name").alias("tag_a"), F.col("Id").alias("id_a"))
    j = lookup_join(pairs, ids, "tag_a", how, n_nodes)
    ids_b = nodes.select(F.col("Name").alias("tag_b"), F.col("Id").alias("id_b"))
    j = lookup_join(j, ids_b, "tag_b", how, n_nodes)
    return (j.withColumn("Source", F.least("id_a", "id_b"))
             .withColumn("Target", F.greatest("id_a", "id_b")))


def cooccur_edges(incidence: DataFrame, nodes: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """One edge per tweet and tag pair: ``TweetID, Source, Target, Type, Weight=1``."""
    e = _with_ids(cooccur_pairs(incidence), nodes, n_nodes)
    return e.select(F.col("tweet_id").alias("TweetID"), "Source", "Target",
                    F.lit("Undirected").alias("Type"), F.lit(1).alias("Weight"))


def cooccur_weighted(incidence: DataFrame, nodes: DataFrame | None = None,
                     n_nodes: int | None = None) -> DataFrame:
    """Edges summed over tweets: ``Source, Target, Weight`` (tweets sharing the pair).

    Pairs are counted by name first (partial aggregation before the shuffle,
    so a pair in a third of all tweets costs one row per map task), and only
    the distinct pairs are mapped to node ids.
    """
    w = cooccur_pairs(incidence).groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("Weight"))
    if nodes is None:
        return w
    e = _with_ids(w, nodes, n_nodes)
    return e.select("Source", "Target", F.lit("Undirected").alias("Type"), "Weight")


def symmetric_edges(weighted: DataFrame) -> DataFrame:
    """Undirected weighted edges ``(Source, Target, Weight)`` in both directions."""
    e = weighted.select(F.col("Source").alias("src"), F.col("Target").alias("dst"),
                        F.col("Weight").cast("double").alias("w")).where(F.col("src") != F.col("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def tag_clusters(nodes: DataFrame, weighted: DataFrame, n_nodes: int | None = None,
                 max_rounds: int = 200) -> tuple[DataFrame, int]:
    """Label propagation on the weighted tag graph: ``(Id, cluster)``.

    Synchronous rounds: every node takes the label with the largest summed
    edge weight among its neighbours, with a self-vote equal to its largest
    incident edge weight (without it synchronous propagation oscillates);
    ties go to the smallest label.  Each round is a join of the edges with
    the current labels and two aggregations (partial aggregation first, so
    a hub node does not sit in one task); the new labels are written to the
    shared folder, which cuts the lineage and survives the loss of an
    executor.  Ends when no label changes and returns ``(labels, rounds)``; if
    labels still change after ``max_rounds`` it raises, since unsettled labels
    are no result.
    """
    sym = symmetric_edges(weighted)
    selfw = sym.groupBy("src").agg(F.max("w").alias("w")).select("src", F.col("src").alias("dst"), "w")
    votes_edges = stage(sym.unionByName(selfw), "votes")
    labels = stage(nodes.select("Id", F.col("Id").alias("cluster")), "labels")
    for rounds in range(1, max_rounds + 1):
        lab = labels.select(F.col("Id").alias("dst"), F.col("cluster").alias("lab"))
        looked = lookup_join(votes_edges, lab, "dst", "inner", n_nodes)
        score = looked.groupBy("src", "lab").agg(F.sum("w").alias("s"))
        best = score.groupBy("src").agg(
            F.max_by("lab", F.struct(F.col("s"), (-F.col("lab")).alias("neg"))).alias("new"))
        nxt = stage(labels.join(best.withColumnRenamed("src", "Id"), "Id", "left")
                          .select("Id", F.col("cluster").alias("old"),
                                  F.coalesce("new", "cluster").alias("cluster")), "labels")
        labels = nxt.select("Id", "cluster")
        if not nxt.where(F.col("old") != F.col("cluster")).limit(1).count():
            return labels, rounds
    raise RuntimeError(f"tag clusters still change after {max_rounds} rounds")


def modularity(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of a labelling: sum_c [ L_c / m - (d_c / 2m)^2 ].

    ``L_c`` is the weight inside cluster c, ``d_c`` the weighted degree sum of
    its nodes and ``m`` the total edge weight; all are aggregates.
    """
    sym = symmetric_edges(weighted)
    lab = labels.select(F.col("Id").alias("src"), F.col("cluster").alias("cs"))
    lab2 = labels.select(F.col("Id").alias("dst"), F.col("cluster").alias("cd"))
    j = sym.join(lab, "src").join(lab2, "dst")
    per = j.groupBy("cs").agg(F.sum("w").alias("deg"),
                              F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inner"))
    tot = sym.agg((F.sum("w") / 2).alias("m"))
    q = with_constants(per, tot).agg(
        F.sum(F.col("inner") / 2 / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))
    nclu = labels.agg(F.countDistinct("cluster").alias("n_clusters"))
    return with_constants(nclu, q)


def modularity_by(weighted: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """``modularity`` of several labellings ``(Id, by, cluster)`` of one graph: ``(by, n_clusters, modularity)``."""
    sym = symmetric_edges(weighted)
    a = labels.select(F.col("Id").alias("src"), by, F.col("cluster").alias("cs"))
    b = labels.select(F.col("Id").alias("dst"), by, F.col("cluster").alias("cd"))
    inside = (sym.join(a, "src").join(b, ["dst", by])
              .groupBy(by, F.col("cs").alias("cluster")).agg(
                  F.sum("w").alias("deg"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inner")))
    tot = sym.agg((F.sum("w") / 2).alias("m"))
    q = with_constants(inside, tot).groupBy(by).agg(
        F.sum(F.col("inner") / 2 / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))
    return labels.groupBy(by).agg(F.countDistinct("cluster").alias("n_clusters")).join(q, by, "left")
