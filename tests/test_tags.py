"""Tag goldens: blank tags, NULL tag strings, enrichment separators."""

from pyspark.sql import functions as F

from tagflow.operators import clean, tags


def test_blank_tags_and_counts(spark):
    df = spark.createDataFrame(
        [(1, "a;;B", None), (2, None, "m"), (3, "x; a", None), (4, "A;a", None)],
        "id long, hashtags string, mentions string").withColumn("text", F.lit("t"))
    d = {r.id: (r.h_number, r.men_number) for r in clean.hashtag_decision(df).collect()}
    assert d == {1: (3, 0), 2: (0, 1), 3: (2, 0), 4: (2, 0)}      # NULL -> 0, blank tag counts
    inc = sorted(tuple(r) for r in tags.tag_incidence(df).collect())
    assert inc == [(1, ""), (1, "a"), (1, "b"), (3, "a"), (3, "x"), (4, "a"), (4, "a")]
    counts = {r.tag: (r.Count, r.n_tweets) for r in tags.tag_counts(tags.tag_incidence(df)).collect()}
    assert counts == {"": (1, 1), "a": (4, 3), "b": (1, 1), "x": (1, 1)}   # repeats in a tweet count
    nodes, n = tags.graph_nodes(tags.popular_tags(tags.tag_counts(tags.tag_incidence(df)), 0))
    assert n == 4
    assert [(r.Id, r.Name) for r in nodes.orderBy("Id").collect()] == [(1, "a"), (2, ""), (3, "b"), (4, "x")]


def test_top_tags_ranks(spark):
    counts = spark.createDataFrame([(f"t{i:02d}", 30 - i) for i in range(25)], "tag string, Count long")
    top = [(r.Id, r.Label) for r in tags.top_tags(counts).orderBy("Id").collect()]
    assert len(top) == 20 and top[0] == (1, "t00") and top[-1] == (20, "t19")


def test_full_profile_has_rows_for_optional_columns(spark):
    from tagflow.operators import ingest

    base = spark.createDataFrame([(1, 0, 5, 0, 1, 0.0, 1, None, "here", 1), (0, 7, 0, 0, 0, 2.5, 0, 1, None, 0)],
                                 "retweet int, quoted_status_id long, in_reply_to_status_id long, id long, truncated int, "
                                 "lat double, possibly_sensitive int, withheld_copyright int, location string, "
                                 "from_user_verified int")
    got = {r.characteristic: r.value for r in ingest.corpus_profile_full(base).collect()}
    assert len(got) == 21 and got["Number of columns"] == 10
    assert got["--Tweets with a link referring to a sensitive content"] == 1
    assert got["--Tweets that their content is removed due to copyright"] == 1
    assert got["--Tweets with user specified location text"] == 1
    assert got["--Tweets issued by users with verified accounts"] == 1
    slim = base.drop("possibly_sensitive", "withheld_copyright", "location", "from_user_verified")
    assert ingest.corpus_profile_full(slim).count() == 17
