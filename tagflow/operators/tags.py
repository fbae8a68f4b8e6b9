"""Tags: incidence table, counts, popularity cut, node table, reports.

The tag-tweet incidence is a long table ``(tweet_id, tag)``, one row per tag
occurrence.  The per-tag *set of tweet ids* of the reference is that table
itself; it is never collected into one row (a hot tag would be one huge
array in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..plans.joins import with_constants
from ..plans.rank import number_rows
from .ingest import labelled


def tagged_tweets(df: DataFrame) -> DataFrame:
    """Tweets with a tag string; ``hashtags`` becomes an array."""
    return (df.where(F.col("hashtags").isNotNull())
              .withColumn("hashtags", F.split(F.col("hashtags"), ";")))


def explode_lists(df: DataFrame, cols: list[str], fill_value: str = "") -> DataFrame:
    """One row per list element, several list columns in parallel.

    Rows with an empty (or NULL) list stay, with ``fill_value`` in the list
    columns; the other columns are repeated.
    """
    others = [c for c in df.columns if c not in cols]
    if len(cols) == 1:
        c = cols[0]
        out = df.select(*others, F.explode_outer(c).alias(c))
        return out.withColumn(c, F.coalesce(F.col(c), F.lit(fill_value)))
    zipped = df.select(*others, F.inline_outer(F.arrays_zip(*cols)))
    return zipped.select(*others, *[F.coalesce(F.col(c), F.lit(fill_value)).alias(c) for c in cols])


def normalize_tag(c) -> "F.Column":
    """Lower-case and strip blanks (all Unicode whitespace, as ``str.strip``)."""
    return tx.py_strip(F.lower(c))


def tag_incidence(df: DataFrame, extra_cols=()) -> DataFrame:
    """``(tweet_id, tag, *extra_cols)``, one row per tag occurrence, normalised."""
    t = tagged_tweets(df).select(F.col("id").alias("tweet_id"), "hashtags", *extra_cols)
    ex = explode_lists(t, ["hashtags"])
    return ex.select("tweet_id", normalize_tag(F.col("hashtags")).alias("tag"), *extra_cols)


def tag_counts(incidence: DataFrame) -> DataFrame:
    """Occurrences per tag (repeats inside a tweet count) and distinct tweets."""
    return incidence.groupBy("tag").agg(F.count(F.lit(1)).alias("Count"),
                                        F.countDistinct("tweet_id").alias("n_tweets"))


def popular_tags(counts: DataFrame, n: int) -> DataFrame:
    """Tags with at least ``n`` occurrences (n = 0 keeps all)."""
    return counts.where(F.col("Count") >= n)


def reduce_incidence(incidence: DataFrame, popular: DataFrame) -> DataFrame:
    """Occurrences of popular tags only (left-semi join: the tag column only)."""
    return incidence.join(popular.select("tag"), "tag", "left_semi")


def graph_nodes(popular: DataFrame) -> tuple[DataFrame, int]:
    """Node table ``Id, Name, Label, Count``: Id 1..N by Count desc, Name asc."""
    numbered, n = number_rows(popular.select("tag", "Count"),
                              [F.col("Count").desc(), F.col("tag").asc()])
    nodes = numbered.select("Id", F.col("tag").alias("Name"), F.col("tag").alias("Label"), "Count")
    return nodes, n


def top_tags(popular: DataFrame, k: int = fixed.TOP_TAGS) -> DataFrame:
    """The k most frequent tags with their rank (a bounded top-k, one small task)."""
    from pyspark.sql import Window

    top = popular.orderBy(F.col("Count").desc(), F.col("tag").asc()).limit(k)
    w = Window.orderBy(F.col("Count").desc(), F.col("tag").asc())
    return top.select(F.row_number().over(w).alias("Id"), F.col("tag").alias("Label"), "Count")


def url_by_tagcount(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Per tags-per-tweet: tweets, links in total, tweets with a link, their share."""
    links = F.size(tx.extract_links(F.col(text_col)))
    per = df.select("h_number", links.alias("url_count"))
    return (per.groupBy(F.col("h_number").alias("hash_count"))
               .agg(F.count(F.lit(1)).alias("number_of_tweets"),
                    F.sum("url_count").alias("url_total_count"),
                    F.count_if(F.col("url_count") > 0).alias("url_total_withurl"))
               .withColumn("url_percent_withurl",
                           F.col("url_total_withurl") / F.col("number_of_tweets")))


def extract_urls(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    links = tx.extract_links(F.col(text_col))
    return texts.select(id_col, F.size(links).alias("url_count"),
                        F.array_join(links, " ").alias("urls"))


def tag_report(df: DataFrame, incidence: DataFrame, popular_incidence: DataFrame,
               edges: DataFrame) -> DataFrame:
    """The twelve figures of the cleaned-corpus report as (characteristic, value) rows.

    Three single-row aggregates, cross-joined (one row each) and stacked.
    """
    a = df.agg(F.count(F.lit(1)).alias("cleaned"),
               F.count_if(F.col("hashtags").isNotNull()).alias("tagged"),
               F.count_if(F.col("h_number") == 1).alias("one"),
               F.count_if(F.col("h_number") == 2).alias("two"),
               F.count_if(F.col("h_number") >= 3).alias("three"),
               F.max("h_number").cast("long").alias("max_tags"))
    b = incidence.agg(F.count(F.lit(1)).alias("total_tags"),
                      F.countDistinct("tag").alias("unique_tags"))
    c = popular_incidence.agg(F.count(F.lit(1)).alias("total_tags_red"),
                              F.countDistinct("tag").alias("unique_tags_red"))
    d = edges.agg(F.count(F.lit(1)).alias("cooccurrences"))
    a = a.withColumn("untagged", F.col("cleaned") - F.col("tagged"))
    row = with_constants(with_constants(with_constants(a, b), c), d)   # four one-row aggregates
    return labelled(row, fixed.TAG_REPORT)
