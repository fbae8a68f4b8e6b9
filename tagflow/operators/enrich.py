"""Quote and reply enrichment.

A quoting or replying tweet gets the referenced tweet's text in front of its
own (``ref + ' ' + own``; an unmatched reference leaves a leading blank) and
the referenced tags and mentions joined with ``'; '``.  Tweets that both
quote and reply get both enriched texts, quote first.  The lookup side is
``data1`` (English, not retweets), so references to anything else find
nothing.

Plan shape: the rows that need a lookup are split by kind *before* any
join, so a join only ever sees rows with a real reference (no shuffle of the
0/NULL sentinel, which would be one giant hot key).  Each kind is one
equi-join against the lookup table, shuffled on the referenced id; a viral
referenced tweet is a hot key on the probe side, which AQE's skew-join split
handles (left outer joins may split the left side).  Untouched rows bypass
the joins and are unioned back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..plans.joins import with_constants


def _lookup(data1: DataFrame) -> DataFrame:
    """The referenced-tweet side: one identical projection for every join, so
    its shuffle on the id is computed once and reused by all of them.

    Ids must be unique: the aggregate fails the query on a repeated one, which
    would otherwise multiply rows.  It groups by the join key, so the join
    needs no further shuffle.
    """
    once = data1.groupBy(F.col("id").alias("ref_id")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(r) for c, r in (
            ("text", "ref_text"), ("hashtags", "ref_tags"), ("mentions", "ref_mentions"))])
    repeated = F.raise_error(F.concat(F.lit("the tweet id "), F.col("ref_id").cast("string"), F.lit(" is repeated")))
    ok = F.when(F.col("_n") > 1, repeated.cast("string"))
    return once.select("ref_id", F.coalesce(ok, F.col("ref_text")).alias("ref_text"), "ref_tags", "ref_mentions")


def _own_text(c: str = "text"):
    # A missing own text prints as 'nan' in the reference's string join.
    return F.coalesce(F.col(c), F.lit("nan"))


def _attach(rows: DataFrame, data1: DataFrame, key: str, tag: str) -> DataFrame:
    """Left-join the referenced tweet and add ``{tag}_etext/_etags/_ementions``."""
    lk = _lookup(data1)
    j = rows.join(lk, rows[key] == lk["ref_id"], "left")
    return (j.withColumn(f"{tag}_etext", F.concat(F.coalesce(F.col("ref_text"), F.lit("")),
                                                  F.lit(" "), _own_text()))
             .withColumn(f"{tag}_etags", blank_to_null(F.concat_ws("; ", "ref_tags", "hashtags")))
             .withColumn(f"{tag}_ementions", blank_to_null(F.concat_ws("; ", "ref_mentions", "mentions")))
             .drop("ref_id", "ref_text", "ref_tags", "ref_mentions"))


_OUT = ["id", "created_at", "retweet", "quoted_status_id", "in_reply_to_status_id",
        "text", "hashtags", "mentions"]


def enrich_quotes(data: DataFrame, data1: DataFrame) -> DataFrame:
    """J1: non-retweet quoting tweets with the quoted tweet in front."""
    rows = data.where((F.col("quoted_status_id") != 0) & (F.col("retweet") == 0)).select(*_OUT)
    e = _attach(rows, data1, "quoted_status_id", "q")
    return e.select(*[c for c in _OUT if c not in ("text", "hashtags", "mentions")],
                    F.col("q_etext").alias("text"), F.col("q_etags").alias("hashtags"),
                    F.col("q_ementions").alias("mentions"))


def enrich_replies(data: DataFrame, data1: DataFrame) -> DataFrame:
    """J2: replies (retweets included) with the replied-to tweet in front."""
    rows = data.where(F.col("in_reply_to_status_id") != 0).select(*_OUT)
    e = _attach(rows, data1, "in_reply_to_status_id", "r")
    return e.select(*[c for c in _OUT if c not in ("text", "hashtags", "mentions")],
                    F.col("r_etext").alias("text"), F.col("r_etags").alias("hashtags"),
                    F.col("r_ementions").alias("mentions"))


def _combine_both():
    return [F.concat(F.col("q_etext"), F.lit(" "), F.col("r_etext")).alias("text"),
            blank_to_null(F.concat_ws("; ", "q_etags", "r_etags")).alias("hashtags"),
            blank_to_null(F.concat_ws("; ", "q_ementions", "r_ementions")).alias("mentions")]


def enrich_both(data: DataFrame, data1: DataFrame) -> DataFrame:
    """J3: tweets that quote and reply; quote-enriched text, blank, reply-enriched text."""
    rows = data.where((F.col("quoted_status_id") != 0) & (F.col("retweet") == 0)
                      & (F.col("in_reply_to_status_id") != 0)).select(*_OUT)
    e = _attach(_attach(rows, data1, "quoted_status_id", "q"), data1, "in_reply_to_status_id", "r")
    return e.select("id", "retweet", "quoted_status_id", "in_reply_to_status_id", *_combine_both())


def enrich_tweets(data1: DataFrame) -> DataFrame:
    """J1-J5 as one plan: data2 = data1 with enriched text, tags and mentions.

    Rows of retweets that reply (part of J2 in the reference) are not in
    data1 and so never change data2; they are left out here from the start.
    ``created_at`` keeps the base value, as the in-place update does.
    """
    q = F.col("quoted_status_id") != 0
    r = F.col("in_reply_to_status_id") != 0
    keep = ["id", "created_at", "quoted_status_id", "retweet", "in_reply_to_status_id"]

    plain = data1.where(~q & ~r).select(*keep, "text", "hashtags", "mentions")

    q_rows = _attach(data1.where(q & ~r), data1, "quoted_status_id", "q")
    q_out = q_rows.select(*keep, F.col("q_etext").alias("text"),
                          F.coalesce("q_etags", "hashtags").alias("hashtags"),
                          F.coalesce("q_ementions", "mentions").alias("mentions"))

    r_rows = _attach(data1.where(~q & r), data1, "in_reply_to_status_id", "r")
    r_out = r_rows.select(*keep, F.col("r_etext").alias("text"),
                          F.coalesce("r_etags", "hashtags").alias("hashtags"),
                          F.coalesce("r_ementions", "mentions").alias("mentions"))

    b_rows = _attach(_attach(data1.where(q & r), data1, "quoted_status_id", "q"),
                     data1, "in_reply_to_status_id", "r")
    t, h, m = _combine_both()
    b_out = b_rows.select(*keep, t, F.coalesce(h, F.col("hashtags")).alias("hashtags"),
                          F.coalesce(m, F.col("mentions")).alias("mentions"))

    return plain.unionByName(q_out).unionByName(r_out).unionByName(b_out)


def check_enrich(data: DataFrame) -> DataFrame:
    """Self-check on the enriched rows: their number against the rows that refer.

    ``enriched_rows`` counts what the joins return, J1 plus the replies that J3
    does not hold (J2 has replying retweets too); ``expected_rows`` counts
    quoting rows plus replies that do not quote, retweets left out, by
    predicates alone.  So the check reports a problem when replying retweets
    exist, and whenever a join loses or multiplies rows.
    """
    data1 = data.where(F.col("retweet") == 0)
    both = enrich_both(data, data1).select("id")
    replies = enrich_replies(data, data1).select("id").join(both, "id", "left_anti")
    quotes = enrich_quotes(data, data1).select("id")
    rows = quotes.unionByName(replies).agg(F.count(F.lit(1)).alias("enriched_rows"))
    q, r = F.col("quoted_status_id") != 0, F.col("in_reply_to_status_id") != 0
    wanted = data1.agg((F.count_if(q) + F.count_if(~q & r)).alias("expected_rows"))
    return with_constants(rows, wanted).withColumn("ok", F.col("enriched_rows") == F.col("expected_rows"))
