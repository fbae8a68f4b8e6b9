"""Ingest stage: language filter, retweet flag, sentinels, profiles.

All of these are narrow column expressions or single-pass aggregates; the
filters sit directly on the scan so Catalyst pushes them into parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

DATA1_COLUMNS = ["id", "created_at", "text", "quoted_status_id", "retweet",
                 "in_reply_to_status_id", "hashtags", "mentions"]


def filter_lang(tweets: DataFrame, lang: str = "en") -> DataFrame:
    """Keep tweets of one language and drop the language column."""
    return tweets.where(F.col("lang") == lang).drop("lang")


def flag_retweets(df: DataFrame) -> DataFrame:
    """retweet = 1 when the text starts with 'RT' (case-sensitive, no blank needed)."""
    return df.withColumn("retweet", F.col("text").startswith("RT").cast("int"))


SENTINEL_COLUMNS = ("in_reply_to_status_id", "quoted_status_id", "truncated", "lat")


def fill_sentinels(df: DataFrame, cols=SENTINEL_COLUMNS) -> DataFrame:
    """NULL -> 0 on the reference and flag columns (0 means 'none')."""
    present = [c for c in cols if c in df.columns]
    return df.fillna(0, subset=present)


def explore(tweets_en: DataFrame) -> DataFrame:
    """Flag retweets and fill sentinels (the English table `data`)."""
    return fill_sentinels(flag_retweets(tweets_en))


def remove_retweets(data: DataFrame) -> DataFrame:
    """data1: English tweets that are not retweets, eight columns."""
    return data.where(~F.col("text").startswith("RT")).select(*DATA1_COLUMNS)


def format_dates(df: DataFrame, col: str = "created_at") -> DataFrame:
    """'yyyy-MM-dd HH:mm:ss' text -> 'MM/dd/yyyy' text."""
    ts = F.to_timestamp(F.col(col), "yyyy-MM-dd HH:mm:ss")
    return df.withColumn(col, F.date_format(ts, "MM/dd/yyyy"))


def labelled(row: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The columns of a one-row table as ``(characteristic, value)`` rows, in the labels' order."""
    found = [(label, c) for c, label in labels.items() if c in row.columns]
    args = [F.lit(len(found))]
    for label, c in found:
        args += [F.lit(label), F.col(c).cast("long")]
    return row.select(F.stack(*args).alias("characteristic", "value"))


def corpus_profile(tweets: DataFrame, lang: str = "en") -> DataFrame:
    """Tweets, English tweets, unique (not RT) English tweets: one scan."""
    is_lang = F.col("lang") == lang
    return labelled(tweets.agg(
        F.count(F.lit(1)).alias("tweets"),
        F.count_if(is_lang).alias("en"),
        F.count_if(is_lang & ~F.col("text").startswith("RT")).alias("unique_en")), fixed.CORPUS_PROFILE)


def corpus_profile_full(data: DataFrame) -> DataFrame:
    """The long profile of the English table `data` (flags and sentinels filled).

    Rows for optional export columns appear only when the column exists.  One
    aggregate computes every figure.
    """
    rt = F.col("retweet") == 1
    q = F.col("quoted_status_id") != 0
    r = F.col("in_reply_to_status_id") != 0
    n = F.count(F.lit(1))
    figures = {
        "columns": F.lit(len(data.columns)), "all": n, "rt": F.count_if(rt), "unique": n - F.count_if(rt),
        "replies": F.count_if(r), "quoting": F.count_if(q), "rt_quoting": F.count_if(rt & q),
        "rt_reply": F.count_if(rt & r), "rt_not_quoting": F.count_if(rt & ~q),
        "unique_quoting": F.count_if(~rt & q), "unique_reply_only": F.count_if(~rt & ~q & r),
        "unique_quoting_only": F.count_if(~rt & q & ~r), "unique_plain": F.count_if(~rt & ~q & ~r),
        "unique_both": F.count_if(~rt & q & r), "any": n - F.count_if(~rt & ~q & ~r),
        "truncated": F.count_if(F.col("truncated") == 1), "geo": F.count_if(F.col("lat") != 0),
    }
    for name, column, figure in (
            ("sensitive", "possibly_sensitive", lambda c: F.count_if(c == 1)),
            ("withheld", "withheld_copyright", lambda c: F.count_if(c == 1)),
            ("location", "location", F.count), ("verified", "from_user_verified", lambda c: F.count_if(c == 1))):
        if column in data.columns:
            figures[name] = figure(F.col(column))
    return labelled(data.agg(*[e.alias(c) for c, e in figures.items()]), fixed.FULL_PROFILE)
