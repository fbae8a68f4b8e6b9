"""Preprocess stage: tag treatment of text, cleaning, de-duplication, filters.

Everything up to the de-duplication is one narrow chain of column
expressions (a single stage, whole-stage codegen around the regex calls).
The de-duplication keeps, per (preprocessed, hashtags), the row with the
smallest id -- as an aggregate (``min_by``) rather than a window, so a hot
key (the same spam text a third of the corpus posts) is reduced map-side
before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

TAG_MODES = ("text_h_in", "text_h_out", "text_h_ne")


def tag_text_modes(df: DataFrame) -> DataFrame:
    """All three tag treatments: keep, strip all tags, strip closing tags."""
    return (df.withColumn("text_h_in", F.col("text"))
              .withColumn("text_h_out", tx.remove_all_tags(F.col("text")))
              .withColumn("text_h_ne", tx.remove_end_tags(F.col("text"))))


def mode_text(mode: str):
    """The text column of a tag treatment: keep, strip all tags, strip closing tags."""
    if mode == "text_h_in":
        return F.col("text")
    if mode == "text_h_out":
        return tx.remove_all_tags(F.col("text"))
    if mode == "text_h_ne":
        return tx.remove_end_tags(F.col("text"))
    raise ValueError(f"unknown tag mode {mode!r}")


def hashtag_decision(df: DataFrame, mode: str = "text_h_in") -> DataFrame:
    """Add the chosen text column plus tag and mention lists and their sizes."""
    df = df.withColumn(mode, mode_text(mode))
    if mode == "text_h_ne":
        df = df.withColumn("hashtags_ne", tx.inline_tags(F.col("text_h_ne")))
    df = (df.withColumn("hashtags_list", tx.split_list(F.col("hashtags")))
            .withColumn("h_number", F.size("hashtags_list"))
            .withColumn("mentions_list", tx.split_list(F.col("mentions")))
            .withColumn("men_number", F.size("mentions_list")))
    if mode == "text_h_ne":
        df = df.withColumn("h_ne_number", F.size("hashtags_ne"))
    return df


def dedup_first(df: DataFrame, keys=("preprocessed", "hashtags"), order_col: str = "id") -> DataFrame:
    """Keep the first row (smallest ``order_col``) per key; NULL keys group together.

    String keys are told apart by their SHA-256, so that a long text moves once, in its row.
    """
    cols = df.columns
    text = {c for c, kind in df.dtypes if kind == "string"}
    marks = [(F.sha2(k, 256) if k in text else F.col(k)).alias(f"_key{i}") for i, k in enumerate(keys)]
    firsts = df.groupBy(*marks).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return firsts.select("_r.*")


def min_words(df: DataFrame, n: int, col: str = "preprocessed") -> DataFrame:
    return df.where(tx.has_words(F.col(col), n))


def ascii_only(df: DataFrame, col: str = "preprocessed") -> DataFrame:
    return df.where(tx.is_ascii(F.col(col)))


def ascii_tags(df: DataFrame, col: str = "hashtags") -> DataFrame:
    """A NULL tag string passes (it is the text 'nan' in the reference)."""
    return df.where(F.col(col).isNull() | tx.is_ascii(F.col(col)))


def is_ascii_row(text, tags):
    """Whether a row passes ``ascii_only`` and ``ascii_tags``."""
    return tx.is_ascii(text) & (tags.isNull() | tx.is_ascii(tags))


def clean_rows(data2: DataFrame, min_word: int, mode: str = "text_h_in") -> DataFrame:
    """Tag treatment -> clean -> de-duplicate -> minimum words, without the columns of ``hashtag_decision``.

    Those are per-row functions of the slim row, derived where they are read.
    """
    if mode == "text_h_in":
        cleaned = tx.clean_text_df(data2, "text", "preprocessed")
    else:
        cleaned = tx.clean_text_df(data2.withColumn("_mode_text", mode_text(mode)), "_mode_text",
                                   "preprocessed").drop("_mode_text")
    return min_words(dedup_first(cleaned), min_word)


def clean_stage(data2: DataFrame, min_word: int, mode: str = "text_h_in") -> DataFrame:
    """``clean_rows`` with the columns of ``hashtag_decision``.

    This is the row set the phrase statistics are learned on (before the
    ASCII filters).
    """
    return hashtag_decision(clean_rows(data2, min_word, mode), mode)


def length_hist(data1: DataFrame, data2: DataFrame) -> DataFrame:
    """Words per cleaned text, one histogram per dataset (each its own)."""
    def hist(df, name):
        n = tx.word_count(F.col("_clean"))
        return (tx.clean_text_df(df.select("text"), "text", "_clean")
                  .select(n.alias("textlen")).groupBy("textlen")
                  .agg(F.count(F.lit(1)).alias("count"))
                  .withColumn("dataset", F.lit(name)))
    return hist(data1, "data1").unionByName(hist(data2, "data2")).select("dataset", "textlen", "count")
