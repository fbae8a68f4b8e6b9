"""Documents built from tweets: per tag, per cluster, pooled for LDA.

A pooled document (all tweets of a tag or of a tag cluster) is never built
as one string or one array: a hot tag would put a third of the corpus into
one row and one task.  Documents are kept in long form -- segments
``(doc, tokens)`` (one distinct token list of a member tweet per row) or
term counts ``(doc, term, count)`` -- and every statistic is an aggregate
with partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.joins import lookup_join
from ..session import stage
from . import tags as tg

SCHEMES = ("all", "tagged", "tag", "cluster")


TEXT_CHOICES = ("tokenized", "preprocessed", "spacy_lemmatized")


def tag_segments(df: DataFrame, popular: DataFrame) -> DataFrame:
    """Distinct ``(tag, text columns)`` rows of popular tags.

    The text columns are those of ``TEXT_CHOICES`` that ``df`` has.  Repeats of
    a tag inside a tweet and tweets with identical content count once per tag,
    as in the reference's de-duplication of tag-text rows.

    Tags are paired with SHA-256 marks of the texts; the texts themselves move
    once, whatever their number of tags, and are then joined by their marks.
    ``first_<mark>`` tells which row of a tag is the one that stands for a
    single text column, see ``distinct_texts``.
    """
    texts = tuple(c for c in TEXT_CHOICES if c in df.columns)
    made = {}
    for c in texts:
        made[c] = F.sha2(F.to_json(F.struct(c)), 256)
        if is_array(df, c):
            made[f"{c}_text"] = F.sha2(as_text(df, c), 256)
    marks = [f"_{m}" for m in made]
    marked = df.select("id", "hashtags", *texts, *[e.alias(f"_{m}") for m, e in made.items()])
    places = tg.reduce_incidence(tg.tag_incidence(marked, extra_cols=marks), popular).select("tag", *marks).distinct()

    def first(mark):
        w = Window.partitionBy("tag", mark).orderBy(*marks)
        return (F.row_number().over(w) == 1).alias(f"first{mark}")

    places = places.select("tag", *marks, *[first(m) for m in marks])
    joined = [f"_{c}" for c in texts]
    whole = marked.where(F.col("hashtags").isNotNull()).groupBy(*joined).agg(*[F.first(c).alias(c) for c in texts])
    return whole.join(places, joined).select("tag", *texts, *[f"first{m}" for m in marks])


def distinct_texts(segments: DataFrame, text_col: str, joined: bool = False) -> DataFrame:
    """``(tag, text_col)``, each once; with ``joined`` the column is ``text``, the list as one string.

    Segments that say which row stands for a text are only filtered; no text moves.
    """
    out = as_text(segments, text_col).alias("text") if joined else F.col(text_col)
    flag = f"first_{text_col}" + ("_text" if joined and is_array(segments, text_col) else "")
    if flag in segments.columns:
        return segments.where(flag).select("tag", out)
    return segments.select("tag", out).distinct()


def tag_docs(segments: DataFrame, nodes: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """Per tag: ``Name, Id, count`` (distinct rows) and the size of its document.

    The document text of a tag is the set of distinct token lists of its
    rows; ``n_texts`` counts them and ``n_tokens`` sums their lengths.
    """
    per = segments.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    texts = (distinct_texts(segments, "tokenized")
                     .groupBy("tag").agg(F.count(F.lit(1)).alias("n_texts"),
                                         F.sum(F.size("tokenized")).alias("n_tokens")))
    out = per.join(texts, "tag")
    ids = nodes.select(F.col("Name").alias("tag"), "Id")
    return lookup_join(out, ids, "tag", "left", n_nodes).select(
        F.col("tag").alias("Name"), "Id", "count", "n_texts", "n_tokens")


def tag_doc_segments(segments: DataFrame, nodes: DataFrame, n_nodes: int | None = None,
                     text_col: str = "tokenized") -> DataFrame:
    """The content of the tag documents in long form: ``(doc_id = tag Id, text)``.

    One row per distinct text of a tag; ``text_col`` is one of
    ``TEXT_CHOICES``.  Token lists are joined with ', ' (the shape the
    vectorizer reads), so a token pattern sees the same tokens as in the
    joined tag document.
    """
    texts = distinct_texts(segments, text_col)
    ids = nodes.select(F.col("Name").alias("tag"), F.col("Id").alias("doc_id"))
    j = lookup_join(texts, ids, "tag", "inner", n_nodes)
    return j.select("doc_id", as_text(segments, text_col).alias("text"))


def is_array(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col].startswith("array")


def as_text(df: DataFrame, col: str):
    return F.array_join(col, ", ") if is_array(df, col) else F.col(col)


def as_tokens(df: DataFrame, col: str):
    return F.col(col) if dict(df.dtypes)[col].startswith("array") else tx.split_words(F.col(col))


def word_freq(df: DataFrame, col: str = "tokenized", k: int | None = None) -> DataFrame:
    """Word frequencies of a text or token column: all words, or the k most frequent.

    List punctuation ``; [ ] ' ,`` is deleted, the text split on blanks and
    lower-cased; empty words are not counted.
    """
    c = F.col(col)
    if dict(df.dtypes)[col].startswith("array"):
        c = F.array_join(c, " ")
    words = F.split(F.translate(c, ";[]',", ""), " ")
    counts = (df.select(F.explode(words).alias("w"))
                .select(F.lower("w").alias("word")).where(F.col("word") != "")
                .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    return counts if k is None else counts.orderBy(F.col("count").desc(), F.col("word").asc()).limit(k)


def pool_texts(df: DataFrame, scheme: str, segments: DataFrame | None = None,
               nodes: DataFrame | None = None, n_nodes: int | None = None,
               clusters: DataFrame | None = None, token_col: str = "tokenized") -> DataFrame:
    """Member texts ``(doc_key, tokens)`` of the documents of a pooling scheme.

    all     every cleaned tweet is a document (key = tweet id)
    tagged  tweets with at least one tag
    tag     one document per popular tag (key = tag Id): its distinct texts
    cluster one document per tag cluster: the distinct tag documents of the
            cluster, re-tokenised on word characters

    ``token_col`` is one of ``TEXT_CHOICES``, for every scheme.  A pooled
    document is the multiset union of its member texts; it is never
    concatenated into one row.
    """
    if scheme in ("all", "tagged"):
        rows = df if scheme == "all" else df.where(F.col("hashtags").isNotNull())
        return rows.select(F.col("id").alias("doc_key"), as_tokens(df, token_col).alias("tokens"))
    if scheme == "tag":
        texts = distinct_texts(segments, token_col)
        ids = nodes.select(F.col("Name").alias("tag"), F.col("Id").alias("doc_key"))
        return lookup_join(texts, ids, "tag", "inner", n_nodes).select(
            "doc_key", as_tokens(segments, token_col).alias("tokens"))
    if scheme == "cluster":
        return cluster_segments(segments, nodes, clusters, n_nodes, token_col).select("doc_key", "tokens")
    raise ValueError(f"unknown scheme {scheme!r}")


def pool_term_counts(df: DataFrame, scheme: str, segments: DataFrame | None = None,
                     nodes: DataFrame | None = None, n_nodes: int | None = None,
                     clusters: DataFrame | None = None, token_col: str = "tokenized") -> DataFrame:
    """Term counts ``(doc_key, term, count)`` of the documents of a pooling scheme."""
    texts = pool_texts(df, scheme, segments, nodes, n_nodes, clusters, token_col)
    ex = texts.select("doc_key", F.explode("tokens").alias("term")).where(F.col("term") != "")
    return ex.groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("count"))


def cluster_segments(segments: DataFrame, nodes: DataFrame, clusters: DataFrame,
                     n_nodes: int | None = None, token_col: str = "tokenized") -> DataFrame:
    """``(doc_key = cluster, tag, text, tokens)``: member texts of the cluster documents.

    Per cluster, the distinct tag documents are pooled (two tags whose
    documents are equal contribute once).  Tag documents are told apart by
    their number of texts and two independent order-free sums of 64-bit hashes
    of their texts, computed as an aggregate.  Tokens are re-split on word
    characters (``\\w+``).
    """
    texts = distinct_texts(segments, token_col, joined=True)
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    sig = texts.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64("text")).alias("s1"),
                                   total(F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")).alias("s2"))
    ids = nodes.select(F.col("Name").alias("tag"), "Id")
    lab = lookup_join(sig, ids, "tag", "inner", n_nodes).join(clusters.select("Id", "cluster"), "Id")
    chosen = stage(lab.groupBy("cluster", "n", "s1", "s2").agg(F.min("tag").alias("tag")).select("tag", "cluster"), "chosen")
    return lookup_join(texts, chosen, "tag", "inner", n_nodes).select(
        F.col("cluster").alias("doc_key"), "tag", "text",
        F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0).alias("tokens"))


def pool_summary(counts: DataFrame, scheme: str, text: str) -> DataFrame:
    """One row per scheme and text: documents, distinct document-term pairs, tokens."""
    return counts.agg(F.countDistinct("doc_key").alias("n_docs"), F.count(F.lit(1)).alias("n_terms"),
                      F.sum("count").alias("n_tokens")).select(
        F.lit(scheme).alias("scheme"), F.lit(text).alias("text"), "n_docs", "n_terms", "n_tokens")
