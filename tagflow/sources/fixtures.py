"""Views that map the driver's tables onto the tweet data model.

The shared tables hold no real tweets, so tweet-shaped views are derived
from them with SQL (see FIXTURES.md part B).  Each view reads only the
columns it needs, so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import default_stopwords, union_stopwords
from ..session import spread

MAX_TURNS = 1_000_000

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of a folder's tables, to notice a changed input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in fs.listStatus(path):
        inner = fs.listStatus(table.getPath()) if table.isDirectory() else [table]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inner]
    return tuple(sorted(found))


# Tweets derived from `documents`: id, time, reply/quote references, tags and
# mentions are functions of doc_id and of the first words of the text.
TWEETS_SQL = r"""
select doc_id+1 as id,
  date_format(timestamp_seconds(1577836800+doc_id*60),'yyyy-MM-dd HH:mm:ss') as created_at,
  concat(case when doc_id%11=0 then 'RT ' else '' end, text) as text, lang,
  case when doc_id%7=0 and doc_id>=7 then doc_id-6 end as in_reply_to_status_id,
  case when doc_id%5=0 and doc_id>=5 then doc_id-4 end as quoted_status_id,
  nullif(array_join(filter(transform(slice(split(text,'[ \\n]'),1,cast(doc_id%4 as int)),
    w->regexp_replace(w,'[^A-Za-z]','')), w->w<>''),';'),'') as hashtags,
  case when doc_id%6=0 then concat('user',cast(doc_id%50 as string)) end as mentions
from {documents}
"""


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw tweet table (schema of a CSV export, ids as BIGINT)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    view = f"tagflow_documents_{abs(hash(sf_dir))}"
    docs.createOrReplaceTempView(view)
    # The view's timestamps are defined in UTC.  The time zone is bound into
    # the expressions when the SQL is analysed, so it is pinned only for that
    # moment and the caller's session setting is restored.
    key = "spark.sql.session.timeZone"
    previous = spark.conf.get(key)
    spark.conf.set(key, "UTC")
    try:
        out = spark.sql(TWEETS_SQL.format(documents=view))
        out.schema                              # analysed now, with UTC bound
    finally:
        spark.conf.set(key, previous)
    return (out.withColumn("truncated", F.lit(None).cast("int"))
               .withColumn("lat", F.lit(None).cast("double")))


def baskets(spark: SparkSession, sf_dir: str, tag_col: str = "p_brand") -> DataFrame:
    """Large tag incidence: an order is a tweet, a part attribute is a tag.

    Output columns ``tweet_id, tag``.  ``part`` is joined without a broadcast
    hint: at scale it is not small, and AQE turns the join into a broadcast
    only when the measured side is under the threshold.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col(tag_col).alias("tag"))
    return (li.join(part, li.l_partkey == part.p_partkey)
              .select(F.col("l_orderkey").alias("tweet_id"), "tag"))


EXTRA_STOPWORDS = ("than", "thing", "ing", "ion", "the")

LEXICON_SQL = r"""
select form, case length(form) % 6 when 0 then 'NOUN' when 1 then 'VERB' when 2 then 'PRON' when 3 then 'ADJ'
                                   when 4 then 'PROPN' else 'ADV' end as pos,
       case when length(form) > 3 then substr(form, 1, length(form) - 1) else substr(form, 1, 2) end as lemma
from (select distinct explode(split(lower(text), '[^a-z]+')) as form from {documents} where lang = 'en')
where length(form) >= 3 and (form like '%n' or form like '%t')
"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon ``(form, pos, lemma)`` made of the words of ``documents`` (there is no real one).

    It covers English words that end in n or t; classes follow from their
    length, lemmas lack the last letter.
    """
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    view = f"tagflow_words_{abs(hash(sf_dir))}"
    docs.createOrReplaceTempView(view)
    return spark.sql(LEXICON_SQL.format(documents=view))


PARADIGM_SQL = r"""
with words as (select distinct explode(split(lower(text), '[^a-z]+')) as form from {documents} where lang = 'en'),
seen as (select substr(form, 1, length(form) - 2) as form, 'VERB' as pos from words where form like '%ed'
         union all select substr(form, 1, length(form) - 3), 'VERB' from words where form like '%ing'
         union all select substr(form, 1, length(form) - 2), 'ADJ' from words where form like '%er'
         union all select substr(form, 1, length(form) - 3), 'ADJ' from words where form like '%est'
         union all select substr(form, 1, length(form) - 1), 'NOUN' from words where form like '%s')
select distinct form, pos, form as lemma from seen join words using (form) where length(form) >= 3
"""


def paradigm_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base forms ``(form, pos, lemma)`` of ``documents``, by the endings that they are also seen with.

    An English word is a verb if it also stands with -ed or -ing, an adjective
    with -er or -est, a noun with -s.
    """
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    view = f"tagflow_paradigms_{abs(hash(sf_dir))}"
    docs.createOrReplaceTempView(view)
    return spark.sql(PARADIGM_SQL.format(documents=view))


def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, word)``: every word of a-z of ``documents``, lower-cased; a null source is empty."""
    d = read_table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.lower("text").alias("t"))
    return d.select("source", F.explode(F.split("t", "[^a-z]+")).alias("word")).where("word <> ''")


def stopword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop-word table: the union of the packaged list and a list of frequent syllable words."""
    words = union_stopwords(default_stopwords(), EXTRA_STOPWORDS)
    return spark.createDataFrame([(w,) for w in words], "word string")


def reply_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply chains: each turn replies to the previous one.

    A turn's id leaves room for ``MAX_TURNS`` turns of a conversation; a longer
    one fails rather than run into the next conversation's ids.
    """
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    base = F.col("conv_id") * MAX_TURNS + F.col("turn")
    fits = F.assert_true(F.col("turn").between(0, MAX_TURNS - 2), "a conversation has too many turns")
    return c.select(
        F.when(fits.isNull(), base + 1).alias("id"),
        F.when(F.col("turn") > 0, base).alias("in_reply_to_status_id"),
        "role", "text")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as texts that carry links: the page URL followed by its HTML."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.select("page_id", F.concat_ws(" ", "url", "html").alias("text"))


def bare_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_texts`` whose first URL has lost its scheme, as people type it."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.select("page_id", F.concat_ws(" ", F.regexp_replace("url", "^https?://", ""), "html").alias("text"))


def page_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(suffix)``: the last labels of the hosts of all pages."""
    host = F.regexp_extract("url", "^https?://([^/?#:]*)", 1)
    return read_table(spark, sf_dir, "pages").select(
        F.lower(F.regexp_extract(host, r"[^.]+$", 0)).alias("suffix")).where("suffix <> ''").distinct()
