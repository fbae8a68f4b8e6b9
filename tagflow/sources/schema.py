"""Explicit schemas: no inference at any scan."""

from pyspark.sql import types as T

TWEET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("created_at", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("lang", T.StringType(), True),
    T.StructField("in_reply_to_status_id", T.LongType(), True),
    T.StructField("quoted_status_id", T.LongType(), True),
    T.StructField("hashtags", T.StringType(), True),
    T.StructField("mentions", T.StringType(), True),
    T.StructField("truncated", T.IntegerType(), True),
    T.StructField("lat", T.DoubleType(), True),
])

# Optional columns of a richer export (used by the long corpus profile).
OPTIONAL_TWEET_FIELDS = [
    T.StructField("possibly_sensitive", T.IntegerType(), True),
    T.StructField("withheld_copyright", T.IntegerType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("from_user_verified", T.IntegerType(), True),
]

LEXICON_SCHEMA = T.StructType([
    T.StructField("form", T.StringType(), False),
    T.StructField("pos", T.StringType(), True),
    T.StructField("lemma", T.StringType(), False),
])
