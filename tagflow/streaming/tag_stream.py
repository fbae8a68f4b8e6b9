"""Tag counting over arriving tweet files (Structured Streaming).

The reference only processes finished exports; this module runs the same
operator functions (language filter, retweet removal, tag incidence) on a
file stream, so counts stay current while files keep arriving.  The
aggregation state is kept by Spark's state store under the query's
checkpoint location (which must be a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, tags
from ..sources.schema import TWEET_SCHEMA


def tweet_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TWEET_SCHEMA).format(fmt)
    if fmt == "csv":
        from ..sources.io import CSV_OPTIONS
        reader = reader.options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def unique_tagged(tweets: DataFrame, lang: str = "en") -> DataFrame:
    """English, non-retweet tweets as a tag incidence ``(tweet_id, tag)``."""
    en = ingest.filter_lang(tweets, lang)
    return tags.tag_incidence(en.where(~F.col("text").startswith("RT")))


def running_tag_counts(tweets: DataFrame, lang: str = "en") -> DataFrame:
    """``(tag, Count)`` over everything seen so far (update/complete mode)."""
    return unique_tagged(tweets, lang).groupBy("tag").agg(F.count(F.lit(1)).alias("Count"))


def windowed_tag_counts(tweets: DataFrame, window: str = "1 hour", watermark: str = "2 hours",
                        lang: str = "en") -> DataFrame:
    """``(window_start, window_end, tag, Count)`` per event-time window.

    Event time is ``created_at``; rows later than the watermark are dropped
    and closed windows are emitted once in append mode.
    """
    t = tweets.withColumn("ts", F.to_timestamp("created_at", "yyyy-MM-dd HH:mm:ss"))
    en = ingest.filter_lang(t, lang).where(~F.col("text").startswith("RT"))
    inc = tags.tag_incidence(en, extra_cols=("ts",)).withWatermark("ts", watermark)
    out = inc.groupBy(F.window("ts", window), "tag").agg(F.count(F.lit(1)).alias("Count"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      "tag", "Count")


def run_to_path(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the data available now into Parquet under ``path`` and read it back.

    In append mode each micro-batch adds its finished rows.  In complete mode
    every micro-batch writes the whole result to a folder of its own, and the
    last one is read.  Nothing passes through the driver.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(path)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={max(done)}")
