"""The streaming tag counts equal the batch counts over the same files."""

import os
import tempfile

from pyspark.sql import functions as F

from tagflow.sources import fixtures
from tagflow.streaming import tag_stream as ts

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    tw = fixtures.tweets(spark, SMALL)
    src = tempfile.mkdtemp(prefix="tagflow-stream-src-")
    # two arriving files
    tw.where(F.col("id") % 2 == 0).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "a"))
    tw.where(F.col("id") % 2 == 1).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "b"))
    stream = ts.tweet_stream(spark, os.path.join(src, "*"), max_files_per_trigger=1)
    out = ts.run_to_path(ts.running_tag_counts(stream), tempfile.mkdtemp(prefix="tagflow-stream-out-"),
                         tempfile.mkdtemp(prefix="tagflow-stream-ckpt-"), mode="complete")
    got = {r.tag: r.Count for r in out.collect()}
    batch = ts.running_tag_counts(spark.read.parquet(os.path.join(src, "*")))
    exp = {r.tag: r.Count for r in batch.collect()}
    assert got == exp and len(exp) > 0


def test_windowed_counts_cover_all_rows(spark):
    tw = fixtures.tweets(spark, SMALL)
    src = tempfile.mkdtemp(prefix="tagflow-stream-src-")
    tw.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "a"))
    stream = ts.tweet_stream(spark, os.path.join(src, "*"))
    out = ts.run_to_path(ts.windowed_tag_counts(stream, "1 hour", "1 hour"),
                         tempfile.mkdtemp(prefix="tagflow-stream-out-"), tempfile.mkdtemp(prefix="tagflow-stream-ckpt-"))
    total = out.agg(F.sum("Count")).first()[0] or 0
    batch_total = ts.unique_tagged(spark.read.parquet(os.path.join(src, "*"))).count()
    # append mode emits windows closed by the watermark; all but the last hour are closed
    assert 0 < total <= batch_total
