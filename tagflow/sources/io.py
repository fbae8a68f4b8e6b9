"""Scans and sinks: tweet CSV exports, stage tables, graph files.

* ``scan_tweets`` reads a CSV export with an explicit schema (no inference),
  quoted texts and doubled quotes, keeping only the asked-for columns (pruned
  at the scan).  An empty field is NULL, as in a pandas read of the same file.
  Texts may hold line breaks by default; then a file cannot be split and is
  one task, so a large export should come as many files.  For an export
  without line breaks in its texts, ``multi_line=False`` lets Spark split
  files.
* ``write_stage`` / ``read_stage`` hand a stage over as Parquet.
* ``write_graph_csv`` writes node and edge tables as CSV for graph tools,
  with array columns joined into text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import TWEET_SCHEMA

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "mode": "PERMISSIVE"}


def scan_tweets(spark: SparkSession, path: str, use_cols=None, schema=TWEET_SCHEMA,
                multi_line: bool = True) -> DataFrame:
    """Read a tweet CSV export; ``use_cols`` selects columns (others are pruned)."""
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.select(*use_cols) if use_cols else df


def write_tweets_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_graph_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV for graph tools: array columns become ``sep``-joined text."""
    cols = [F.array_join(F.col(c), sep).alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
