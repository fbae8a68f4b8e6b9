"""Distributed 1..N numbering of a sorted DataFrame.

``row_number()`` over an unpartitioned window moves every row into one task.
Here the rows are range-partitioned by the sort and written to the shared
folder with their partition and position (so neither can change if a task is
recomputed after an executor loss), and each row's number is its partition's
offset plus its position inside the partition.  The offset
table has one row per partition, so broadcasting it is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def number_rows(df: DataFrame, order_cols: list, id_col: str = "Id") -> tuple[DataFrame, int]:
    """Return ``(df + id_col, row count)``; ids follow the total order ``order_cols``.

    ``order_cols`` must be a total order (ties broken) for the ids to be
    deterministic.
    """
    pos = stage(df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))), "offsets")
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = (pos.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
              .withColumn(id_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
              .drop("_pid", "_mid", "_first", "_off"))
    return out, int(total)
