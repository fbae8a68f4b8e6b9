"""Joins against lookup tables whose size is known.

A lookup side is broadcast only when its row count has been measured and is
under ``MAX_BROADCAST_ROWS``, and its bytes, which are then summed once, are
under ``MAX_BROADCAST_BYTES``; otherwise the join is left to the planner
(sort-merge join on the key, which AQE may still turn into a broadcast from
the measured shuffle size, and whose skewed partitions it splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20

_SIZES: dict = {}


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows of a small table: its strings and eight bytes for any other column.

    Summed by one aggregate, once for each plan.
    """
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(df.columns))
    if key not in _SIZES:
        size = F.lit(0)
        for name, kind in df.dtypes:
            size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
        _SIZES[key] = int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    return _SIZES[key]


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                small_rows: int | None = None) -> DataFrame:
    if small_rows is not None and small_rows <= MAX_BROADCAST_ROWS and bytes_of(small) <= MAX_BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (a global aggregate) to every row.

    ``one_row`` must be an aggregate without grouping, so it has exactly one
    row by construction; it is broadcast and the join is a per-row append.
    """
    return df.crossJoin(F.broadcast(one_row))
