"""Narrow integer columns to the smallest type that holds their range.

One aggregate computes min and max of every integral column in a single
scan; the casts are then plain projections.  NULLs count as 0 (they are
filled with 0 first).  Non-negative columns take the smallest *unsigned*
width by strict upper bounds (255, 65535, 4294967295), mapped to the Spark
type that holds that range (Spark has no unsigned types); columns with a
negative minimum take the smallest signed width whose open bounds hold both
ends.  Doubles become floats only when asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# (unsigned width name, strict upper bound, Spark type holding the range)
UNSIGNED = [("uint8", 255, "smallint"), ("uint16", 65535, "int"),
            ("uint32", 4294967295, "bigint"), ("uint64", None, "decimal(20,0)")]
# (signed width name, open lower bound, open upper bound, Spark type)
SIGNED = [("int8", -128, 127, "tinyint"), ("int16", -32768, 32767, "smallint"),
          ("int32", -2147483648, 2147483647, "int"),
          ("int64", -9223372036854775808, 9223372036854775807, "bigint")]


def _choice(mn, mx):
    mn = F.coalesce(mn, F.lit(0))
    mx = F.coalesce(mx, F.lit(0))
    uns = F.lit(UNSIGNED[-1][0])
    for name, hi, _ in reversed(UNSIGNED[:-1]):
        uns = F.when(mx < hi, F.lit(name)).otherwise(uns)
    sig = F.lit(SIGNED[-1][0])
    for name, lo, hi, _ in reversed(SIGNED[:-1]):
        sig = F.when((mn > lo) & (mx < hi), F.lit(name)).otherwise(sig)
    return F.when(mn >= 0, uns).otherwise(sig)


def narrow_plan(df: DataFrame) -> DataFrame:
    """``(column, min_value, max_value, width)`` for every integral column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGRAL)]
    filled = [F.coalesce(F.col(c), F.lit(0)) for c in cols]
    row = df.agg(*[F.min(e).alias(f"mn_{i}") for i, e in enumerate(filled)],
                 *[F.max(e).alias(f"mx_{i}") for i, e in enumerate(filled)])
    # One scan: the single aggregate row is unfolded into a row per column.
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"mn_{i}").cast("long").alias("min_value"),
                        F.col(f"mx_{i}").cast("long").alias("max_value")) for i, c in enumerate(cols)]
    out = row.select(F.inline(F.array(*entries)))
    return out.withColumn("width", _choice(F.col("min_value"), F.col("max_value")))


def narrow_types(df: DataFrame, floats: bool = False) -> tuple[DataFrame, dict]:
    """Return ``(narrowed df, {column: width})``; the plan is one small row per column."""
    plan = {r["column"]: r["width"] for r in narrow_plan(df).collect()}   # one row per column
    spark_type = {n: t for n, _, t in UNSIGNED} | {n: t for n, _, _, t in SIGNED}
    cols = []
    for f in df.schema.fields:
        if f.name in plan:
            cols.append(F.coalesce(F.col(f.name), F.lit(0)).cast(spark_type[plan[f.name]]).alias(f.name))
        elif floats and isinstance(f.dataType, T.DoubleType):
            cols.append(F.col(f.name).cast("float").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols), plan
