"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_path


PART_ROWS = 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def worker_cache() -> dict:
    """A dict that lives as long as the worker process (tokenizers, power tables)."""
    return sys.__dict__.setdefault("_tagflow_worker_cache", {})


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Later steps read only the columns they need, and the loss of an executor
    costs no recomputation of what came before.
    """
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*dfs: DataFrame) -> None:
    """Delete written stages that no later step reads."""
    for df in dfs:
        remove_path(df.sparkSession, df._staged_path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``PART_ROWS`` rows at most.

    Whole texts are moved, so Spark's default of 10,000 rows would be tens of
    megabytes a batch on both sides of the pipe.  A session that has a smaller
    setting keeps it.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= PART_ROWS:
        conf.set(BATCH_SETTING, PART_ROWS)
    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, fields: T.StructType, inputs: list[str],
                   compute: Callable, keep: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` (or those in ``keep``) plus ``fields``, computed batch by batch.

    ``compute(*arrow columns named in inputs)`` returns one list or array per
    new field.  An input column whose name equals a new one (in any case) is
    replaced, except where it is the same column.
    """
    import pyarrow as pa

    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields
            if f.name.lower() not in taken and (keep is None or f.name in keep)]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept]
    new_names = [f.name for f in fields]
    ask = list(inputs)

    def run(batches: Iterator) -> Iterator:
        for b in parts_of(batches):
            new = compute(*[b.column(b.schema.get_field_index(c)) for c in ask])
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            cols += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(cols, names=names + new_names)

    return map_arrow(df, run, T.StructType(kept + list(fields.fields)))


def parts_of(batches: Iterator) -> Iterator:
    """Arrow batches in parts of ``PART_ROWS`` rows, which bounds what a worker holds as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, PART_ROWS):
            yield b.slice(i, PART_ROWS)


def as_bytes(col) -> list:
    """The UTF-8 bytes of an Arrow string column; None where it is null."""
    import pyarrow as pa

    return col.cast(pa.binary()).to_pylist()


def is_whole(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def whole_ids(df: DataFrame, col: str):
    """Column: the id as a long; ids that are no whole numbers are refused."""
    if not is_whole(df, col):
        raise TypeError(f"{col} must hold whole numbers")
    return F.col(col).cast("long")


def with_unique_ids(docs: DataFrame, id_col: str, keep: list) -> DataFrame:
    """``docs`` with a column ``_rid`` that tells every row apart.

    ``_rid`` is the id itself where ids are whole numbers, unique and present,
    which one aggregate over the id column checks.  Otherwise the rows are
    numbered and written once, so that the numbers survive a recomputation.
    """
    odd = not is_whole(docs, id_col)
    if not odd:
        ids = docs.groupBy(id_col).count()
        odd = ids.where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count() > 0
    cols = [F.col(c) if isinstance(c, str) else c for c in keep]
    if not odd:
        return docs.select(F.col(id_col).cast("long").alias("_rid"), *cols)
    return staged(docs.select(F.monotonically_increasing_id().alias("_rid"), *cols), "numbered")
