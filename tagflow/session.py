"""Session helpers.

``build_session`` is for tests, the bench and local runs.  On a cluster the
caller owns the session; library code only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  AQE re-plans joins (broadcast conversion
# from measured shuffle sizes), coalesces small partitions and splits skewed
# ones; UTC keeps the timestamp formats of the fixtures stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tagflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("tagflow.localSpread", str(spark.sparkContext.defaultParallelism))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store) and is used as is.  Where it is unset, a local run gets a scratch
    folder of its own; on a cluster that would be a folder per machine, so
    there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tagflow-ckpt-", dir=os.environ.get("TAGFLOW_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written stage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{name}-{uuid.uuid4().hex[:12]}"


# Makes Spark remove a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = {"lock": threading.Lock(), "open": 0, "before": None}


@contextmanager
def shuffles_removed(spark: SparkSession):
    """While open, the shuffle files of a query go when it ends; then the session's setting is as it was.

    Several threads may hold it open at once.
    """
    c = _cleaning
    with c["lock"]:
        if not c["open"]:
            c["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        c["open"] += 1
    try:
        yield
    finally:
        with c["lock"]:
            c["open"] -= 1
            if not c["open"]:
                spark.conf.unset(CLEANUP) if c["before"] is None else spark.conf.set(CLEANUP, c["before"])


def stage(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write a pipeline stage to the shared folder as Parquet (with the writer's ``options``) and read it back.

    The stage is computed once.  Later steps read only the columns they use,
    with filters pushed to the scan, and a lost executor costs no
    recomputation of the upstream work (unlike a cache or a local checkpoint).
    What was shuffled for it is removed as soon as it is written.
    """
    path = stage_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files of a DataFrame that ``stage`` returned and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table over the cores of a local run that asks for it.

    A small file with few row groups leaves cores idle in tests and in the
    bench; ``build_session`` therefore sets ``tagflow.localSpread``.  Where the
    setting is absent, as on a cluster, the table is returned as it is and no
    shuffle is added.
    """
    cores = int(df.sparkSession.conf.get("tagflow.localSpread", "0"))
    return df.repartition(cores) if cores else df
