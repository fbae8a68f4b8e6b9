"""Common lines, counted in levelled sorted runs of line hashes.

Documents come in batches.  What a batch holds is reduced to one row per line
key: two hashes of the key and the number of documents that hold it.  A run is
such a table, bucketed and sorted by the hashes.  A new batch merge-anti-joins
the runs: keys that the runs already hold in ``min_docs`` documents are settled
and are not written again; the rest is added as a run of level 0.  Whenever a
level has ``fanout`` runs they are merged into one run of the next level, so a
key is rewritten a logarithmic number of times.  Batches and runs have the same
buckets, so neither the anti-joins nor the merges move a run between machines.

Native throughout: column expressions, aggregates and joins only.

Defined results

* null or empty text: one empty line, kept;
* keys shorter than ``min_chars`` code points are never dropped;
* a document in which every line goes keeps the empty string;
* a line that stands several times in a document counts it once, and all its
  places go; equal rows, repeated ids and null ids are documents of their own;
* an empty table gives an empty table; very long texts are split, hashed and
  put together again in time linear in their length;
* columns of the input come back as they are, except one named ``n_lines``,
  ``n_dropped`` or ``kept``, which is replaced.

Two keys count as equal where 96 bits of two hashes agree: among 10^12
different lines the chance of one such error is about one in 10^5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..session import stage_path
from .common import remove_path, staged, unstage, with_unique_ids

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h", "g"]
MADE = ("n_lines", "n_dropped", "kept")


def line_key(line):
    """Column: a line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashes(key) -> list:
    """Columns ``h`` (64 bits) and ``g`` (32 bits): hashes of a key with two seeds."""
    return [F.xxhash64(key).alias("h"),
            F.shiftright(F.xxhash64(F.lit("line"), key), 32).cast("int").alias("g")]


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def document_keys(docs: DataFrame, min_chars: int, *keep) -> DataFrame:
    """(``keep``, h, g): one row for each document and different line key."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    return docs.select(*keep, F.explode(F.array_distinct(keys)).alias("k")).select(*keep, *hashes(F.col("k")))


class LineRuns:
    """Levelled sorted runs of line hashes; see the module's text.

    Runs are Parquet tables in the shared folder.  ``buckets`` must be the same
    for all batches; the default is the session's number of shuffle partitions,
    so that a bucket is one file.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be at least 1 and fanout at least 2")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``keys`` holds ``h`` and ``g``, one row for each document and key."""
        own = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        self._put(0, self._unsettled(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level, self.levels[level])
            level += 1

    def common(self) -> DataFrame:
        """``h``, ``g``, ``n`` of the keys in at least ``min_docs`` documents, once each."""
        if len(self.runs()) > 1:
            self._compact(len(self.levels) - 1, self.runs())
        if not self.runs():
            return self.spark.createDataFrame([], "h long, g int, n long")
        (_, path), = self.runs()
        # read by path: the other side of a join may then be split where a key is frequent
        return self.spark.read.schema("h long, g int, n long, common boolean").parquet(path).where("common").drop("common")

    def seen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key stands in some run: a batch against all that came before."""
        return self._joined(keys, "left_semi")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key stands in no run."""
        return self._joined(keys, "left_anti")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []

    def _joined(self, keys: DataFrame, how: str) -> DataFrame:
        tables = [self.spark.table(t).select(*KEY) for t, _ in self.runs()]
        if how == "left_anti":
            for t in tables:
                keys = keys.join(t, KEY, how)
            return keys
        every = self.spark.createDataFrame([], "h long, g int")
        for t in tables:
            every = every.unionAll(t)
        return keys.join(every, KEY, how)

    def _unsettled(self, counts: DataFrame) -> DataFrame:
        for name, _ in self.runs():
            counts = counts.join(self.spark.table(name).where("common").select(*KEY), KEY, "left_anti")
        return counts

    def _put(self, level: int, counts: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        path = stage_path(self.spark, "line-run")
        (counts.select(*KEY, "n", (F.col("n") >= self.min_docs).alias("common"))
         .write.partitionBy("common").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", path).option("compression", "zstd").saveAsTable(name))
        self.levels[level].append((name, path))

    def _compact(self, level: int, runs: list[tuple[str, str]]) -> None:
        """Merge ``runs`` into one run of the level above."""
        every = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            every = every.unionAll(self.spark.table(name))
        merged = every.groupBy(*KEY).agg(F.sum("n").alias("n"))
        self.levels = [[r for r in rs if r not in runs] for rs in self.levels]
        # a key may have been settled by a higher level after a lower run was written
        self._put(level + 1, self._unsettled(merged))
        self._drop(runs)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, path)


def common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> LineRuns:
    """The runs of ``docs`` (a column ``text``), added in ``batches`` batches dealt by a hash of the text.

    The keys of all batches are written by one pass over the texts; a batch then
    reads its own part.
    """
    spark = docs.sparkSession
    path = stage_path(spark, "line-keys")
    batch = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(batches)).cast("int")
    (document_keys(docs.select("text", batch.alias("batch")), min_chars, "batch")
     .write.option("compression", "zstd").partitionBy("batch").parquet(path))
    keys = spark.read.schema("h long, g int, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select(*KEY))
    remove_path(spark, path)
    return runs


def without_lines(lines, gone):
    """Column: the array ``lines`` without the places (from 0, ascending) in ``gone``, by the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text",
                      id_col: str = "doc_id", batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` plus ``n_lines`` (before), ``n_dropped`` and ``kept`` (the text without common lines).

    A line goes, in every document, where its key stands in at least
    ``min_docs`` documents.
    """
    columns = [c for c in docs.columns if c.lower() not in MADE]
    others = [F.col(f"`{c}`") for c in columns if c != text_col]
    rows = with_unique_ids(docs, id_col, [F.struct(F.lit(0), *others).alias("row"), F.col(f"`{text_col}`").alias("text")])
    runs = common_lines(rows.select("text"), min_docs, min_chars, batches, fanout)
    common = runs.common()
    at = (rows.select("_rid", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
          .select("_rid", "pos", line_key(F.col("line")).alias("k"))
          .where(F.length("k") >= min_chars).select("_rid", "pos", *hashes(F.col("k"))))
    hits = lookup_join(at, common.select(*KEY), KEY, "inner", small_rows=common.count())
    gone = staged(hits.groupBy("_rid").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "line-places")
    runs.close()
    lines, none = lines_of(F.col("text")), F.array().cast("array<int>")
    # places are few bytes beside the texts of their documents: hashed per partition, so that texts are not sorted
    left = (rows.join(gone.hint("shuffle_hash"), "_rid", "left")
            .select("row", lines.alias("lines"), F.coalesce("gone", none).alias("gone"), "text"))
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns],
                       F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
                       F.when(F.size("gone") == 0, F.coalesce("text", F.lit("")))
                       .otherwise(F.array_join(without_lines(F.col("lines"), F.col("gone")), "\n")).alias("kept"))


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept, one row per document."""
    out = drop_common_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
