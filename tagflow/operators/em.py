"""LDA by EM (MAP estimates; Asuncion, Welling, Smyth, Teh, UAI 2009) as joins and sums.

The corpus is in long form, ``(doc, idx, count)``; no group holds a whole document.  The model is the expected tokens of
each topic per term and per document.  In an iteration an entry's tokens are
dealt to the topics in proportion to

    (n_term,topic + eta - 1) * (n_doc,topic + alpha - 1) / (n_topic + V * (eta - 1))

and the shares are summed per term and per document.  Entries and term counts
are dealt out by the term once and kept in memory (spilling to disk), so the
sums per term need no shuffle; only partial sums per document move.  Where
the documents' counts are few (``rounds.MOST_GLOBAL``) they are sent to packs of
entries, and an iteration is one job over arrays (``rounds``); else an iteration
is a join of tables.  The priors, update and likelihood are those of MLlib's EM optimizer, whose graph
sends every entry's topics to its term and its document by a shuffle.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import MAX_BROADCAST_BYTES, with_constants
from ..session import stage
from . import rounds

ETA = 1.1              # MLlib's prior of a term in a topic
STAGE_EVERY = 10       # iterations after which the term counts are written, which bounds what a lost executor costs
ENTRIES_AT_ONCE = 1 << 18

# The workers' functions go by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def entries_of(vectors: DataFrame) -> DataFrame:
    """``(doc, idx, count)`` of a table of vectors ``features``, sparse or dense; documents are numbered as MLlib does."""
    u = vectors.select(F.monotonically_increasing_id().alias("doc"), F.unwrap_udt("features").alias("f"))
    pairs = F.when(F.col("f.type") == 0, F.arrays_zip(F.col("f.indices").alias("idx"), F.col("f.values").alias("count"))) \
             .otherwise(F.transform("f.values", lambda x, i: F.struct(i.alias("idx"), x.alias("count"))))
    return stage(u.select("doc", F.inline(pairs)).where("count <> 0"), "entries")


def _n(k: int, table: str) -> list[str]:
    return [f"{table}{i}" for i in range(k)]


def _added(cols: list[str]):
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0]))


def _sums(shares: DataFrame, key: str, table: str, k: int) -> DataFrame:
    return shares.groupBy(key).agg(*[F.sum(s).alias(n) for s, n in zip(_n(k, "s"), _n(k, table))])


@dataclass
class EMModel:
    """``terms (idx, t0..)`` and ``docs (doc, d0..)``: expected tokens per topic; ``entries`` is what it was fitted on."""
    terms: DataFrame
    docs: DataFrame
    entries: DataFrame
    n_docs: int
    k: int
    alpha: float
    v: int

    def isDistributed(self) -> bool:
        return True

    def topic_counts(self) -> DataFrame:
        def long(df, id_col, table):
            return df.select(id_col.alias("id"), F.posexplode(F.array(*_n(self.k, table))).alias("topic", "n"))
        return long(self.terms, -F.col("idx").cast("long") - 1, "t").unionByName(
            long(self.docs, F.col("doc").cast("long"), "d"))

    def describeTopics(self, maxTermsPerTopic: int = 10) -> DataFrame:
        """``(topic, termIndices, termWeights)``: the most probable terms of each topic."""
        n = self.topic_counts().where("id < 0").select("topic", (-F.col("id") - 1).cast("int").alias("idx"), "n")
        order = Window.partitionBy("topic").orderBy(F.col("n").desc(), F.col("idx"))
        top = n.withColumn("r", F.row_number().over(order)).where(F.col("r") <= maxTermsPerTopic)
        all_ = n.groupBy("topic").agg(F.sum("n").alias("all"))
        # topics x words
        top = top.join(F.broadcast(all_), "topic").groupBy("topic").agg(F.array_sort(F.collect_list(
            F.struct("r", "idx", (F.col("n") / F.col("all")).alias("w")))).alias("l"))
        return top.select("topic", F.col("l.idx").alias("termIndices"), F.col("l.w").alias("termWeights"))

    def trainingLogLikelihood(self) -> float:
        """The log likelihood of the corpus under the model's topics and mixtures."""
        f = _factors(self.docs, self.k, self.alpha, self.v)
        mixed = F.log(_added([f"g{i}" for i in range(self.k)])) - F.log("weight")
        g = _weighted(self.entries, self.terms, f, self.n_docs, self.k)
        return g.agg(F.coalesce(F.sum(F.col("count") * mixed), F.lit(0.0))).first()[0]


def _factors(docs: DataFrame, k: int, alpha: float, v: int) -> DataFrame:
    """``(doc, f0.., weight)``: a document's part of an entry's topic weights, and the sum of its smoothed counts."""
    totals = docs.agg(*[F.sum(d).alias(n) for d, n in zip(_n(k, "d"), _n(k, "n"))])
    return with_constants(docs, totals).select(
        "doc", *[((F.col(f"d{i}") + (alpha - 1)) / (F.col(f"n{i}") + v * (ETA - 1))).alias(f"f{i}") for i in range(k)],
        (_added(_n(k, "d")) + k * (alpha - 1)).alias("weight"))


def _weighted(entries: DataFrame, terms: DataFrame, factors: DataFrame, n_docs: int, k: int) -> DataFrame:
    """Entries with the topics' weights ``g0..``."""
    if n_docs * (k + 2) * 8 <= MAX_BROADCAST_BYTES:
        factors = F.broadcast(factors)
    return entries.join(terms, "idx").join(factors, "doc").select(
        "doc", "idx", "count", "weight", *[((F.col(f"t{i}") + (ETA - 1)) * F.col(f"f{i}")).alias(f"g{i}") for i in range(k)])


def _shares(weighted: DataFrame, k: int) -> DataFrame:
    """The tokens of an entry dealt in proportion to its weights: ``(doc, idx, s0..)``."""
    w = weighted.withColumn("u", F.col("count") / _added(_n(k, "g")))
    return w.select("doc", "idx", *[(F.col(f"g{i}") * F.col("u")).alias(f"s{i}") for i in range(k)])


def dealt(df: DataFrame) -> DataFrame:
    """A table with ``idx`` dealt out and sorted by it, kept in memory from its first use (spilling to disk)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "idx").sortWithinPartitions("idx").persist(StorageLevel.MEMORY_AND_DISK)


def fit(entries: DataFrame, start: DataFrame, k: int, iterations: int, v: int) -> EMModel:
    """EM over ``entries (doc, idx, count)`` and a vocabulary of ``v`` terms.

    ``start`` holds the topic counts to begin with as a saved MLlib model
    does: ``(id, topicWeights)``, ids as in ``topic_counts``.
    """
    alpha = 50.0 / k + 1

    def columns(rows, id_col, table):
        weights = rows.select(id_col, vector_to_array("topicWeights").alias("_w"))
        return weights.select(weights.columns[0], *[F.get("_w", F.lit(i)).alias(n) for i, n in enumerate(_n(k, table))])

    n_docs = start.where("id >= 0").count()
    docs = stage(columns(start.where("id >= 0"), F.col("id").alias("doc"), "d"), "topics_of_docs")
    terms = stage(columns(start.where("id < 0"), (-F.col("id") - 1).cast("int").alias("idx"), "t"), "topics_of_terms")
    if not iterations:
        return EMModel(terms, docs, entries, n_docs, k, alpha, v)
    if n_docs * k <= rounds.MOST_GLOBAL:
        terms, docs = _fit_in_packs(entries, terms, docs, k, iterations, v, alpha)
        return EMModel(terms, docs, entries, n_docs, k, alpha, v)
    held, terms, old = dealt(entries), dealt(terms), None
    for number in range(1, iterations + 1):
        shares = _shares(_weighted(held, terms, _factors(docs, k, alpha, v), n_docs, k), k)
        # Computes the term counts that the shares come from, on their first use; those before are done with.
        docs = stage(_sums(shares, "doc", "d", k), "topics_of_docs")
        if old is not None:
            old.unpersist()
        old, terms = terms, _sums(shares, "idx", "t", k)
        if number == iterations:
            terms = stage(terms, "topics_of_terms")
        elif number % STAGE_EVERY == 0:
            terms = dealt(stage(terms, "topics_of_terms"))
        else:
            terms = terms.persist(StorageLevel.MEMORY_AND_DISK)
    old.unpersist()
    held.unpersist()
    return EMModel(terms, docs, entries, n_docs, k, alpha, v)


def _fit_in_packs(entries: DataFrame, terms: DataFrame, docs: DataFrame, k: int, iterations: int, v: int,
                  alpha: float) -> tuple[DataFrame, DataFrame]:
    """``terms`` and ``docs`` after ``iterations`` over packs of entries; the documents' counts pass through the driver."""
    first = docs.select("doc", *_n(k, "d")).toArrow()
    ids = first.column("doc").to_numpy()
    order = np.argsort(ids)
    ids, counts = ids[order], np.stack([first.column(n).to_numpy() for n in _n(k, "d")], axis=1)[order]
    parts = rounds.pack_count(entries, entries.count())
    part = F.pmod(F.xxhash64(F.col("idx").cast("long")), F.lit(parts)).cast("int").alias("part")
    numbers = entries.sparkSession.sparkContext.broadcast(ids)

    def build(e, t):
        import pyarrow as pa

        at = np.argsort(t.column("idx").to_numpy())
        idx = t.column("idx").to_numpy()[at].astype(np.int32)
        weights = np.stack([t.column(n).to_numpy()[at] for n in _n(k, "t")]).reshape(k, -1)
        w = e.column("idx").to_numpy()
        by = np.argsort(w, kind="stable")
        arrays = (np.searchsorted(numbers.value, e.column("doc").to_numpy()[by]).astype(np.int32),
                  np.searchsorted(idx, w[by]).astype(np.int32), e.column("count").to_numpy()[by], idx, weights)
        return pa.Table.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["doc", "w", "count", "idx", "t"])

    left = entries.select(part, F.col("doc").cast("long").alias("doc"), "idx", F.col("count").cast("double").alias("count"))
    right = terms.select(part, "idx", *_n(k, "t"))
    packs = stage(left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(
        build, "doc binary, w binary, count binary, idx binary, t binary"), "entries_in_packs", maxRecordsPerFile=rounds.FILE_PACKS)

    def load(r):
        return (*(np.frombuffer(b, kind) for b, kind in ((r.doc, np.int32), (r.w, np.int32), (r["count"], float), (r.idx, np.int32))),), \
            np.frombuffer(r.t).reshape(k, -1)

    def step(pack, t, d):
        doc, w, count, idx = pack
        # a row per topic throughout: what is gathered lies side by side
        factors = (d.T + (alpha - 1)) / (d.sum(axis=0) + v * (ETA - 1))[:, None]
        smooth, new, part_ = t + (ETA - 1), np.zeros((k, len(idx))), np.zeros((k, len(d)))
        for i in range(0, len(w), ENTRIES_AT_ONCE):
            cut = slice(i, i + ENTRIES_AT_ONCE)
            g = smooth[:, w[cut]] * factors[:, doc[cut]]
            g *= count[cut] / g.sum(axis=0)
            for topic in range(k):
                new[topic] += np.bincount(w[cut], g[topic], len(idx))
                part_[topic] += np.bincount(doc[cut], g[topic], len(d))
        return new, part_.T

    run = rounds.Rounds(packs, load)
    for _ in range(iterations):
        counts = run.round(step, counts)

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                idx = np.frombuffer(batch.column("idx")[n].as_buffer(), np.int32)
                t = np.frombuffer(batch.column("t")[n].as_buffer()).reshape(k, -1)
                for i in range(0, len(idx), ENTRIES_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(idx[i:i + ENTRIES_AT_ONCE]),
                                                      *[pa.array(x[i:i + ENTRIES_AT_ONCE]) for x in t]], names=["idx", *_n(k, "t")])

    made = run.result(lambda pack, t: (bytearray(pack[3].tobytes()), bytearray(t.tobytes())), "idx binary, t binary")
    new = stage(made.mapInArrow(listed, "idx int, " + ", ".join(f"{n} double" for n in _n(k, "t"))), "topics_of_terms")
    run.end()
    rows = entries.sparkSession.createDataFrame([(int(i), *map(float, c)) for i, c in zip(ids, counts)],
                                                "doc long, " + ", ".join(f"{n} double" for n in _n(k, "d")))
    return new, stage(rows, "topics_of_docs")
