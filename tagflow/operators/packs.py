"""Products of all pairs of sparse vectors, pack by pack, without a shuffle of pairs.

A pack holds some whole vectors as arrays, sorted by term.  The packs are written
once; every pair of packs then meets in a cartesian product that reads the written
table again, so no entry, candidate or product passes through shuffle files.  A
worker holds two packs and the matrix of their products.

Terms stand in a pack as 64-bit hashes.  The hashes of all terms are counted first
and another seed is taken if two terms had the same one, so the products are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

PACK_ENTRIES = 1 << 20      # entries of a pack, on average, at most
PACK_VECTORS = 2048         # vectors of a pack, on average, at most
SMALL_PACK = 1 << 16        # a smaller table is not dealt into more than SPREAD packs of this size
SPREAD = 16
CHUNK = 1 << 20             # products that are laid out at once

# The workers' functions go by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def term_seed(terms: DataFrame) -> int:
    """A seed under which no two of the (distinct) ``terms`` have the same hash."""
    for seed in range(16):
        n = terms.agg(F.count("term").alias("all"), F.countDistinct(F.xxhash64(F.lit(seed), "term")).alias("hashes")).first()
        if n["all"] == n["hashes"]:
            return seed
    raise ValueError("terms are not distinct")


def pack_count(entries: int, vectors: int) -> int:
    return max(1, -(-entries // PACK_ENTRIES), -(-vectors // PACK_VECTORS), min(SPREAD, -(-entries // SMALL_PACK)))


def packed(vecs: DataFrame, seed: int) -> DataFrame:
    """``(pack, docs, terms, starts, rows, weights)`` of ``(doc_id, term, weight)``, written once.

    ``terms`` are sorted; entries ``starts[k]`` to ``starts[k + 1]`` of ``rows`` (places
    in ``docs``) and ``weights`` belong to term k.
    """
    vecs = vecs.where(F.col("doc_id").isNotNull() & F.col("term").isNotNull() & F.col("weight").isNotNull())
    n = vecs.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("doc_id").alias("vectors")).first()
    dealt = vecs.select(F.pmod(F.xxhash64("doc_id"), F.lit(pack_count(*n))).cast("int").alias("pack"),
                        F.col("doc_id").alias("doc"), F.xxhash64(F.lit(seed), "term").alias("code"),
                        F.col("weight").cast("double").alias("weight"))
    schema = T.StructType([T.StructField("pack", T.IntegerType()),
                           T.StructField("docs", T.ArrayType(vecs.schema["doc_id"].dataType)),
                           *[T.StructField(c, T.BinaryType()) for c in ("terms", "starts", "rows", "weights")]])

    def build(table):
        import pyarrow as pa

        docs = table.column("doc").unify_dictionaries().combine_chunks().dictionary_encode()
        docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
        code = table.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        arrays = (code[first], np.append(first, len(code)).astype(np.int32),
                  docs.indices.to_numpy().astype(np.int32)[order], table.column("weight").to_numpy()[order])
        kept = pa.ListArray.from_arrays(pa.array([0, len(docs.dictionary)], pa.int32()), docs.dictionary)
        return pa.Table.from_arrays([table.column("pack").slice(0, 1).combine_chunks(), kept,
                                     *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=schema.names)

    # one file for each pack: packs spread over the tasks of the product
    return stage(dealt.groupBy("pack").applyInArrow(build, schema), "packs", maxRecordsPerFile=1)


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] numbers), then the same of first[1], and so on."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def products(left: tuple, right: tuple, n1: int, n2: int) -> np.ndarray:
    """The n1 x n2 products of the vectors of two packs ``(terms, starts, rows, weights)``.

    Terms that many vectors of both packs have are multiplied as dense columns, all
    others entry by entry.
    """
    (t1, s1, r1, w1), (t2, s2, r2, w2) = left, right
    _, i, j = np.intersect1d(t1, t2, assume_unique=True, return_indices=True)
    out = np.zeros(n1 * n2)
    a1, a2 = s1[i].astype(np.int64), s2[j].astype(np.int64)
    c1, c2 = s1[i + 1] - a1, s2[j + 1] - a2
    work = c1 * c2
    dense = work > n1 * n2 / 200 + (n1 + n2) / 8

    rare = np.flatnonzero(~dense)
    part = np.cumsum(work[rare]) // CHUNK
    for k in np.split(rare, np.flatnonzero(np.diff(part)) + 1) if len(rare) else []:
        each = np.repeat(c2[k], c1[k])
        x = np.repeat(spans(a1[k], c1[k]), each)
        y = spans(np.repeat(a2[k], c1[k]), each)
        np.add.at(out, r1[x] * np.int64(n2) + r2[y], w1[x] * w2[y])

    often = np.flatnonzero(dense)
    width = max(1, 4 * CHUNK // (n1 + n2))
    out = out.reshape(n1, n2)
    for k in (often[at:at + width] for at in range(0, len(often), width)):
        def columns(rows, weights, a, c, n, k=k):
            e = spans(a[k], c[k])
            at = rows[e] * np.int64(len(k)) + np.repeat(np.arange(len(k)), c[k])
            return np.bincount(at, weights[e], n * len(k)).reshape(n, len(k))

        out += columns(r1, w1, a1, c1, n1) @ columns(r2, w2, a2, c2, n2).T
    return out


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of packs: each pair once if both sides are one table, else all."""
    names = [c for c in left.columns if c != "pack"]
    a = left.select(F.col("pack").alias("pack1"), *[F.col(c).alias(f"{c}1") for c in names])
    b = right.select(F.col("pack").alias("pack2"), *[F.col(c).alias(f"{c}2") for c in names])
    b = b.hint("shuffle_replicate_nl")
    if left is not right:
        return a.crossJoin(b).drop("pack1", "pack2").withColumn("same", F.lit(False))
    # of (a, b) and (b, a) the one that the parity of a + b tells: half of each task's pairs
    odd = (F.col("pack1") + F.col("pack2")) % 2 == 1
    once = (F.col("pack1") == F.col("pack2")) | (odd == (F.col("pack1") > F.col("pack2")))
    return a.join(b, once).withColumn("same", F.col("pack1") == F.col("pack2")).drop("pack1", "pack2")


def _matrices(batches: Iterator) -> Iterator:
    """``(docs of the rows, docs of the columns, products)``; of a pack with itself each pair once, the others NaN."""
    kinds = {"terms": np.int64, "starts": np.int32, "rows": np.int32, "weights": np.float64}
    for batch in batches:
        for k in range(batch.num_rows):
            def side(s, batch=batch, k=k):
                return tuple(np.frombuffer(batch.column(f"{c}{s}")[k].as_buffer(), t) for c, t in kinds.items())

            docs = [batch.column(f"docs{s}")[k].values for s in (1, 2)]
            m = products(side(1), side(2), *map(len, docs))
            if batch.column("same")[k].as_py():
                m[np.triu_indices(len(m))] = np.nan
            yield *docs, m


def pairs_from(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(d1, d2, Weight)``, Weight >= threshold, d1 a vector of ``left``, d2 of ``right`` (both ``packed``).

    With one table on both sides each pair of different vectors comes once.
    """
    kind = left.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("d1", kind), T.StructField("d2", kind), T.StructField("Weight", T.DoubleType())])
    return _meet(left, right).mapInArrow(_found(threshold), schema)


def _found(threshold: float, rows: int = 1 << 16) -> Callable:
    def run(batches):
        import pyarrow as pa

        for d1, d2, m in _matrices(batches):
            flat = m.ravel()
            at = np.flatnonzero(flat >= threshold)
            for k in (at[i:i + rows] for i in range(0, len(at), rows)):
                yield pa.RecordBatch.from_arrays([d1.take(pa.array(k // m.shape[1])), d2.take(pa.array(k % m.shape[1])),
                                                  pa.array(flat[k])], names=["d1", "d2", "Weight"])

    return run


def pair_counts(packs: DataFrame) -> DataFrame:
    """One row ``(joined_rows, candidates)``: sum of the products of all pairs, and how many are not 0."""
    def run(batches):
        import pyarrow as pa

        for _, _, m in _matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([round(np.nansum(m))]), pa.array([int((m > 0).sum())])],
                                             names=["joined_rows", "candidates"])

    counts = _meet(packs, packs).mapInArrow(run, "joined_rows long, candidates long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("joined_rows", "candidates")])
