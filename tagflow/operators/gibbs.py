"""Gibbs-sampled topics with re-optimised alpha.

The state is a table of tokens, each with its topic.  A sweep draws every
token's topic anew from the counts at the start of the sweep, its own place
taken out of them: with topic counts ``n_dt`` of its document, ``n_wt`` of its
term and ``n_t`` of all tokens,

    p(t)  ~  (n_dt + alpha_t) (n_wt + beta) / (n_t + V beta)

Counts are merged once a sweep, as in distributed samplers that give every task
its own copy; here every token is its own task, so the result does not depend on
how tokens lie in partitions.  Draws are hashes of (place, sweep, seed): a
repeated run, or a task that runs twice, draws the same.

Every ``optimize_every`` sweeps alpha is fitted to the documents' counts by
Minka's fixed point, with the digamma function as a column expression; only the
k sums reach the driver.

Tokens are dealt out in packs by their term once and stay there; only their
topics change (``rounds``).  Terms' counts are those of a pack's own tokens.  The
counts of documents, and of the few terms with so many tokens that they are
spread over packs, are added up once a sweep and sent to every pack.  Where these
are more than ``rounds.MOST_GLOBAL`` numbers, term and document counts are joined
to the tokens by equi-joins of the planner's choice instead (``sweep``), so
neither the vocabulary nor the documents are bounded; a sweep then is one job that
writes the next state.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.joins import lookup_join, with_constants
from ..session import stage, unstage
from . import rounds

SWEEPS = 40            # the reference point is 1500; a parameter of the fit
ALPHA_SUM, BETA = 50.0, 0.01
OPTIMIZE_EVERY = 5
ALPHA_STEPS = 3
LEAST_ALPHA = 1e-4
SPREAD_TOKENS = 1 << 18    # tokens of a term that are dealt out over the packs
DEALT_TOKENS = 1 << 20     # tokens that are dealt out at once
CHUNK = 1 << 17            # tokens whose weights are laid out at once

# The workers' functions go by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_table(texts: DataFrame, vocab: DataFrame, vocab_rows: int, order: Sequence[str]) -> DataFrame:
    """``(doc, place, idx)`` of pooled texts ``(doc_key, tokens, *order)``; ``order`` tells a document's texts apart.

    ``place`` is a hash of the document, the text and the position in it.
    """
    t = texts.select("doc_key", *order, F.posexplode("tokens").alias("pos", "term"))
    t = lookup_join(t, vocab.select("term", "idx"), "term", "inner", vocab_rows)
    return t.select(F.col("doc_key").alias("doc"), F.xxhash64("doc_key", *order, "pos").alias("place"), "idx")


def uniform(place: Column, sweep: int, seed: int) -> Column:
    """A number in [0, 1) with 53 random bits, from a hash of place, sweep and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(place, F.lit(sweep).cast("long"), F.lit(seed).cast("long")), 11)
    return bits.cast("double") / float(1 << 53)


def per_topic(k: int, name: str) -> Column:
    return F.array(*[F.count_if(F.col("z") == t).cast("double") for t in range(k)]).alias(name)


def drawn(weights: Column, u: Column, k: int) -> Column:
    """The first topic at which the running sum of ``weights`` exceeds ``u`` times their sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    start = F.struct((u * total).alias("left"), F.lit(0).alias("t"), F.lit(-1).alias("z"))

    def step(s, x):
        left = s["left"] - x
        return F.struct(left.alias("left"), (s["t"] + 1).alias("t"),
                        F.when((s["z"] < 0) & (left < 0), s["t"]).otherwise(s["z"]).alias("z"))

    return F.aggregate(weights, start, step, lambda s: F.when(s["z"] < 0, k - 1).otherwise(s["z"]))


def sweep(state: DataFrame, k: int, v: int, alpha: Sequence[float], beta: float, number: int, seed: int) -> DataFrame:
    """``state (doc, place, idx, z)`` with every token's topic drawn anew."""
    terms = state.groupBy("idx").agg(per_topic(k, "n_w"))
    docs = state.groupBy("doc").agg(per_topic(k, "n_d"))
    every = state.agg(per_topic(k, "n_t"))
    j = with_constants(state.join(terms, "idx").join(docs, "doc"), every)
    alphas = F.array(*[F.lit(float(a)) for a in alpha])

    def weight(t):
        own = F.when(t == F.col("z"), 1.0).otherwise(0.0)
        at = lambda name: F.get(F.col(name), t) - own
        return (at("n_d") + F.get(alphas, t)) * (at("n_w") + beta) / (at("n_t") + v * beta)

    weights = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), weight)
    j = j.select("doc", "place", "idx", weights.alias("weights"))
    return j.select("doc", "place", "idx", drawn(F.col("weights"), uniform(F.col("place"), number, seed), k).alias("z"))


def digamma(x: Column) -> Column:
    """Digamma for x > 0: six steps of its recurrence, then the asymptotic series."""
    y = x + 6.0
    inv = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return series - sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)


def fitted_alpha(doc_counts: DataFrame, alpha: Sequence[float], steps: int = ALPHA_STEPS) -> list[float]:
    """Minka's fixed point for the Dirichlet of documents' topic counts ``n_d`` (an array per document)."""
    alpha = list(alpha)
    k = len(alpha)
    for _ in range(steps):
        total = float(sum(alpha))
        n = F.aggregate("n_d", F.lit(0.0), lambda a, x: a + x)
        sums = [F.sum(digamma(F.get("n_d", F.lit(t)) + alpha[t]) - digamma(F.lit(alpha[t]))).alias(f"s{t}")
                for t in range(k)]
        got = doc_counts.agg(*sums, F.sum(digamma(n + total) - digamma(F.lit(total))).alias("all")).first()
        if not got["all"]:
            break
        alpha = [max(a * got[f"s{t}"] / got["all"], LEAST_ALPHA) for t, a in enumerate(alpha)]
    return alpha


def fitted(counts: np.ndarray, alpha: Sequence[float], steps: int = ALPHA_STEPS) -> list[float]:
    """``fitted_alpha`` of the counts as a matrix, a row per document."""
    def psi(x):
        y = x + 6.0
        inv = 1.0 / (y * y)
        series = np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
        return series - sum(1.0 / (x + i) for i in range(6))

    alpha = np.array(alpha, dtype=float)
    for _ in range(steps):
        every = float((psi(counts.sum(axis=1) + alpha.sum()) - psi(alpha.sum())).sum())
        if not every:
            break
        alpha = np.maximum(alpha * (psi(counts + alpha) - psi(alpha)).sum(axis=0) / every, LEAST_ALPHA)
    return alpha.tolist()


def uniforms(place: np.ndarray, sweep: int, seed: int) -> np.ndarray:
    """``uniform`` of an array: XXH64 of place, sweep and seed in turn, as Spark chains it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    with np.errstate(over="ignore"):
        h = np.full(len(place), 42, dtype=np.uint64)
        for x in (place.view(np.uint64), np.array([sweep], np.int64).view(np.uint64), np.array([seed], np.int64).view(np.uint64)):
            h = h + p5 + np.uint64(8)
            h = turned(h ^ (turned(x * p2, 31) * p1), 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _in_packs(tokens: DataFrame, k: int, v: int, sweeps: int, alpha: list[float], beta: float, optimize_every: int,
              seed: int) -> tuple[DataFrame, list[float]] | None:
    """``sample_topics`` over packs; None where the counts per document are too many for that, or there are no tokens."""
    tokens = tokens.select("doc", "place", "idx").where(F.col("doc").isNotNull() & F.col("idx").isNotNull())
    # The tokens themselves are read once more only, and not written but in their packs.
    entries = stage(tokens.groupBy("doc", "idx").agg(F.count(F.lit(1)).alias("n")), "entries")
    of_docs = entries.select("doc").distinct()
    n_docs = of_docs.count()
    if not n_docs or n_docs * k > rounds.MOST_GLOBAL:
        return None
    rows = entries.agg(F.sum("n")).first()[0]
    heavy = stage(entries.groupBy("idx").agg(F.sum("n").alias("n")).where(F.col("n") > SPREAD_TOKENS).select("idx"), "spread_terms")
    if (n_docs + heavy.count()) * k > rounds.MOST_GLOBAL:
        return None
    docs = of_docs.toArrow().column("doc").combine_chunks()         # at most MOST_GLOBAL
    spread = np.sort(np.array([r.idx for r in heavy.collect()], dtype=np.int64))            # likewise
    far = F.broadcast(heavy.select("idx", F.lit(True).alias("far")))
    number = {d: n for n, d in enumerate(docs.to_pylist())}
    spark = tokens.sparkSession
    numbers, names = spark.sparkContext.broadcast(number), spark.sparkContext.broadcast(docs)
    parts = rounds.pack_count(tokens, rows)
    dealt = tokens.join(far, "idx", "left").select(
        "doc", "place", F.col("idx").cast("long").alias("idx"),
        F.pmod(F.xxhash64(F.when(F.col("far"), F.col("place")).otherwise(F.col("idx").cast("long"))), F.lit(parts)).cast("int").alias("part"))

    kinds = (("doc", np.int32), ("place", np.int64), ("idx", np.int64))

    def deal(batches):
        """Rows ``(part, doc, place, idx)`` as arrays, which move in less room."""
        import pyarrow as pa

        held, n = [], 0

        def out():
            part, *arrays = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((arrays[2], part))
            part, arrays = part[order], [a[order] for a in arrays]
            cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *[pa.array(
                [a[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for a in arrays]], names=["part", *dict(kinds)])

        for batch in batches:
            if batch.num_rows:
                doc = batch.column("doc").dictionary_encode()
                of = np.array([numbers.value[d] for d in doc.dictionary.to_pylist()], dtype=np.int32)
                held.append((batch.column("part").to_numpy(), of[doc.indices.to_numpy()], batch.column("place").to_numpy(),
                             batch.column("idx").to_numpy()))
                n += batch.num_rows
            if n >= DEALT_TOKENS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def build(table):
        import pyarrow as pa

        doc, place, idx = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in kinds)
        terms, w = np.unique(idx, return_inverse=True)
        order = np.lexsort((doc, w))
        arrays = (doc[order], place[order], w[order].astype(np.int32), terms)
        return pa.Table.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["doc", "place", "w", "terms"])

    schema = "doc binary, place binary, w binary, terms binary"
    moved = dealt.mapInArrow(deal, "part int, doc binary, place binary, idx binary")
    packs = stage(moved.groupBy("part").applyInArrow(build, schema), "tokens_in_packs", maxRecordsPerFile=rounds.FILE_PACKS)
    small = np.uint8 if k <= 256 else np.int32

    def load(r):
        place = np.frombuffer(r.place, np.int64)
        z = np.minimum(np.floor(uniforms(place, 0, seed) * k), k - 1).astype(small)
        return (np.frombuffer(r.doc, np.int32), place, np.frombuffer(r.w, np.int32), np.frombuffer(r.terms, np.int64)), z

    def far_terms(terms):
        at = np.minimum(np.searchsorted(spread, terms), max(len(spread) - 1, 0))
        own = np.flatnonzero(spread[at] == terms) if len(spread) else np.zeros(0, int)
        return own, at[own]

    def counted(pack, z):
        """The counts of documents and of spread terms."""
        doc, _, w, terms = pack
        n = np.bincount(doc * np.int64(k) + z, minlength=n_docs * k).reshape(n_docs, k)
        out = np.zeros((len(spread), k), dtype=np.int64)
        own, at = far_terms(terms)
        if len(own):
            out[at] = np.bincount(w * np.int64(k) + z, minlength=len(terms) * k).reshape(-1, k)[own]
        return np.concatenate([n, out])

    def begin(pack, z, _):
        return z, counted(pack, z)

    def step(pack, z, value):
        doc, place, w, terms = pack
        counts, alphas, sweep_number = value
        n_d, n_t = counts[:n_docs].astype(float), counts[:n_docs].sum(axis=0).astype(float)
        n_w = np.bincount(w * np.int64(k) + z, minlength=len(terms) * k).reshape(-1, k).astype(float)
        own, at = far_terms(terms)
        n_w[own] = counts[n_docs:][at]
        new = np.empty_like(z)
        for i in range(0, len(z), CHUNK):
            cut = slice(i, i + CHUNK)
            d, x, old = n_d[doc[cut]], n_w[w[cut]], z[cut]
            weights, total = [], np.zeros(len(old))
            for t in range(k):
                one = (old == t).astype(float)
                weights.append((d[:, t] - one + alphas[t]) * (x[:, t] - one + beta) / (n_t[t] - one + v * beta))
                total = total + weights[-1]
            left, drawn_ = uniforms(place[cut], sweep_number, seed) * total, np.full(len(old), k - 1, dtype=z.dtype)
            found = np.zeros(len(old), dtype=bool)
            for t in range(k):
                left = left - weights[t]
                hit = ~found & (left < 0)
                drawn_[hit] = t
                found |= hit
            new[cut] = drawn_
        return new, counted(pack, new)

    run = rounds.Rounds(packs, load)
    counts = run.round(begin, None)
    for number_ in range(1, sweeps + 1):
        counts = run.round(step, (counts, alpha, number_))
        if optimize_every and number_ % optimize_every == 0:
            alpha = fitted(counts[:n_docs].astype(float), alpha)

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                doc, place, w, terms, z = (np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in (
                    ("doc", np.int32), ("place", np.int64), ("w", np.int32), ("terms", np.int64), ("z", small)))
                for i in range(0, len(z), CHUNK):
                    cut = slice(i, i + CHUNK)
                    yield pa.RecordBatch.from_arrays([names.value.take(pa.array(doc[cut])), pa.array(place[cut]), pa.array(terms[w[cut]]),
                                                      pa.array(z[cut].astype(np.int32))], names=["doc", "place", "idx", "z"])

    types = {f.name: f.dataType.simpleString() for f in tokens.schema}
    made = run.result(lambda pack, z: (*(bytearray(a.tobytes()) for a in pack), bytearray(z.tobytes())), schema + ", z binary")
    made = stage(made, "topics_of_tokens", maxRecordsPerFile=rounds.FILE_PACKS)
    unstage(packs)
    state = made.mapInArrow(listed, f"doc {types['doc']}, place long, idx long, z int").select(
        "doc", "place", F.col("idx").cast(types["idx"]).alias("idx"), "z")
    run.end()
    return state, alpha


def sample_topics(tokens: DataFrame, k: int, v: int, sweeps: int = SWEEPS, alpha_sum: float = ALPHA_SUM,
                  beta: float = BETA, optimize_every: int = OPTIMIZE_EVERY,
                  seed: int = fixed.LDA_SEED) -> tuple[DataFrame, list[float]]:
    """``(doc, place, idx, z)`` after ``sweeps`` sweeps over ``tokens (doc, place, idx)``, and alpha.

    ``v`` is the size of the vocabulary; ``optimize_every`` 0 keeps alpha as it
    starts, ``alpha_sum / k`` each.
    """
    if k < 1 or v < 0 or beta <= 0 or alpha_sum <= 0:
        raise ValueError("k, alpha_sum and beta must be positive")
    alpha = [alpha_sum / k] * k
    if sweeps:
        got = _in_packs(tokens, k, v, sweeps, alpha, beta, optimize_every, seed)
        if got:
            return got
    first = F.least(F.floor(uniform(F.col("place"), 0, seed) * k), F.lit(k - 1)).cast("int")
    state = stage(tokens.select("doc", "place", "idx", first.alias("z")), "topics_of_tokens")
    for number in range(1, sweeps + 1):
        state = stage(sweep(state, k, v, alpha, beta, number, seed), "topics_of_tokens")
        if optimize_every and number % optimize_every == 0:
            alpha = fitted_alpha(stage(state.groupBy("doc").agg(per_topic(k, "n_d")), "topics_of_docs"), alpha)
    return state, alpha


def topic_sizes(state: DataFrame, alpha: Sequence[float]) -> DataFrame:
    """``(topic, alpha, n_tokens, share)``, one row per topic, also of those without a token."""
    spark = state.sparkSession
    rows = spark.createDataFrame(list(enumerate(map(float, alpha))), "topic int, alpha double")   # k rows
    n = state.groupBy(F.col("z").alias("topic")).agg(F.count(F.lit(1)).alias("n_tokens"))
    j = rows.join(n, "topic", "left").fillna(0, ["n_tokens"])
    return with_constants(j, state.agg(F.count(F.lit(1)).alias("all"))).select(
        "topic", "alpha", "n_tokens", F.try_divide(F.col("n_tokens"), F.col("all")).alias("share"))


def topic_words(state: DataFrame, vocab: DataFrame, n: int, k: int) -> DataFrame:
    """``(topic, rank, term, count)``: the terms most often drawn in each topic (k x n rows); ties by term number."""
    per = state.groupBy(F.col("z").alias("topic"), "idx").agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("idx").asc()]
    # partial top lists first, so that no task holds a topic's whole vocabulary
    part = per.withColumn("part", F.pmod("idx", F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("topic", "part").orderBy(*order))).where(F.col("r") <= n)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("rank") <= n)
    # k x n rows
    return vocab.select("idx", "term").join(F.broadcast(top.select("topic", "rank", "idx", "count")), "idx").drop("idx")
