"""Topic models: bag of words, LDA sweep, c_v coherence, topic views.

The MALLET Gibbs sampler of the reference is re-aimed at LDA fitted by EM
(operators/em.py), which reads every entry in every iteration: topics are
comparable in kind, not number for number.

c_v coherence (Roeder, Both, Hinneburg, WSDM 2015) is computed as Spark
jobs.  Probabilities are shares of boolean sliding windows of 110 tokens that
slide over whole documents (a shorter document is one window).  A pooled
document is never one row: its member texts have a fixed order, and their
offsets come from a distributed prefix sum.  Instead of exploding every
window, each occurrence of a topic word covers an interval of window starts.
Window starts are dealt into blocks.  In a block a word is a row of bits, one
for each window start that it covers: its window count is their number, a
pair's count that of the bits which both rows have.  Only pairs that stand in
a topic together are counted, so the work grows with the blocks and with the
topics, not with the square of all their words, and no group is larger than a
block.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..plans.joins import lookup_join, with_constants
from ..plans.rank import number_rows
from ..session import stage, stage_path, unstage
from . import em

LDA_MAX_ITER = 30      # passes over the corpus; a parameter of the fit
BLOCK_WINDOWS = 1 << 16
PAIRS_AT_ONCE = 256    # of a block: 4 MB


def bag_of_words(counts: DataFrame):
    """Count vectors from term counts ``(doc_key, term, count)``.

    The vocabulary is every term, numbered from 0 by falling total (ties by
    term).  Returns ``(vectors (doc_key, features, length), vocab DataFrame
    (idx, term, total), vocabulary size)``.  Vectors are written as the
    structs that sparse vectors are stored as and read back as vectors, so no
    Python builds them.
    """
    from pyspark.ml.linalg import VectorUDT

    totals = counts.groupBy("term").agg(F.sum("count").alias("total"))
    numbered, v = number_rows(totals, [F.col("total").desc(), F.col("term").asc()], "rank")
    vocab = stage(numbered.select((F.col("rank") - 1).cast("int").alias("idx"), "term", "total"), "vocabulary")
    j = lookup_join(counts, vocab.select("term", "idx"), "term", "inner", v)
    per_doc = j.groupBy("doc_key").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col("count").cast("double").alias("c")))).alias("e"),
        F.sum("count").alias("length"))
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(v).alias("size"),
                      F.col("e.idx").alias("indices"), F.col("e.c").alias("values"))
    path = stage_path(counts.sparkSession, "vectors")
    rows = per_doc.select("doc_key", sparse.alias("features"), "length")
    rows.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
                           for f in rows.schema])
    return counts.sparkSession.read.schema(schema).parquet(path), vocab, v


def fit_lda(vectors: DataFrame, k: int, max_iter: int = LDA_MAX_ITER, optimizer: str = "em",
            seed: int = fixed.LDA_SEED):
    """LDA; with EM (the default) every iteration reads the whole corpus.

    EM starts from MLlib's random assignment, a fit without iterations; other
    optimizers are MLlib's throughout.
    """
    from pyspark.ml.clustering import LDA

    if optimizer != "em":
        return LDA(k=k, maxIter=max_iter, seed=seed, optimizer=optimizer, featuresCol="features").fit(vectors)
    start = LDA(k=k, maxIter=0, seed=seed, optimizer="em", featuresCol="features").fit(vectors)
    path = stage_path(vectors.sparkSession, "lda_start")
    start.write().overwrite().save(path)
    counts = vectors.sparkSession.read.parquet(f"{path}/oldModel/data/topicCounts")
    return em.fit(em.entries_of(vectors), counts, k, max_iter, start.vocabSize())


def topic_counts(model) -> DataFrame:
    """``(id, topic, n)``: the expected tokens of each topic per term and per document.

    Terms have negative ids (-1 for term 0) and documents the others, as in a
    saved MLlib model.  Neither the vocabulary's matrix nor the documents'
    topics pass through the driver.
    """
    return model.topic_counts()


def topic_words(model, vocab: DataFrame, n: int) -> DataFrame:
    """``(topic, rank, term, weight)``: the n most probable terms per topic (k x n rows)."""
    d = model.describeTopics(n)
    ex = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "e"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("e.termIndices").alias("idx"),
                   F.col("e.termWeights").alias("weight"))
    # The k x n rows are the small side.
    return vocab.select("idx", "term").join(F.broadcast(ex), "idx").drop("idx")


def topic_terms(model, vocab: DataFrame, n: int = fixed.TOPIC_TERMS) -> DataFrame:
    """One row per topic: ``Topic1..K`` and its n top terms joined by ', '."""
    tw = topic_words(model, vocab, n)
    per = tw.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("l"))
    return per.select(F.concat(F.lit("Topic"), (F.col("topic") + 1).cast("string")).alias("topic"),
                      F.array_join(F.transform("l", lambda s: s["term"]), ", ").alias("terms"))


def topic_relevance(model, vocab: DataFrame, lam: float = 0.6, top: int | None = None) -> DataFrame:
    """Relevance of every term to every topic, lam*ln(phi) + (1-lam)*ln(phi/p), and the topic's share.

    phi is the term's share of the topic; p its share of all tokens; a topic's
    share is that of the tokens the model assigns to it.  Terms without weight in a topic have no row.  With ``top`` only the most
    relevant terms of each topic are returned, with their rank.
    """
    counts = topic_counts(model)
    terms = counts.where("id < 0").select((-F.col("id") - 1).cast("int").alias("idx"), "topic", "n")
    # One row per topic.
    total = terms.groupBy("topic").agg(F.sum("n").alias("all"))
    phi = terms.join(F.broadcast(total), "topic").select("idx", "topic", (F.col("n") / F.col("all")).alias("phi"))
    tot = vocab.agg(F.sum("total").alias("n"))
    p = with_constants(vocab, tot).select("idx", "term", (F.col("total") / F.col("n")).alias("p"))
    rel = phi.where("phi > 0").join(p, "idx").withColumn(
        "relevance", lam * F.log("phi") + (1 - lam) * F.log(F.col("phi") / F.col("p")))
    cols = ["term", "phi", "relevance"]
    if top is not None:
        # Partial top lists first, so that no task holds a topic's whole vocabulary.
        order = [F.col("relevance").desc(), F.col("term").asc()]
        part = rel.withColumn("_part", F.pmod(F.col("idx"), F.lit(64)))
        first = Window.partitionBy("topic", "_part").orderBy(*order)
        part = part.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top)
        rel = part.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(
            F.col("rank") <= top)
        cols = ["rank", *cols]
    mass = counts.where("id >= 0").groupBy("topic").agg(F.sum("n").alias("m"))
    share = with_constants(mass, mass.agg(F.sum("m").alias("all"))).select(
        "topic", (F.col("m") / F.col("all")).alias("share"))
    return rel.join(F.broadcast(share), "topic").select((F.col("topic") + 1).alias("topic"), *cols, "share")


def prepare_texts(texts: DataFrame, order_cols: list[str], window: int = fixed.COHERENCE_WINDOW) -> DataFrame:
    """Member texts with their places: ``(doc_key, tokens, start, S)``.

    ``start`` is the number of tokens before the text in its document, in the
    order of ``order_cols``; ``S`` is the document's last window start.  The
    texts are range-partitioned by the order and written; offsets are sums
    per partition, added up over the few partitions that a document spans.
    """
    n = F.size("tokens")
    rows = stage(texts.orderBy("doc_key", *order_cols).select(
        "doc_key", "tokens", F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid")), "members")
    per = rows.groupBy("doc_key", "_pid").agg(F.sum(n).alias("_n"))
    w = Window.partitionBy("doc_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("doc_key", "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                        F.sum("_n").over(Window.partitionBy("doc_key")).alias("_total"))
    inside = Window.partitionBy("doc_key", "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(before, ["doc_key", "_pid"])
    out = stage(placed.select("doc_key", "tokens", (F.col("_before") + F.col("_in")).alias("start"),
                              F.greatest(F.col("_total") - window, F.lit(0)).alias("S")), "placed")
    unstage(rows)
    return out


def _words_and_pairs(topics: DataFrame) -> tuple[list[str], np.ndarray]:
    """The words of all topics, sorted, and the pairs (numbers i < j, one per row) that stand in a topic together."""
    sets: dict = {}
    for r in topics.select("topic", "term").where(F.col("term").isNotNull()).distinct().collect():   # topics x top words
        sets.setdefault(r[0], []).append(r[1])
    words = sorted({w for ws in sets.values() for w in ws})
    number = {w: i for i, w in enumerate(words)}
    pairs = sorted({p for ws in sets.values() for p in combinations(sorted(number[w] for w in ws), 2)})
    return words, np.array(pairs, dtype=np.int32).reshape(-1, 2)


def _block_bits(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block and, per word, a row of 64-bit pieces whose bits are the window starts it covers.

    The intervals ``a..b`` of a word come in order; those that meet are merged first.
    """
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (a[1:] > b[:-1] + 1)
    begins = np.flatnonzero(new)
    lo, hi = a[begins], np.maximum.reduceat(b, begins)
    present, row = np.unique(w[begins], return_inverse=True)
    width = (int(hi.max()) + 1) // 64 + 1
    bits = np.zeros((len(present), width), dtype=np.uint64)
    for turn in (lo, hi + 1):           # no two turns of a word are alike
        np.add.at(bits, (row, turn // 64), np.uint64(1) << (turn % 64).astype(np.uint64))
    for n in (1, 2, 4, 8, 16, 32):      # a bit becomes the parity of the turns up to it
        bits ^= bits << np.uint64(n)
    odd = np.bitwise_xor.accumulate(bits >> np.uint64(63), axis=1)
    bits[:, 1:] ^= np.uint64(0) - odd[:, :-1]
    return present, bits


def _tallies(pairs: np.ndarray, n_words: int):
    """Task of ``mapInArrow``: rows ``(doc_key, blk, w, a, b)`` in order to ``(i, j, c)``.

    ``c`` is the number of window starts of the task's blocks that words i and j
    both cover; i = j is the word itself.  A task holds one block at a time and
    a sum per word and pair.
    """
    def run(batches):
        single, both = np.zeros(n_words, dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)

        def add(pieces):
            present, bits = _block_bits(*(np.concatenate(c) for c in zip(*pieces)))
            single[present] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            row = np.full(n_words, -1)
            row[present] = np.arange(len(present))
            found = np.flatnonzero((row[pairs] >= 0).all(axis=1))
            for k in range(0, len(found), PAIRS_AT_ONCE):
                part = found[k:k + PAIRS_AT_ONCE]
                i, j = row[pairs[part]].T
                both[part] += np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)

        key, pieces = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, blks, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (blks[1:] != blks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(docs)]):
                if pieces and key != (docs[lo], blks[lo]):
                    add(pieces)
                    pieces = []
                key = docs[lo], blks[lo]
                pieces.append([c[lo:hi] for c in cols])
        if pieces:
            add(pieces)
        words, sums = np.flatnonzero(single), np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([words, pairs[sums, 0]]).astype(np.int32)),
             pa.array(np.concatenate([words, pairs[sums, 1]]).astype(np.int32)),
             pa.array(np.concatenate([single[words], both[sums]]))], ["i", "j", "c"])

    return run


def coherence_cv(topics: DataFrame, texts: DataFrame, window: int = fixed.COHERENCE_WINDOW,
                 eps: float = fixed.COHERENCE_EPS, block: int = BLOCK_WINDOWS) -> DataFrame:
    """c_v per topic: ``(topic, coherence)``.

    ``topics`` holds ``(topic, term)`` for the top words of each topic (a
    small table: topics x words); ``texts`` is the output of
    ``prepare_texts``.
    """
    # Written once: the steps below read the topics' words, and the words' shares, many times over.
    topics = stage(topics.select("topic", "term"), "topic_words")
    words, pairs = _words_and_pairs(topics)
    numbers = texts.sparkSession.createDataFrame(list(enumerate(words)), "w int, term string")
    n_windows = texts.groupBy("doc_key").agg(F.first("S").alias("S")).agg(F.sum(F.col("S") + 1).alias("N"))
    occ = texts.select("doc_key", "S", "start", F.posexplode("tokens").alias("pos", "term")).join(F.broadcast(numbers), "term")
    occ = occ.withColumn("pos", F.col("start") + F.col("pos"))
    occ = occ.select("doc_key", "w", F.greatest(F.col("pos") - (window - 1), F.lit(0)).alias("a"),
                     F.least(F.col("pos"), F.col("S")).alias("b"))
    occ = occ.select("doc_key", "w", "a", "b", F.explode(F.sequence(
        F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("blk"))
    first = F.col("blk") * block
    occ = occ.select("doc_key", "blk", "w", (F.greatest("a", first) - first).cast("int").alias("a"),
                     (F.least("b", first + (block - 1)) - first).cast("int").alias("b"))
    # A block is bounded, so dealing whole blocks by their key leaves no large group.
    dealt = occ.repartition("doc_key", "blk").sortWithinPartitions("doc_key", "blk", "w", "a", "b")
    tallies = stage(dealt.mapInArrow(_tallies(pairs, len(words)), "i int, j int, c long")
                         .groupBy("i", "j").agg(F.sum("c").alias("c")), "tallies")
    term = lambda n, name: F.broadcast(numbers.select(F.col("w").alias(n), F.col("term").alias(name)))
    tallies = tallies.join(term("i", "t1"), "i").join(term("j", "t2"), "j")
    single = tallies.where("i = j").select(F.col("t1").alias("term"), "c")
    pair = tallies.where("i < j").select("t1", "t2", F.col("c").alias("c12"))

    tw = topics.select("topic", "term")
    grid = (tw.alias("i").join(tw.alias("j"), "topic")
              .select("topic", F.col("i.term").alias("wi"), F.col("j.term").alias("wj")))
    sc = single.select(F.col("term").alias("wi"), F.col("c").alias("ci"))
    sc2 = single.select(F.col("term").alias("wj"), F.col("c").alias("cj"))
    pc = pair.select(F.col("t1").alias("wi"), F.col("t2").alias("wj"), "c12")
    pc = pc.unionByName(pc.select(F.col("wj").alias("wi"), F.col("wi").alias("wj"), "c12"))
    g = with_constants(grid.join(sc, "wi").join(sc2, "wj").join(pc, ["wi", "wj"], "left"), n_windows)
    c12 = F.when(F.col("wi") == F.col("wj"), F.col("ci")).otherwise(F.coalesce(F.col("c12"), F.lit(0)))
    p12 = c12 / F.col("N") + eps
    npmi = F.log(p12 / ((F.col("ci") / F.col("N")) * (F.col("cj") / F.col("N")))) / -F.log(p12)
    g = stage(g.select("topic", "wi", "wj", npmi.alias("npmi")), "npmi")
    vw = g.groupBy("topic", "wj").agg(F.sum("npmi").alias("vw"))        # context vector of the word set
    cw = g.join(vw, ["topic", "wj"]).groupBy("topic", "wi").agg(
        F.sum(F.col("npmi") * F.col("vw")).alias("dot"), F.sqrt(F.sum(F.col("npmi") ** 2)).alias("ni"))
    nw = vw.groupBy("topic").agg(F.sqrt(F.sum(F.col("vw") ** 2)).alias("nw"))
    cos = cw.join(nw, "topic").select("topic", (F.col("dot") / (F.col("ni") * F.col("nw"))).alias("cos"))
    return cos.groupBy("topic").agg(F.avg("cos").alias("coherence"))


def lda_sweep(vectors: DataFrame, ks, fit_fn, coherence_fn, parallelism: int = 4):
    """Fit one model per k; return ``(table, models)``.

    table: ``k, log_likelihood, log_perplexity, coherence, best`` where
    coherence is c_v averaged over the topics and ``best`` marks the k with
    the highest coherence.  The fits are independent Spark jobs and run from
    ``parallelism`` driver threads at once (as ``CrossValidator`` does), so
    small models do not leave the cluster idle.  ``fit_fn(k)`` gives the model,
    ``coherence_fn(k, model)`` its c_v per topic.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = vectors.sparkSession

    # Log-perplexity is -log-likelihood / corpus token count, so one number per
    # k gives both.
    tokens = vectors.agg(F.sum("length")).first()[0]

    def one(k):
        m = fit_fn(k)
        cv = coherence_fn(k, m).agg(F.avg("coherence")).first()[0]
        ll = float(m.trainingLogLikelihood() if m.isDistributed() else m.logLikelihood(vectors))
        return k, m, (int(k), ll, -ll / float(tokens), float(cv) if cv is not None else None)

    ks = list(ks)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(ks)))) as pool:
        done = list(pool.map(one, ks))
    models = {k: m for k, m, _ in done}
    rows = [r for _, _, r in done]
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("log_likelihood", T.DoubleType()),
                           T.StructField("log_perplexity", T.DoubleType()),
                           T.StructField("coherence", T.DoubleType())])
    table = spark.createDataFrame(rows, schema)     # one row per k: a handful of numbers
    best = table.agg(F.max_by("k", "coherence").alias("best_k"))
    table = with_constants(table, best).withColumn("best", F.col("k") == F.col("best_k")).drop("best_k")
    return table, models
