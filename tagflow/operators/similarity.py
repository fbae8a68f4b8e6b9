"""TF-IDF, cosine and soft-cosine similarity of documents, similarity edges.

Vectors are long sparse tables ``(doc_id, term, weight)``.

TF-IDF follows the vectorizer the reference configures: tokens by a token
pattern (no lower-casing), stop words removed before n-grams, tf = 1 +
ln(count), idf = ln((1 + N) / (1 + df)) + 1, rows scaled to unit length;
terms with df above ``max_df`` (a share of N when a float, a count when an
int) are dropped, then the ``max_features`` most frequent terms are kept
(ties by term).  MLlib's IDF omits the ``+ 1`` and is not used.

Cosine pairs are exact: the vectors are written once in packs, and every pair
of packs meets in one task that multiplies them (``packs``).  No candidate, no
entry and no product passes through a shuffle, so disk grows with the entries
only.  ``candidate_report`` counts what prefix filtering (Bayardo, Ma, Srikant,
"Scaling up all pairs similarity search", WWW 2007) would leave: with terms in
one global order (rarest first), a unit vector only needs to index the prefix of
its terms up to the point where the rest has norm < t; two vectors with cosine
>= t always share an indexed term (Cauchy-Schwarz on the un-indexed rest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import default_stopwords
from ..plans.joins import lookup_join, with_constants
from ..session import stage, unstage
from . import packs

# The vectorizer's default token pattern `\b\w\w+\b` matches maximal runs of
# two or more word characters; spelled without \b (whose meaning differs
# between regex engines).
DEFAULT_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def ngrams(tokens, lo: int, hi: int):
    """All n-grams for n in [lo, hi], joined by a blank, in order."""
    grams = []
    for n in range(lo, hi + 1):
        if n == 1:
            grams.append(tokens)
            continue
        k = F.size(tokens) - n + 1
        g = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
                        lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))
        grams.append(F.when(k >= 1, g).otherwise(F.array().cast("array<string>")))
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def term_counts(segments: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
                token_pattern: str = DEFAULT_TOKEN_PATTERN, ngram_range=(1, 1),
                stopwords=None) -> DataFrame:
    """``(doc_id, term, tf)`` raw counts; a document may span many segment rows.

    n-grams are formed inside a segment; the partial aggregation of the
    ``groupBy`` keeps a hot document from landing whole in one task.
    """
    sw = list(default_stopwords() if stopwords is None else stopwords)
    toks = F.regexp_extract_all(F.col(text_col), F.lit(token_pattern), 0)
    rows = segments.select(F.col(doc_col).alias("doc_id"), F.filter(toks, lambda t: ~t.isin(sw)).alias("_toks"))
    if ngram_range != (1, 1):
        # A column of its own: the n-gram lambdas would work the tokens out anew for each position.
        rows = stage(rows, "tokens")
    return (rows.select("doc_id", F.explode(ngrams(F.col("_toks"), *ngram_range)).alias("term"))
                    .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(tf: DataFrame, n_docs: DataFrame, max_df=1.0, max_features: int | None = None) -> DataFrame:
    """``(term, df, ctf, idf)`` after the max_df and max_features cuts.

    ``n_docs`` is a one-row DataFrame ``(n_docs)``; it is cross-joined as a
    constant (one row by construction).
    """
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    stats = with_constants(stats, n_docs)
    limit = F.lit(max_df) if isinstance(max_df, int) and not isinstance(max_df, bool) \
        else F.lit(float(max_df)) * F.col("n_docs")
    stats = stats.where(F.col("df") <= limit)
    if max_features is not None:
        stats = stats.orderBy(F.col("ctf").desc(), F.col("term").asc()).limit(int(max_features))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return stats.select("term", "df", "ctf", idf.alias("idf"))


def tfidf(segments: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
          token_pattern: str = DEFAULT_TOKEN_PATTERN, ngram_range=(1, 1), max_df=1.0,
          max_features: int | None = None, stopwords=None) -> tuple[DataFrame, DataFrame]:
    """Return ``(weights (doc_id, term, weight), vocabulary)``, both written; weights are unit rows."""
    # The raw counts feed both the vocabulary and the weights: written once.
    tf = stage(term_counts(segments, text_col, doc_col, token_pattern, ngram_range, stopwords))
    n_docs = segments.agg(F.countDistinct(doc_col).alias("n_docs"))
    vocab = stage(vocabulary(tf, n_docs, max_df, max_features))
    v = vocab.select("term", "idf")
    w = lookup_join(tf, v, "term", "inner", vocab.count()).select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    # The raw weights feed both the norms and the unit rows: written once, so the terms meet their idf once.
    raw = stage(w, "raw_weights")
    unstage(tf)
    unit = stage(unit_rows(raw, "doc_id", "raw"), "tfidf")
    unstage(raw)
    return unit, vocab


def unit_rows(w: DataFrame, key: str, val: str) -> DataFrame:
    """Scale each ``key`` group to unit L2 length: ``(key, term, weight)``.

    The norm is a partially aggregated group-by joined back on the key, not a
    window that would hold a whole group in one task.  The norms are written;
    where they are few they go to the entries, which then do not move (else AQE
    may split a hot key on the big side).
    """
    norms = stage(w.groupBy(key).agg(F.sqrt(F.sum(F.col(val) * F.col(val))).alias("_norm")), "norms")
    return lookup_join(w, norms, key, "inner", norms.count()).select(
        key, "term", (F.col(val) / F.col("_norm")).alias("weight"))


def _split_prefix(vecs: DataFrame, doc_freq: DataFrame, bound: float) -> DataFrame:
    """``vecs`` plus ``in_prefix``: the entry lies in its vector's prefix for ``bound``.

    Terms are ordered rarest first (df asc, term asc); an entry is in the
    prefix while the norm of the entries from it to the end is >= bound.
    The running sum is a window over one vector's own entries.
    """
    ordered = vecs.join(doc_freq.select("term", "df"), "term")
    w = (Window.partitionBy("doc_id").orderBy(F.col("df").desc(), F.col("term").desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = ordered.withColumn("_suffix_sq", F.sum(F.col("weight") * F.col("weight")).over(w))
    # A slightly longer prefix only adds candidates; the dot products stay exact.
    return s.select("doc_id", "term", "weight",
                    (F.col("_suffix_sq") >= bound * bound * (1 - 1e-9)).alias("in_prefix"))


POSTING_BLOCK = 2048     # entries of one term that meet in one task


def _shared_prefix(pu: DataFrame, pv: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """Join of prefix postings on the term, frequent terms split into blocks.

    A term with n indexed entries on the right is dealt into n / block parts;
    its left entries go to each part.  So no task holds a whole frequent
    posting list, and nearly all terms have one part.
    """
    parts = pv.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    left = pu.join(parts, "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = left.select("d1", "term", "w1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = pv.join(parts, "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    right = right.select("d2", "term", "w2", F.pmod(F.xxhash64("d2"), F.col("parts")).cast("int").alias("part"))
    return left.join(right, ["term", "part"]).where(F.col("d1") > F.col("d2"))


def candidate_report(vecs: DataFrame, threshold: float, doc_freq: DataFrame | None = None) -> DataFrame:
    """What prefix filtering leaves of the cosine pair search at a threshold: one row of counts.

    ``term_join_rows`` is what joining all postings would emit, ``joined_rows``
    what the prefix join emits, ``candidates`` its distinct pairs, ``results``
    the pairs at the threshold.  The prefix join is counted by the products of
    its entries, taken as ones: none of its rows is written.
    """
    if doc_freq is None:
        doc_freq = vecs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    prefix = _split_prefix(vecs, doc_freq, threshold).where("in_prefix").withColumn("weight", F.lit(1.0))
    seed = packs.term_seed(doc_freq)
    cand = packs.pair_counts(packs.packed(prefix, seed))
    n = F.col("n")
    full = vecs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("term_join_rows"))
    found = cosine_pairs(vecs, threshold, doc_freq).agg(F.count(F.lit(1)).alias("results"))
    return with_constants(with_constants(full, cand), found)


def _pair_search(u: DataFrame, v: DataFrame, threshold: float, doc_freq: DataFrame) -> DataFrame:
    """Exact ``(Source, Target, Weight)`` = u[Source] . v[Target] >= threshold, Source > Target.

    ``doc_freq`` lists the terms, each once.
    """
    seed = packs.term_seed(doc_freq)
    pu = packs.packed(u, seed)
    if u is v:
        pairs = packs.pairs_from(pu, pu, threshold)
        return pairs.select(F.greatest("d1", "d2").alias("Source"), F.least("d1", "d2").alias("Target"), "Weight")
    pairs = packs.pairs_from(pu, packs.packed(v, seed), threshold).where(F.col("d1") > F.col("d2"))
    return pairs.select(F.col("d1").alias("Source"), F.col("d2").alias("Target"), "Weight")


def cosine_pairs(vecs: DataFrame, threshold: float, doc_freq: DataFrame | None = None) -> DataFrame:
    """``(Source, Target, Weight)``: Source > Target, cosine >= threshold (> 0).

    ``vecs`` must hold unit rows.  ``doc_freq`` (term, df) lists their terms;
    it is computed from ``vecs`` when not supplied.
    """
    if threshold <= 0:
        raise ValueError("threshold must be > 0: pairs with similarity 0 are not enumerated")
    if doc_freq is None:
        doc_freq = vecs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _pair_search(vecs, vecs, threshold, doc_freq)


def term_similarity(vecs: DataFrame, threshold: float) -> DataFrame:
    """Term-term similarity ``(t1, t2, s)``, both directions, s = cosine of the
    terms' document columns, kept when s >= threshold.  Computed with the
    same exact pair search on the transposed table."""
    cols = vecs.select(F.col("term").alias("doc_id"), F.col("doc_id").cast("string").alias("term"),
                       F.col("weight").alias("w"))
    unit = unit_rows(cols, "doc_id", "w")
    p = cosine_pairs(unit, threshold)
    one = p.select(F.col("Source").alias("t1"), F.col("Target").alias("t2"), F.col("Weight").alias("s"))
    return one.unionByName(one.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "s"))


def merge_alike_terms(vecs: DataFrame) -> DataFrame:
    """``vecs`` with one term (the smallest) for all terms of equal unit document columns, weights summed.

    Such terms are fully similar and equally similar to any other, so soft
    cosine over the merged terms is that over all terms; terms of one document
    only, all alike in it, need no pairs.  Equal columns are told by their
    length and two independent 64-bit signatures of their entries.
    """
    unit = unit_rows(vecs.select("term", F.col("doc_id").alias("_doc"), F.col("weight").alias("_w"))
                         .select(F.col("term").alias("doc_id"), F.col("_doc").alias("term"), "_w"), "doc_id", "_w")
    entry = [F.col("term"), F.round("weight", 9)]
    marks = unit.groupBy(F.col("doc_id").alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*entry)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), *entry)).alias("h2"))
    marks = stage(marks, "columns")
    first = marks.groupBy("n", "h1", "h2").agg(F.min("term").alias("class"))
    to = marks.join(first, ["n", "h1", "h2"]).select("term", "class")
    return stage(vecs.join(to, "term").groupBy("doc_id", F.col("class").alias("term"))
                     .agg(F.sum("weight").alias("weight")), "alike")


def soft_cosine_pairs(vecs: DataFrame, term_sim: DataFrame, threshold: float) -> DataFrame:
    """Soft cosine x.S.y / sqrt(x.S.x * y.S.y) with S = identity + ``term_sim``.

    ``term_sim`` holds the off-diagonal entries ``(t1, t2, s)`` in both
    directions.  With u = x / |x|_S and v = S.y / |y|_S the score is u.v, so
    the exact pair search of ``cosine_pairs`` carries over.
    """
    if threshold <= 0:
        raise ValueError("threshold must be > 0: pairs with similarity 0 are not enumerated")
    y = vecs.select(F.col("doc_id"), F.col("term").alias("t2"), F.col("weight").alias("w"))
    spread = (y.join(term_sim, "t2").select("doc_id", F.col("t1").alias("term"),
                                            (F.col("s") * F.col("w")).alias("v")))
    sy = (spread.unionByName(vecs.select("doc_id", "term", F.col("weight").alias("v")))
                .groupBy("doc_id", "term").agg(F.sum("v").alias("v")))
    self_dot = (vecs.join(sy, ["doc_id", "term"]).groupBy("doc_id")
                    .agg(F.sqrt(F.sum(F.col("weight") * F.col("v"))).alias("sn")))
    u = stage(vecs.join(self_dot, "doc_id").select("doc_id", "term", (F.col("weight") / F.col("sn")).alias("weight")))
    v = stage(sy.join(self_dot, "doc_id").select("doc_id", "term", (F.col("v") / F.col("sn")).alias("weight")))
    return _pair_search(u, v, threshold, v.select("term").distinct())


def similarity_edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or above the threshold as undirected graph edges."""
    return (pairs.where(F.col("Weight") >= threshold)
                 .select("Source", "Target", "Weight", F.lit("Undirected").alias("Type")))


def check_pairs(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Self-check of a similarity edge table against the N(N-1)/2 pair space."""
    return edges.agg(
        F.lit(n_nodes).cast("long").alias("n_nodes"),
        F.lit(n_nodes * (n_nodes - 1) // 2).cast("long").alias("max_pairs"),
        F.count(F.lit(1)).alias("edge_rows"),
        F.count_if(F.col("Source") <= F.col("Target")).alias("misordered"),
        F.count_if(F.col("Weight") > 1 + 1e-9).alias("above_one"),
    ).withColumn("ok", (F.col("edge_rows") <= F.col("max_pairs")) & (F.col("misordered") == 0)
                 & (F.col("above_one") == 0))
