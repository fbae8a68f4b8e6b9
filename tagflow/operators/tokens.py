"""Tokens: lemmatised token lists and the bigram phrase model.

No part-of-speech tagger is available; word classes and lemmas come from a
lexicon table ``(form, pos, lemma)`` supplied by the caller.  Without one,
lemma = form and every class passes.  An ambiguous form takes its first class
in the fixed order NOUN, VERB, ADJ, ADV, PROPN, other (ties by lemma); a form
that the lexicon lacks counts as a noun that is its own lemma.  Token lists
lemmatise the first four classes and leave other words as they are; phrase
lists keep the first five classes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.stopwords import default_stopwords
from ..plans.joins import lookup_join, with_constants
from ..session import stage

POS_ORDER = {"NOUN": 0, "VERB": 1, "ADJ": 2, "ADV": 3, "PROPN": 4}
OTHER = 9


def keep_token(t, stopwords) -> "F.Column":
    """Token filter: not punctuation, longer than two letters, not a stop word.

    ``isin`` over a long literal list is rewritten by the optimizer to a
    hash-set lookup, also inside the lambda.
    """
    return ((F.length(t) >= fixed.MIN_TOKEN_LEN)
            & ~F.lit(fixed.TOKEN_PUNCTUATION).contains(t)
            & ~t.isin(list(stopwords)))


def _lexicon(lexicon: DataFrame) -> DataFrame:
    """``(form, rank, lemma)``: the first class of each form."""
    rank = F.coalesce(*[F.when(F.col("pos") == k, F.lit(v)) for k, v in POS_ORDER.items()], F.lit(OTHER))
    first = lexicon.groupBy("form").agg(F.min(F.struct(rank.alias("rank"), "lemma")).alias("x"))
    return first.select("form", "x.rank", "x.lemma")


def _look_up(lists: DataFrame, col: str, lexicon: DataFrame, id_col: str, keep, lexicon_rows: int | None) -> DataFrame:
    """``(id, col)`` with each token replaced; ``keep(form, rank, lemma)`` gives the new token or null.

    Tokens move as (id, position, token) rows only, and the lexicon is
    broadcast where its size is known to be small.  A row's tokens are
    regrouped, which its own text bounds.
    """
    ex = lists.select(id_col, F.posexplode(col).alias("_pos", "form"))
    looked = lookup_join(ex, _lexicon(lexicon), "form", "left", small_rows=lexicon_rows)
    looked = looked.withColumn("_new", keep(F.col("form"), F.coalesce("rank", F.lit(0)), F.coalesce("lemma", "form")))
    grouped = looked.where(F.col("_new").isNotNull()).groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_new"))), lambda s: s["_new"]).alias("_list"))
    return lists.select(id_col).join(grouped, id_col, "left").select(
        id_col, F.coalesce("_list", F.array().cast("array<string>")).alias(col))


def tokenize_lemma(df: DataFrame, col: str = "preprocessed", out: str = "tokenized",
                   stopwords=None, lexicon: DataFrame | None = None,
                   lexicon_rows: int | None = None, id_col: str = "id") -> DataFrame:
    """Split on blanks, lemmatise through the lexicon, drop short/stop tokens.

    Stop words are removed after lemmatisation, so inflected forms of stop
    words go too.  Without a lexicon this is a pure projection (no shuffle).
    """
    sw = default_stopwords() if stopwords is None else tuple(stopwords)
    words = tx.split_words(F.col(col))
    if lexicon is None:
        return df.withColumn(out, F.filter(words, lambda t: keep_token(t, sw)))

    def keep(form, rank, lemma):
        token = F.when(rank < POS_ORDER["PROPN"], lemma).otherwise(form)
        return F.when(keep_token(token, sw), token)

    lists = df.select(id_col, words.alias(out))
    return df.join(_look_up(lists, out, lexicon, id_col, keep, lexicon_rows), id_col)


# ---- phrase (bigram) model --------------------------------------------------
# Phrase tokens: lower-case, accents stripped, maximal runs of word characters
# that are not decimal digits, 2..15 characters, not starting with '_'.
PHRASE_TOKEN_RE = r"[\p{L}\p{Nl}\p{No}_]+"


def phrase_tokens(c) -> "F.Column":
    """Tokens of the phrase model for a text column (apostrophes removed first; gaps of any kind end a token)."""
    low = F.lower(F.replace(c, F.lit("'"), F.lit("")))
    t = F.when(tx.is_ascii(c), low).otherwise(tx.deaccent(low))      # an ASCII text has no accents
    toks = F.regexp_extract_all(t, F.lit(PHRASE_TOKEN_RE), 0)
    return F.filter(toks, lambda w: (F.length(w) >= fixed.PHRASE_TOKEN_MIN)
                    & (F.length(w) <= fixed.PHRASE_TOKEN_MAX) & ~w.startswith("_"))


def _adjacent(toks):
    """Array of (a, b) structs for adjacent tokens."""
    n = F.size(toks)
    return F.when(n >= 2, F.arrays_zip(F.slice(toks, 1, n - 1).alias("a"), F.slice(toks, 2, n - 1).alias("b"))) \
            .otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def mine_bigrams(texts: DataFrame, col: str = "preprocessed", min_count: int = fixed.PHRASE_MIN_COUNT,
                 threshold: float = fixed.PHRASE_THRESHOLD) -> DataFrame:
    """Learned phrases ``(a, b, n_a, n_b, n_ab, score)`` with score > threshold.

    score = (n_ab - min_count) * V / (n_a * n_b), V = distinct words plus
    distinct adjacent pairs.  Words and pairs are counted in one pass over the
    texts by one aggregate with map-side combining, which is written once; V
    is its number of rows.  A pair is counted as one string, its words joined
    by a blank, which no word holds.
    """
    toks = texts.select(phrase_tokens(F.col(col)).alias("t"))
    n = F.size("t")
    pairs = F.when(n >= 2, F.zip_with(F.slice("t", F.lit(1), n - 1), F.slice("t", F.lit(2), n - 1),
                                      lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    counts = stage(toks.select(F.explode(F.concat("t", pairs)).alias("w"))
                       .groupBy("w").agg(F.count(F.lit(1)).alias("n")), "phrase_counts")
    vsize = counts.agg(F.count(F.lit(1)).alias("V"))
    pair = F.col("w").contains(" ")
    uni = counts.where(~pair).select(F.col("w").alias("a"), "n")
    bi = counts.where(pair).select(F.substring_index("w", " ", 1).alias("a"), F.substring_index("w", " ", -1).alias("b"), "n")
    ua = uni.select("a", F.col("n").alias("n_a"))
    ub = uni.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    often = bi.where(F.col("n") > min_count).select("a", "b", F.col("n").alias("n_ab"))
    scored = (with_constants(often.join(ua, "a").join(ub, "b"), vsize)
                .withColumn("score", (F.col("n_ab") - min_count) / (F.col("n_a") * F.col("n_b")) * F.col("V")))
    return scored.where(F.col("score") > threshold).select("a", "b", "n_a", "n_b", "n_ab", "score")


def _fused(t, starts):
    """Tokens ``t`` with the pairs that begin at ``starts`` (from 0, in order, no two overlap; null: none) fused.

    Each pair takes along the tokens between the pair before it and itself, so
    the work is linear in the tokens.
    """
    def upto(i, k):
        begin = F.when(k > 0, F.get(starts, k - 1) + 2).otherwise(0)
        pair = F.concat(F.get(t, i), F.lit("_"), F.get(t, i + 1))
        return F.concat(F.slice(t, begin + 1, i - begin), F.array(pair))

    rest = F.slice(t, F.element_at(starts, -1) + 3, F.size(t))
    return F.when(F.size(starts) > 0, F.concat(F.flatten(F.transform(starts, upto)), rest)).otherwise(
        F.coalesce(t, F.array().cast("array<string>")))


def apply_bigrams(df: DataFrame, phrases: DataFrame, col: str = "preprocessed", out: str = "spacy_lemmatized",
                  stopwords=None, id_col: str = "id", lexicon: DataFrame | None = None,
                  phrase_rows: int | None = None, lexicon_rows: int | None = None) -> DataFrame:
    """``(id, out)``: learned phrases fused (``a_b``) greedily left to right, after stop words.

    Stop words (the list plus 're') are removed first; a pair that is a
    phrase is fused and the scan resumes after it.  In a run of consecutive
    phrase positions the fused ones are every other position from the run's
    start, so the greedy scan reduces to a parity test computed with window
    functions over the (few) phrase hits.  With a lexicon, tokens of other
    than five word classes go and the rest become lemmas; lemmas of two
    letters or fewer are dropped at the end.  Only ids and token arrays move.
    """
    sw = list(default_stopwords() if stopwords is None else stopwords) + list(fixed.PHRASE_EXTRA_STOPWORDS)
    base = df.select(id_col, F.filter(phrase_tokens(F.col(col)), lambda w: ~w.isin(sw)).alias("_t"))
    pairs = base.select(id_col, F.posexplode(_adjacent(F.col("_t"))).alias("i", "p")) \
                .select(id_col, "i", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    # With a measured phrase count under the bound, the phrase table is
    # broadcast and the adjacent pairs are matched map-side (no shuffle of
    # one row per token); otherwise a shuffled semi-join.
    hits = lookup_join(pairs, phrases.select("a", "b"), ["a", "b"], "left_semi", phrase_rows) \
        .select(id_col, "i")
    run = hits.withColumn("_g", F.col("i") - F.row_number().over(Window.partitionBy(id_col).orderBy("i")))
    run = run.withColumn("_k", F.col("i") - F.min("i").over(Window.partitionBy(id_col, "_g")))
    started = (run.where(F.col("_k") % 2 == 0).groupBy(id_col)
                  .agg(F.array_sort(F.collect_list("i")).alias("_s")))     # bounded by the row's own length
    lists = base.join(started, id_col, "left").select(id_col, _fused(F.col("_t"), F.col("_s")).alias(out))
    if lexicon is None:
        return lists.select(id_col, F.filter(out, lambda w: F.length(w) >= fixed.MIN_TOKEN_LEN).alias(out))

    def keep(form, rank, lemma):
        return F.when((rank < OTHER) & (F.length(lemma) >= fixed.MIN_TOKEN_LEN), lemma)

    return _look_up(lists, out, lexicon, id_col, keep, lexicon_rows)
