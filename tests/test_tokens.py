"""Phrase model: mining and greedy fusion against plain-Python brute force."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tagflow.operators import tokens as tk

WORDS = ["aa", "bb", "cc", "dd", "eee", "ff"]


def py_greedy(toks, phrases):
    out, i = [], 0
    while i < len(toks):
        if i + 1 < len(toks) and (toks[i], toks[i + 1]) in phrases:
            out.append(toks[i] + "_" + toks[i + 1])
            i += 2
        else:
            out.append(toks[i])
            i += 1
    return [w for w in out if len(w) >= 3]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=14), min_size=1, max_size=6),
       st.sets(st.tuples(st.sampled_from(WORDS), st.sampled_from(WORDS)), max_size=8))
def test_apply_bigrams_is_greedy(spark, docs, phrases):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, preprocessed string")
    ph = spark.createDataFrame(list(phrases) or [("zz", "zz")], "a string, b string")
    got = {r.id: list(r.spacy_lemmatized) for r in tk.apply_bigrams(df, ph, stopwords=[]).collect()}
    assert got == {i: py_greedy(d, phrases) for i, d in enumerate(docs)}


def test_mine_bigrams_scores(spark):
    rnd = random.Random(4)
    docs = [[rnd.choice(WORDS[:4]) for _ in range(rnd.randint(2, 30))] for _ in range(40)]
    uni = Counter(w for d in docs for w in d)
    bi = Counter((a, b) for d in docs for a, b in zip(d, d[1:]))
    v = len(uni) + len(bi)
    exp = {}
    for (a, b), n in bi.items():
        s = (n - 5) / (uni[a] * uni[b]) * v
        if s > 0.05:
            exp[(a, b)] = s
    df = spark.createDataFrame([(" ".join(d),) for d in docs], "preprocessed string")
    got = {(r.a, r.b): r.score for r in tk.mine_bigrams(df, threshold=0.05).collect()}
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-12


LEXICON = [("cats", "NOUN", "cat"), ("ran", "VERB", "run"), ("ran", "OTHER", "aaa"), ("they", "PRON", "qk"),
           ("oslo", "PROPN", "oslox"), ("axe", "NOUN", "ax"), ("aa_bbb", "PRON", "zzz")]


def test_token_lists_with_a_lexicon(spark):
    lex = spark.createDataFrame(LEXICON, "form string, pos string, lemma string")
    df = spark.createDataFrame([(1, "cats ran they oslo axe the house"), (2, "")], "id long, preprocessed string")
    got = {r.id: list(r.tokenized) for r in tk.tokenize_lemma(df, stopwords=["the"], lexicon=lex).collect()}
    # Pronouns and proper nouns stay as they are; "ax" is too short.
    assert got == {1: ["cat", "run", "they", "oslo", "house"], 2: []}
    got = {r.id: list(r.tokenized) for r in tk.tokenize_lemma(df, stopwords=["run"], lexicon=lex, lexicon_rows=7).collect()}
    assert got[1] == ["cat", "they", "oslo", "the", "house"]


def test_phrase_lists_with_a_lexicon(spark):
    lex = spark.createDataFrame(LEXICON, "form string, pos string, lemma string")
    df = spark.createDataFrame([(1, "cats they ran oslo axe aa bbb house"), (2, "they")], "id long, preprocessed string")
    ph = spark.createDataFrame([("aa", "bbb")], "a string, b string")
    got = {r.id: list(r.spacy_lemmatized) for r in tk.apply_bigrams(df, ph, stopwords=[], lexicon=lex).collect()}
    # Pronouns go (the fused one too), lemmas of two letters go.
    assert got == {1: ["cat", "run", "oslox", "house"], 2: []}


def test_accents_of_all_scripts_are_stripped(spark):
    from tagflow.functions import text as tx

    df = spark.createDataFrame([("\u05e9\u05bc\u05dc \u0643\u064e \u0915\u0941 \u00e9\u1ebf\u0451",)], "t string")
    assert df.select(tx.deaccent(df.t)).first()[0] == "\u05e9\u05dc \u0643 \u0915 ee\u0435"
