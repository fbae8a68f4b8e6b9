"""Steps whose work must not outgrow their input."""

import numpy as np

from pyspark.sql import functions as F

from tagflow.functions import text as tx
from tagflow.operators import clean, similarity, tokens, topics


def test_block_bits_match_brute_force():
    rng = np.random.default_rng(3)
    for size, window in ((1, 3), (64, 5), (200, 7), (1000, 110)):
        rows = sorted((int(w), max(int(p) - window + 1, 0), int(p))
                      for w, p in zip(rng.integers(0, 9, size), rng.permutation(size * 2)[:size]))
        present, bits = topics._block_bits(*np.array(rows).T)
        for word, row in zip(present, bits):
            covered = {x for w, a, b in rows if w == word for x in range(a, b + 1)}
            assert {x for x in range(64 * len(row)) if int(row[x // 64]) >> (x % 64) & 1} == covered


def test_coherence_counts_only_pairs_of_a_topic(spark):
    tw = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c"), (1, "d"), (2, "a"), (2, "b")], "topic int, term string")
    words, pairs = topics._words_and_pairs(tw)
    assert words == ["a", "b", "c", "d"] and pairs.tolist() == [[0, 1], [2, 3]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unit_rows_do_not_move_the_entries(spark):
    w = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 2.0)], "doc_id long, term string, raw double")
    unit = similarity.unit_rows(w, "doc_id", "raw")
    assert "hashpartitioning" not in plan_of(unit)
    assert sorted(map(tuple, unit.collect())) == [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 1.0)]


def test_ngrams_of_short_and_long_lists(spark):
    t = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["a", "b", "c"])], "id long, t array<string>")
    got = {r.id: r.g for r in t.select("id", similarity.ngrams(F.col("t"), 1, 3).alias("g")).collect()}
    assert got == {1: [], 2: ["a"], 3: ["a", "b", "c", "a b", "b c", "a b c"]}


def test_fused_pairs_keep_the_tokens_between_them(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [], None), (1, ["a"], None), (2, ["a", "b"], [0])]
    for n in range(3, 60):
        starts, i = [], int(rng.integers(0, 3))
        while i < n - 1:
            starts.append(i)
            i += int(rng.integers(2, 5))
        rows.append((n, [f"w{k}" for k in range(n)], starts or None))
    df = spark.createDataFrame(rows, "id int, t array<string>, s array<int>")
    for r in df.select("t", "s", tokens._fused(F.col("t"), F.col("s")).alias("got")).collect():
        want, i = [], 0
        while i < len(r.t):
            pair = i in (r.s or [])
            want.append("_".join(r.t[i:i + 2]) if pair else r.t[i])
            i += 2 if pair else 1
        assert r.got == want


def test_gaps_close_in_one_pass(spark):
    texts = ["a,1, b", " ,a", "a  b\t c", "a.b,c", "1", ",", "", " ", "a 1 2 b", "x　— y ", " a--", "a b", "12,34 a", ",,  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("old", tx.collapse_whitespace(
        tx.remove_digits(tx.punctuation_to_space(F.col("t"))))).withColumn("new", tx.gaps_to_space(tx.remove_digits(F.col("t"))))
    assert [r for r in df.collect() if r.old != r.new] == []


def test_has_words_agrees_with_the_count(spark):
    texts = ["", " ", "a", " a ", "a b", " a b", "a b ", "  a\tb  c ", "a b c", "a b c d e f", " a b c d", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(-1, 6):
        both = df.select(tx.has_words(F.col("t"), n).alias("a"), (tx.word_count(F.col("t")) >= n).alias("b")).collect()
        assert [r for r in both if r.a != r.b] == []


def test_first_rows_are_grouped_by_marks_of_texts(spark):
    rows = [(3, "x y", None), (1, "x y", None), (2, "x y", "t"), (5, None, "t"), (4, None, "t"), (6, "x", "y")]
    first = clean.dedup_first(spark.createDataFrame(rows, "id int, preprocessed string, hashtags string"))
    assert sorted(first.collect()) == [(1, "x y", None), (2, "x y", "t"), (4, None, "t"), (6, "x", "y")]
    assert "sha2" in plan_of(first)


def test_phrases_are_counted_by_one_key(spark, monkeypatch):
    """A pair is one string; words and pairs of short texts, nulls and odd gaps are counted as before."""
    written = {}
    monkeypatch.setattr(tokens, "stage", lambda df, name: written.setdefault(name, df))
    texts = ["Aa bb\tcc", "aa\u2003bb", "it's aa  bb", "", "aa", None, "aa\nbb cc_d \u00c9aa"]
    df = spark.createDataFrame([(t,) for t in texts], "preprocessed string")
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n_ab, r.score) for r in tokens.mine_bigrams(df, min_count=1, threshold=0.1).collect()}
    assert written["phrase_counts"].columns == ["w", "n"]
    counts = dict(map(tuple, written["phrase_counts"].collect()))
    assert counts == {"aa": 5, "bb": 4, "cc": 1, "its": 1, "cc_d": 1, "eaa": 1, "aa bb": 4, "bb cc": 1, "its aa": 1,
                      "bb cc_d": 1, "cc_d eaa": 1}
    assert got == {("aa", "bb"): (5, 4, 4, 3 / 20 * 11)}
