"""Word vectors against dense linear algebra, the neighbour search against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tagflow.operators import embeddings as E
from tagflow.operators import similarity


def texts(seed=2, groups=4, words=12, n=120):
    """Words of a group stand together, so words of a group are alike."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g = r.randrange(groups)
        out.append([f"g{g}w{r.randrange(words):02}" if r.random() < 0.9 else f"x{r.randrange(30):02}" for _ in range(r.randint(0, 25))])
    return out + [None, ["once"], [], ["g0w00"] * 4]


def plain_counts(ts, window, least):
    have = Counter(w for t in ts for w in t or [])
    n = Counter()
    for t in ts:
        for i, x in enumerate(t or []):
            for y in t[i + 1:i + 1 + window]:
                if x != y and have[x] >= least and have[y] >= least:
                    n[min(x, y), max(x, y)] += 1
    return n


def plain_ppmi(n):
    each, total = Counter(), 2 * sum(n.values())
    for (a, b), c in n.items():
        each[a] += c
        each[b] += c
    x = {p: math.log(c * total / (each[p[0]] * each[p[1]])) for p, c in n.items()}
    return {p: v for p, v in x.items() if v > 0}


@pytest.fixture(scope="module")
def made(spark):
    ts = texts()
    df = spark.createDataFrame([(t,) for t in ts], "tokens array<string>").repartition(3)
    counts = E.cooccurrences(df, window=4, min_count=3)
    return ts, counts, E.ppmi(counts)


def test_counts_and_ppmi(made):
    ts, counts, pmi = made
    want = plain_counts(ts, 4, 3)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(want)
    got = {(r.a, r.b): r.x for r in pmi.collect()}
    assert got.keys() == plain_ppmi(want).keys()
    assert all(abs(got[p] - x) < 1e-9 for p, x in plain_ppmi(want).items())


def test_vectors_are_the_leading_eigenvectors(made):
    ts, _, pmi = made
    x = plain_ppmi(plain_counts(ts, 4, 3))
    words = sorted({w for p in x for w in p})
    m = np.zeros((len(words), len(words)))
    for (a, b), v in x.items():
        m[words.index(a), words.index(b)] = m[words.index(b), words.index(a)] = v
    value, vector = np.linalg.eigh(m)
    for rank, rounds, near in ((4, 6, 0.02), (8, 3, None)):
        top = np.argsort(-value)[:rank]
        best = (vector[:, top] * value[top]) @ vector[:, top].T
        got = {r.word: r.v for r in E.word_vectors(pmi, rank=rank, rounds=rounds).collect()}
        assert sorted(got) == words
        e = np.array([got[w] for w in words])
        assert e.shape[1] == rank
        # the four groups give four eigenvalues that stand apart; behind them the spectrum is flat, so that the
        # vectors of rank 8 are not unique in practice, but they lose hardly more than the best ones
        assert near is None or np.linalg.norm(e @ e.T - best) < near * np.linalg.norm(best)
        assert np.linalg.norm(m - e @ e.T) < 1.03 * np.linalg.norm(m - best)


def test_search_finds_what_all_pairs_find(made, spark):
    vectors = E.word_vectors(made[2], rank=8)
    for threshold in (0.7, 0.9):
        exact = {(r.t1, r.t2): r.s for r in E.exact_alike_words(vectors, threshold).collect()}
        found = {(r.t1, r.t2): r.s for r in E.alike_words(vectors, threshold).collect()}
        assert len(exact) > 20 and found.keys() <= exact.keys() and len(found) >= 0.9 * len(exact)
        assert all(abs(found[p] - exact[p]) < 1e-9 for p in found)
    groups = [(a[:2] == b[:2]) for a, b in exact if a[0] == b[0] == "g"]
    assert sum(groups) > 0.9 * len(groups)
    # soft cosine takes the table
    vecs = spark.createDataFrame([(1, "g0w01", 1.0), (2, "g0w02", 1.0), (3, "g1w01", 1.0)], "doc_id long, term string, weight double")
    s = E.both_ways(E.exact_alike_words(vectors, 0.7))
    pairs = {(r.Source, r.Target): r.Weight for r in similarity.soft_cosine_pairs(vecs, s, 0.6).collect()}
    near = E.scored(spark.createDataFrame([("g0w01", "g0w02")], "t1 string, t2 string"), E.unit(vectors)).first().s
    assert (near < 0.7 or abs(pairs[2, 1] - near) < 1e-9) and (3, 1) not in pairs


def test_plan_of_the_search():
    for words in (1, 1000, 10 ** 6, 10 ** 9):
        bits, tables = E.search_plan(words, 0.8)
        same = (1 - math.acos(0.8) / math.pi) ** bits
        assert 1 - (1 - same) ** tables >= E.RECALL and words / 2 ** bits <= E.PER_SIGNATURE
    with pytest.raises(ValueError):
        E.alike_words(None, 1.5)


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None,), ([],), (["a"],)], "tokens array<string>")
    pmi = E.ppmi(E.cooccurrences(df, min_count=1))
    vectors = E.word_vectors(pmi)
    assert pmi.count() == 0 and vectors.count() == 0 and E.alike_words(vectors, 0.8).count() == 0


def test_cooccurrences_are_counted_by_code(spark, monkeypatch):
    """Null words, words that differ in letters only Unicode knows, and words that share a code."""
    ts = [["b", None, "a", "b"], ["\u00e4", "a", "\u00e4"], ["a", "b"], ["\u00e4", "a"], ["b", "A"], [None, None]]
    df = spark.createDataFrame([(t,) for t in ts], "tokens array<string>").repartition(2)
    want = {("a", "b"): 3, ("a", "\u00e4"): 3}

    def got():
        return {(r.a, r.b): r.n for r in E.cooccurrences(df, window=2, min_count=2).collect()}

    plan = E.cooccurrences(df, window=2, min_count=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    assert got() == want
    monkeypatch.setattr(E, "code", lambda w: E.F.length(w).cast("long"))     # every word clashes
    assert got() == want


def test_vectors_and_pmi_of_blocks_are_those_of_rows(made, spark, monkeypatch):
    """Pairs counted in numbered blocks, and as rows where the words are too many to be broadcast."""
    ts, _, pmi = made
    df = spark.createDataFrame([(t,) for t in ts], "tokens array<string>").repartition(3)
    pairs = E.word_pairs(df, window=4, min_count=3).staged()
    assert pairs.rows is None and pairs.blocks.count() > 1
    want = {(r.a, r.b): (r.n, round(r.x, 9)) for r in pmi.collect()}
    assert {(r.a, r.b): (r.n, round(r.x, 9)) for r in pairs.pmi().collect()} == want

    def near(vectors):
        v = {r.word: np.array(r.v) for r in vectors.collect()}
        return sorted(v), np.array([v[w] @ v[x] for w in sorted(v) for x in sorted(v)])

    words, products = near(E.word_vectors(pmi, rank=4, rounds=6))
    got = near(pairs.vectors(rank=4, rounds=6))
    assert got[0] == words and np.allclose(got[1], products, atol=1e-6)
    monkeypatch.setattr(E, "MAX_BROADCAST_ROWS", 3)
    many = E.word_pairs(df, window=4, min_count=3)
    assert many.blocks is None
    assert {(r.a, r.b): (r.n, round(r.x, 9)) for r in many.staged().pmi().collect()} == want


def test_alike_words_need_no_shuffle_of_candidates(spark, monkeypatch):
    """Packs of words: every pair is met once, whatever the packs, and only pairs that share a signature are kept."""
    r = np.random.default_rng(3)
    rows = [(f"w{i:03}", [float(x) for x in r.standard_normal(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "word string, v array<double>")
    exact = {(x.t1, x.t2): x.s for x in E.exact_alike_words(df, 0.9).collect()}
    for size in (4096, 16):
        monkeypatch.setattr(E, "PACK_WORDS", size)
        out = E.alike_words(df, 0.9, recall=0.999999)
        found = [(x.t1, x.t2, x.s) for x in out.collect()]
        assert len(found) == len({f[:2] for f in found}) and {f[:2] for f in found} == exact.keys()
        assert all(abs(s - exact[a, b]) < 1e-12 for a, b, s in found)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
