"""TF-IDF and (soft) cosine pairs against brute force on small fixtures."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tagflow.operators import similarity as sim


def _random_docs(seed, n_docs=25, vocab=30, max_len=12):
    rnd = random.Random(seed)
    words = [f"w{i:02d}" for i in range(vocab)]
    docs = []
    for d in range(n_docs):
        for s in range(rnd.randint(1, 3)):
            docs.append((d, ", ".join(rnd.choice(words[: rnd.randint(3, vocab)]) for _ in range(rnd.randint(1, max_len)))))
    return docs


def _py_tfidf(docs, max_df=1.0, max_features=None):
    tf = {}
    ids = sorted({d for d, _ in docs})
    for d, text in docs:
        for t in text.split(", "):
            tf.setdefault(d, {}).setdefault(t, 0)
            tf[d][t] += 1
    n = len(ids)
    df, ctf = {}, {}
    for d in tf:
        for t, c in tf[d].items():
            df[t] = df.get(t, 0) + 1
            ctf[t] = ctf.get(t, 0) + c
    terms = [t for t in df if df[t] <= max_df * n]
    terms.sort(key=lambda t: (-ctf[t], t))
    if max_features:
        terms = terms[:max_features]
    keep = set(terms)
    out = {}
    for d in tf:
        raw = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf[d].items() if t in keep}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            out[(d, t)] = v / norm
    return out


def test_tfidf_matches_formula(spark):
    docs = _random_docs(1)
    seg = spark.createDataFrame(docs, "doc_id long, text string")
    w, _ = sim.tfidf(seg, token_pattern=r"w\d+", max_df=0.8, max_features=20, stopwords=[])
    got = {(r.doc_id, r.term): r.weight for r in w.collect()}
    exp = _py_tfidf(docs, 0.8, 20)
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-9


def test_idf_is_smoothed(spark):
    seg = spark.createDataFrame([(1, "w01 w02"), (2, "w02")], "doc_id long, text string")
    _, vocab = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
    got = {r.term: r.idf for r in vocab.collect()}
    assert abs(got["w01"] - (math.log(3 / 2) + 1)) < 1e-12 and abs(got["w02"] - 1) < 1e-12


def test_ngrams_of_segments(spark):
    seg = spark.createDataFrame([(1, "a1 the b1 c1"), (1, "b1 c1"), (2, "d1"), (3, "")], "doc_id long, text string")
    tf = sim.term_counts(seg, token_pattern=r"[a-z0-9]+", ngram_range=(1, 3), stopwords=["the"])
    got = {(r.doc_id, r.term): r.tf for r in tf.collect()}
    assert got == {(1, "a1"): 1, (1, "b1"): 2, (1, "c1"): 2, (1, "a1 b1"): 1, (1, "b1 c1"): 2, (1, "a1 b1 c1"): 1, (2, "d1"): 1}


def test_split_postings_lose_no_pair(spark):
    docs = _random_docs(6, n_docs=40, vocab=8)
    seg = spark.createDataFrame(docs, "doc_id long, text string")
    w, vocab = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
    p = sim.stage(sim._split_prefix(w, vocab, 0.3)).where("in_prefix")
    pu = p.select(F.col("doc_id").alias("d1"), "term", F.col("weight").alias("w1"))
    pv = p.select(F.col("doc_id").alias("d2"), "term", F.col("weight").alias("w2"))
    rows = [sorted((r.d1, r.d2, r.term) for r in sim._shared_prefix(pu, pv, block=b).collect()) for b in (2048, 3)]
    assert rows[0] == rows[1] and rows[0]


def test_candidate_report(spark):
    docs = _random_docs(9, n_docs=40)
    seg = spark.createDataFrame(docs, "doc_id long, text string")
    w, vocab = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
    low, high = (sim.candidate_report(w, t, vocab).first() for t in (0.1, 0.9))
    assert high.joined_rows < low.joined_rows <= low.term_join_rows == high.term_join_rows
    assert high.results <= high.candidates <= low.candidates and low.results <= low.candidates


def _dense(vecs, docs, terms):
    m = np.zeros((len(docs), len(terms)))
    di = {d: i for i, d in enumerate(docs)}
    ti = {t: i for i, t in enumerate(terms)}
    for (d, t), v in vecs.items():
        m[di[d], ti[t]] = v
    return m


def test_cosine_pairs_exact(spark):
    for seed, thr in [(2, 0.2), (3, 0.5), (4, 0.05), (5, 0.9)]:
        docs = _random_docs(seed, n_docs=30)
        exp_w = _py_tfidf(docs)
        seg = spark.createDataFrame(docs, "doc_id long, text string")
        w, vocab = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
        got = {(r.Source, r.Target): r.Weight for r in sim.cosine_pairs(w, thr, vocab).collect()}
        ids = sorted({d for d, _ in docs})
        terms = sorted({t for _, t in exp_w})
        m = _dense(exp_w, ids, terms)
        g = m @ m.T
        exp = {(ids[i], ids[j]): g[i, j] for i in range(len(ids)) for j in range(len(ids))
               if ids[i] > ids[j] and g[i, j] >= thr}
        assert set(got) == set(exp), (seed, thr)
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-9


def test_soft_cosine_matches_dense(spark):
    docs = _random_docs(7, n_docs=15, vocab=12)
    seg = spark.createDataFrame(docs, "doc_id long, text string")
    w, _ = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
    ts = sim.term_similarity(w, 0.3)
    got = {(r.Source, r.Target): r.Weight for r in sim.soft_cosine_pairs(w, ts, 0.1).collect()}
    exp_w = _py_tfidf(docs)
    ids = sorted({d for d, _ in docs})
    terms = sorted({t for _, t in exp_w})
    m = _dense(exp_w, ids, terms)
    cols = m / np.linalg.norm(m, axis=0)
    s = cols.T @ cols
    s = np.where(s >= 0.3, s, 0.0)
    np.fill_diagonal(s, 1.0)
    g = m @ s @ m.T
    nrm = np.sqrt(np.diag(g))
    exp = {}
    for i in range(len(ids)):
        for j in range(len(ids)):
            v = g[i, j] / (nrm[i] * nrm[j])
            if ids[i] > ids[j] and v >= 0.1 and g[i, j] != 0:
                exp[(ids[i], ids[j])] = v
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-9


def test_soft_cosine_over_merged_terms_matches_dense(spark):
    docs = [(d, " ".join([t] + ["w90 w91"] * (d % 2) + [f"w{50 + 3 * d + i}" for i in range(3)]))
            for d, t in _random_docs(7, n_docs=15, vocab=12)]
    w, _ = sim.tfidf(spark.createDataFrame(docs, "doc_id long, text string"), token_pattern=r"w\d+", stopwords=[])
    merged = sim.merge_alike_terms(w)
    assert merged.select("term").distinct().count() < w.select("term").distinct().count()
    got = {(r.Source, r.Target): r.Weight
           for r in sim.soft_cosine_pairs(merged, sim.term_similarity(merged, 0.3), 0.1).collect()}
    rows = w.collect()
    ids, terms = sorted({r.doc_id for r in rows}), sorted({r.term for r in rows})
    m = np.zeros((len(ids), len(terms)))
    for r in rows:
        m[ids.index(r.doc_id), terms.index(r.term)] = r.weight
    cols = m / np.linalg.norm(m, axis=0)
    s = cols.T @ cols
    s = np.where(s >= 0.3, s, 0.0)
    np.fill_diagonal(s, 1.0)
    g = m @ s @ m.T
    g = g / np.sqrt(np.outer(np.diag(g), np.diag(g)))
    exp = {(ids[i], ids[j]): g[i, j] for i in range(len(ids)) for j in range(i) if g[i, j] >= 0.1}
    assert set(got) == set(exp)
    assert all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_cosine_rejects_nonpositive_threshold(spark):
    seg = spark.createDataFrame([(1, "w01")], "doc_id long, text string")
    w, _ = sim.tfidf(seg, token_pattern=r"w\d+", stopwords=[])
    try:
        sim.cosine_pairs(w, 0.0)
    except ValueError:
        return
    raise AssertionError("expected ValueError")
