"""Products of all pairs of vectors, pack by pack, against dense products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.operators import packs
from tagflow.operators import similarity as sim


def _vecs(seed, n_docs=60, vocab=80):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_docs):
        size = rnd.randint(1, 12)
        # the first terms are in most vectors, the others in few
        terms = {t for t in range(6) if rnd.random() < 0.8} | {int(vocab * rnd.random() ** 2) for _ in range(size)}
        w = {t: rnd.random() + 0.1 for t in terms}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(d, f"t{t}", x / norm) for t, x in w.items()]
    return rows


def _dense(rows):
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m = np.zeros((len(docs), len(terms)))
    for d, t, w in rows:
        m[docs.index(d), terms.index(t)] += w
    return docs, m


@pytest.fixture
def many_packs(monkeypatch):
    monkeypatch.setattr(packs, "PACK_VECTORS", 7)
    monkeypatch.setattr(packs, "CHUNK", 50)


def test_pairs_over_packs(spark, many_packs):
    for seed, threshold in [(1, 0.2), (2, 0.7)]:
        rows = _vecs(seed)
        docs, m = _dense(rows)
        g = m @ m.T
        exp = {(i, j): g[i, j] for i in docs for j in range(i) if g[i, j] >= threshold}
        for kind in ("long", "string"):
            vecs = spark.createDataFrame(rows, "doc_id long, term string, weight double")
            vecs = vecs.withColumn("doc_id", F.col("doc_id").cast(kind))
            got = sim.cosine_pairs(vecs, threshold).collect()
            assert all(r.Source > r.Target for r in got)
            got = {tuple(sorted((int(r.Source), int(r.Target)), reverse=True)): r.Weight for r in got}
            assert set(got) == set(exp) and len(got) > 20
            assert all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_pairs_need_no_exchange(spark):
    """Neither candidates nor entries are shuffled for the pairs: the plan reads the written packs only."""
    vecs = sim.stage(spark.createDataFrame(_vecs(3), "doc_id long, term string, weight double"))
    plan = sim.cosine_pairs(vecs, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_products_repeated_and_lonely_entries(spark, many_packs):
    rows = _vecs(4) + [(0, "t0", 0.25), (7, "t3", 0.5), (7, "t3", 0.5), (999, "only", 1.0)]
    docs, m = _dense(rows)
    vecs = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    p = packs.packed(vecs, 0)
    got = {(max(r.d1, r.d2), min(r.d1, r.d2)): r.Weight for r in packs.pairs_from(p, p, 0.1).collect()}
    g = m @ m.T
    exp = {(docs[i], docs[j]): g[i, j] for i in range(len(docs)) for j in range(i) if g[i, j] >= 0.1}
    assert set(got) == set(exp) and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_two_tables(spark, many_packs):
    a, b = _vecs(5, n_docs=30), _vecs(6, n_docs=40)
    u, v = (spark.createDataFrame(x, "doc_id long, term string, weight double") for x in (a, b))
    got = {(r.d1, r.d2): r.Weight for r in packs.pairs_from(packs.packed(u, 0), packs.packed(v, 0), 0.3).collect()}
    terms = sorted({t for _, t, _ in a + b})
    m = [np.zeros((n, len(terms))) for n in (30, 40)]
    for x, rows in zip(m, (a, b)):
        for d, t, w in rows:
            x[d, terms.index(t)] = w
    g = m[0] @ m[1].T
    assert set(got) == {(i, j) for i in range(30) for j in range(40) if g[i, j] >= 0.3}
    assert all(abs(got[i, j] - g[i, j]) < 1e-9 for i, j in got)


def test_counts_of_the_prefix_join(spark, many_packs):
    rows = _vecs(8)
    vecs = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    df = vecs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    prefix = sim._split_prefix(vecs, df, 0.6).where("in_prefix").collect()
    joined = [(x.doc_id, y.doc_id) for x in prefix for y in prefix if x.term == y.term and x.doc_id > y.doc_id]
    got = sim.candidate_report(vecs, 0.6).first()
    assert (got.joined_rows, got.candidates) == (len(joined), len(set(joined)))


def test_empty_table(spark):
    vecs = spark.createDataFrame([], "doc_id long, term string, weight double")
    assert sim.cosine_pairs(vecs, 0.5).count() == 0
    assert sim.candidate_report(vecs, 0.5).first().candidates == 0


def test_terms_listed_twice_are_refused(spark):
    with pytest.raises(ValueError):
        packs.term_seed(spark.createDataFrame([("a",), ("a",)], "term string"))
