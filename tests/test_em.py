"""The EM fit against MLlib's optimizer, number for number, and the shuffles of an iteration."""

import random

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagflow.operators import em, topics


def vectors(spark):
    rnd = random.Random(8)
    rows = [[float(rnd.randint(1, 5)) if w == d or rnd.random() < 0.3 else 0.0 for w in range(30)] for d in range(12)]
    rows.append([2.0] * 30)                     # one document holds every term
    made = [(Vectors.dense(r) if i % 3 else Vectors.sparse(30, [(w, x) for w, x in enumerate(r) if x]),)
            for i, r in enumerate(rows)]
    return topics.stage(spark.createDataFrame(made, ["features"]).repartition(3), "vectors")


def test_fit_is_that_of_mllib(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(em, "STAGE_EVERY", 2)
    vec, k = vectors(spark), 3
    want = LDA(k=k, maxIter=5, seed=1, optimizer="em").fit(vec)
    got = topics.fit_lda(vec, k, max_iter=5, seed=1)
    assert isinstance(got, em.EMModel)          # no graph
    want.write().save(str(tmp_path / "m"))
    saved = spark.read.parquet(str(tmp_path / "m/oldModel/data/topicCounts"))
    a = {(r.id, r.topic): r.n for r in saved.select("id", F.posexplode(vector_to_array("topicWeights")).alias("topic", "n")).collect()}
    b = {(r.id, r.topic): r.n for r in topics.topic_counts(got).collect()}
    assert a.keys() == b.keys() and max(abs(a[x] - b[x]) for x in a) < 1e-9
    assert abs(got.trainingLogLikelihood() - want.trainingLogLikelihood()) < 1e-6
    mine = {r.topic: r for r in got.describeTopics(4).collect()}
    for r in want.describeTopics(4).collect():
        assert mine[r.topic].termIndices == r.termIndices and np.allclose(mine[r.topic].termWeights, r.termWeights)


def test_sums_per_term_move_no_entry(spark):
    vec = vectors(spark)
    m = topics.fit_lda(vec, 2, max_iter=0)
    held, terms = em.dealt(m.entries), em.dealt(m.terms)
    held.count(), terms.count()
    shares = em._shares(em._weighted(held, terms, em._factors(m.docs, 2, m.alpha, m.v), m.n_docs, 2), 2)
    plan = em._sums(shares, "idx", "t", 2)._jdf.queryExecution().executedPlan().toString()
    outside = plan.split("InMemoryRelation")[0]
    assert "HashAggregate" in outside and "Exchange hashpartitioning(idx" not in outside


def test_packs_fit_as_joins_do(spark, monkeypatch):
    vec = vectors(spark)
    monkeypatch.setattr(em, "ENTRIES_AT_ONCE", 5)
    one = topics.fit_lda(vec, 3, max_iter=12)
    assert one.terms.count() == 30 and one.docs.count() == 13

    def no_packs(*a):
        raise AssertionError("the documents' counts are over the bound")

    monkeypatch.setattr(em.rounds, "MOST_GLOBAL", 38)
    monkeypatch.setattr(em, "_fit_in_packs", no_packs)
    two = topics.fit_lda(vec, 3, max_iter=12)
    a, b = ({(r.id, r.topic): r.n for r in topics.topic_counts(m).collect()} for m in (one, two))
    assert a.keys() == b.keys() and max(abs(a[x] - b[x]) for x in a) < 1e-9
