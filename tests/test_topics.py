"""c_v coherence against explicit sliding windows; LDA invariants."""

import math
import random

from pyspark.sql import functions as F

from tagflow.operators import topics


def _py_cv(topic_words, texts, window=110, eps=1e-12):
    wins = []
    for t in texts:
        if len(t) <= window:
            wins.append(set(t))
        else:
            wins.extend(set(t[i:i + window]) for i in range(len(t) - window + 1))
    n = len(wins)

    def p(*ws):
        return sum(1 for w in wins if all(x in w for x in ws)) / n

    out = {}
    for k, ws in topic_words.items():
        def npmi(a, b):
            p12 = (p(a) if a == b else p(a, b)) + eps
            return math.log(p12 / (p(a) * p(b))) / -math.log(p12)
        vec = {a: [npmi(a, b) for b in ws] for a in ws}
        vw = [sum(vec[a][j] for a in ws) for j in range(len(ws))]
        cos = []
        for a in ws:
            dot = sum(x * y for x, y in zip(vec[a], vw))
            cos.append(dot / (math.sqrt(sum(x * x for x in vec[a])) * math.sqrt(sum(y * y for y in vw))))
        out[k] = sum(cos) / len(cos)
    return out


def test_coherence_cv_matches_windows(spark):
    """Documents of several member texts: windows slide over the whole document, across blocks."""
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(15)]
    docs = [[[rnd.choice(vocab) for _ in range(rnd.choice([0, 5, 40, 130]))] for _ in range(rnd.randint(1, 5))]
            for _ in range(8)]
    tw = {0: vocab[:5], 1: vocab[3:9], 2: vocab[9:14]}
    tdf = spark.createDataFrame([(k, w) for k, ws in tw.items() for w in ws], "topic int, term string")
    xdf = spark.createDataFrame([(d, i, t) for d, ts in enumerate(docs) for i, t in enumerate(ts)],
                                "doc_key long, i int, tokens array<string>").repartition(5)
    exp = _py_cv(tw, [[w for t in ts for w in t] for ts in docs], 110)
    placed = topics.prepare_texts(xdf, ["i"], window=110)
    for block in (topics.BLOCK_WINDOWS, 37):
        got = {r.topic: r.coherence for r in topics.coherence_cv(tdf, placed, window=110, block=block).collect()}
        assert set(got) == set(exp)
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-9


def test_lda_invariants(spark):
    rnd = random.Random(2)
    rows = [(d, f"w{rnd.randint(0, 20)}", rnd.randint(1, 4)) for d in range(30) for _ in range(8)]
    counts = (spark.createDataFrame(rows, "doc_key long, term string, count long")
                   .groupBy("doc_key", "term").agg(F.sum("count").alias("count")))
    vec, vocab, v = topics.bag_of_words(counts)
    assert v == vocab.count() == counts.select("term").distinct().count()
    totals = [(r.total, r.term) for r in vocab.orderBy("idx").collect()]
    assert totals == sorted(totals, key=lambda x: (-x[0], x[1]))
    names = {r.idx: r.term for r in vocab.collect()}
    got = {(r.doc_key, names[int(i)]): c for r in vec.collect() for i, c in zip(r.features.indices, r.features.values)}
    assert got == {(r.doc_key, r.term): r["count"] for r in counts.collect()}
    m = topics.fit_lda(vec, 3, max_iter=5)
    for r in m.describeTopics(5).collect():
        assert list(r.termWeights) == sorted(r.termWeights, reverse=True)
    rel = topics.topic_relevance(m, vocab).collect()
    n = sum(r["count"] for r in counts.collect())
    share = {r.topic: r.share for r in rel}
    assert abs(sum(share.values()) - 1) < 1e-9
    p = {r.term: r.total / n for r in vocab.collect()}
    for t in share:
        mine = [r for r in rel if r.topic == t]
        assert abs(sum(r.phi for r in mine) - 1) < 1e-9
        for r in mine:
            want = 0.6 * math.log(r.phi) + 0.4 * math.log(r.phi / p[r.term])
            assert abs(r.relevance - want) < 1e-9
    # The counts behind the topics are the corpus: every term's expected tokens add up to its total.
    mass = topics.topic_counts(m).where("id < 0").groupBy("id").agg(F.sum("n").alias("n")).collect()
    for r in mass:
        assert abs(r.n - p[names[-r.id - 1]] * n) < 1e-6
    top = topics.topic_relevance(m, vocab, top=4).collect()
    for t in share:
        best = sorted((r for r in rel if r.topic == t), key=lambda r: (-r.relevance, r.term))[:4]
        assert [r.term for r in sorted((r for r in top if r.topic == t), key=lambda r: r["rank"])] == [r.term for r in best]


def test_coherence_reads_the_topics_once(spark):
    """The topics' words are worked out once, and the plan of the result does not repeat how they came about."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c")], "topic int, term string").coalesce(1)
    texts = topics.prepare_texts(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"])], "doc_key int, tokens array<string>"),
                                 ["tokens"])
    out = topics.coherence_cv(words.mapInArrow(passed, words.schema), texts, window=2)
    assert out.count() == 2 and seen.value == 4
