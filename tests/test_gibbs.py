"""Sampled topics against the same draws in plain Python; planted topics; alpha."""

import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tagflow.operators import gibbs as G


def u_of(place, sweep, seed):
    h = 42
    for x in (place, sweep, seed):
        h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
    return (h >> 11) / (1 << 53)


def plain_digamma(x):
    y = x + 6.0
    inv = 1.0 / (y * y)
    s = math.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return s - sum(1.0 / (x + i) for i in range(6))


def plain(tokens, k, v, sweeps, beta, seed, every):
    alpha = [G.ALPHA_SUM / k] * k
    z = {p: min(int(u_of(p, 0, seed) * k), k - 1) for _, p, _ in tokens}
    for s in range(1, sweeps + 1):
        nd, nw, nt = {}, {}, [0.0] * k
        for d, p, w in tokens:
            nd.setdefault(d, [0.0] * k)[z[p]] += 1
            nw.setdefault(w, [0.0] * k)[z[p]] += 1
            nt[z[p]] += 1
        new = {}
        for d, p, w in tokens:
            own = [1.0 if t == z[p] else 0.0 for t in range(k)]
            ws = [(nd[d][t] - own[t] + alpha[t]) * (nw[w][t] - own[t] + beta) / (nt[t] - own[t] + v * beta) for t in range(k)]
            left, new[p] = u_of(p, s, seed) * sum(ws), k - 1
            for t, x in enumerate(ws):
                left -= x
                if left < 0:
                    new[p] = t
                    break
        z = new
        if every and s % every == 0:
            nd = {}
            for d, p, _ in tokens:
                nd.setdefault(d, [0.0] * k)[z[p]] += 1
            for _ in range(G.ALPHA_STEPS):
                tot = sum(alpha)
                den = sum(plain_digamma(sum(n) + tot) - plain_digamma(tot) for n in nd.values())
                alpha = [max(a * sum(plain_digamma(n[t] + a) - plain_digamma(a) for n in nd.values()) / den, G.LEAST_ALPHA)
                         for t, a in enumerate(alpha)]
    return z, alpha


def planted(seed, docs=30, length=40):
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(length):
            rows.append((d, r.getrandbits(62), (d % 2) * 10 + r.randrange(10)))
    return rows


def test_equals_plain_python_whatever_the_partitions(spark):
    rows = planted(4, docs=8, length=15)
    want, alpha = plain(rows, 3, 20, 4, G.BETA, 7, 2)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc long, place long, idx int").repartition(parts)
        state, got_alpha = G.sample_topics(df, 3, 20, sweeps=4, optimize_every=2, seed=7)
        assert {r.place: r.z for r in state.collect()} == want
        assert got_alpha == pytest.approx(alpha, rel=1e-9)
    assert state.select("doc", "place", "idx").exceptAll(df).count() == 0 and state.count() == len(rows)


def test_planted_topics_are_found(spark):
    rows = planted(1)
    df = spark.createDataFrame(rows, "doc long, place long, idx int")
    state, alpha = G.sample_topics(df, 2, 20, sweeps=15, alpha_sum=1.0, optimize_every=5)
    by = {}
    for r in state.collect():
        by.setdefault(r.idx // 10, []).append(r.z)
    share = [max(z.count(0), z.count(1)) / len(z) for z in by.values()]
    assert min(share) > 0.95 and {max(set(z), key=z.count) for z in by.values()} == {0, 1}
    vocab = spark.createDataFrame([(i, f"t{i:02}") for i in range(20)], "idx int, term string")
    words = G.topic_words(state, vocab, 10, 2).collect()
    assert len(words) == 20 and {r.topic: {x.term[1] for x in words if x.topic == r.topic} for r in words}.values()
    sizes = G.topic_sizes(state, alpha).collect()
    assert sum(r.n_tokens for r in sizes) == len(rows) and abs(sum(r.share for r in sizes) - 1) < 1e-12


def test_digamma_and_alpha(spark):
    xs = [1e-4, 0.3, 1.0, 2.5, 10.0, 1e6]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(G.digamma(F.col("x")).alias("y")).collect()]
    for x, y in zip(xs, got):
        h = 1e-5 * max(1.0, x)
        if x >= 0.3:
            assert y == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-6, abs=1e-6)
    assert got[2] == pytest.approx(-0.5772156649015329, abs=1e-10)
    # documents that keep to one topic call for a small alpha, even ones for a large one
    one = spark.createDataFrame([([20.0, 0.0],), ([0.0, 20.0],)] * 10, "n_d array<double>")
    even = spark.createDataFrame([([10.0, 10.0],)] * 20, "n_d array<double>")
    assert max(G.fitted_alpha(one, [1.0, 1.0], 20)) < 0.3 and min(G.fitted_alpha(even, [1.0, 1.0], 20)) > 3


def test_no_tokens_and_wrong_parameters(spark):
    df = spark.createDataFrame([], "doc long, place long, idx int")
    state, alpha = G.sample_topics(df, 2, 0, sweeps=2, optimize_every=1)
    assert state.count() == 0 and alpha == [25.0, 25.0]
    assert [r.n_tokens for r in G.topic_sizes(state, alpha).collect()] == [0, 0]
    with pytest.raises(ValueError):
        G.sample_topics(df, 0, 5)


def test_packs_draw_as_joins_do(spark, monkeypatch):
    """One job a sweep over packs, also with terms spread over packs and chunks, against the joined counts."""
    rows = planted(5, docs=6, length=25) + [(d, 10 ** 6 + 100 * d + i, 3) for d in range(6) for i in range(15)]
    named = spark.createDataFrame([(f"d{d}", p, w) for d, p, w in rows], "doc string, place long, idx int").repartition(3)
    staged = []
    monkeypatch.setattr(G, "stage", lambda df, name="stage", f=G.stage, **o: staged.append(name) or f(df, name, **o))

    def drawn():
        staged.clear()
        state, alpha = G.sample_topics(named, 3, 20, sweeps=12, optimize_every=4, seed=5)
        return {(r.doc, r.place, r.idx): r.z for r in state.collect()}, alpha, state.dtypes

    monkeypatch.setattr(G.rounds, "MOST_GLOBAL", 0)
    want, alpha, kinds = drawn()
    assert staged.count("topics_of_tokens") == 13
    monkeypatch.setattr(G.rounds, "MOST_GLOBAL", 1 << 20)
    for spread, chunk, dealt in ((1 << 18, 1 << 17, 1 << 20), (20, 7, 30)):
        monkeypatch.setattr(G, "DEALT_TOKENS", dealt)
        monkeypatch.setattr(G, "SPREAD_TOKENS", spread)
        monkeypatch.setattr(G, "CHUNK", chunk)
        got, got_alpha, got_kinds = drawn()
        assert got == want and got_kinds == kinds and got_alpha == pytest.approx(alpha, rel=1e-9)
        assert staged.count("topics_of_tokens") == 1          # no state is written between the sweeps
