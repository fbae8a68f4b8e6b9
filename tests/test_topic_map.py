"""Distances of topics against the definition, coordinates against the distances."""

import math
import random

import numpy as np
import pytest

from tagflow.operators import topic_map as tm


def js(p: dict, q: dict) -> float:
    out = 0.0
    for w in p.keys() | q.keys():
        a, b = p.get(w, 0.0), q.get(w, 0.0)
        m = (a + b) / 2
        out += (a * math.log(a / m) if a else 0) / 2 + (b * math.log(b / m) if b else 0) / 2
    return out


def test_distances_and_map(spark):
    rng = random.Random(5)
    rows = [(t, rng.randint(0, 40), rng.choice([0.0, 0.5, 1.0, 3.0])) for t in range(7) for _ in range(30)]
    rows += [(8, 100, 1.0), (8, 101, 2.0), (9, 100, 2.0), (9, 101, 4.0), (10, 5, 0.0)]
    df = spark.createDataFrame(rows, "topic int, idx int, n double")
    dist: dict = {}
    for t, w, n in rows:
        if n:
            dist.setdefault(t, {}).setdefault(w, 0.0)
            dist[t][w] += n
    dist = {t: {w: n / sum(d.values()) for w, n in d.items()} for t, d in dist.items()}
    got = {(r.a, r.b): (r.shared, r.divergence) for r in tm.distances(tm.shares_of(df)).collect()}
    assert all(a < b for a, b in got) and (0, 8) not in got and abs(got[8, 9][1]) < 1e-12
    for a in dist:
        for b in dist:
            if a < b:
                shared, d = got.get((a, b), (0, math.log(2)))
                assert shared == len(dist[a].keys() & dist[b].keys()) and abs(d - js(dist[a], dist[b])) < 1e-9
    placed = {r.topic: r for r in tm.topic_map(df).collect()}
    assert set(placed) == set(dist) and abs(sum(r.share for r in placed.values()) - 1) < 1e-9
    assert math.dist((placed[8].x, placed[8].y), (placed[9].x, placed[9].y)) < 1e-6
    assert sorted(r["rank"] for r in placed.values()) == list(range(1, len(dist) + 1))
    assert tm.topic_map(df.limit(0)).count() == 0


def test_coordinates_of_points_in_a_plane():
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(12, 2))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    out = tm.principal_coordinates(d)
    assert np.allclose(np.sqrt(((out[:, None] - out[None]) ** 2).sum(-1)), d)
    assert tm.principal_coordinates(np.zeros((1, 1))).tolist() == [[0, 0]]


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(tm, "MAX_GROUPS", 2)
    df = spark.createDataFrame([(i, 1, 1.0) for i in range(3)], "topic int, idx int, n double")
    with pytest.raises(ValueError):
        tm.topic_map(df)
