"""Co-occurrence, numbering, label propagation and modularity vs brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagflow.operators import graph, tags
from tagflow.plans.rank import number_rows


def test_number_rows_is_dense_and_ordered(spark):
    rnd = random.Random(5)
    rows = [(f"t{i:03d}", rnd.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "tag string, Count long").repartition(7)
    out, n = number_rows(df, [F.col("Count").desc(), F.col("tag").asc()])
    got = sorted((r.Id, r.tag) for r in out.collect())
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert n == 300
    assert [g[0] for g in got] == list(range(1, 301))
    assert [g[1] for g in got] == [e[0] for e in exp]


def test_cooccur_pairs_brute_force(spark):
    rnd = random.Random(3)
    inc = [(t, f"g{rnd.randint(0, 6)}") for t in range(40) for _ in range(rnd.randint(0, 5))]
    df = spark.createDataFrame(inc, "tweet_id long, tag string")
    got = sorted(tuple(r) for r in graph.cooccur_pairs(df).collect())
    per = {}
    for t, g in inc:
        per.setdefault(t, set()).add(g)
    exp = sorted((t, a, b) for t, s in per.items() for a, b in itertools.combinations(sorted(s), 2))
    assert got == exp


def _py_lpa(nodes, edges):
    adj = {n: {} for n in nodes}
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    lab = {n: n for n in nodes}
    for r in range(1, 100):
        new = {}
        for n in nodes:
            if not adj[n]:
                new[n] = lab[n]
                continue
            score = {}
            for m, w in adj[n].items():
                score[lab[m]] = score.get(lab[m], 0) + w
            score[lab[n]] = score.get(lab[n], 0) + max(adj[n].values())
            new[n] = min(score, key=lambda l: (-score[l], l))
        if new == lab:
            return lab, r
        lab = new
    return lab, None


def _py_modularity(nodes, edges, lab):
    m = sum(w for _, _, w in edges)
    deg, inner = {}, {}
    for a, b, w in edges:
        deg[lab[a]] = deg.get(lab[a], 0) + w
        deg[lab[b]] = deg.get(lab[b], 0) + w
        if lab[a] == lab[b]:
            inner[lab[a]] = inner.get(lab[a], 0) + w
    return sum(inner.get(c, 0) / m - (deg[c] / (2 * m)) ** 2 for c in deg)


def test_label_propagation_and_modularity(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        nodes = list(range(1, 21))
        edges = {}
        for _ in range(35):
            a, b = rnd.sample(nodes, 2)
            edges[(min(a, b), max(a, b))] = rnd.randint(1, 5)
        el = [(a, b, w) for (a, b), w in edges.items()]
        nd = spark.createDataFrame([(n,) for n in nodes], "Id long")
        ed = spark.createDataFrame(el, "Source long, Target long, Weight long")
        labels, rounds = graph.tag_clusters(nd, ed, len(nodes))
        exp, exp_rounds = _py_lpa(nodes, el)
        assert exp_rounds == rounds
        assert {r.Id: r.cluster for r in labels.collect()} == exp
        q = graph.modularity(ed, labels).first()
        assert abs(q.modularity - _py_modularity(nodes, el, exp)) < 1e-9
        assert -0.5 <= q.modularity <= 1


def test_explode_lists_keeps_empty_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], [])],
                               "id long, l1 array<string>, l2 array<string>")
    got = sorted(tuple(r) for r in tags.explode_lists(df, ["l1", "l2"], fill_value="").collect())
    assert got == [(1, "a", "x"), (1, "b", "y"), (2, "", "")]
    got1 = sorted(tuple(r) for r in tags.explode_lists(df.drop("l2"), ["l1"]).collect())
    assert got1 == [(1, "a"), (1, "b"), (2, "")]


def test_unsettled_clusters_are_no_result(spark):
    nd = spark.createDataFrame([(i,) for i in range(1, 9)], "Id long")
    ed = spark.createDataFrame([(i, i + 1, 1) for i in range(1, 8)], "Source long, Target long, Weight long")
    with pytest.raises(RuntimeError, match="still change"):
        graph.tag_clusters(nd, ed, 8, max_rounds=1)


def test_pairs_in_rows_equal_the_join(spark):
    rnd = random.Random(8)
    rows = [(t, [f"g{rnd.randint(0, 6)}" for _ in range(rnd.randint(0, 6))]) for t in range(60)]
    df = spark.createDataFrame(rows + [(99, None)], "id long, hashtags array<string>")
    inc = spark.createDataFrame([(t, g) for t, gs in rows for g in gs], "tweet_id long, tag string")
    assert (sorted(map(tuple, graph.cooccur_in_rows(df).collect()))
            == sorted(map(tuple, graph.cooccur_pairs(inc).collect())))
