"""Modularity classes against a plain-Python version of the rule, label propagation and planted groups."""

import random

from tagflow.operators import communities as C
from tagflow.operators import graph

from test_graph import _py_lpa, _py_modularity


def hash_level(x, turn):
    return 31 - len(bin(((x % C.RANGE + 1) * (C.TURN + C.TURN_STEP * turn)) % C.RANGE)[2:])


def plain_level(nodes, adj, m2):
    """Communities of one level, and the modularity gain (times 2 m^2) of every accepted round."""
    deg = {n: sum(adj[n].values()) for n in nodes}
    c, gains = {n: n for n in nodes}, []
    for turn in range(1, 200):
        t, opts = {}, {}
        for n in nodes:
            t[c[n]] = t.get(c[n], 0) + deg[n]
        for n in nodes:
            into = {}
            for o, w in adj[n].items():
                if o != n:
                    into[c[o]] = into.get(c[o], 0) + w
            others = [(m2 * w - deg[n] * t[d], -d) for d, w in into.items() if d != c[n]]
            if others:
                v, neg = max(others)
                g = v - (m2 * into.get(c[n], 0) - deg[n] * (t[c[n]] - deg[n]))
                if g > 0:
                    opts[n] = (-neg, g)
        if not opts:
            return c, turn - 1
        out, into = {}, {}
        for n, (d, g) in opts.items():
            out[c[n]] = max(out.get(c[n], (0, 0)), (g, -n))
            into[d] = max(into.get(d, (0, 0)), (g, -n))
        movers = {}
        for n, (d, g) in opts.items():
            if (c[n] not in into or out[c[n]] > into[c[n]]) and (d not in out or into[d] > out[d]):
                movers[n] = 31 if (g, -n) == out[c[n]] == into[d] else hash_level(n, turn)
        new = dict(c)
        for n, lv in movers.items():
            d, g = opts[n]
            rivals = sum(deg[o] for o, x in movers.items() if x >= lv and opts[o][0] == d)
            rivals += sum(deg[o] for o, x in movers.items() if x >= lv and c[o] == c[n])
            if g > deg[n] * (rivals - 2 * deg[n]):
                new[n] = d
        assert new != c
        c = new
    raise AssertionError("unsettled")


def plain(nodes, edges):
    adj = {n: {} for n in nodes}
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    m2, members, levels = sum(sum(x.values()) for x in adj.values()), {n: n for n in nodes}, []
    while True:
        c, moved = plain_level(list(adj), adj, m2)
        if not moved and levels:
            return levels
        name = {}
        for n in adj:
            name[c[n]] = min(name.get(c[n], n), n)
        to = {n: name[c[n]] for n in adj}
        members = {n: to[x] for n, x in members.items()}
        levels.append(members)
        if not moved:
            return levels
        nxt = {x: {} for x in to.values()}
        for a, row in adj.items():
            for b, w in row.items():
                nxt[to[a]][to[b]] = nxt[to[a]].get(to[b], 0) + w
        adj = nxt


def frames(spark, nodes, edges):
    return (spark.createDataFrame([(n,) for n in nodes], "Id long"),
            spark.createDataFrame(edges, "Source long, Target long, Weight long"))


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.level, {})[r.Id] = r.cluster
    return [out[k] for k in sorted(out)]


def planted(seed, groups=6, size=7):
    r, edges = random.Random(seed), {}
    n = groups * size
    for a in range(n):
        for b in range(a + 1, n):
            if r.random() < (0.6 if a // size == b // size else 0.05):
                edges[a * 13 + 5, b * 13 + 5] = r.randint(1, 3)
    return [a * 13 + 5 for a in range(n)], [(a, b, w) for (a, b), w in edges.items()]


def test_equals_the_rule_in_plain_python_and_rises(spark):
    for seed in (1,):
        nodes, edges = planted(seed)
        nodes = nodes + [10_000]                                       # without edges
        nd, ed = frames(spark, nodes, edges)
        df = C.modularity_classes(nd, ed)
        got, want = collected(df), plain(nodes, edges)
        assert got == want and got[-1][10_000] == 10_000
        q = [_py_modularity(nodes, edges, lab) for lab in got]
        assert q == sorted(q)
        assert q[-1] >= _py_modularity(nodes, edges, _py_lpa(nodes, edges)[0]) - 1e-12
        by = {r.level: r for r in graph.modularity_by(ed, df, "level").collect()}
        assert [round(by[i + 1].modularity, 9) for i in range(len(q))] == [round(x, 9) for x in q]
        assert [by[i + 1].n_clusters for i in range(len(q))] == [len(set(lab.values())) for lab in got]
        assert {r.Id: r.cluster for r in C.last_level(df).collect()} == got[-1]


def test_every_round_is_a_gain():
    """Rounds of the rule on random graphs never lower the modularity (checked by the asserts and levels)."""
    for seed in range(40):
        r = random.Random(seed)
        nodes = list(range(1, 30))
        edges = {}
        for _ in range(r.randint(5, 90)):
            a, b = r.sample(nodes, 2)
            edges[min(a, b), max(a, b)] = r.randint(1, 9)
        el = [(a, b, w) for (a, b), w in edges.items()]
        q = [_py_modularity(nodes, el, lab) for lab in plain(nodes, el)]
        assert q == sorted(q) and q[0] >= _py_modularity(nodes, el, {n: n for n in nodes})


def test_a_hub_takes_its_leaves_in_few_rounds(spark):
    nodes, edges = list(range(1, 302)), [(1, i, 1) for i in range(2, 302)]
    _, rounds = plain_level(nodes, {n: ({i: 1 for i in range(2, 302)} if n == 1 else {1: 1}) for n in nodes}, 600)
    assert rounds < 20
    assert collected(C.modularity_classes(*frames(spark, nodes, edges))) == plain(nodes, edges)


def test_no_edges_and_no_nodes(spark):
    nd, ed = frames(spark, [3, 4], [(3, 4, 1)])
    assert collected(C.modularity_classes(nd, ed.limit(0))) == [{3: 3, 4: 4}]
    assert collected(C.modularity_classes(nd, ed)) == [{3: 3, 4: 3}]
    assert C.modularity_classes(nd.limit(0), ed.limit(0)).count() == 0
