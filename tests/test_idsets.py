"""Id sets against Python sets: containers, ids read back, intersections."""

import random

from tagflow.operators import idsets as S


def incidence(seed=3):
    r = random.Random(seed)
    pools = {"hot": (range(1, 90_000), 6000), "warm": (range(20_000, 70_000), 1500), "rare": (range(1, 200_000), 40),
             "edge": ([-32768, -32767, -1, 0, 1, 2, 32767, 32768, 32769, 65536, 65537, 2 ** 40 + 7], 12),
             "dense": (range(32_769, 65_537), 3000)}
    rows = [(i, t) for t, (pool, n) in pools.items() for i in r.sample(list(pool), n)]
    rows += [(5, None), (6, None), (None, "rare"), (None, "gone")]
    return rows + rows[:500]


def test_containers_sizes_and_members(spark):
    rows = incidence()
    df = spark.createDataFrame(rows, "tweet_id long, tag string").repartition(6)
    sets = S.id_sets(df, array_ids=512)
    want = {}
    for i, t in rows:
        if i is not None:
            want.setdefault(t, set()).add(i)
    got = {}
    for r in S.members(sets).collect():
        assert r.id not in got.setdefault(r.tag, set())
        got[r.tag].add(r.id)
    assert got == want
    assert {r.tag: r.n_tweets for r in S.set_sizes(sets).collect()} == {t: len(v) for t, v in want.items()}
    kinds = {r.tag: 0 for r in sets.collect()}
    for r in sets.collect():
        assert (r.bits is None) == (r.n < 512) and (r.ids is None) == (r.n >= 512)
        assert r.bits is None or len(r.bits) == 4096
        assert r.ids is None or r.ids == sorted(r.ids)
        kinds[r.tag] += r.bits is not None
    assert kinds["hot"] >= 2 and kinds["rare"] == 0 and kinds["dense"] == 1


def test_overlaps(spark):
    rows = incidence()
    df = spark.createDataFrame(rows, "tweet_id long, tag string")
    own = {}
    for i, t in rows:
        if i is not None:
            own.setdefault(t, set()).add(i)
    names = ["hot", "warm", "rare", "edge", "dense"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    got = S.overlaps(S.id_sets(df), spark.createDataFrame(pairs, "tag_a string, tag_b string")).collect()
    assert {(r.tag_a, r.tag_b): (r.n_a, r.n_b, r.shared) for r in got} == {
        (a, b): (len(own[a]), len(own[b]), len(own[a] & own[b])) for a, b in pairs}
    assert all(abs(r.jaccard - len(own[r.tag_a] & own[r.tag_b]) / len(own[r.tag_a] | own[r.tag_b])) < 1e-12 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "tweet_id long, tag string")
    assert S.id_sets(df).count() == 0 and S.members(S.id_sets(df)).count() == 0
