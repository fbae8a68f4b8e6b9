"""SimHash against a plain computation and brute-force links."""

import random

import pytest
import xxhash

from tagflow.llm import simhash
from tagflow.llm.components import connected_components


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def components(nodes, linked):
    """Smallest reachable node of each node, by search."""
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += linked.get(x, ())
    return out


def corpus(rng):
    vocab = [f"w{i}" for i in range(80)]
    docs = []
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        docs.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            edit = list(words)
            for _ in range(rng.randint(0, 2)):
                edit[rng.randrange(len(edit))] = rng.choice(vocab).upper()
            docs.append("\t".join(edit))
    return docs + [None, "", " \n", "one", "ONE", "one two", "a b c", "É x y", "é x y"]


@pytest.mark.parametrize("block", [4096, 4])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = set()
    for c in centres:
        for _ in range(30):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [simhash._signed(x) for x in prints]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.links(df, 3, block).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in edges)
    linked, want = {}, {}
    for a, b in edges:
        linked.setdefault(a, []).append(b)
        linked.setdefault(b, []).append(a)
    for i, x in enumerate(prints):
        want[i] = [j for j, y in enumerate(prints) if (x ^ y).bit_count() <= 3]
    assert components(range(len(prints)), linked) == components(range(len(prints)), want)


def test_lower_bound_holds():
    rng = random.Random(8)
    from collections import Counter

    def code(x):
        return [bin(x >> (2 * i) & 3).count("1") for i in range(32)]

    worst = Counter()
    for _ in range(500):
        x, y = rng.getrandbits(64), rng.getrandbits(64)
        bound = sum(abs(a - b) for a, b in zip(code(x), code(y)))
        assert bound <= (x ^ y).bit_count()
        worst[bound] += 1


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus(random.Random(6))
    df = spark.createDataFrame([(10 + 3 * i, t, "z", 1) for i, t in enumerate(docs)],
                               "doc_id long, text string, fingerprint string, fp long")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {10 + 3 * i: plain_fingerprint(t) for i, t in enumerate(docs)}
    linked = {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3] for a in prints}
    want = components(prints, linked)
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert len(set(want.values())) < len(docs)


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, None), (None, "q r s t u")],
                               "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id or r.component_id)
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7)]
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, -1, 5, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        simhash.near_duplicates(df.selectExpr("'a' as doc_id", "text"))


def test_texts_that_share_an_id_stay_apart(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, other), (6, one), (7, other), (8, None), (5, one)]
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame(turn, "doc_id long, text string")
        for parts in (1, 4):
            kept = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(df.repartition(parts)).collect())
            assert kept == [(5, one), (5, other), (8, "")]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(500, 560)] + [(3, 3), (None, 4)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)]
    df = spark.createDataFrame(edges + edges[:10], "a long, b long")
    linked = {}
    for a, b in edges:
        if a is not None and a != b:
            linked.setdefault(a, []).append(b)
            linked.setdefault(b, []).append(a)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components(linked, linked)
