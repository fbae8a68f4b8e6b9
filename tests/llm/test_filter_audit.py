"""Filter interactions against a walk through all orders in plain Python."""

import random
from itertools import permutations

import pytest

from tagflow.llm import filter_audit as A

FILTERS = {"A": A.few_words(4), "B": A.repetitive(65), "C": A.shouting(20), "D": A.holds("[#$]")}


def fails(rows):
    """Letters that each row (id, text, part) fails, in plain Python."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in t).split(" ") if x]
        f = set("A" * (len(w) < 4)) | set("B" * (100 * len(set(w)) < 65 * len(w)))
        f |= set("C" * (100 * sum("A" <= c <= "Z" for c in t) > 20 * len(t))) | set("D" * any(c in "#$" for c in t))
        f |= set("E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append(f)
    return out


def brute(rows, labels, letters="ABCDE"):
    bad = fails(rows)
    bad = [f & set(letters) for f in bad]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out, removed_by = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, bad) if (r[2] or "") == part]
        for order in permutations(letters):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                out[part, "".join(order), step] = [
                    c, len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                removed_by[part, c] = removed_by.get((part, c), 0) + len(gone)
    return {k: (*v, removed_by[k[0], v[0]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in df.collect()}


def sample():
    r = random.Random(3)
    bits = ["word", "other", "THIRD", "a#b", "$", "five\tsix", "é", "Ü", "x\x0by", "z\nz"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 7))) for _ in range(40)] + [None, "", " ", "SHOUT " * 5000]
    rows = [(i, r.choice(texts), r.choice(["p", "q", None, ""])) for i in range(150)]
    rows += [(r.randint(0, 149), r.choice(texts), "q") for _ in range(20)]      # repeated ids
    rows += [(None, r.choice(texts), "p") for _ in range(10)] + rows[:5]        # missing ids, repeated rows
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(0, 1, 1), (2, 0, 0)]
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_against_all_orders(spark):
    rows, labels = sample()
    docs, lab = frames(spark, rows, labels)
    got = collected(A.audit(docs, lab, FILTERS, "E"))
    assert len(got) == 3 * 120 * 5 and got == brute(rows, labels)


def test_fewer_filters_without_copies_and_labels(spark):
    rows, _ = sample()
    docs, _ = frames(spark, rows, [(0, 0, 0)])
    two = {k: FILTERS[k] for k in "DA"}
    want = {k: v for k, v in brute(rows, [], "AD").items()}
    assert collected(A.audit(docs, None, two)) == want


def test_a_text_that_all_sources_copy(spark):
    rows = [(i, "the same long text here", f"s{i % 50}") for i in range(500)]
    got = collected(A.audit(*frames(spark, rows, [(0, 1, 0), (499, 1, 1)]), FILTERS, "E"))
    assert got["s0", "EABCD", 1] == ("E", 1, 9, 0, 9, 0, 0, 1080) and got["s1", "EABCD", 1][:3] == ("E", 0, 10)
    assert sum(v[1] for k, v in got.items() if k[1:] == ("EABCD", 1)) == 1
    assert sum(v[5] for k, v in got.items() if k[1:] == ("EABCD", 1)) == 1


def test_empty_tables_clashing_columns_and_wrong_letters(spark):
    rows, labels = sample()
    docs, lab = frames(spark, rows, labels)
    assert A.audit(docs.limit(0), lab, FILTERS, "E").count() == 0
    odd = docs.selectExpr("*", "1 as mask", "'x' as part", "2 as n", "3 as id", "4 as words", "5 as good", "6 as digest")
    assert collected(A.audit(odd, lab.limit(0), FILTERS, "E")) == brute(rows, [])
    for wrong in ({}, {"AB": FILTERS["A"]}, {c: FILTERS["A"] for c in "ABCDEFG"}):
        with pytest.raises(ValueError):
            A.audit(docs, lab, wrong)
    with pytest.raises(ValueError):
        A.audit(docs, lab, FILTERS, "A")


def test_walk_enumerates_prefixes(spark):
    masks = spark.createDataFrame([(0,), (5,)], "mask int")
    got = A.walk(masks, list("abc")).collect()
    assert len({r.prefix for r in got}) == 3 + 6 + 6 and len(got) == 30
    at = {(r.prefix, r.mask): (r.kept, r.removed, r.redundant, r.single) for r in got}
    assert at["ca", 5] == (False, False, True, False) and at["c", 5] == (False, True, False, False)
    assert at["b", 5] == (True, False, False, False) and at["cab", 0] == (True, False, False, False)
