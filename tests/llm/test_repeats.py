"""Suffix and substring dedup against brute force over every window."""

import collections
import hashlib
import random

import pytest

from tagflow.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, ranges string, kept long"


def brute(docs, units, size):
    """Per document: the mask of units covered by a window that also starts elsewhere."""
    seq = [units(t) for t in docs]
    seen = collections.Counter(tuple(s[i:i + size]) for s in seq for i in range(len(s) - size + 1))
    out = []
    for s in seq:
        mask = [False] * len(s)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i:i + size])] > 1:
                mask[i:i + size] = [True] * size
        out.append(mask)
    return out


def texts(rng, n, join):
    parts = [join.join(rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.randint(20, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            t.append(rng.choice(parts) if rng.random() < 0.5 else join.join(rng.choice("xyzwuvß") for _ in range(rng.randint(0, 60))))
        out.append(join.join(t))
    out += [out[0], out[1], None, "", "a" * 300, "ab" * 100, "  \n ", "q " * 80]
    edited = list(max(out, key=lambda t: len(t or "")))
    edited[len(edited) // 2] = "#"
    return out + ["".join(edited)]


@pytest.mark.parametrize("limit", [4096, 2])
def test_suffix_dedup_equals_brute_force(spark, limit):
    rng = random.Random(3)
    docs = texts(rng, 60, "")
    size = 24
    want = brute(docs, lambda t: (t or "").encode(), size)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(docs)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df, size, limit=limit).collect()}
    assert len(got) == len(docs)
    assert sum(map(any, want)) > 20
    for i, (t, mask) in enumerate(zip(docs, want)):
        data = (t or "").encode()
        assert bytes(got[i].kept) == bytes(b for b, m in zip(data, mask) if not m)
        assert (got[i].n_bytes, got[i].n_removed) == (len(data), sum(mask))
        runs = sum(m and not (j and mask[j - 1]) for j, m in enumerate(mask))
        assert len(got[i].removed) == runs


@pytest.mark.parametrize("limit", [4096, 2])
def test_substring_dedup_equals_brute_force(spark, limit):
    rng = random.Random(5)
    docs = texts(rng, 60, " ")
    size = 7
    want = brute(docs, lambda t: (t or "").split(), size)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(docs)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in substring_dedup.without_repeats(df, size, limit=limit).collect()}
    assert sum(map(any, want)) > 20
    for i, (t, mask) in enumerate(zip(docs, want)):
        words = (t or "").split()
        assert got[i].kept == " ".join(w for w, m in zip(words, mask) if not m)
        assert (got[i].n_words, got[i].n_removed) == (len(words), sum(mask))


def test_suffix_dedup_at_production_size(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    other = lambda: "".join(rng.choice("ijklmnop ") for _ in range(900))
    docs = [other() + passage + other(), passage[:450] + other(), other() + passage[100:499], other(), passage]
    want = brute(docs, str.encode, 400)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in suffix_dedup.digest(df).collect():
        mask, data = want[r.doc_id], docs[r.doc_id].encode()
        assert r.n_removed == sum(mask)
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, m in zip(data, mask) if not m)).hexdigest()


def test_rows_that_repeat_an_id_or_have_none(spark):
    rng = random.Random(1)
    words = " ".join(rng.choice("abcdefgh") * 3 for _ in range(60))
    df = spark.createDataFrame([(1, words), (1, "x y z"), (None, words), (2, "u v " + words)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.without_repeats(df).collect()}
    assert got == {(1, 60): 60, (1, 3): 0, (None, 60): 60, (2, 62): 60}


def test_ids_that_are_no_numbers(spark):
    words = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("a", words), ("b", words), ("c", "x")], "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(df).collect()}
    assert got == {"a": 50, "b": 50, "c": 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digest(df).count() == 0
    assert substring_dedup.digest(df).count() == 0


def test_long_text_is_worked_in_parts(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1_200_000))
    at = (1 << 19) - 300                              # a repeat across the border of two parts
    df = spark.createDataFrame([(1, long), (2, long[at:at + 800])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df).select("doc_id", "n_removed", "removed").collect()}
    assert got[2].n_removed == 800
    assert [(r.start, r.end) for r in got[1].removed] == [(at, at + 800)]
