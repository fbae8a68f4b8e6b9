"""Quality rules against plain counts, brute-force decoding and held-out labels."""

import collections
import itertools
import random
import re

import numpy as np

from tagflow.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed)


def corpus():
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "été", "runs", "past", "old", "mill", "日本"]) + rng.choice("abcd")
                                      for _ in range(rng.randint(8, 30))) + "." for _ in range(rng.randint(2, 8)))
    bad = lambda: "\n".join(" | ".join(rng.choice(["buy", "now", "click"]) + str(rng.randint(0, 999)) for _ in range(9)) + " |"
                            for _ in range(8))
    texts = [good() if i % 2 else bad() for i in range(120)]
    return texts + [None, "", " \n\t", "a b c " * 40, "x\x1cy\x85z " * 20, "same line of words\n" * 30, "w" * 5000, "é" * 60 + " a"]


def test_counts_equal_a_plain_computation(spark):
    texts = corpus()
    model = quality.fit(texts[:80], [i % 2 for i in range(80)])
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality.quality_rules(df, model).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), i
        assert not (r.base_failed and r.kept)
    for i in range(80, 120):                               # held out
        if not got[i].base_failed:
            assert got[i].kept == bool(i % 2)
    assert quality.quality_rules(df.limit(0), model).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores, trans = rng.normal(size=rng.integers(1, 8)), rng.normal(size=(2, 2))

        def value(path):
            return sum(s for s, p in zip(scores, path) if p) + sum(trans[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert tuple(quality.viterbi(scores, trans)) == best


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, max_docs=150)
    used = labels.groupBy("doc_id").agg({"quality": "min"}).orderBy("doc_id")
    chosen = {r[0] for r in used.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").limit(150).collect()}
    rows = quality.quality_rules(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    held = [r for r in rows if r.doc_id not in chosen]
    assert len(held) > 100
    assert sum(r.kept == bool(r.quality) for r in held) / len(held) > 0.97
    assert all(r.kept for r in held if r.quality)


def test_without_labels_every_line_is_content(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert quality.quality_rules(docs, model).first().kept
