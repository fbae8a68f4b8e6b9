"""BM25 retrieval against exhaustive scoring, and leaks against brute force."""

import random

import numpy as np

from tagflow.llm import decontaminate as dc


def items(rng, vocab, n):
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(6, 50))]
        cut = rng.randint(0, len(words))
        out.append((i, " ".join(words[:cut]) + ". " + " ".join(words[cut:]) + "."))
    return out


def test_block_max_wand_equals_exhaustive_search():
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    rows = [(i, *dc.question_and_answer(t)) for i, t in items(rng, vocab, 90)]
    rows = [r for r in rows if r[1]]
    ix = dc.build_index(rows)
    for _ in range(80):
        terms = sorted({ix.vocab[w] for w in rng.sample(vocab, 60) if w in ix.vocab})
        if rng.random() < 0.5:
            terms = sorted({ix.vocab[w] for w in rng.choice(rows)[1]} | set(terms[:5]))
        score = np.zeros(len(rows))
        for t in terms:
            s, e = ix.starts[t], ix.starts[t + 1]
            score[ix.docs[s:e]] += ix.impact[s:e]
        for threshold in (0.1, 0.3, 0.6, 0.9):
            got = dict(dc.block_max_wand(ix, terms, threshold))
            assert set(got) == set(np.flatnonzero(score >= threshold - 1e-9))
            assert all(abs(score[d] - s) < 1e-9 for d, s in got.items())
    own = [sum(ix.impact[ix.starts[t]:ix.starts[t + 1]][ix.docs[ix.starts[t]:ix.starts[t + 1]] == d].sum()
               for t in range(len(ix.vocab))) for d in range(len(rows))]
    assert np.allclose(own, 1)


def test_leaks(spark):
    rng = random.Random(7)
    vocab = [a + b for a in "bcdfghklmn" for b in ("an", "et", "or", "is", "um")]
    bench = items(rng, vocab, 40) + [(100, None), (101, " . "), (102, "Single sentence without more words here")]
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, want = [], {}
    for i in range(120):
        text, leak = noise(rng.randint(0, 400)), set()
        if i % 3 == 0:
            item = rng.choice(bench[:40])
            text += ". " + item[1].upper().replace(" ", "\n") + " " + noise(rng.randint(0, 300))
            leak.add(item[0])
        docs.append(text)
        want[i] = leak
    docs += [None, "", "single SENTENCE, without more words here!"]
    want |= {120: set(), 121: set(), 122: {102}}
    bench_df = spark.createDataFrame(bench + [(None, "x y z")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(docs)], "doc_id long, text string, leaks int")
    for size in (1024, 10):
        got = {r.doc_id: {m.item_id for m in r.leaks} for r in dc.with_leaks(df, bench_df, max_items=size).collect()}
        assert {k: v & set(range(200)) for k, v in got.items()} == want
    assert dc.with_leaks(df, bench_df.limit(0), keep=["doc_id"]).where("size(leaks) > 0").count() == 0
    assert dc.with_leaks(df.limit(0), bench_df).count() == 0


def test_half_an_item_is_no_leak(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight. The answer is nine ten eleven.")],
                                  "item_id long, text string")
    df = spark.createDataFrame([(1, "one two three four five six seven eight and no more of it"),
                                (2, "x one two three four five six seven eight the answer is nine ten eleven y")],
                               "doc_id long, text string")
    got = {r.doc_id: len(r.leaks) for r in dc.with_leaks(df, bench, keep=["doc_id"]).collect()}
    assert got == {1: 0, 2: 1}


def test_one_changed_word_or_a_missing_end_is_a_leak(spark):
    question, answer = [f"q{i}" for i in range(30)], [f"a{i}" for i in range(6)]
    bench = spark.createDataFrame([(1, " ".join(question) + ". " + " ".join(answer) + ".")], "item_id long, text string")
    words = question + answer
    texts = [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(36)]
    texts += [" ".join(question), " ".join(question[:25])]
    df = spark.createDataFrame(list(enumerate(f"before {t} after" for t in texts)), "doc_id long, text string")
    got = {r.doc_id: r.leaks for r in dc.with_leaks(df, bench, keep=["doc_id"]).collect()}
    assert [len(got[i]) for i in range(38)] == [1] * 37 + [0]
    assert abs(got[33][0].item_overlap - 29 / 32) < 1e-9 and got[33][0].question_overlap == 1
    assert got[33][0].answer_overlap < 0.8 and abs(got[36][0].item_overlap - 26 / 32) < 1e-9


def test_scores_do_not_depend_on_the_size_of_an_index(spark):
    rng = random.Random(11)
    vocab = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)]
    bench = items(rng, vocab, 60)
    texts = [rng.choice(bench)[1] + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts += [texts[0], "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench_df = spark.createDataFrame(bench + [bench[3]], "item_id long, text string")
    rows = dc.length_classes(sorted(bench + [bench[3]]))
    got = []
    for size in (1024, 7, 3):
        found = dc.with_leaks(df, bench_df, max_items=size, keep=["doc_id"]).collect()
        got.append({(r.doc_id, m.item_id): round(m.score, 9) for r in found for m in r.leaks})
    assert got[0] == got[1] == got[2] and len(got[0]) >= 40
    assert {i: s for (d, i), s in got[0].items() if d == 0} == {i: s for (d, i), s in got[0].items() if d == 40}
    for kind, of_kind in rows.items():       # by the definition, over all items of the class
        texts_of = [q + a for _, q, a in of_kind]
        n, words, longest, df_of = dc.statistics_of(of_kind)
        assert n == len(of_kind) and words == sum(map(len, texts_of)) and longest == max(map(len, texts_of))
        assert all(df_of[w] == sum(w in t for t in texts_of) for w in df_of)
        part = dc.build_index(of_kind[:3], (n, words, longest, df_of))
        whole = dc.build_index(of_kind)
        for w, t in part.vocab.items():
            u = whole.vocab[w]
            all_of = dict(zip(whole.docs[whole.starts[u]:whole.starts[u + 1]], whole.impact[whole.starts[u]:whole.starts[u + 1]]))
            for d, x in zip(part.docs[part.starts[t]:part.starts[t + 1]], part.impact[part.starts[t]:part.starts[t + 1]]):
                assert abs(all_of[d] - x) < 1e-12
