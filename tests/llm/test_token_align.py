"""Alignment of two tokenizers against quadratic plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tagflow.llm import token_align as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, names):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(names[i]), i))
        at = out[-1][1]
    return out


def plain(text, a, b):
    """n_a, n_b, groups and links (repeats included) of a text by comparing all pairs."""
    if not text:
        return 0, 0, [], []
    x, y = spans(a.encode([text])[0], a.bytes), spans(b.encode([text])[0], b.bytes)
    want = (" " + text).encode()
    if any(b"".join(t.bytes[i] for *_, i in s) != want for t, s in ((a, x), (b, y))):
        return 0, 0, [], []
    links = [(i, j) for s, e, i in x for u, v, j in y if s < v and u < e]
    cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups = [",".join(str(i) for s, e, i in x if p <= s and e <= q) + "|" + ",".join(str(i) for s, e, i in y if p <= s and e <= q)
              for p, q in zip([0, *cuts], cuts)]
    return len(x), len(y), groups, links


def brute(texts):
    a, b = A.load(A_PATH), A.load(B_PATH)
    each = [plain(t, a, b) for t in texts]
    held = Counter(p for e in each for p in set(e[3]))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [(n_a, n_b, len(g), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls), ";".join(g))
            for n_a, n_b, g, ls in each]


def texts():
    r = random.Random(2)
    bits = ["the", "internationalisation", " ", "\n", "\t", "é", "日本語", "🙂", "<s>", "</s>", "<|endoftext|>", "<unk>", "0x41",
            "<0x41>", "don't", "  ", "▁", "ﬁ", " ", "​", "é", "x" * 40, "1234567", "#$%", "Ω", "\x00", "ẞ"]
    out = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    return out + [None, "", " ", "\n", "a", " lead", "trail ", "the the the", "the the the", "naïve façade coöperate " * 40]


def rows_of(df):
    return {r.k: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()}


def frame(spark, ts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(ts)], "doc_id long, text string, k int").repartition(5)


def test_against_all_pairs(spark):
    ts = texts()
    got, want = rows_of(A.align(frame(spark, ts), A_PATH, B_PATH)), dict(enumerate(brute(ts)))
    assert got == want
    assert sum(w[0] == 0 for w in want.values()) < len(ts) / 2 and any(w[2] < w[0] for w in want.values())


def test_more_portions_change_nothing(spark):
    ts = texts()
    want = rows_of(A.align(frame(spark, ts), A_PATH, B_PATH))
    many = A.portions(frame(spark, ts), A_PATH, B_PATH, "text", ["k"], "text", portion_links=20)
    assert many.count() > 40
    assert rows_of(A.align(frame(spark, ts), A_PATH, B_PATH, portion_links=20)) == want


def listed(aligner, ts):
    return [(a, b, n, list(links), said) for a, b, n, links, said in aligner.texts(ts)]


def test_cut_texts_align_as_whole_ones():
    r = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\u0085", "\u00a0", "\u2003", "\u200b", "\u0308", "'s", "'ll", "I'm", "a", "B", "7", "#", "é", "語",
            "🙂", "▁", "the", "ing", "<s>", "\x00", "\r", ".", '"', "<|endoftext|>"]
    cut, whole = A.Aligner(A_PATH, B_PATH), A.Aligner(A_PATH, B_PATH)
    assert cut.cuts
    whole.cuts = False
    ts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    assert listed(cut, ts) == listed(whole, ts)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(A, "MEMORY", 50)
    one, ts = A.Aligner(A_PATH, B_PATH), [f"word{i} and{i % 7}" for i in range(400)]
    got = [v for i in range(0, 400, 10) for v in listed(one, ts[i:i + 10])]
    assert len(one.young) <= 50 and len(one.old) <= 50 and got == listed(A.Aligner(A_PATH, B_PATH), ts)


def test_portion_packs_and_unpacks():
    p = A.Portion()
    p.add((1,), np.array([7, 7, 3]))
    p.add((2,), np.zeros(0, np.int64))
    p.add((3,), np.array([3, 9]))
    keys, held, blob = p.pairs()
    sizes, places, times = A.unpacked(blob, 3)
    assert list(keys) == [3, 7, 9] and list(held) == [2, 1, 1]
    assert list(sizes) == [2, 0, 2] and list(places) == [0, 1, 0, 2] and list(times) == [1, 2, 1, 1]


def test_digest_long_text_repeats_missing_ids_clashes_and_empty_table(spark):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))
    schema = "doc_id long, text string, n_best string, links int, portion int, docs int"
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (4, long), (5, None)]
    df = spark.createDataFrame([(*r, "old", 1, 2, 3) for r in rows], schema)
    out = A.align(df, A_PATH, B_PATH, groups="sha256")
    got = out.collect()
    assert len(got) == 5 and {(r.links, r.portion, r.docs) for r in got} == {(1, 2, 3)}
    cat = [r for r in got if r.text == "the cat"]
    assert len(cat) == 3 and {r.count_sum for r in cat} == {3 * cat[0].n_links}
    a, b = A.load(A_PATH), A.load(B_PATH)
    assert {r.groups_sha256 for r in cat} == {hashlib.sha256(";".join(plain("the cat", a, b)[2]).encode()).hexdigest()}
    big, none = next(r for r in got if r.doc_id == 4), next(r for r in got if r.doc_id == 5)
    assert big.n_a > 100_000 and big.n_links >= max(big.n_a, big.n_b) and none.groups_sha256 == ""
    assert (none.n_a, none.n_links, none.n_best, none.count_sum) == (0, 0, 0, 0)
    assert A.align(df.limit(0), A_PATH, B_PATH).count() == 0
    with pytest.raises(ValueError):
        A.align(df, A_PATH, B_PATH, groups="md5")


def test_byte_letters_are_a_bijection():
    letters = A.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and len(letters) == 256
    assert A.load(A_PATH).bytes[220] == b" " and A.load(B_PATH).bytes[3] == b"\x00"
