"""Token counts and packing against the tokenizer library."""

import collections
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagflow.llm import packing, tokens

LATIN = "".join(map(chr, [*range(9, 14), *range(32, 256), 0x130, 0x301, 0x3A3]))

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a<|startoftext|>b", "x <|endoftext|>", "don't WON'T 'S", "İstanbul ΣΑΣ ﬁ", "é é", "日本語 テキスト", "a\x1cb\x85c\xa0d　e",
       "12３४", "\U0001f600‍", "\x00\x01", "x" * 500, "<|STARTOFTEXT|> A b", "Wörter, größe; naïve. ½² ªº \xad",
       "end.' x,, y., 3, é, <|endoftext|>.", " \n\t", "", None, "<|startoftext|" + "|>" * 3]


@pytest.fixture(scope="module")
def lib():
    return tokens.load(PATH)


def ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def fast():
    return tokens.Counter(PATH, tokens.whole_tokens(PATH), True), tokens.Encoder(PATH, True)


def test_whole_tokens_are_proven(lib):
    whole = tokens.whole_tokens(PATH)
    assert len(whole) > 30_000
    assert all(len(lib.model.tokenize(w)) == 1 for w in random.Random(1).sample(sorted(whole), 500))


@settings(max_examples=1500, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet=LATIN, max_size=60))
def test_any_text_equals_the_library(lib, fast, text):
    counter, encoder = fast
    want = ids(lib, text)
    data = text.encode("utf-8", "ignore")
    want = ids(lib, data.decode())
    assert counter.count(data) == len(want)
    assert encoder.encode(data) == b"".join(i.to_bytes(4, "little") for i in want)


def test_token_counts(spark, lib):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokens.token_counts(df, PATH, 4).collect()}
    for i, t in enumerate(ODD):
        n = len(ids(lib, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4)
    assert tokens.token_counts(df.limit(0), PATH, 4).count() == 0


def test_other_files_are_encoded_whole():
    assert tokens.splits_at_space(PATH)
    assert not tokens.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_round_trip(spark, lib):
    rng = random.Random(3)
    docs = ODD + [" ".join(rng.choice(["alpha", "beta", "zq"]) for _ in range(rng.randint(0, 150))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, offset int").repartition(7)
    got = packing.pack(df, PATH, capacity=64).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in enumerate(docs):
        want = ids(lib, t) + [0]
        total += len(want)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(want) // 64)))
        for r in pieces:
            part = want[r.start:r.start + r.length]
            assert r.start == 64 * r.piece and r.length == len(part)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        assert sum(r.length for r in pieces) == len(want)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_seq) <= -(-total // 64) + 2
    assert packing.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), room=st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for x, n in counts.items():
        for _ in range(n):
            sums |= {s + x for s in sums if s + x <= room}
    got = packing.fullest(dict(counts), room)
    assert sum(x * n for x, n in got) == max(sums)
    assert all(n <= counts[x] for x, n in got)


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=12))
def test_plan_places_every_piece_once(counts):
    rows = packing.plan(dict(counts), 50)
    bins = collections.defaultdict(list)
    for x, n in counts.items():
        mine = [r for r in rows.tolist() if r[0] == x]
        assert [r[1] for r in mine] == [0, *[r[2] for r in mine][:-1]] and mine[-1][2] == n
        for _, first, last, per, base, off in mine:
            for t in range(last - first):
                bins[base + t // per].append((off + t % per * x, x))
    for b in bins.values():
        at = 0
        for off, x in sorted(b):
            assert off == at
            at += x
        assert at <= 50
