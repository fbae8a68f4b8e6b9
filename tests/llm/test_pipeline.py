"""The pipeline against a brute-force version of its stages, and the entry module."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tagflow.llm import decontaminate, quality, tokens

from .test_repeats import brute
from .test_simhash import components, plain_fingerprint

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(rng):
    vocab = [a + b + c for a in "bcdfgklm" for b in ("an", "été", "or", "is") for c in ("ed", "ly", "a")]
    prose = lambda n: " ".join(rng.choice(vocab) + ("." if rng.random() < 0.1 else "") for _ in range(n)) + "."
    passage = prose(90)
    bench = [(i, prose(rng.randint(12, 40))) for i in range(12)]
    docs, labels = [], []
    for i in range(150):
        if i % 5 == 0:
            text = " | ".join(f"{rng.choice(vocab)}{rng.randint(0, 99)}###" for _ in range(70))
        else:
            text = "\n".join(prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 5)))
            if i % 7 == 1:
                text += "\n" + passage + "\n" + prose(30)
            if i % 11 == 2:
                text += "\n" + bench[i % 12][1] + "\n" + prose(20)
        docs.append(text)
        labels.append((i, int(i % 5 != 0), 0))
    docs += [docs[1], docs[2], docs[3].replace("a", "A", 1), prose(10), "", None, passage + " " + passage]
    return [(i, t, "en", None, len(t or "")) for i, t in enumerate(docs)], labels, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, bench = corpus(random.Random(12))
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, labels, bench


def brute_force(docs, labels, bench):
    """Documents after each stage, as {id: text}."""
    good = {i: q for i, q, _ in labels}
    train = sorted((i, t, good[i]) for i, t, *_ in docs if i in good)
    model = quality.fit([t for _, t, _ in train], [q for *_, q in train])
    state, trans = np.array(model.state), np.array(model.trans)
    kept = {i: t for i, t, *_ in docs if quality.measure((t or "").encode(), state, trans, 0.5)[-1]}
    stages = [kept]
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    linked = {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3] for a in prints}
    group = components(prints, linked)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    stages.append(kept)
    ids = sorted(kept)
    masks = brute([kept[i] for i in ids], str.encode, corpus_pipeline.PASSAGE_BYTES)
    cut = {i: bytes(b for b, m in zip(kept[i].encode(), mask) if not m).decode("utf-8", "ignore") for i, mask in zip(ids, masks)}
    kept = {i: t for i, t in cut.items() if t == kept[i] or t.strip()}
    stages.append(kept)
    clean = {}
    for i, t in kept.items():
        words = " ".join(decontaminate.words_of(t))
        if not any(" ".join(decontaminate.words_of(b)) in words for _, b in bench):
            clean[i] = t
    stages.append(clean)
    return stages


def test_stages_equal_brute_force(spark, folder):
    d, docs, labels, bench = folder
    want = brute_force(docs, labels, bench)
    sizes = [len(w) for w in want]
    assert len(docs) > sizes[0] > sizes[1] > sizes[3] > 80
    assert any(want[1][i] != t for i, t in want[2].items())
    df = spark.read.parquet(f"{d}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        df = corpus_pipeline.staged(stage(spark, df, d), name)
        assert df.columns == COLUMNS
        rows = df.collect()
        assert {r.doc_id: r.text for r in rows} == expected, name
        assert all(r.n_chars == len(r.text) for r in rows)
    lib = tokens.load(PATH)
    pieces = collections.defaultdict(list)
    used = collections.Counter()
    for r in corpus_pipeline.run(spark, d).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id] += r.length
    total = 0
    assert set(pieces) == set(want[3])
    for i, rs in pieces.items():
        ids = lib.encode(want[3][i], add_special_tokens=False).ids + [0]
        total += len(ids)
        for r in rs:
            part = ids[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        assert sum(r.length for r in rs) == len(ids)
    assert max(used.values()) <= 2048 and len(used) <= -(-total // 2048) + 1


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    d, *_ = folder
    df = spark.read.parquet(f"{d}/documents.parquet")
    odd = df.selectExpr("*", "1 as kept", "'x' as leaks", "2 as n_words", "3 as fp")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), d).count() == 0, name
        assert {"doc_id"} <= set(stage(spark, odd, d).columns), name


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and {"op4_warc", "op7_substring_dedup"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op4_warc", "op7_substring_dedup"])
def test_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(rows, key=key)
