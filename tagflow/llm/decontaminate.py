"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are the index, the training passages the queries.  Scores are
divided by the item's score against its own words, so 1 means that a passage
has every word of the item, and one threshold serves all items.  For each
passage all items above the threshold are retrieved; a retrieved item counts
as leaked if the passage also holds ``overlap`` of the word shingles of the
whole item, or of its question and of its answer each.  (One changed word takes
most shingles of a short part, but few of the whole item.)

An item's answer is its last sentence and its question all before; an item of
one sentence is a question without an answer.  Words are runs of letters and
digits in lower case.  Items are put in classes by length (powers of two); a
class with items of up to m words is searched with passages of 2 m words that
start every m words, so each occurrence of an item lies whole in some passage.

Document frequencies, mean and largest length and number of items of a class are
taken over all items, by aggregates, so neither an item's score nor the passages
depend on which others share its index.  An index holds at most ``max_items`` items of a class; one pass
over the documents searches the indexes of ``INDEXES * max_items`` items, which
are broadcast (their size is bounded by that), so any number of items is
handled.  The passes over the documents shuffle nothing.
"""

from __future__ import annotations

import re
from itertools import repeat
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rank import number_rows
from .common import append_columns, staged

MAX_ITEMS = 1024     # items of one index
INDEXES = 4          # a pass takes so many times the items of an index
BLOCK = 4            # items of one posting block
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?](?:\s+|$)|\n+")

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
                     T.StructField("question_overlap", T.DoubleType()),
                     T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType()),
                    T.StructField("item_overlap", T.DoubleType())])


ITEM = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("n_words", T.LongType()),
                     T.StructField("words", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list, list]:
    """Words of all sentences but the last, and of the last one."""
    parts = [w for w in (words_of(s) for s in SENTENCE.split(text or "")) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list, size: int) -> set:
    """Shingles of ``size`` words; of fewer words the whole sequence."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap_of(part: list, passage: list, size: int) -> float:
    """Share of the part's shingles that the passage has; 1 for an empty part."""
    want = shingles(part, size)
    if not want:
        return 1.0
    return len(want & shingles(passage, min(size, len(part)))) / len(want)


def statistics_of(items: list) -> tuple[int, int, int, dict]:
    """Items, words, words of the longest, and items per word of ``(item_id, question, answer)``."""
    df: dict = {}
    for _, q, a in items:
        for w in dict.fromkeys(q + a):
            df[w] = df.get(w, 0) + 1
    lengths = [len(q) + len(a) for _, q, a in items]
    return len(items), sum(lengths), max(lengths), df


def build_index(items: list, corpus: tuple[int, int, int, dict] | None = None, block: int = BLOCK, k1: float = K1,
                b: float = B) -> SimpleNamespace:
    """Inverted index of ``(item_id, question, answer)`` of one length class.

    ``corpus`` has the statistics of the class that the items are of, as
    ``statistics_of`` gives them (default: those of ``items``).

    ``span``: words of the longest item of the class; ``vocab``: word -> term; the postings
    of term t are ``docs[starts[t]:starts[t + 1]]`` (item numbers, increasing)
    with ``impact``, the share of the item's own BM25 score that the term gives;
    ``block_max[term, block]`` and ``term_max[term]``: largest impacts.
    """
    texts = [q + a for _, q, a in items]
    n, total_words, span, df = corpus or statistics_of(items)
    mean = total_words / n
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    lists: list = [[] for _ in vocab]
    for d, t in enumerate(texts):
        tf: dict = {}
        for w in t:
            tf[w] = tf.get(w, 0) + 1
        own = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (k1 + 1)
               / (c + k1 * (1 - b + b * len(t) / mean)) for w, c in tf.items()}
        total = sum(own.values())
        for w, s in own.items():
            lists[vocab[w]].append((d, s / total))
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    docs = np.array([d for x in lists for d, _ in x], dtype=np.int64)
    impact = np.array([s for x in lists for _, s in x])
    blocks = -(-len(items) // block)
    block_max = np.zeros((len(vocab), blocks), dtype=np.float32)
    term = np.repeat(np.arange(len(vocab)), np.diff(starts))
    np.maximum.at(block_max, (term, docs // block), np.nextafter(impact.astype(np.float32), np.float32(2)))
    return SimpleNamespace(span=span, items=items, vocab=vocab, starts=starts, docs=docs,
                           impact=impact, block_max=block_max, term_max=block_max.max(axis=1))


def block_max_wand(ix: SimpleNamespace, terms: list, threshold: float, block: int = BLOCK) -> list:
    """All ``(item number, score)`` with score >= threshold for a query of distinct terms.

    Cursors over the postings are kept by item.  The pivot is the first item at
    which the terms' maxima can reach the threshold; if the maxima of its
    blocks cannot, all cursors jump past the nearest block end.
    """
    cur = [[int(ix.docs[ix.starts[t]]), int(ix.starts[t]), int(ix.starts[t + 1]), t] for t in terms]
    docs = ix.docs
    eps, found, end = 1e-9, [], len(ix.items)

    def advance(c: list, to: int) -> None:
        at = c[1] + int(docs[c[1]:c[2]].searchsorted(to))
        c[1], c[0] = at, int(docs[at]) if at < c[2] else end

    while True:
        cur = sorted(c for c in cur if c[0] < end)
        bound, pivot = 0.0, None
        for i, c in enumerate(cur):
            bound += ix.term_max[c[3]]
            if bound >= threshold - eps:
                pivot = i
                break
        if pivot is None:
            return found
        doc = cur[pivot][0]
        while pivot + 1 < len(cur) and cur[pivot + 1][0] == doc:
            pivot += 1
        inside = doc // block
        if sum(float(ix.block_max[c[3], inside]) for c in cur[:pivot + 1]) < threshold - eps:
            to = (inside + 1) * block
            if pivot + 1 < len(cur):
                to = min(to, cur[pivot + 1][0])
            for c in cur[:pivot + 1]:
                advance(c, max(to, doc + 1))
        elif cur[0][0] == doc:
            score = sum(float(ix.impact[c[1]]) for c in cur[:pivot + 1])
            if score >= threshold - eps:
                found.append((doc, score))
            for c in cur[:pivot + 1]:
                advance(c, doc + 1)
        else:
            for c in cur[:pivot]:
                if c[0] < doc:
                    advance(c, doc)


def build_classes(rows: list, corpus: dict, max_items: int = MAX_ITEMS) -> tuple[dict, list]:
    """Indexes of at most ``max_items`` items of a length class, and the vocabulary of all of them.

    ``corpus`` has the statistics of each class.  Returns ``(vocab, [(index,
    own)])``; ``own`` turns a term of the shared vocabulary (or -1) into the
    index's term, -1 where it has none.
    """
    indexes = [build_index(of_kind[i:i + max_items], corpus[kind])
               for kind, of_kind in length_classes(rows).items() for i in range(0, len(of_kind), max_items)]
    vocab: dict = {}
    for ix in indexes:
        for w in ix.vocab:
            vocab.setdefault(w, len(vocab))
    out = []
    for ix in indexes:
        own = np.full(len(vocab) + 1, -1, dtype=np.int64)
        for w, t in ix.vocab.items():
            own[vocab[w]] = t
        out.append((ix, own))
    return vocab, out


def leaks_of(text: str | None, vocab: dict, indexes: list, threshold: float, overlap: float, shingle: int) -> dict:
    """Leaked items of one document: item id -> best (score, question, answer overlap, first word, item overlap)."""
    words, best = words_of(text), {}
    terms = np.array(list(map(vocab.get, words, repeat(-1))), dtype=np.int64)
    for ix, own in indexes:
        for item, m in search(ix, own[terms], words, threshold, overlap, shingle).items():
            if item not in best or m[0] > best[item][0]:
                best[item] = m
    return best


def search(ix: SimpleNamespace, known: np.ndarray, words: list, threshold: float, overlap: float, shingle: int) -> dict:
    """Leaked items of one class; ``known`` has the term of each word, -1 for none."""
    span = ix.span
    at = np.flatnonzero(known >= 0)
    if not len(at):
        return {}
    half, terms = at // span, known[at]
    # A word lies in the passage that starts in its half and in the one before.
    passage = np.concatenate([half, half - 1])
    key = np.unique(passage[passage >= 0] * len(ix.vocab) + np.concatenate([terms, terms])[passage >= 0])
    passage, terms = key // len(ix.vocab), key % len(ix.vocab)
    cut = np.append(0, np.flatnonzero(np.diff(passage)) + 1)
    # No item of a block can reach the threshold unless the block's maxima can.
    bound = np.maximum.reduce(np.add.reduceat(ix.block_max[terms], cut, axis=0), axis=1)
    best: dict = {}
    ends = np.append(cut[1:], len(key))
    for i in np.flatnonzero(bound >= threshold - 1e-6):
        hits = block_max_wand(ix, terms[cut[i]:ends[i]].tolist(), threshold)
        first = int(passage[cut[i]]) * span
        text = words[first:first + 2 * span]
        for d, score in hits:
            item, question, answer = ix.items[d]
            q, a = overlap_of(question, text, shingle), overlap_of(answer, text, shingle)
            whole = overlap_of(question + answer, text, shingle)
            if (whole >= overlap or q >= overlap and a >= overlap) and (item not in best or score > best[item][0]):
                best[item] = (score, q, a, first, whole)
    return best


def kind_of(n_words: int) -> int:
    """The length class: the power of two that a number of words fits."""
    return (n_words - 1).bit_length()


def length_classes(rows: list) -> dict:
    """Items ``(item_id, question, answer)`` with a word, by length class."""
    by: dict = {}
    for item, text in rows:
        q, a = question_and_answer(text)
        if q:
            by.setdefault(kind_of(len(q) + len(a)), []).append((item, q, a))
    return {k: by[k] for k in sorted(by)}


def measured(rows: DataFrame) -> DataFrame:
    """``(i, t)`` plus length class, number of words and distinct words; items without a word go."""

    def compute(col):
        words = [q + a for q, a in map(question_and_answer, col.to_pylist())]
        return [[kind_of(len(w)) if w else None for w in words], [len(w) for w in words],
                [list(dict.fromkeys(w)) for w in words]]

    return append_columns(rows, ITEM, ["t"], compute).where("n_words > 0")


def with_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5,
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               max_items: int = MAX_ITEMS, keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``leaks``: one struct per leaked item, in order of ``item_id``.

    Null or empty texts, and items without a word or an id, leak nothing.
    Items that repeat an id count separately, the best match is reported (of
    equal ones that of the earliest passage).  Repeated documents are searched
    each; a text of any length is searched whole, passage by passage.  An empty
    table of documents gives no row, one of items empty lists.  A column of
    ``docs`` named ``leaks`` is replaced, other columns of any name stay.
    """
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"),
                                                           F.col(item_text).alias("t"))
    numbered, n_items = number_rows(measured(rows), ["i", "t"], "place")
    of_words = numbered.select("kind", F.explode("words").alias("word"))
    df = staged(of_words.groupBy("kind", "word").agg(F.count("*").alias("n")), "item_words")
    sums = {r[0]: tuple(r)[1:] for r in                                                # one row per power of two
            numbered.groupBy("kind").agg(F.count("*"), F.sum("n_words"), F.max("n_words")).collect()}
    passes = -(-n_items // (INDEXES * max_items)) or 1
    out, asked = docs, keep
    sc = docs.sparkSession.sparkContext
    for k in range(passes):
        part = numbered.where(F.floor((F.col("place") - 1) / (INDEXES * max_items)) == k)
        corpus = {kind: (*of_kind, {}) for kind, of_kind in sums.items()}
        own = part.select("kind", F.explode("words").alias("word")).distinct()
        for kind, word, n in df.join(own, ["kind", "word"]).select("kind", "word", "n").collect():
            corpus[kind][3][word] = n
        rows_of_pass = sorted((r[0], r[1]) for r in part.select("i", "t").collect())
        held = sc.broadcast(build_classes(rows_of_pass, corpus, max_items))
        more = k > 0

        def compute(col, *before, held=held, more=more):
            found = []
            vocab, indexes = held.value
            for j, text in enumerate(col.to_pylist()):
                best = leaks_of(text, vocab, indexes, threshold, overlap, shingle)
                if more:
                    for m in before[0][j].as_py():
                        if m["item_id"] not in best or m["score"] > best[m["item_id"]][0]:
                            best[m["item_id"]] = tuple(m[n] for n in LEAK.names[1:])
                found.append([(i, *best[i]) for i in sorted(best)])
            return [[[dict(zip(LEAK.names, m)) for m in f] for f in found]]

        fields = T.StructType([T.StructField("leaks", T.ArrayType(LEAK))])
        last = k == passes - 1
        out = append_columns(out, fields, [text_col] + ["leaks"] * more, compute,
                             keep=asked if last or asked is None else asked + [text_col])
    return out
