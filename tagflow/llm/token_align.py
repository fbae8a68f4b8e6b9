"""Alignment of the tokens that two tokenizers make of the same texts.

The ends of a tokenizer's tokens are cumulative byte counts; a dictionary maps
each end to the place of its token.  The intersection of the two dictionaries'
keys, sorted, holds the offsets where both tokenizers end a token; they slice
both id lists into groups, and within a group the links (pairs of tokens whose
byte ranges overlap) are expanded by walking both slices.

Tasks work in *portions*: documents in a row until they hold ``PORTION_LINKS``
links.  A portion is one written row: its different id pairs with the number of
its documents that hold them, and per document the places of its pairs in that
list.  Counting pairs over the corpus sums portion counts, and the sums go back
to the portions, not to the documents: the pair that every document holds is one
row per portion.

Defined results

* null and empty texts, and texts whose tokens do not spell a blank and the text
  in either tokenizer (normalisers change some characters), have no tokens: zeros
  and an empty ``groups``;
* special strings inside a text are plain text;
* ties for the highest count of a first id all count as best;
* repeated rows, repeated and null ids are documents of their own and each counts;
* very long texts are one portion each; an empty table gives an empty table;
* ``keep`` columns come back as they are, except those named like a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, staged, worker_cache

PORTION_LINKS = 1 << 21
PORTION_DOCS = 4096
BATCH_TEXTS = 128
#: Stretches that a worker remembers, in each of two generations, and the longest of them.
MEMORY, LONGEST = 250_000, 64

LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", '.,;:!?&%*#")]}'
#: Where a stretch begins: at a blank or line end after something else (but not at the last character), and at
#: a mark after a Latin letter.
CUT = re.compile(rf"(?<=\S)(?=[ \n].)|(?<=[{LATIN}])(?=[{re.escape(MARKS)}])", re.S)
#: What a stretch is put behind where there is none before it.
FIRST = " a"

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCORES = ("n_best", "count_sum")
MADE = (*COUNTS, *SCORES, "groups", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, are
    the letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a blank and the text by a byte-level tokenizer file (.json), and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.made_of = json.load(f)
        letters = byte_letters()
        self.bytes = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for word, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()

    def cuts_at_words(self) -> bool:
        """Whether white space after another character, and a mark after a letter, always begins a pre-token.

        They do under the usual pattern, in which white space stands only at the
        start of a pre-token or in one of nothing else, and letters and marks in
        different ones, where nothing is normalised and no added token is looked
        for in texts.
        """
        pre, model = self.made_of.get("pre_tokenizer") or {}, self.made_of.get("model") or {}
        return (self.made_of.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True
                and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
                and all(t["special"] for t in self.made_of.get("added_tokens", [])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Ids of the text by a sentencepiece model, which puts a blank before it, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def cuts_at_words(self) -> bool:
        """Whether no piece holds a blank or line end, or a mark after a letter, behind its start, and texts stay as they are.

        No merge then reaches over the end of a word, and the segmentation of
        one word does not depend on another.
        """
        probe = "e\u0301  \ufb01 \u0308\u00a0 x "
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        mark = re.compile(f"[{LATIN}][{re.escape(MARKS)}]")
        return (not any("▁" in p.lstrip("▁") or "\n" in p or mark.search(p) for p in pieces)
                and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def load(path: str):
    held = worker_cache()
    if ("align", path) not in held:
        held["align", path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return held["align", path]


class Aligner:
    """Groups and links of two id lists that spell the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = load(path_a), load(path_b)
        self.len_a, self.len_b = ([len(x) for x in t.bytes] for t in (self.a, self.b))
        self.name_a, self.name_b = ([str(i) for i in range(len(t.bytes))] for t in (self.a, self.b))
        self.base = len(self.b.bytes)
        self.cuts = self.a.cuts_at_words() and self.b.cuts_at_words()
        self.young: dict = {}
        self.old: dict = {}

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, np.ndarray, str]]:
        """n_a, n_b, n_groups, links (as ``a * base + b``) and groups of each text."""
        each = [CUT.split(" " + t) if self.cuts else [" " + t] for t in texts]
        known = self.stretches({c for cs in each for c in cs})
        for text, cs in zip(texts, each):
            found = list(map(known.__getitem__, cs)) if text else [None]
            if None in found:
                yield 0, 0, 0, np.zeros(0, np.int64), ""
            else:
                n_a, n_b, n_groups, links, groups = zip(*found)
                yield sum(n_a), sum(n_b), sum(n_groups), np.frombuffer(b"".join(links), np.int64), ";".join(groups)

    def stretches(self, wanted: set[str]) -> dict:
        """What each stretch aligns to; None where the tokens do not spell it."""
        out, new = {}, []
        young, old, unknown = self.young.get, self.old.get, self
        for c in wanted:
            v = young(c, unknown)
            if v is unknown:
                v = old(c, unknown)
                if v is unknown:
                    new.append(c)
                    continue
                self.remember(c, v)
            out[c] = v
        # Stretches that end in no white space are, put together, one text that is cut where they meet.
        plain = [c for c in new if self.cuts and not c[-1:].isspace()]
        found = self.joined(plain) if plain else []
        if found is None:
            plain, found = [], []
        alone = set(new).difference(plain)
        for c, v in chain(zip(plain, found), zip(alone, map(self.one, alone))):
            out[c] = v
            self.remember(c, v)
        return out

    def one(self, c: str):
        found = self.joined([c])
        return None if found is None else found[0]

    def joined(self, stretches: list[str]) -> list[tuple] | None:
        """n_a, n_b, n_groups, links and groups of each; None where tokens do not spell the text."""
        parts = [p for i, c in enumerate(stretches)
                 for p in ((FIRST, c) if self.cuts and (not i or c[0] not in " \n") else (c,))]
        text = "".join(parts)
        (x,), (y,) = self.a.encode([text[1:]]), self.b.encode([text[1:]])
        spelt = text.encode()
        if b"".join(map(self.a.bytes.__getitem__, x)) != spelt or b"".join(map(self.b.bytes.__getitem__, y)) != spelt:
            return None
        groups, links, end_a, end_b, so_far = self.align(x, y)
        links, out = array("q", links).tobytes(), []
        at = p = q = g = n = 0
        for c in parts:
            at += len(c.encode())
            (g1, n1), p1, q1 = so_far[at], end_a[at], end_b[at]
            if c is not FIRST:
                out.append((p1 - p, q1 - q, g1 - g, links[8 * n:8 * n1], ";".join(groups[g:g1])))
            p, q, g, n = p1, q1, g1, n1
        return out

    def remember(self, c: str, value) -> None:
        if len(c) <= LONGEST:
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[c] = value

    def align(self, x: list[int], y: list[int]) -> tuple[list[str], list[int], dict, dict, dict]:
        """Groups as ``a1,a2|b1`` and links as ``a * base + b``, in the order of the text.

        Also the dictionaries from ends to the tokens up to there, of both lists,
        and from common ends to the groups and links up to there.
        """
        base, name_a, name_b = self.base, self.name_a, self.name_b
        end_a = dict(zip(accumulate([self.len_a[t] for t in x]), range(1, len(x) + 1)))
        end_b = dict(zip(accumulate([self.len_b[t] for t in y]), range(1, len(y) + 1)))
        groups, links, so_far = [], [], {}
        i = j = 0
        for end in sorted(end_a.keys() & end_b.keys()):
            p, q = end_a[end], end_b[end]
            if p - i == 1 and q - j == 1:
                groups.append(name_a[x[i]] + "|" + name_b[y[j]])
                links.append(x[i] * base + y[j])
            else:
                own_a, own_b = x[i:p], y[j:q]
                groups.append(",".join([name_a[t] for t in own_a]) + "|" + ",".join([name_b[t] for t in own_b]))
                if p - i == 1:
                    links += [x[i] * base + t for t in own_b]
                elif q - j == 1:
                    links += [t * base + y[j] for t in own_a]
                else:
                    links += self.overlaps(own_a, own_b)
            so_far[end] = len(groups), len(links)
            i, j = p, q
        return groups, links, end_a, end_b, so_far

    def overlaps(self, x: list[int], y: list[int]) -> Iterator[int]:
        """Links of a group: both slices start and end together."""
        u = v = 0
        end_u, end_v = self.len_a[x[0]], self.len_b[y[0]]
        while True:
            yield x[u] * self.base + y[v]
            if end_u == end_v:
                # only the group's end is common
                return
            if end_u < end_v:
                u += 1
                end_u += self.len_a[x[u]]
            else:
                v += 1
                end_v += self.len_b[y[v]]


def cached_aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner: what it remembers serves all tasks of the worker."""
    held = worker_cache()
    if ("aligner", path_a, path_b) not in held:
        held["aligner", path_a, path_b] = Aligner(path_a, path_b)
    return held["aligner", path_a, path_b]


class Portion:
    """Documents in a row, until they hold enough links."""

    def __init__(self, most_links: int = PORTION_LINKS):
        self.rows, self.keys, self.times, self.n_links, self.most_links = [], [], [], 0, most_links

    def add(self, row: tuple, links: np.ndarray) -> None:
        keys, times = np.unique(links, return_counts=True)
        self.rows.append(row)
        self.keys.append(keys)
        self.times.append(times)
        self.n_links += len(links)

    def full(self) -> bool:
        return self.n_links >= self.most_links or len(self.rows) >= PORTION_DOCS

    def pairs(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The different pairs, the documents that hold each, and the documents' places in that list."""
        keys, places, held = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True,
                                       return_counts=True)
        sizes = np.array([len(k) for k in self.keys], dtype="<u4")
        times = np.concatenate([np.zeros(0, np.int64), *self.times]).astype("<u4")
        return keys, held, zlib.compress(sizes.tobytes() + places.astype("<u4").tobytes() + times.tobytes(), 1)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, places and times of ``n`` documents, as ``Portion.pairs`` packed them."""
    every = np.frombuffer(zlib.decompress(blob), dtype="<u4")
    sizes, m = every[:n].astype(np.int64), (len(every) - n) // 2
    return sizes, every[n:n + m], every[n + m:].astype(np.int64)


def portions(docs: DataFrame, path_a: str, path_b: str, text_col: str, keep: list[str], groups: str,
             portion_links: int = PORTION_LINKS) -> DataFrame:
    """One row per portion: portion, a, b, held (arrays), the documents' columns as arrays, links."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [f for f in docs.schema.fields if f.name in keep and f.name.lower() not in MADE]
    made = T.StructType([T.StructField("portion", T.LongType()),
                         *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a", "b", "held")],
                         T.StructField("links", T.BinaryType()),
                         *[T.StructField(f"made_{n}", T.ArrayType(T.LongType())) for n in COUNTS],
                         T.StructField("made_groups", T.ArrayType(T.StringType())),
                         *[T.StructField(f"kept_{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept)]])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in made])
    names = [f.name for f in kept]

    def row_of(p: Portion, number: int, base: int):
        keys, held, links = p.pairs()
        columns = [[number], [keys // base], [keys % base], [held], [links], *([list(c)] for c in zip(*p.rows))]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator) -> Iterator:
        aligner = cached_aligner(path_a, path_b)
        first, n, p = TaskContext.get().partitionId() << 32, 0, Portion(portion_links)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                values = [part.column(part.schema.get_field_index(c)).to_pylist() for c in names]
                for k, (n_a, n_b, n_groups, links, said) in enumerate(aligner.texts(texts)):
                    if groups == "sha256" and said:
                        said = hashlib.sha256(said.encode()).hexdigest()
                    p.add((n_a, n_b, n_groups, len(links), said, *[v[k] for v in values]), links)
                    if p.full():
                        yield row_of(p, first + n, aligner.base)
                        n, p = n + 1, Portion(portion_links)
        if p.rows:
            yield row_of(p, first + n, aligner.base)

    return map_arrow(docs.select(text_col, *[c for c in names if c != text_col]), run, made)


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, docs (documents that hold the pair linked) and best (whether it is the highest of its a)."""
    held = written.select(F.explode(F.arrays_zip("a", "b", "held")).alias("p")).select("p.*")
    counts = held.groupBy("a", "b").agg(F.sum("held").alias("docs"))
    # an id of the first vocabulary meets at most all ids of the second
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None,
          groups: str = "text", portion_links: int = PORTION_LINKS) -> DataFrame:
    """``keep`` columns (default: all) and, per document, the figures of its alignment.

    n_a, n_b, n_groups, n_links; ``groups``, the groups as ``a1,a2|b1;a3|b2,b3``
    (with ``groups="sha256"`` their SHA-256 in ``groups_sha256`` instead);
    n_best, links whose pair is held by as many documents as any pair of its
    first id; count_sum, the documents that hold the pair, summed over links.
    The files must be at the same place on every machine.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups must be text or sha256")
    keep = docs.columns if keep is None else keep
    kept = [f for f in docs.schema.fields if f.name in keep and f.name.lower() not in MADE]
    written = staged(portions(docs, path_a, path_b, text_col, keep, groups, portion_links), "portions")
    counts = staged(pair_counts(written), "pair-counts")
    pairs = written.select("portion", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")) \
        .select("portion", "place", "p.a", "p.b")
    back = (pairs.join(counts, ["a", "b"]).groupBy("portion")
            .agg(F.sort_array(F.collect_list(F.struct("place", "docs", "best"))).alias("found"))
            .select("portion", F.col("found.docs").alias("docs"), F.col("found.best").alias("best")))
    both = written.drop("a", "b", "held").join(back, "portion", "left")
    return unrolled(both, kept, "groups" if groups == "text" else "groups_sha256")


def unrolled(portions_with_counts: DataFrame, kept: list[T.StructField], groups_col: str) -> DataFrame:
    """The documents of each portion, with ``n_best`` and ``count_sum``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in COUNTS],
                           *[T.StructField(n, T.LongType()) for n in SCORES], T.StructField(groups_col, T.StringType())])
    names = [f.name for f in schema.fields]
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def flat(batch, name: str, k: int):
        return batch.column(batch.schema.get_field_index(name))[k].values

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for k in range(batch.num_rows):
                made = [flat(batch, f"made_{n}", k) for n in COUNTS]
                sizes, places, times = unpacked(batch.column(batch.schema.get_field_index("links"))[k].as_py(), len(made[0]))
                if len(places):
                    docs = flat(batch, "docs", k).to_numpy(zero_copy_only=False)[places]
                    best = flat(batch, "best", k).to_numpy(zero_copy_only=False)[places]
                    ends = np.cumsum(sizes)
                    sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
                            for v in (times * best, times * docs)]
                else:
                    sums = [np.zeros(len(sizes), np.int64)] * 2
                columns = [*[flat(batch, f"kept_{i}", k) for i in range(len(kept))], *made, *sums,
                           flat(batch, "made_groups", k)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types)],
                    names=names)

    return map_arrow(portions_with_counts, run, schema)
