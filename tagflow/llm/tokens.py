"""Token counts and ids of a published tokenizer file (``tokenizers`` JSON).

A tokenizer whose normaliser and pre-tokenizer never look across ASCII white
space gives the same ids piece by piece as for the whole text.  Texts are
therefore cut at ASCII white space and each distinct piece is worked out once
per worker; a bounded memory of pieces serves the repeats.  Whether a file
has that property is checked from its own description (``splits_at_space``);
other files are encoded text by text.

Token counts take the whole-token shortcut: ``whole_tokens`` proves, once and
for every vocabulary entry, which strings the merges turn into exactly one
token.  A pre-token that is such a string counts one without any merging;
only the rest goes through the merges.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, worker_cache

CACHE_PIECES = 250_000    # pieces in a generation of a worker's memory
CACHE_BYTES = 64          # longer pieces are worked out anew each time
SAFE_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splits_at_space(path: str) -> bool:
    """Whether texts may be cut at ASCII white space without changing ids.

    True for files that lower-case, compose and turn white space into one
    space, then drop the spaces by a split of the kept pattern, as this
    family of files does; anything else answers False.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm = d.get("normalizer") or {}
    steps = norm.get("normalizers", [norm])
    for s in steps:
        if s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ":
            continue
        if s.get("type") not in SAFE_NORMALIZERS - {"NFKC", "NFKD"}:
            return False
    pre = d.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [pre])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"]
                for t in d.get("added_tokens", []))
    return plain and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True \
        and r"\s" in str(split.get("pattern")) and " " not in str(split["pattern"].get("Regex", " "))


def whole_tokens(path: str) -> frozenset:
    """Every vocabulary string (as the pre-tokenizer writes it) that encodes alone as one token.

    The proof is by running the merges over each candidate once; the set is no
    larger than the vocabulary.
    """
    tok = load(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    found = set()
    for entry in model["vocab"]:
        if entry.endswith(end):
            word = entry[:len(entry) - len(end)]
            if word and len(tok.model.tokenize(word)) == 1:
                found.add(word)
    return frozenset(found)


class PreTokens:
    """The pre-tokens of a text without special strings, as the merges take them.

    Printable Latin-1 text is composed already and its classes are the same in
    all Unicode versions, so there the file's own pattern on the lower-cased
    text is all; other texts go through the library's normaliser and
    pre-tokenizer.
    """

    def __init__(self, path: str, tok, split: bool):
        import regex

        self.tok, self.find = tok, None
        if split:
            with open(path, encoding="utf-8") as f:
                d = json.load(f)
            pre = d["pre_tokenizer"]
            kinds = [s["type"] for s in pre.get("pretokenizers", [pre])]
            lower = any(s["type"] == "Lowercase" for s in d["normalizer"].get("normalizers", [d["normalizer"]]))
            if kinds == ["Split", "ByteLevel"] and lower:
                self.find = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
                self.level = {b: ord(c) for b, c in enumerate(byte_letters()) if chr(b) != c}

    def __call__(self, text: str) -> list:
        if self.find is not None and text.isprintable():
            if text.isascii():
                return self.find(text.lower())
            if max(text) <= "\xff":
                return [w.encode().decode("latin-1").translate(self.level) for w in self.find(text.lower())]
        tok = self.tok
        norm = tok.normalizer.normalize_str(text) if tok.normalizer else text
        return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(norm)]


def byte_letters() -> list:
    """The printable letter by which byte-level vocabularies write each byte.

    Printable Latin-1 characters stand for themselves; the other bytes get the
    letters from U+0100 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered:
    """What pieces of texts turn into; one per worker, file and use.

    ``find(text)`` works a piece out, ``join`` puts the values of a text's
    pieces together.  Two generations of pieces are remembered: when the young
    one is full it becomes the old one, so frequent pieces stay.
    """

    def __init__(self, path: str, split: bool):
        self.tok, self.split = load(path), split
        self.pre = PreTokens(path, self.tok, split)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special_bytes = [s.encode() for s in self.special]
        self.young: dict = {}
        self.old: dict = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def keep(self, piece: bytes, value) -> None:
        if len(piece) <= CACHE_BYTES:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = value

    def work_out(self, piece: bytes):
        value = self.old.get(piece)
        if value is None:
            # A closing mark after an ASCII letter or digit is a pre-token of its own.
            if len(piece) > 1 and piece[-1] in b",.;" and piece[-2:-1].isalnum():
                value = self.value(piece[:-1]) + self.value(piece[-1:])
            else:
                value = self.find(piece.decode())
        self.keep(piece, value)
        return value

    def value(self, piece: bytes):
        value = self.young.get(piece)
        return self.work_out(piece) if value is None else value

    def values(self, data: bytes) -> list:
        """The values of a text's pieces, cut at ASCII white space."""
        low = data.lower()                  # as the pieces are in any case, but for special strings
        if not any(s in data or s.lower() in low for s in self.special_bytes):
            data = low
        words = data.split()
        got = list(map(self.young.get, words))
        if None in got:
            value = self.value
            for i, v in enumerate(got):
                if v is None:
                    got[i] = value(words[i])
        return got


class Counter(Remembered):
    """Counts tokens of byte strings."""

    def __init__(self, path: str, whole: frozenset, split: bool):
        super().__init__(path, split)
        self.whole = whole

    def find(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        merge, whole = self.tok.model.tokenize, self.whole
        return sum(1 if w in whole else len(merge(w)) for w in self.pre(text))

    def count(self, data: bytes | None) -> int:
        if not data:
            return 0
        return sum(self.values(data)) if self.split else self.find(data.decode())


class Encoder(Remembered):
    """Token ids of byte strings as little-endian 32-bit words."""

    def find(self, text: str) -> bytes:
        if not self.split or any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            merge = self.tok.model.tokenize
            ids = [t.id for w in self.pre(text) for t in merge(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, data: bytes | None) -> bytes:
        if not data:
            return b""
        return b"".join(self.values(data)) if self.split else self.find(data.decode())


def cached_counter(path: str, whole: frozenset, split: bool) -> Counter:
    held = worker_cache()
    if ("count", path) not in held:
        held["count", path] = Counter(path, whole, split)
    return held["count", path]


def cached_encoder(path: str, split: bool) -> Encoder:
    held = worker_cache()
    if ("encode", path) not in held:
        held["encode", path] = Encoder(path, split)
    return held["encode", path]


def token_counts(docs: DataFrame, path: str, limit: int, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` is a tokenizer file at the same place on every machine.  Null text
    counts as empty; no begin, end or padding tokens are added, and nothing is
    truncated.  The proven whole tokens are sent along (one set, at most the
    vocabulary).
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    split = splits_at_space(path)
    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])

    def compute(col):
        counter = cached_counter(path, whole.value, split)
        data = as_bytes(col)
        n = [counter.count(b) for b in data]
        return [[len(b or b"") for b in data], n, [k > limit for k in n]]

    return append_columns(docs, fields, [text_col], compute, keep)
