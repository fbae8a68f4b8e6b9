"""Removal of repeated word sequences by fixed-block anchors.

Any window of ``size`` words holds a whole block of ``(size + 1) // 2`` words at
a multiple of that number.  So the non-overlapping blocks of every string are
indexed, every rolling window of block length probes the index, and the places
that share a block are extended to both sides together: two places have a
window in common if they agree in o words to the left and in the rest to the
right, for some o.  Extending classes of places, not pairs, keeps the work in
proportion to the places.

The strings compared are those that share an anchor (see ``windows``); equal
windows always do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import FACTOR, GROUP_LIMIT, Hashes, covered, cut_out, mixed, repeated_windows, runs_of, word_units

SIZE = 35
GRAM = 6


def fixed_blocks(size: int):
    """Solver of a portion: which windows of ``size`` words occur again in their group."""
    block = (size + 1) // 2
    spare = size - block

    def solve(group: np.ndarray, offset: np.ndarray, strings: list) -> list:
        words = np.frombuffer(b"".join(strings), dtype=np.uint64)
        count = np.array([len(s) // 8 for s in strings])
        begin = np.cumsum(count) - count
        end = begin + count
        which = np.repeat(np.arange(len(strings)), count)
        place = np.arange(len(words))
        flags = np.zeros(len(words), dtype=bool)
        hashes = Hashes(words)
        probe = place[place + block <= end[which]]
        salt = mixed(group.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
        key = mixed(hashes.of(probe, probe + block) ^ salt[which[probe]])
        # The index: reference blocks at multiples of the block length.
        index = np.unique(key[(probe - begin[which[probe]]) % block == 0])
        at = np.minimum(np.searchsorted(index, key), len(index) - 1)
        hit = index[at] == key
        probe, entry = probe[hit], at[hit]
        met = np.bincount(entry, minlength=len(index)) > 1
        probe, entry = probe[met[entry]], entry[met[entry]]
        first, last = begin[which[probe]], end[which[probe]]
        for o in range(spare + 1):
            ok = (probe - o >= first) & (probe - o + size <= last)
            start = probe[ok] - o
            # Places of one block that agree on both sides.
            sides = mixed(hashes.of(start, start + size) ^ (entry[ok].astype(np.uint64) * np.uint64(FACTOR)))
            ordered = np.argsort(sides, kind="stable")
            same = sides[ordered][1:] == sides[ordered][:-1]
            flags[start[ordered[1:][same]]] = True
            flags[start[ordered[:-1][same]]] = True
        return [flags[b:b + c - size + 1] for b, c in zip(begin, count)]

    return solve


def repeated_words(docs: DataFrame, size: int = SIZE, gram: int = GRAM, limit: int = GROUP_LIMIT) -> DataFrame:
    return repeated_windows(docs, word_units, size, min(gram, size), fixed_blocks(size), raw=False, limit=limit, chunk=8)


FIELDS = T.StructType([
    T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                       T.StructField("end", T.LongType())])))])


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """All columns (or ``keep``) plus ``kept`` (words joined by a space), ``n_words``, ``n_removed``, ``removed``.

    Each word covered by a window of ``size`` words that also starts anywhere
    else, in the same document or another, is removed; windows do not cross
    documents and are judged on the input.  Null text has no words, and
    texts of fewer words than a window are kept whole.  Rows that repeat an id
    are documents of their own.
    """

    def work(data: bytes, ranges: list | None) -> tuple:
        words = data.split()
        mask = covered(len(words), ranges, size)
        stay = [w for w, m in zip(words, mask.tolist()) if not m] if ranges else words
        spans = [{"start": a, "end": b + 1} for a, b in runs_of(mask)] if ranges else []
        return b" ".join(stay).decode(), len(words), int(mask.sum()), spans

    return cut_out(docs, lambda rows: repeated_words(rows, size, limit=limit), work, FIELDS, id_col, text_col, keep)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of ``without_repeats``."""
    got = without_repeats(docs, size, keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
