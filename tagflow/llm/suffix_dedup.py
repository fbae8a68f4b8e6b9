"""Removal of repeated byte strings by column-wise construction of suffix structures.

The strings that share an anchor (see ``windows``) are one collection.  Its
suffixes are sorted column by column, as in the multi-document construction of
Bauer, Cox and Rosone (2013): all strings are taken from their right ends, and
each round puts the next symbol of every string in front of its suffix.  The
Burrows-Wheeler column, the symbols before the sorted suffixes, is what the
next round sorts by: a stable sort of it maps every suffix to its place (the
LF mapping).  The common prefixes of neighbours follow along: one more than
the least of those between the two before if their symbols agree, else none.

A window is repeated if a neighbour of its suffix shares at least ``size``
bytes.  Since equal windows lie at the same distance from the anchor, suffixes
of one distance only are compared: the columns of different distances are never
merged, and a round reads and writes the current column and the current
prefixes from end to end, no more.  A portion is bounded (``windows``), so
these sequential files are kept as arrays in the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import GROUP_LIMIT, byte_units, covered, cut_out, repeated_windows, runs_of

SIZE = 400
GRAM = 32


def column_matrix(offset: np.ndarray, strings: list) -> np.ndarray:
    """Symbols by column, right to left, aligned at the anchor.

    Symbol 0 stands for no symbol: right of a string's end or left of its start.
    """
    size = np.array([len(s) for s in strings])
    most = int((size - offset).max())             # symbols from the anchor on
    out = np.zeros((most + int(offset.max()), len(strings)), dtype=np.uint16)
    for i, s in enumerate(strings):
        first = most + int(offset[i]) - len(s)
        out[first:first + len(s), i] = np.frombuffer(s, dtype=np.uint8)[::-1]
        out[first:first + len(s), i] += np.uint16(1)
    return out


def column_wise(size: int):
    """Solver of a portion: which windows of ``size`` bytes occur again in their group."""

    def solve(group: np.ndarray, offset: np.ndarray, strings: list) -> list:
        symbols = column_matrix(offset, strings)
        lengths = np.array([len(s) for s in strings])
        most = int((lengths - offset).max())
        n = len(strings)
        base = group.astype(np.int64) * 257
        order = np.arange(n)                     # strings by the suffix inserted so far
        common = np.zeros(n + 1, dtype=np.int32)  # of each suffix and the one before it
        flags = np.zeros((len(symbols), n), dtype=bool)
        for step, column in enumerate(symbols):
            bwt = column[order].astype(np.int64)
            key = base[order] + bwt
            if np.all(key[1:] >= key[:-1]):
                same = np.concatenate(([False], (key[1:] == key[:-1]) & (bwt[1:] > 0)))
                common[:n] = np.where(same, common[:n] + 1, 0)
            else:
                to = np.argsort(key, kind="stable")
                key, bwt = key[to], bwt[to]
                same = np.concatenate(([False], (key[1:] == key[:-1]) & (bwt[1:] > 0)))
                new = np.zeros(n + 1, dtype=np.int32)
                j = np.flatnonzero(same)
                before, now = to[j - 1], to[j]
                near = now == before + 1
                new[j[near]] = common[now[near]] + 1
                far = ~near
                if far.any():
                    ends = np.stack([before[far] + 1, now[far] + 1], axis=1).ravel()
                    new[j[far]] = np.minimum.reduceat(common, ends)[0::2] + 1
                common, order = new, order[to]
            if step + 1 >= size:
                hit = common[:n] >= size
                hit[:-1] |= hit[1:]
                flags[step, order[hit]] = True
        out = []
        for i in range(n):
            # Window w starts at column offset - w before the anchor.
            wins = lengths[i] - size + 1
            at = most - 1 + offset[i] - np.arange(wins)
            out.append(flags[at, i])
        return out

    return solve


def repeated_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, limit: int = GROUP_LIMIT) -> DataFrame:
    return repeated_windows(docs, byte_units, size, min(gram, size), column_wise(size), raw=True, limit=limit, chunk=32)


FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                       T.StructField("end", T.LongType())])))])


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, limit: int = GROUP_LIMIT, as_text: bool = False) -> DataFrame:
    """All columns (or ``keep``) plus ``kept``, ``n_bytes``, ``n_removed`` and the spans ``removed``.

    ``kept`` has the remaining bytes; with ``as_text`` it is a string, in which
    the bytes of characters that a cut has split are left out.

    Each byte covered by a string of ``size`` bytes that also starts anywhere
    else, in the same document or another, is removed; matches do not cross
    documents and are judged on the input.  Null text counts as empty, and
    texts shorter than ``size`` are kept whole.  Rows that repeat an id are
    documents of their own.
    """

    def work(data: bytes, ranges: list | None) -> tuple:
        mask = covered(len(data), ranges, size)
        kept = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes() if ranges else data
        spans = [{"start": a, "end": b + 1} for a, b in runs_of(mask)] if ranges else []
        return kept.decode("utf-8", "ignore") if as_text else kept, len(data), int(mask.sum()), spans

    fields = T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *FIELDS.fields])
    return cut_out(docs, lambda rows: repeated_bytes(rows, size, limit=limit), work, fields, id_col, text_col, keep)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats``."""
    got = without_repeats(docs, size, keep=["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


