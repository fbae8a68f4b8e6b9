"""Repeated windows of a fixed length, over bytes or words, dealt out by minimum substrings.

A window of ``size`` units (bytes or words) is dealt by the smallest hash of
its grams of ``gram`` units (minimum substring partitioning): equal windows
have the same smallest gram at the same place in them, so they always meet.
Neighbouring windows mostly share that gram (the anchor); each run of windows
with one anchor is one string, the text from its first window's start to its
last window's end.  So the corpus becomes a slim table of about two anchors
per ``size`` units, and only strings whose anchor occurs again are ever
moved:

1. Anchors with their string's hash are written once.  An aggregate finds
   the anchors that occur twice or more.
2. Equal strings of an anchor are one row with a count from here on, so any
   number of copies is one string (and wholly repeated).  An anchor whose
   strings are all equal is done.
3. The remaining distinct strings go to their anchor's group, and a solver
   (the operator's own method) finds the repeated windows of each group.
   Groups are streamed through a task in bounded portions.
4. An anchor with more than ``limit`` distinct strings, such as a passage that
   a large part of all documents quotes, is not gathered: its windows are
   compared as hashes by aggregates, first in chunks (the units that all
   windows of a chunk share), then one by one in the chunks that occur again.
5. The repeated windows go back to all members of the strings, and by document
   to the texts.

Texts are told apart by a 64-bit hash of grams, plus a 64-bit hash of strings;
all counting is over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, map_arrow, parts_of, staged, unstage, with_unique_ids, worker_cache

GROUP_LIMIT = 4096          # distinct strings of one anchor that a task may hold
PORTION_ROWS = 8192         # strings worked on together: whole groups up to one of these bounds
PORTION_BYTES = 4 << 20
CUT_ROWS = 4096             # strings of a batch
LONG = 1 << 19              # window starts of a text worked on together
FACTOR = 0x9E3779B97F4A7C15
U = np.uint64

ANCHOR = T.StructType([T.StructField("h", T.LongType()), T.StructField("sh", T.LongType()),
                       T.StructField("_rid", T.LongType()), T.StructField("p", T.IntegerType()),
                       T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
STRING = T.StructType([T.StructField("h", T.LongType()), T.StructField("sh", T.LongType()),
                       T.StructField("n", T.LongType()), T.StructField("large", T.BooleanType()),
                       T.StructField("off", T.IntegerType()), T.StructField("s", T.BinaryType())])
RUN = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])
RUNS = T.StructType([T.StructField("h", T.LongType()), T.StructField("sh", T.LongType()),
                     T.StructField("runs", T.ArrayType(RUN))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverse modulo 2 ** 64, for i < n."""
    held = worker_cache()
    if "powers" not in held or len(held["powers"][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for f in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            x = np.full(size, f, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        held["powers"] = tuple(both)
    return held["powers"]


class Hashes:
    """Hashes of all stretches of an array of 64-bit unit values."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * up[:len(units)], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def byte_units(data: bytes) -> np.ndarray:
    """A 64-bit value per byte."""
    held = worker_cache()
    if "bytes" not in held:
        held["bytes"] = mixed(np.arange(1, 257, dtype=np.uint64) * U(FACTOR))
    return held["bytes"][np.frombuffer(data, dtype=np.uint8)]


def word_units(data: bytes) -> np.ndarray:
    """A 64-bit hash per word, words being runs without ASCII white space."""
    import xxhash

    return np.array([*map(xxhash.xxh3_64_intdigest, data.split())], dtype=np.uint64)


def anchors_of(units: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """``h, sh, p, a, b`` of the anchors of a text: each owns the windows that start in a..b."""
    parts = []
    for base in range(0, len(units) - size + 1, LONG):
        hashes = Hashes(units[base:base + LONG + size - 1])
        g = hashes.all_of(gram)
        width = size - gram + 1
        wins = len(g) - width + 1
        low = U((1 << 20) - 1)
        key = np.full(-(-len(g) // width) * width, U(2 ** 64 - 1))
        key[:len(g)] = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        rows = key.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        p = (np.minimum(behind[:wins], ahead[width - 1:width - 1 + wins]) & low).astype(np.int64)
        cut = np.flatnonzero(p[1:] != p[:-1]) + 1
        a = np.append(0, cut)
        b = np.append(cut, wins) - 1
        p = p[a]
        sh = mixed(hashes.of(a, b + size) + (p - a).astype(np.uint64))
        parts.append((g[p], sh, p + base, a + base, b + base))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else ()


def find_anchors(docs: DataFrame, to_units: Callable, size: int, gram: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts_of(batches):
            rids = batch.column(batch.schema.get_field_index("_rid")).to_pylist()
            got = []
            for rid, data in zip(rids, as_bytes(batch.column(batch.schema.get_field_index("text")))):
                found = anchors_of(to_units(data), size, gram) if data else ()
                if found:
                    got.append((*found, np.full(len(found[0]), rid)))
            if got:
                h, sh, p, a, b, r = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(r),
                     *(pa.array(x.astype(np.int32)) for x in (p, a, b))], names=ANCHOR.names)

    return map_arrow(docs.select("_rid", "text"), run, ANCHOR)


def packed(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_z``, the text in compressed form, for shuffles that move whole texts."""
    import zstandard

    def compute(col):
        z = zstandard.ZstdCompressor(level=1)
        return [[None if b is None else z.compress(b) for b in as_bytes(col)]]

    return append_columns(docs, T.StructType([T.StructField("_z", T.BinaryType())]), [text_col], compute, keep)


def unpacked(col) -> list:
    """Texts as bytes from an Arrow column that ``packed`` made."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [None if b is None else z.decompress(b) for b in col.to_pylist()]


def cut_strings(docs: DataFrame, wanted: DataFrame, to_units: Callable | None, size: int) -> DataFrame:
    """The strings of ``wanted`` (h, sh, n, large, _rid, p, a, b), cut from their documents."""
    per = wanted.groupBy("_rid").agg(F.collect_list(F.struct("h", "sh", "n", "large", "p", "a", "b")).alias("want"))
    types = ("int64", "int64", "int64", "bool_", "int32", "binary")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows):
            cols = [pa.array(c, getattr(pa, t)()) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(cols, names=STRING.names)

        for batch in parts_of(batches):
            rows = []
            want = batch.column(batch.schema.get_field_index("want")).to_pylist()
            for data, ws in zip(unpacked(batch.column(batch.schema.get_field_index("_z"))), want):
                units = to_units(data) if to_units else data
                for w in ws:
                    s = units[w["a"]:w["b"] + size]
                    rows.append((w["h"], w["sh"], w["n"], w["large"], w["p"] - w["a"], s if to_units is None else s.tobytes()))
                if len(rows) >= CUT_ROWS:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    # Merged even where one side is small: a broadcast would put both Python steps into one task,
    # with a worker process for each.
    joined = packed(docs, "text", ["_rid"]).join(per.hint("merge"), "_rid")
    return map_arrow(joined.select("_z", "want"), run, STRING)


def runs_of(flags: np.ndarray) -> list:
    """``[(first, last)]`` of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


def solve_groups(strings: DataFrame, solver: Callable, size: int, unit_bytes: int) -> DataFrame:
    """Repeated windows of each string, by ``solver`` on portions of whole groups.

    ``solver(group, offset, strings)`` gets arrays for strings sorted by group
    and returns one boolean array per string: which windows occur again in
    its group.  A string that stands for several equal ones is wholly
    repeated.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def emit():
            h = np.array([r[0] for r in held])
            group = np.append(0, np.cumsum(h[1:] != h[:-1]))
            flags = solver(group, np.array([r[4] for r in held]), [r[5] for r in held])
            rows = []
            for r, f in zip(held, flags):
                wins = len(r[5]) // unit_bytes - size + 1
                runs = [(0, wins - 1)] if r[2] > 1 else runs_of(f)
                if runs:
                    rows.append((r[0], r[1], [{"i": i, "j": j} for i, j in runs]))
            held.clear()
            kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], kind)], names=RUNS.names)

        total = 0
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in STRING.names]
            for r in zip(*cols):
                if held and r[0] != held[-1][0] and (len(held) >= PORTION_ROWS or total >= PORTION_BYTES):
                    yield emit()
                    total = 0
                held.append(r)
                total += len(r[5])
        if held:
            yield emit()

    return map_arrow(strings.repartition("h").sortWithinPartitions("h", "sh"), run, RUNS)


def spread_runs(strings: DataFrame, from_string: Callable, size: int, chunk: int, unit_bytes: int) -> DataFrame:
    """Repeated windows of the strings of very large groups, by aggregates of window hashes.

    Windows are told by their place before the anchor.  All windows of a chunk
    of places share their core; only chunks whose core occurs in another
    string are looked at window by window.
    """
    key = T.StructType([T.StructField("k", T.LongType()), T.StructField("h", T.LongType()),
                        T.StructField("sh", T.LongType()), T.StructField("at", T.IntegerType())])

    def rows(batches: Iterator, fine: bool) -> Iterator:
        import pyarrow as pa

        for batch in parts_of(batches):
            got = []
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
            for x, (h, sh, off, s) in enumerate(zip(cols["h"], cols["sh"], cols["off"], cols["s"])):
                units = from_string(s)
                hashes = Hashes(units)
                place = off - np.arange(len(units) - size + 1)     # of each window
                if fine:
                    at = place[np.isin(place // chunk, cols["chunks"][x])]
                    found = hashes.of(off - at, off - at + size)
                else:
                    at = np.unique(place // chunk)
                    found = hashes.of(off - at * chunk, off - at * chunk - chunk + 1 + size)
                k = mixed(found + np.array([h]).view(np.uint64) * U(FACTOR) + at.astype(np.uint64))
                got.append((k.view(np.int64), np.full(len(k), h), np.full(len(k), sh), at.astype(np.int32)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=key.names)

    def again(found: DataFrame) -> DataFrame:
        more = found.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
        return found.join(more, "k", "left_semi")

    coarse = map_arrow(strings, lambda b: rows(b, False), key)
    chunks = again(coarse).groupBy("h", "sh").agg(F.collect_set("at").alias("chunks"))
    fine = map_arrow(strings.join(chunks, ["h", "sh"]), lambda b: rows(b, True), key)
    places = again(fine).groupBy("h", "sh").agg(F.array_sort(F.collect_set("at")).alias("at"))
    rest = strings.select("h", "sh", "n", "off", F.length("s").alias("bytes")).join(places, ["h", "sh"], "left")

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
            out = []
            for h, sh, n, off, size_of, at in zip(*(cols[c] for c in ("h", "sh", "n", "off", "bytes", "at"))):
                flags = np.full(size_of // unit_bytes - size + 1, n > 1)
                flags[off - np.array(at or [], dtype=np.int64)] = True
                found = runs_of(flags)
                if found:
                    out.append((h, sh, [{"i": i, "j": j} for i, j in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), kind))], names=RUNS.names)

    return map_arrow(rest, runs, RUNS)


def repeated_windows(docs: DataFrame, to_units: Callable, size: int, gram: int, solver: Callable, raw: bool,
                     limit: int = GROUP_LIMIT, chunk: int = 16) -> DataFrame:
    """``(_rid, ranges)``: the starts ``[a, b]`` of windows that occur elsewhere too.

    ``docs`` has ``_rid`` (unique) and ``text``.  ``raw`` tells that strings are
    the text's bytes; otherwise they are arrays of 64-bit units.  A window
    counts as repeated if its units also start at any other place of any
    document, its own included.  Documents without repeated windows have no row.
    """
    unit_bytes = 1 if raw else 8
    from_string = to_units if raw else (lambda s: np.frombuffer(s, dtype=np.uint64))
    anchors = staged(find_anchors(docs, to_units, size, gram), "anchors")
    again = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min("sh").alias("lo"), F.max("sh").alias("hi"))
    # Written, so that both sides of the join are shuffled for it and a frequent anchor can be split.
    again = staged(again.where("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "again")
    members = staged(anchors.join(again, "h"), "members")
    unstage(anchors, again)
    kinds = members.where("mixed").groupBy("h", "sh").agg(
        F.count("*").alias("n"), F.min(F.struct("_rid", "p", "a", "b")).alias("one"))
    kinds = staged(kinds.select("h", "sh", "n", "one.*"), "kinds")
    large = kinds.groupBy("h").count().where(F.col("count") > limit).select("h", F.lit(True).alias("large"))
    large = staged(large, "large")
    any_large = large.limit(1).count() > 0
    wanted = kinds.join(large, "h", "left") if any_large else kinds.withColumn("large", F.lit(False))
    strings = cut_strings(docs, wanted.withColumn("large", F.coalesce("large", F.lit(False))),
                          None if raw else to_units, size)
    if any_large:
        strings = staged(strings, "strings")
    found = solve_groups(strings.where("not large") if any_large else strings, solver, size, unit_bytes)
    if any_large:
        found = found.unionByName(spread_runs(strings.where("large"), from_string, size, chunk, unit_bytes))
    found = staged(found, "found")
    unstage(kinds, large, *([strings] if any_large else []))
    parts = members.where("mixed").join(found, ["h", "sh"]).select("_rid", "a", F.explode("runs").alias("r")).select(
        "_rid", (F.col("a") + F.col("r.i")).alias("a"), (F.col("a") + F.col("r.j")).alias("b"))
    parts = parts.unionByName(members.where("not mixed").select("_rid", "a", "b"))
    return parts.groupBy("_rid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def cut_out(docs: DataFrame, find: Callable, work: Callable, fields: T.StructType, id_col: str, text_col: str,
            keep: list[str] | None) -> DataFrame:
    """All columns of ``docs`` (or ``keep``) plus ``fields``.

    ``find(rows)`` gives the ranges of rows ``(_rid, text)``, ``work(bytes,
    ranges)`` the values of ``fields`` for a text.  Columns named like a result
    are replaced, and ``_rid``, ``_text``, ``_z`` and ``ranges`` are working names
    that do not come back.
    """
    drop = {"_rid", "_text", "_z", "ranges", *(f.name.lower() for f in fields)}
    cols = [c for c in docs.columns if (keep is None or c in keep) and c.lower() not in drop]
    named = docs.select(*dict.fromkeys([*cols, id_col, text_col]))
    others = [F.col(c) for c in cols if c != text_col]
    rows = with_unique_ids(named, id_col, [*others, F.col(text_col).alias("_text")])
    ranges = find(rows.select("_rid", F.col("_text").alias("text")))
    joined = packed(rows, "_text", [c for c in rows.columns if c != "_text"])
    joined = joined.join(ranges.hint("merge"), "_rid", "left")
    back = text_col in cols
    out = T.StructType([*([T.StructField(text_col, T.StringType())] if back else []), *fields.fields])

    def compute(z, found):
        texts = unpacked(z)
        done = list(zip(*(work(b or b"", rs) for b, rs in zip(texts, found.to_pylist()))))
        return [[None if b is None else b.decode() for b in texts], *done] if back else done

    done = append_columns(joined, out, ["_z", "ranges"], compute, keep=[c for c in cols if c != text_col])
    return done.select(*cols, *fields.names)


def covered(n: int, ranges: list | None, size: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    if not ranges:
        return np.zeros(n, dtype=bool)
    step = np.zeros(n + 1, dtype=np.int32)
    a = np.array([r["a"] for r in ranges])
    b = np.array([r["b"] for r in ranges])
    np.add.at(step, a, 1)
    np.add.at(step, b + size, -1)
    return np.cumsum(step[:-1]) > 0
