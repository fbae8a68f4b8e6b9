"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of the
segments' bit counts is its embedding.  One differing bit changes one count
by one, so the Manhattan distance of two embeddings is never above the
Hamming distance of the fingerprints: it is a lower bound to prune with.
Counts 0, 1, 2 are kept as unary codes 00, 01, 11, so a whole embedding is
one 64-bit word and the Manhattan distance is the bit count of an XOR.

The grid: the coordinates are dealt into ``max_bits + 3`` groups.  Vectors
within distance ``max_bits`` differ in at most that many groups, hence agree
on three; every choice of three groups is one grid, its cell the vector's
coordinates there.  Members of a cell are compared by the lower bound, then by
the exact Hamming distance.

Scale: equal fingerprints are first made one row (partial aggregation), so a
group of copies of any size is one point.  A cell with more than ``block``
points is dealt into blocks, and each pair of blocks is a separate piece of
work.  A piece emits a spanning forest of its links (at most one row per
point), never all pairs; the forests of all cells have the same components as
all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, map_arrow, staged, unstage, whole_ids
from .components import connected_components

SEED = 42
SEGMENTS = 32          # two bits each
ODD = 0x5555555555555555
BLOCK = 4096


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text's UTF-8 bytes: bit set where over half the shingle hashes set it."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``fp``, the fingerprint as a signed long; null text counts as empty."""

    def compute(col):
        return [np.array([fingerprint(b, shingle) for b in as_bytes(col)], dtype="<u8").view("<i8")]

    return append_columns(docs, T.StructType([T.StructField("fp", T.LongType())]), [text_col], compute, keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp):
    """Column: the 32 segment counts of a fingerprint column as unary codes in one long."""
    odd = F.lit(ODD)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_masks(max_bits: int) -> list[int]:
    """One 64-bit mask per grid: the coordinates of three of ``max_bits + 3`` groups."""
    groups = max_bits + 3
    of = [i * groups // SEGMENTS for i in range(SEGMENTS)]
    masks = []
    for chosen in combinations(range(groups), 3):
        masks.append(_signed(sum(3 << (2 * i) for i in range(SEGMENTS) if of[i] in chosen)))
    return masks


def _forest(fp: np.ndarray, side: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among points; with ``side`` only links across sides."""
    half = np.uint64(ODD)
    high, low = (fp >> np.uint64(1)) & half, fp & half
    code = low | high | ((low & high) << np.uint64(1))
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    stack: list[int] = []
    while len(left) or stack:
        if stack:
            x = stack.pop()
        else:
            x, left = int(left[0]), left[1:]
        if not len(left):
            continue
        near = np.bitwise_count(code[left] ^ code[x]) <= max_bits
        if side is not None:
            near &= side[left] != side[x]
        if not near.any():
            continue
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fp[left[at]] ^ fp[x]) <= max_bits]
        if len(at):
            found = left[at]
            out += [(x, int(y)) for y in found]
            stack += found.tolist()
            left = np.delete(left, at)
    return out


def links(points: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Forest of links ``(a, b)`` among ``points`` = distinct ``(fp, node)``.

    Two points are linked if their fingerprints differ in ``max_bits`` bits or
    fewer; the rows returned connect exactly what all links connect.
    """
    masks = grid_masks(max_bits)
    cells = points.withColumn("e", embedding(F.col("fp"))).select(
        "fp", "node", F.explode(F.array(*[
            F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell"))
            for i, m in enumerate(masks)])).alias("c")).select("c.grid", "c.cell", "fp", "node")
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    # Written, so that a cell with very many points can be split in the join.
    sizes = staged(sizes.select("grid", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    # Cells with one point go; the rest are dealt into pairs of blocks.
    b = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    full = cells.join(sizes, ["grid", "cell"]).withColumn("side", b)
    pieces = full.select("grid", "cell", "fp", "node", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pieces = pieces.select("grid", "cell", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"),
                           "side", "fp", "node")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def solve(rows) -> tuple[list, list]:
            xs, ys = [], []
            key, side, fp, node = rows
            cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(key))
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                across = side[s:e] if key[s, 2] != key[s, 3] else None
                for x, y in _forest(fp[s:e], across, max_bits):
                    xs.append(int(node[s + x]))
                    ys.append(int(node[s + y]))
            return xs, ys

        def rows_of(bs):
            get = lambda c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in bs])
            key = np.stack([get("grid").astype(np.int64), get("cell"), get("i").astype(np.int64),
                            get("j").astype(np.int64)], axis=1)
            return key, get("side"), get("fp").astype(np.int64).view(np.uint64), get("node")

        def out(xs, ys):
            return pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])

        # Rows come sorted by piece; the last piece of a batch may go on in the next one.
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key, side, fp, node = rows_of(held)
            last = np.flatnonzero(np.any(key != key[-1], axis=1))
            if not len(last):
                continue
            end = int(last[-1]) + 1
            yield out(*solve((key[:end], side[:end], fp[:end], node[:end])))
            tail = pa.Table.from_batches(held).slice(end).combine_chunks().to_batches()
            held = tail
        if held:
            yield out(*solve(rows_of(held)))

    dealt = pieces.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    return map_arrow(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable through fingerprints that
    differ in ``max_bits`` bits or fewer.  Null text counts as empty; texts
    without a word have fingerprint zero and are linked like any other.  Rows
    that repeat an id are returned as often as they come.  A row without an id
    gets the component of its fingerprint (null if no row with an id has that
    fingerprint) and adds no link of its own.
    """
    prints = staged(with_fingerprints(docs.select(whole_ids(docs, id_col).alias("node"),
                                                  F.col(text_col).alias("text")), shingle, "text", keep=["node"]), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("node").alias("node")).where("node IS NOT NULL")
    points = staged(points, "points")
    comps = connected_components(links(points, max_bits))
    named = points.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    result = prints.join(named, "fp", "left").select(
        F.col("node").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    result = staged(result, "near")
    unstage(prints, points)
    return result


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one whose id is the group's smallest.

    Documents without an id are kept.  Where ids repeat, the rows are numbered
    and written once, groups are formed of rows, and of rows that share the
    group's smallest id the one with the smallest hash of its text stays.
    """
    named = docs.where(F.col(id_col).isNotNull())
    ids = named.select(whole_ids(docs, id_col).alias("i")).groupBy("i").count()
    if ids.where("count > 1").limit(1).count():
        rows = staged(named.select(F.monotonically_increasing_id().alias("_row"), *docs.columns), "numbered")
        groups = near_duplicates(rows, shingle, max_bits, "_row", text_col).select("_row", "component_id")
        order = F.struct(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), F.col("_row"))
        stay = rows.join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("m")).select("m._row")
        one = rows.join(stay.hint("shuffle_hash"), "_row", "left_semi").drop("_row")
    else:
        groups = near_duplicates(named, shingle, max_bits, id_col, text_col)
        # ids are few bytes beside the texts: hashed per partition at every size, texts move once and are not sorted
        stay = groups.where(F.col(id_col) == F.col("component_id")).select(id_col)
        one = named.join(stay.hint("shuffle_hash"), id_col, "left_semi")
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
