"""Best-fit packing of tokenised documents by minimum bin slack.

A document is its token ids and an end id; documents over the capacity are cut
into pieces of the capacity.  All that decides a packing is how many pieces
of each length there are: a table of at most ``capacity`` numbers, whatever
the size of the corpus.  Over it the plan is made bin by bin: the longest
length left goes in, a subset-sum over bit sets finds the combination of the
other lengths that leaves the least slack, and that combination is taken as
many times as the counts allow.

The rows are then numbered within their length, without gathering a length
anywhere: each task counts its own, and one small window adds up the tasks.
The number tells which bin of the plan a piece goes to, and where in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes, map_arrow, parts_of, staged, whole_ids
from .tokens import cached_encoder, splits_at_space

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "part", "seq")])


def fullest(counts: dict, room: int) -> list[tuple[int, int]]:
    """The lengths ``[(length, times)]`` whose sum comes closest to ``room`` from below.

    Subset-sum over bit sets: bit i of ``reach`` is set if some of the lengths
    seen so far add up to i.  Long lengths come first, and the search ends as
    soon as ``room`` itself is reached.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []    # length, copies in this step, reach before it
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            new = (reach | reach << (length * take)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return sorted(out.items(), reverse=True)


def plan(histogram: dict, capacity: int) -> np.ndarray:
    """Where the pieces go: rows ``length, first, last, per_bin, first_bin, offset``.

    Pieces of a length are numbered from 0; number r with first <= r < last is
    in bin ``first_bin + (r - first) // per_bin`` at
    ``offset + (r - first) % per_bin * length``.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        if not left[top]:
            order.pop(0)
            continue
        left[top] -= 1
        rest = dict(fullest(left, capacity - top))
        left[top] += 1
        rest[top] = rest.get(top, 0) + 1
        times = min(left[x] // n for x, n in rest.items())
        offset = 0
        for x in sorted(rest, reverse=True):
            n = rest[x]
            rows.append((x, used[x], used[x] + n * times, n, bins, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
        bins += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, numbered within its length and task."""
    split = splits_at_space(path)
    end = int(end_id).to_bytes(4, "little")
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                        *PIECES.fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        names = [f.name for f in out]
        types = [pa.int64(), pa.int32()] + [pa.int64()] * 5
        enc = cached_encoder(path, split)
        for b in parts_of(batches):
            rows = []
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for doc, data in zip(ids, as_bytes(b.column(b.schema.get_field_index("text")))):
                ids32 = enc.encode(data) + end
                for k in range(0, len(ids32), 4 * capacity):
                    part_ids = ids32[k:k + 4 * capacity]
                    n = len(part_ids) // 4
                    seq = seen.get(n, 0)
                    seen[n] = seq + 1
                    rows.append((doc, k // (4 * capacity), k // 4, n, zlib.crc32(part_ids), part, seq))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        enc.forget()     # the worker may next serve a step that needs the memory

    return map_arrow(docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")), run, out)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Null text counts as empty, so each document has at least the piece with the
    end id.  Rows that repeat an id are packed as often as they come.  An empty
    table gives no rows.
    """
    pieces = staged(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    per = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "before")
    # At most ``capacity`` rows.
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}
    rows = plan(histogram, capacity)
    # As many rows as there are tasks and lengths, so it is merged, not broadcast.
    counted = before.select("length", "part", "before").hint("merge")
    joined = pieces.join(counted, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("seq")).alias("number"))
    # The plan sorted by (length, first) as one increasing key.
    stride = int(rows[:, 2].max() + 1) if len(rows) else 1
    keys = rows[:, 0] * stride + rows[:, 1] if capacity * stride < 2 ** 62 else None
    held = docs.sparkSession.sparkContext.broadcast((rows, keys))
    fields = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(length, number):
        table, key = held.value
        n, r = length.to_numpy(), number.to_numpy()
        if key is None:
            raise ValueError("more pieces than a plan can number")
        at = table[np.searchsorted(key, n * stride + r, side="right") - 1]
        t = r - at[:, 1]
        return [at[:, 4] + t // at[:, 3], at[:, 5] + t % at[:, 3] * n]

    return append_columns(joined, fields, ["length", "number"], place,
                          keep=["doc_id", "piece", "start", "length", "ids_crc32"])
