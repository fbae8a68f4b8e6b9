"""Word vectors from the corpus itself, and which words are alike by them.

Words that stand within ``window`` places of each other are counted; the counts
become positive pointwise mutual information (PPMI), a sparse symmetric table.
Its leading eigenvectors are found by randomised subspace iteration (Halko,
Martinsson, Tropp 2011): multiplying the table with a tall thin one is a join
and an aggregate, and making that orthonormal needs only its p x p Gram matrix,
the one thing that reaches the driver (p = rank + ``OVERSAMPLE``, whatever the
vocabulary).  A word's vector is its row of the eigenvectors, scaled by the roots
of the positive eigenvalues (Levy, Goldberg 2014).

Alike words are searched by random hyperplanes: words whose signatures agree in
one of several tables are candidates, and the exact cosine decides.  The number
of tables follows from the wanted recall at the threshold, the signature's
length from the vocabulary, so a signature is shared by a few dozen words.
"""

from __future__ import annotations

import json
import math
import sys
from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, lookup_join, with_constants
from ..plans.rank import number_rows
from ..session import stage, unstage

WINDOW, MIN_COUNT = 5, 5
RANK, OVERSAMPLE, ROUNDS = 32, 16, 3
RECALL = 0.98
PER_SIGNATURE = 64
PAIRS_AT_ONCE = 1 << 22    # pairs that a task counts at once: 32 MB
ROWS_AT_ONCE = 1 << 14
BLOCKS, MOST_ROWS = 16, 1 << 16
LEAST_CUTS, MOST_CUTS = 16, 64     # MAX_BROADCAST_ROWS words in so many blocks: a key within two blocks has 32 bits
HELD_BYTES = 128 << 20     # sums that a task holds
PACK_WORDS = 4096

# The workers' functions go by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def code(word) -> Column:
    return F.xxhash64(word)


@dataclass
class WordPairs:
    """Counts of pairs of words, which go by codes: ``known (w, k)`` tells the word of a code.

    Either ``rows (a, b, n)``, or, where the codes are few enough to be
    broadcast, ``blocks (blk, keys, n)``: a word's number is the place of its
    code in the sorted ``codes``, words are cut into ``cuts`` blocks of ``size``,
    and a pair (first number below the second) is a key within the block
    ``first block * cuts + second block``.
    """
    known: DataFrame
    words: int
    rows: DataFrame | None = None
    blocks: DataFrame | None = None
    codes: Broadcast | None = None
    cuts: int = 0
    size: int = 0

    def staged(self) -> WordPairs:
        """The same with the counts written."""
        return replace(self, **{n: stage(getattr(self, n), "word_pairs") for n in ("rows", "blocks") if getattr(self, n) is not None})

    def counts(self) -> DataFrame:
        """``(a, b, n)``, codes."""
        return self.rows if self.blocks is None else self.blocks.mapInArrow(self._listed(), "a long, b long, n long")

    def sums(self) -> Broadcast:
        """Of each number the sum of ``n`` of its pairs (blocks only; at most ``MAX_BROADCAST_ROWS`` numbers)."""
        cuts, size = self.cuts, self.size

        def run(batches):
            import pyarrow as pa

            held = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    blk, r, c, n = _pairs_of(batch, k, cuts, size)
                    for b, at in zip(blk, (r, c)):
                        held[b] = held.get(b, 0) + np.bincount(at, n, size)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())],
                                             names=["blk", "m"])

        out = np.zeros(cuts * size)
        for r in _summed(self.blocks.mapInArrow(run, "blk int, m binary")).collect():
            out[r.blk * size:(r.blk + 1) * size] = np.frombuffer(r.m)
        return self.known.sparkSession.sparkContext.broadcast(out)

    def pmi(self) -> DataFrame:
        """``ppmi`` of the words, a < b."""
        pairs = ppmi(self.rows) if self.blocks is None else self.blocks.mapInArrow(
            self._listed(self.sums()), "a long, b long, n long, x double")
        return with_words(pairs, self.known, self.words)

    def _listed(self, sums: Broadcast | None = None):
        codes, cuts, size = self.codes, self.cuts, self.size

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(batch.num_rows):
                    blk, r, c, n = _pairs_of(batch, k, cuts, size)
                    r, c, x = r + blk[0] * size, c + blk[1] * size, None
                    if sums is not None:
                        r, c, n, x = _positive(r, c, n, sums.value)
                    for at in range(0, len(n), ROWS_AT_ONCE):
                        cut = slice(at, at + ROWS_AT_ONCE)
                        cols = [codes.value[r[cut]], codes.value[c[cut]], n[cut], *([] if x is None else [x[cut]])]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["a", "b", "n", "x"][:len(cols)])

        return run

    def vectors(self, rank: int = RANK, rounds: int = ROUNDS) -> DataFrame:
        """``word_vectors`` of ``pmi()``."""
        if self.blocks is None:
            return word_vectors(self.pmi(), rank, rounds)
        codes, cuts, size, sums = self.codes, self.cuts, self.size, self.sums()

        def table(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(batch.num_rows):
                    blk, r, c, n = _pairs_of(batch, k, cuts, size)
                    r, c, _, x = _positive(r + blk[0] * size, c + blk[1] * size, n, sums.value)
                    arrays = ((r - blk[0] * size).astype(np.int32), (c - blk[1] * size).astype(np.int32), x)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()) for b in blk] + [
                        pa.array([v.tobytes()], pa.binary()) for v in arrays], names=["i", "j", "rows", "cols", "x"])

        def number(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(codes.value, batch.column(1).to_numpy()))],
                                                 names=["word", "idx"])

        numbers = stage(self.known.select("w", "k").mapInArrow(number, "word string, idx long"), "numbers")
        return _vectors(self.blocks.mapInArrow(table, "i int, j int, rows binary, cols binary, x binary"), numbers, size, rank, rounds)


def _pairs_of(batch, k: int, cuts: int, size: int) -> tuple:
    """``((first block, second block), rows, columns, n)`` of row k."""
    keys, n = np.frombuffer(batch.column("keys")[k].as_buffer(), np.uint32), np.frombuffer(batch.column("n")[k].as_buffer(), np.int64)
    keys = keys.astype(np.int64)
    return divmod(batch.column("blk")[k].as_py(), cuts), keys // size, keys % size, n


def _positive(r: np.ndarray, c: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple:
    """The pairs whose PMI is above zero, with it."""
    x = np.log(n * sums.sum() / (sums[r] * sums[c]))
    ok = x > 0
    return r[ok], c[ok], n[ok], x[ok]


def word_pairs(texts: DataFrame, token_col: str = "tokens", window: int = WINDOW, min_count: int = MIN_COUNT) -> WordPairs:
    """Places at which two words stand within ``window`` of each other.

    Words found fewer than ``min_count`` times are left out, but keep their
    place.  Words go by 64-bit codes, once it is known that no two share a code
    (else as words).  Pairs are counted chunk by chunk, then block by block;
    where the codes are too many to be broadcast, as rows.
    """
    t = texts.select(F.col(token_col).alias("t")).where(F.size("t") > 0)
    words = stage(t.select(F.explode("t").alias("w")).where(F.col("w").isNotNull()).groupBy("w").agg(
        F.count(F.lit(1)).alias("c")).select("w", code("w").alias("k"), "c"), "words")
    clash = words.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if clash:
        words = words.withColumn("k", F.col("w"))
    else:
        t = t.select(F.transform("t", lambda w: F.when(w.isNotNull(), code(w))).alias("t"))
    size = F.size("t")
    often = words.where(F.col("c") >= min_count)
    known = stage(often.select("w", "k"), "known_words")
    rows = known.count()
    if not clash and 0 < rows <= MAX_BROADCAST_ROWS:
        tokens = often.agg(F.sum("c")).first()[0]
        cuts = min(MOST_CUTS, max(LEAST_CUTS, math.isqrt(2 * window * tokens // PAIRS_AT_ONCE) + 1))
        pairs = WordPairs(known, rows, cuts=cuts, size=-(-rows // cuts))
        pairs.codes = known.sparkSession.sparkContext.broadcast(np.sort(known.select("k").toArrow().column("k").to_numpy()))
        pairs.blocks = _counted(t.where(size > 1), pairs, window)
        return pairs

    def apart(o):
        return F.zip_with(F.slice("t", F.lit(1), size - o), F.slice("t", o + 1, size - o), lambda x, y: F.struct(
            F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

    pairs = t.where(size > 1).select(F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(window), size - 1)), apart))).alias("p")).select("p.a", "p.b").where("a <> b")
    if rows <= MAX_BROADCAST_ROWS:
        for c in ("a", "b"):
            pairs = lookup_join(pairs, known.select(F.col("k").alias(c)), c, "left_semi", rows)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    for c in ("a", "b"):
        pairs = lookup_join(pairs, known.select(F.col("k").alias(c)), c, "left_semi", rows)
    return WordPairs(known, rows, rows=pairs)


def _counted(lists: DataFrame, pairs: WordPairs, window: int) -> DataFrame:
    """``(blk, keys, n)`` of the pairs in lists ``t`` of codes; one row a block."""
    held, cuts, size = pairs.codes, pairs.cuts, pairs.size

    def count(batches):
        import pyarrow as pa

        order, parts, n = held.value, [], 0

        def merged():
            q, c = np.unique(np.concatenate(parts), return_counts=True)
            blk = q // (size * size)
            cut = np.append(np.flatnonzero(np.append(True, blk[1:] != blk[:-1])), len(q))
            keys, c = (q - blk * (size * size)).astype(np.uint32), c.astype(np.uint32)
            piece = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(blk[cut[:-1]].astype(np.int32)), piece(keys), piece(c)], names=["blk", "keys", "n"])

        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            flat, ends = batch.column(0).values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
            codes = flat.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(order, codes), len(order) - 1)
            at = np.where(flat.is_valid().to_numpy(zero_copy_only=False) & (order[at] == codes), at, -1)
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for o in range(1, window + 1):
                x, y = at[:-o], at[o:]
                ok = (text[:-o] == text[o:]) & (x >= 0) & (y >= 0) & (x != y)
                x, y = np.minimum(x[ok], y[ok]), np.maximum(x[ok], y[ok])
                if len(x):
                    parts.append((x // size * cuts + y // size) * (size * size) + x % size * size + y % size)
                    n += len(x)
                if n > PAIRS_AT_ONCE:
                    yield merged()
                    parts, n = [], 0
        if parts:
            yield merged()

    def add(table):
        import pyarrow as pa

        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.Table.from_arrays([table.column("blk").slice(0, 1).combine_chunks(),
                                     *[pa.array([a.tobytes()], pa.binary()) for a in (keys[first], np.add.reduceat(n, first))]],
                                    names=["blk", "keys", "n"])

    schema = "blk int, keys binary, n binary"
    return lists.mapInArrow(count, schema).groupBy("blk").applyInArrow(add, schema)


def with_words(pairs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """Pairs of words, a < b, for pairs of their codes; the other columns stay."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    for c in ("a", "b"):
        pairs = lookup_join(pairs, known.select(F.col("k").alias(c), F.col("w").alias(f"w_{c}")), c, "inner", rows)
    return pairs.select(F.least("w_a", "w_b").alias("a"), F.greatest("w_a", "w_b").alias("b"), *rest)


def cooccurrences(texts: DataFrame, token_col: str = "tokens", window: int = WINDOW,
                  min_count: int = MIN_COUNT) -> DataFrame:
    """``(a, b, n)`` with a < b: the counts of ``word_pairs``."""
    pairs = word_pairs(texts, token_col, window, min_count)
    return with_words(pairs.counts(), pairs.known, pairs.words)


def ppmi(counts: DataFrame) -> DataFrame:
    """``(a, b, n, x)`` with a < b: ln(n N / (n_a n_b)) where it is above zero; N and n_a count both directions."""
    both = counts.select("a", "n").unionByName(counts.select(F.col("b").alias("a"), "n"))
    each = stage(both.groupBy("a").agg(F.sum("n").cast("double").alias("n_a")), "word_sums")
    words = each.count()
    total = counts.agg((2 * F.sum("n")).cast("double").alias("all"))
    j = lookup_join(counts, each, "a", "inner", words)
    j = lookup_join(j, each.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b", "inner", words)
    x = F.log(F.col("n") * F.col("all") / (F.col("n_a") * F.col("n_b")))
    return with_constants(j, total).select("a", "b", "n", x.alias("x")).where("x > 0")


def turned(v: Column, matrix: np.ndarray) -> Column:
    """An array times a small matrix, which is one constant of the plan."""
    columns = F.from_json(F.lit(json.dumps(matrix.T.tolist())), "array<array<double>>")
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(v, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def block_size(words: int) -> int:
    """Words of a block: ``BLOCKS`` blocks, or more where a block would have over ``MOST_ROWS`` words."""
    return min(max(-(-words // BLOCKS), 1), MOST_ROWS)


def _blocks(pmi: DataFrame, numbers: DataFrame, words: int) -> DataFrame:
    """``(i, j, rows, cols, x)``, i <= j: the table ``(a, b, x)`` cut into blocks of numbered words, written once.

    An entry stands in one block only; the other direction is its transpose.
    """
    size = block_size(words)
    t = pmi
    for c in ("a", "b"):
        t = lookup_join(t, numbers.select(F.col("word").alias(c), F.col("idx").alias(f"n_{c}")), c, "inner", words)
    p, q = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    dealt = t.select(F.floor(p / size).cast("int").alias("i"), F.floor(q / size).cast("int").alias("j"),
                     (p % size).cast("int").alias("r"), (q % size).cast("int").alias("c"), "x")

    def build(table):
        import pyarrow as pa

        cut = [table.column(n).slice(0, 1).combine_chunks() for n in ("i", "j")]
        order = np.lexsort((table.column("c").to_numpy(), table.column("r").to_numpy()))
        arrays = [table.column(n).to_numpy()[order] for n in ("r", "c", "x")]
        return pa.Table.from_arrays([*cut, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["i", "j", "rows", "cols", "x"])

    return stage(dealt.groupBy("i", "j").applyInArrow(build, "i int, j int, rows binary, cols binary, x binary"), "pmi",
                 maxRecordsPerFile=8)


def _summed(parts: DataFrame) -> DataFrame:
    """``(blk, m)``: the sums of the matrices of each block."""
    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("m"))
        return pa.Table.from_arrays([table.column("blk").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())],
                                    names=["blk", "m"])

    return parts.groupBy("blk").applyInArrow(add, "blk int, m binary")


def times(blocks: DataFrame, thin: DataFrame, turn: np.ndarray, size: int) -> DataFrame:
    """``(blk, m)``: the symmetric table of ``blocks`` times the tall matrix ``thin (blk, m)``, that turned by ``turn`` first.

    A task adds up what it has for each block, so one matrix a block and task moves.
    """
    def run(batches):
        import pyarrow as pa

        sums, held = {}, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.T.tobytes() for m in sums.values()], pa.binary())],
                                              names=["blk", "m"])

        for batch in batches:
            for n in range(batch.num_rows):
                i, j = batch.column("i")[n].as_py(), batch.column("j")[n].as_py()
                rows, cols = (np.frombuffer(batch.column(c)[n].as_buffer(), np.int32) for c in ("rows", "cols"))
                x = np.frombuffer(batch.column("x")[n].as_buffer())
                left, right = (np.ascontiguousarray((np.frombuffer(batch.column(c)[n].as_buffer()).reshape(-1, len(turn)) @ turn).T)
                               for c in ("mi", "mj"))
                for blk, at, frm, other in ((i, rows, cols, right), (j, cols, rows, left)):
                    own = left.shape[1] if blk == i else right.shape[1]
                    part = np.array([np.bincount(at, x * row[frm], own) for row in other])
                    if blk in sums:
                        sums[blk] += part
                    else:
                        sums[blk], held = part, held + part.nbytes
                if held > HELD_BYTES:
                    yield out()
                    sums, held = {}, 0
        if sums:
            yield out()

    n = thin.count()
    wide = n * size * len(turn) * 8 <= MAX_BROADCAST_BYTES
    j = blocks
    for c in ("i", "j"):
        side = thin.select(F.col("blk").alias(c), F.col("m").alias(f"m{c}"))
        j = j.join(F.broadcast(side) if wide else side, c)
    return _summed(j.mapInArrow(run, "blk int, m binary"))


def inner(rows: DataFrame, left: str, right: str, k: int) -> np.ndarray:
    """The k x k matrix of the products of the blocks' matrices ``left`` (transposed) and ``right``, summed."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros((k, k))
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[n].as_buffer()).reshape(-1, k) for c in (left, right))
                total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    got = rows.select(*dict.fromkeys([left, right])).mapInArrow(run, "s binary").collect()       # a k x k matrix per task
    return sum((np.frombuffer(r.s).reshape(k, k) for r in got), np.zeros((k, k)))


def orthonormal(rows: DataFrame, k: int) -> np.ndarray:
    """The matrix that turns the columns of ``rows (blk, m)`` into orthonormal ones which span them."""
    value, vector = np.linalg.eigh(inner(rows, "m", "m", k))
    keep = value > max(value.max(initial=0.0), 0.0) * 1e-10
    return vector[:, keep] / np.sqrt(value[keep])


def word_vectors(pmi: DataFrame, rank: int = RANK, rounds: int = ROUNDS) -> DataFrame:
    """``(word, v)``: vectors of at most ``rank`` numbers for the words of ``pmi (a, b, x)``."""
    words = pmi.select(F.explode(F.array("a", "b")).alias("word")).distinct()
    numbered, n = number_rows(words, [code("word"), F.col("word")], "idx")
    numbers = stage(numbered.select("word", (F.col("idx") - 1).alias("idx")), "numbers")
    if not n:
        return numbers.select("word", F.array().cast("array<double>").alias("v"))
    return _vectors(_blocks(pmi.select("a", "b", "x"), numbers, n), numbers, block_size(n), rank, rounds)


def _vectors(table: DataFrame, numbers: DataFrame, size: int, rank: int, rounds: int) -> DataFrame:
    """``word_vectors`` of ``table (i, j, rows, cols, x)`` (see ``_blocks``) for the words ``numbers (word, idx)`` that it holds."""
    k = rank + OVERSAMPLE
    sign = lambda i: F.when(F.xxhash64("word", F.lit(i)) < 0, -1.0).otherwise(1.0)
    start = numbers.select(F.floor(F.col("idx") / size).cast("int").alias("blk"), "idx", F.array(*[sign(i) for i in range(k)]).alias("v"))

    def build(rows):
        import pyarrow as pa

        order = np.argsort(rows.column("idx").to_numpy())
        m = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        return pa.Table.from_arrays([rows.column("blk").slice(0, 1).combine_chunks(), pa.array([m.tobytes()], pa.binary())], names=["blk", "m"])

    thin = stage(start.groupBy("blk").applyInArrow(build, "blk int, m binary"), "subspace")
    turn = np.eye(k)
    for _ in range(rounds):
        old, thin = thin, stage(times(table, thin, turn, size), "subspace")
        unstage(old)
        turn = orthonormal(thin, turn.shape[1])
        if not turn.shape[1]:
            return numbers.limit(0).select("word", F.array().cast("array<double>").alias("v"))
    image = times(table, thin, turn, size).withColumnRenamed("m", "y")
    both = stage(thin.select("blk", "m").join(image, "blk"), "subspace")
    basis, p = turn, turn.shape[1]

    def turned_blocks(matrix):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                made = [(np.frombuffer(m.as_buffer()).reshape(-1, len(matrix)) @ matrix).tobytes() for m in batch.column("m")]
                yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array(made, pa.binary()), batch.column("y")], names=["blk", "m", "y"])
        return run

    small = inner(both.mapInArrow(turned_blocks(basis), "blk int, m binary, y binary"), "m", "y", p)
    unstage(both)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = [i for i in np.argsort(-value) if value[i] > 1e-9 * abs(value).max()][:rank]
    last = basis @ (vector[:, order] * np.sqrt(value[order]))

    def rows_of(batches):
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                m = np.frombuffer(batch.column("m")[n].as_buffer()).reshape(-1, len(last))
                own = np.flatnonzero(m.any(axis=1))         # words without an entry are nought
                v, own = m[own] @ last, own + batch.column("blk")[n].as_py() * size
                for at in range(0, len(v), ROWS_AT_ONCE):
                    part = v[at:at + ROWS_AT_ONCE]
                    ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(own[at:at + ROWS_AT_ONCE]),
                                                      pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], names=["idx", "v"])

    vectors = stage(thin.mapInArrow(rows_of, "idx long, v array<double>").join(numbers, "idx").select("word", "v"), "vectors")
    unstage(thin)
    return vectors


def unit(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select("word", "v", norm.alias("r")).where("r > 0").select(
        "word", F.transform("v", lambda x: x / F.col("r")).alias("v"))


def cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search_plan(words: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)``: at the threshold a pair shares a signature in some table with probability ``recall``."""
    bits = max(4, math.ceil(math.log2(max(words, 1) / PER_SIGNATURE)) if words > PER_SIGNATURE else 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def alike_words(vectors: DataFrame, threshold: float, recall: float = RECALL, seed: int = 1) -> DataFrame:
    """``(t1, t2, s)`` with t1 < t2: pairs of words whose vectors have a cosine of ``threshold`` or more.

    Every returned ``s`` is exact; a pair at the threshold is found with
    probability ``recall``, closer ones more surely.  ``exact_alike_words``
    compares all.
    """
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    v = stage(unit(vectors), "unit_vectors")
    about = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("k")).first()
    if not about.n:
        return v.sparkSession.createDataFrame([], "t1 string, t2 string, s double")
    bits, tables = search_plan(about.n, threshold, recall)
    planes = np.random.default_rng(seed).standard_normal((about.k, tables * bits))
    packs = -(-about.n // PACK_WORDS)

    def build(table):
        import pyarrow as pa

        m = table.column("v").combine_chunks().flatten().to_numpy()
        return pa.Table.from_arrays([table.column("pack").slice(0, 1).combine_chunks(),
                                     pa.array([table.column("word").to_pylist()], pa.list_(pa.string())), pa.array([m.tobytes()], pa.binary())],
                                    names=["pack", "words", "m"])

    dealt = v.select(F.pmod(code("word"), F.lit(packs)).cast("int").alias("pack"), "word", "v")
    made = stage(dealt.groupBy("pack").applyInArrow(build, "pack int, words array<string>, m binary"), "word_packs", maxRecordsPerFile=1)
    a = made.select(*[F.col(c).alias(f"{c}1") for c in made.columns])
    b = made.select(*[F.col(c).alias(f"{c}2") for c in made.columns]).hint("shuffle_replicate_nl")
    # of (a, b) and (b, a) the one that the parity of a + b tells: half of each task's pairs
    odd = (F.col("pack1") + F.col("pack2")) % 2 == 1
    met = a.join(b, (F.col("pack1") == F.col("pack2")) | (odd == (F.col("pack1") > F.col("pack2"))))
    return met.mapInArrow(_alike(planes, bits, threshold), "t1 string, t2 string, s double")


def _marks(m: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The signatures of vectors: a number for each table."""
    sides = (m @ planes > 0).reshape(len(m), -1, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def _alike(planes: np.ndarray, bits: int, threshold: float):
    """Task: two packs to ``(t1, t2, s)`` of their words with s >= threshold that share a signature in some table.

    The products in single precision, which are off by less than 1e-5, tell what is worked out exactly.
    """
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for n in range(batch.num_rows):
                words = [batch.column(f"words{s}")[n].values for s in (1, 2)]
                m1, m2 = (np.frombuffer(batch.column(f"m{s}")[n].as_buffer()).reshape(-1, len(planes)) for s in (1, 2))
                same = batch.column("pack1")[n].as_py() == batch.column("pack2")[n].as_py()
                marks = [_marks(m, planes, bits) for m in (m1, m2)]
                near = m2.astype(np.float32).T
                for at in range(0, len(m1), 512):
                    i, j = np.nonzero(m1[at:at + 512].astype(np.float32) @ near >= threshold - 1e-5)
                    i += at
                    if same:
                        i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), ROWS_AT_ONCE):
                        x, y = i[k:k + ROWS_AT_ONCE], j[k:k + ROWS_AT_ONCE]
                        s = np.zeros(len(x))
                        for c in range(len(planes)):
                            s += m1[x, c] * m2[y, c]
                        ok = (s >= threshold) & (marks[0][x] == marks[1][y]).any(axis=1)
                        t1, t2 = words[0].take(pa.array(x[ok])), words[1].take(pa.array(y[ok]))
                        less = pa.compute.less(t1, t2)
                        yield pa.RecordBatch.from_arrays([pa.compute.if_else(less, t1, t2), pa.compute.if_else(less, t2, t1), pa.array(s[ok])],
                                                         names=["t1", "t2", "s"])

    return run


def scored(pairs: DataFrame, v: DataFrame) -> DataFrame:
    j = pairs.join(v.select(F.col("word").alias("t1"), F.col("v").alias("v1")), "t1")
    j = j.join(v.select(F.col("word").alias("t2"), F.col("v").alias("v2")), "t2")
    return j.select("t1", "t2", cosine("v1", "v2").alias("s"))


def exact_alike_words(vectors: DataFrame, threshold: float) -> DataFrame:
    """``alike_words`` by comparing all pairs: for small vocabularies and to measure recall."""
    v = unit(vectors)
    a, b = v.select(F.col("word").alias("t1")), v.select(F.col("word").alias("t2"))
    return scored(a.join(b, F.col("t1") < F.col("t2")), v).where(F.col("s") >= threshold)


def both_ways(alike: DataFrame) -> DataFrame:
    """``(t1, t2, s)`` in both directions, as soft cosine takes it."""
    return alike.unionByName(alike.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "s"))
