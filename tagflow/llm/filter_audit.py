"""What each filter of a chain removes, under every order of the filters.

A document is reduced to the set of filters that it fails, as bits.  Documents
of a part with equal bits are one *cell* with its numbers of documents, so all
that follows depends on the number of parts only.  A recursive query starts at
the masks of the cells with the empty prefix; each level extends every prefix by
every letter not yet used, carries the bits applied so far, and emits what that
step does to the mask: kept, removed here, removed before, fails this one only.
The emitted rows join the cells by mask, and orders read the figures of their
prefixes.

Equal texts are found by their SHA-256: copies are counted before they are
shuffled, and of each part's copies only the smallest id meets those of the
other parts, so a text that a third of the corpus repeats is a few rows.

Defined results

* null text is the empty text, null part the empty string, a missing label no
  label; several labels of one id count as 1 where any of them is 1;
* a document without an id is no copy of a smaller id and makes none; rows of
  the same id and text are copies of smaller ids only;
* every row of the input counts, repeated ones too; an empty table gives no row;
* other columns of the input, whatever their names, are not read;
* a part has a row for every order and step, with zeros where nothing happens.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WORD_GAP = r"[\x20\x09-\x0D]+"
MAX_FILTERS = 6

WALK = """
WITH RECURSIVE walk (prefix, step, letter, mask, before, bit) AS (
  SELECT '', 0, '', mask, 0, 0 FROM {masks}
  UNION ALL
  SELECT concat(prefix, f.letter), step + 1, f.letter, mask, before | bit, f.bit FROM (
    SELECT prefix, step, mask, before, bit, explode(filter({letters}, f -> (f.bit & (before | bit)) = 0)) AS f FROM walk))
SELECT prefix, step, letter, mask, (mask & (before | bit)) = 0 AS kept,
       (mask & bit) <> 0 AND (mask & before) = 0 AS removed,
       (mask & bit) <> 0 AND (mask & before) <> 0 AS redundant, mask = bit AS single
FROM walk WHERE step > 0
"""


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def few_words(least: int) -> Callable[[Column, Column], Column]:
    return lambda text, words: F.size(words) < least


def repetitive(percent: int) -> Callable[[Column, Column], Column]:
    """Under ``percent`` of the words are different ones."""
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouting(percent: int) -> Callable[[Column, Column], Column]:
    """Over ``percent`` of the code points are A-Z."""
    return lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) \
        > percent * F.length(text)


def holds(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, words: text.rlike(pattern)


def letters_of(filters: dict[str, Callable], copies: str | None) -> list[str]:
    letters = [*filters, *([copies] if copies else [])]
    if not 1 <= len(letters) <= MAX_FILTERS or len(set(letters)) < len(letters) or any(len(c) != 1 for c in letters):
        raise ValueError(f"1 to {MAX_FILTERS} filters with different one-character names")
    return letters


def cells(docs: DataFrame, labels: DataFrame | None, filters: dict[str, Callable], copies: str | None = None,
          part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail.

    ``filters`` maps letters to conditions on the text and its words; ``copies``
    is the letter of the filter that fails copies of a smaller id's text.
    """
    letters = letters_of(filters, copies)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    base = base.select("*", words_of(F.col("text")).alias("words"))
    mask = F.lit(0)
    for i, c in enumerate(letters):
        if c in filters:
            mask = mask.bitwiseOR(F.when(filters[c](F.col("text"), F.col("words")), 1 << i).otherwise(0))
    base = base.select("part", "id", mask.alias("mask"),
                       (F.unhex(F.sha2("text", 256)) if copies else F.lit(None).cast("binary")).alias("digest"))
    if labels is None:
        base = base.select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    else:
        one = labels.groupBy(F.col("doc_id").alias("id")).agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
        base = base.join(one, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    if not copies:
        found = base.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    else:
        found = marked_copies(base, kind, 1 << letters.index(copies))
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def marked_copies(base: DataFrame, kind: list[str], bit: int) -> DataFrame:
    """``kind`` and ``n``, where ``mask`` has ``bit`` for copies of a smaller id's text."""
    per_id = base.groupBy("digest", *kind, "id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    group = per_id.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"),
        F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    lowest = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.col("unknown") + F.when(F.col("first.id") == lowest, F.col("first.n")).otherwise(0)
    both = group.select(*kind, "n", own.alias("own")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("c"))
    return both.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")


def walk(masks: DataFrame, letters: list[str]) -> DataFrame:
    """prefix, step, letter, mask and what the last letter of the prefix does to documents of that mask.

    At most 64 masks and 1956 prefixes (``MAX_FILTERS`` letters).
    """
    spec = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    return masks.sparkSession.sql(WALK.replace("{letters}", f"array({spec})"), masks=masks)


def audit(docs: DataFrame, labels: DataFrame | None, filters: dict[str, Callable], copies: str | None = None,
          part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text.

    Columns: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (what the filter removes, summed
    over all orders; divided by their number it is the Shapley value).
    """
    letters = letters_of(filters, copies)
    k = len(letters)
    cell = staged(cells(docs, labels, filters, copies, part_col, id_col, text_col), "cells")
    steps = staged(walk(cell.select("mask").distinct(), letters), "walk")
    # at most 64 x 1956 rows of five narrow columns, whatever the input
    emitted = F.broadcast(steps.select("mask", "prefix", "kept", "removed", "redundant", "single"))

    def total(n: str, flag: str):
        return F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))

    per_prefix = cell.join(emitted, "mask").groupBy("part", "prefix").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"),
        total("n", "redundant").alias("redundant"), total("n", "single").alias("unique_fails"),
        total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"))
    letter, step = F.substring("prefix", -1, 1), F.length("prefix")
    orders_with = F.element_at(F.array(*[F.lit(factorial(k - s)) for s in range(1, k + 1)]), step)
    shapley = F.sum(F.col("removed") * orders_with).over(Window.partitionBy("part", "filter"))
    per_prefix = per_prefix.select("part", "prefix", letter.alias("filter"), step.alias("step"), "kept", "removed",
                                   "redundant", "unique_fails", "good_lost", "toxic_lost").withColumn("shapley", shapley)
    full = steps.where(F.col("step") == k).select(F.col("prefix").alias("filter_order")).distinct()
    # 720 orders at most
    orders = F.broadcast(full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n"))
                         .select("filter_order", F.expr("substring(filter_order, 1, n)").alias("prefix")))
    return per_prefix.join(orders, "prefix").select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley")
