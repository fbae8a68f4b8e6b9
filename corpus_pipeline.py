"""From raw documents to packed training sequences.

Each stage is one operator of ``tagflow.llm`` over all that its predecessor
kept; its rows are written as Parquet and read again as the next stage's
input.  All stages but the last return the columns of ``documents``.

1. quality_rules: documents that fail the base rules or whose lines are mostly
   boilerplate go.
2. near_duplicates: of each group of SimHash-linked documents the one with the
   smallest id stays.
3. suffix_dedup: byte strings of PASSAGE_BYTES bytes that occur again are cut
   out of every place, which takes passages of 51 words and more (in the given
   tables half of the repeated stretches of 51 words have 305 bytes or fewer); a cut that falls inside a character takes the rest of it along,
   and a document that loses all its words goes.
4. decontaminate: documents that hold a test item go.
5. pack: the rest is packed into sequences of at most 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.llm import decontaminate, packing, quality, simhash, suffix_dedup
from tagflow.llm.common import staged, table

CAPACITY = 2048
PASSAGE_BYTES = 250


def columns_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; one named like a working column of an operator may be gone."""
    return out.select(*[c for c in docs.columns if c in out.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return columns_of(docs, quality.quality_rules(docs, model).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return columns_of(docs, simhash.keep_one(docs, shingle=3, max_bits=3))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(docs, size=PASSAGE_BYTES, as_text=True)
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return columns_of(docs, cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return columns_of(docs, marked.where(F.size("leaks") == 0))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The fingerprints, the fitted field and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
