"""Stage sinks write every table and read back with the same row counts."""

import tempfile

import pytest

from tagflow.plans import chain
from tagflow.plans.chain import Pipeline
from tagflow.plans.stages import write_stages
from tagflow.sources import io

SMALL = "/root/testdata/sf0.001"


def test_write_stages_round_trip(spark):
    p = Pipeline.of(spark, SMALL)
    out = tempfile.mkdtemp(prefix="tagflow-stages-")
    paths = write_stages(p, out)
    assert io.read_stage(spark, paths["nodes"]).count() == p.n_nodes
    assert io.read_stage(spark, paths["data2"]).count() == p.data2.count()
    assert io.read_stage(spark, paths["edges"]).count() == p.edges.count()
    csv_nodes = spark.read.option("header", True).csv(paths["nodes_csv"])
    assert csv_nodes.count() == p.n_nodes


def test_union_stopwords():
    from tagflow.functions.stopwords import union_stopwords
    assert union_stopwords(["a", "b"], ["b", "c"]) == ("a", "b", "c")


def test_a_stop_word_table_is_bounded(spark):
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "word string")
    assert chain.listed(words) == ("a", "b") and chain.listed(words, 2) == ("a", "b")
    with pytest.raises(ValueError):
        chain.listed(words, 1)


def test_shuffle_files_go_with_the_stage(spark):
    from pyspark.sql import functions as F

    from tagflow import session

    before = spark.conf.get(session.CLEANUP, None)
    sc = spark.sparkContext._jsc.sc()
    made = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    first = sc.newShuffleId()
    out = session.stage(made, "counts")
    last = sc.newShuffleId()
    import time

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        left = [b for b in (f.getName() for f in list_of(blocks.getAllFiles())) if b.startswith("shuffle_")
                and first < int(b.split("_")[1]) < last]
        if not left:
            break
        time.sleep(0.1)
    assert last - first > 1 and not left
    assert out.count() == 7 and spark.conf.get(session.CLEANUP, None) == before
    session.unstage(out)
    assert not spark.sparkContext._jvm.java.io.File(out._staged_path.removeprefix("file:")).exists()


def list_of(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_token_lists_are_written_with_the_cleaned_rows(spark):
    """``df`` is not written a second time: its rows are those of ``kept``, tokenised."""
    from tagflow.operators.tokens import tokenize_lemma
    from tagflow.plans.chain import Pipeline

    p = Pipeline(spark, "/root/testdata/sf0.001")
    got = {r.id: (r.preprocessed, r.tokenized) for r in p.df.collect()}
    want = {r.id: (r.preprocessed, r.tokenized) for r in tokenize_lemma(p.kept).collect()}
    assert got == want and "tokenized" in p.cleaned.columns and p.staged.columns == p.kept.columns
    assert p.df.inputFiles() == p.cleaned.inputFiles()
