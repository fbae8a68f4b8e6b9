"""Tag segments: rows against a plain distinct, and how often texts move."""

from pyspark.sql import functions as F

from tagflow.operators import docs
from tagflow.operators import tags as tg

ROWS = [
    (1, "A;b", ["x", "y"], "x y"), (2, "a", ["x", "y"], "x  y"), (3, "a;a", ["x", "y"], "x y"), (3, "c", ["x", "y"], "x y"),
    (None, "b", ["z"], "z the"), (None, "b ;a", ["z"], "z"), (4, None, ["z"], "z"), (5, "b", [], ""), (6, "b", None, None),
    (7, "c;b", ["x, y"], "x, y"), (8, "", ["q"], "q"), (9, "b", [""], ""),
]


def _frames(spark):
    df = spark.createDataFrame(ROWS, "id long, hashtags string, tokenized array<string>, preprocessed string")
    popular = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    plain = tg.reduce_incidence(tg.tag_incidence(df, extra_cols=("tokenized", "preprocessed")), popular)
    return df, popular, plain.select("tag", "tokenized", "preprocessed").distinct()


def rows(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def test_segments_are_the_distinct_texts_of_each_tag(spark):
    df, popular, plain = _frames(spark)
    got = docs.tag_segments(df, popular)
    assert rows(got, "tag", "tokenized", "preprocessed") == rows(plain, "tag", "tokenized", "preprocessed")
    for col in ("tokenized", "preprocessed"):
        assert rows(docs.distinct_texts(got, col), "tag", col) == rows(plain.select("tag", col).distinct(), "tag", col)
        text = plain.select("tag", docs.as_text(plain, col).alias("text")).distinct()
        assert rows(docs.distinct_texts(got, col, joined=True), "tag", "text") == rows(text, "tag", "text")
        assert rows(docs.distinct_texts(plain, col), "tag", col) == rows(docs.distinct_texts(got, col), "tag", col)


def test_texts_of_written_segments_do_not_move(spark, tmp_path):
    df, popular, _ = _frames(spark)
    docs.tag_segments(df, popular).write.parquet(f"{tmp_path}/segments")
    segments = spark.read.parquet(f"{tmp_path}/segments")
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "Id long, Name string")
    for col in ("tokenized", "preprocessed"):
        plan = docs.tag_doc_segments(segments, nodes, 3, col)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "Id long, cluster long")
    out = docs.cluster_segments(segments, nodes, labels, 3)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where(F.col("doc_key") == 2).select("tag").distinct().collect()[0].tag == "c"
