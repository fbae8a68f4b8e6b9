"""Every registered query with an oracle: Spark result == DuckDB result (sf0.001)."""

import hashlib
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tagflow.plans.registry import REGISTRY
from tagflow.sources.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(E.__file__))


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


# The queries of the training-data operators are tested in tests/llm.
@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in REGISTRY))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert _digest(sdf.columns, rows) == _digest(rel.columns, drows)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, t in sdf.dtypes:
        assert _SPARK_TO_DUCK.get(t, t) == duck_types[col], (col, t, duck_types[col])


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                  "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Id", "Label", "Count"]
    rows = df.collect()
    assert [r.Id for r in rows] == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 20
    assert [r.Count for r in rows] == sorted((r.Count for r in rows), reverse=True)


def test_topic_models_of_the_registered_corpus(spark):
    """The fitted queries have no SQL: their results must still fit the corpus they come from."""
    from tagflow.plans import chain

    q = {n: E.queries()[n](spark, SMALL).collect()
         for n in ("lda_sweep", "coherence_cv", "topic_terms", "topic_relevance", "topic_relevance_top", "cluster_docs")}
    sweep = q["lda_sweep"]
    assert [r.k for r in sorted(sweep)] == list(chain.LDA_KS)
    assert [r.k for r in sweep if r.best] == [max(sweep, key=lambda r: r.coherence).k]
    tokens = sum(r.n_tokens for r in q["cluster_docs"])
    for r in sweep:
        assert abs(r.log_perplexity + r.log_likelihood / tokens) < 1e-9 and -1 <= r.coherence <= 1
    assert {r.topic for r in q["coherence_cv"]} == set(range(chain.TOPIC_K))
    assert {r.topic for r in q["topic_terms"]} == {f"Topic{i + 1}" for i in range(chain.TOPIC_K)}
    for t in range(1, chain.TOPIC_K + 1):
        mine = [r for r in q["topic_relevance"] if r.topic == t]
        assert abs(sum(r.phi for r in mine) - 1) < 1e-6
        ranked = sorted(mine, key=lambda r: (-r.relevance, r.term))[:30]
        top = sorted((r for r in q["topic_relevance_top"] if r.topic == t), key=lambda r: r["rank"])
        assert [r.term for r in top] == [r.term for r in ranked]
    assert abs(sum({r.topic: r.share for r in q["topic_relevance"]}.values()) - 1) < 1e-9


def test_pair_candidates_cover_the_results(spark):
    r = E.queries()["pair_candidates"](spark, SMALL).first()
    assert r.results == E.queries()["cosine_pairs"](spark, SMALL).count()
    assert r.results <= r.candidates <= r.joined_rows <= r.term_join_rows


def test_oracle_needs_no_spark_jars(tmp_path):
    """All SQL is built in a process whose pyspark has no jars; one failing string spares the others."""
    code = f"""
import glob, os, zipfile, sys, warnings
sys.path.insert(0, {ROOT!r})
def hidden(*a, **k):
    raise FileNotFoundError("no jars here")
glob.glob = zipfile.ZipFile = hidden
import __spark_entry__ as E
from tagflow.plans import oracle
assert set(oracle.ORACLE) == set(oracle.oracle_strings())
n = len(E.oracle_sql())
oracle.ORACLE["top_tags"] = lambda: 1 / 0
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    assert len(E.oracle_sql()) == n - 1 and seen
print("built", n)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert "built" in done.stdout, done.stderr


def test_a_changed_input_is_noticed(spark, tmp_path):
    from tagflow.plans.chain import Pipeline

    (tmp_path / "documents.parquet").mkdir()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.limit(20).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    first = Pipeline.of(spark, str(tmp_path))
    assert Pipeline.of(spark, str(tmp_path)) is first
    docs.limit(30).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert Pipeline.of(spark, str(tmp_path)).tweets.count() == 30


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from tagflow import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
