"""Common lines against plain Python, the runs' levels, edge cases."""

import hashlib
import random
from collections import Counter

from tagflow.llm import line_dedup as L

LOW = str.maketrans(L.UPPER, L.LOWER)


def key(line):
    return line.strip(L.SPACE).translate(LOW)


def brute(texts, min_docs, min_chars=1):
    n = Counter()
    for t in texts:
        n.update({key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def texts():
    r = random.Random(5)
    pool = ["Home", " home\t", "HOME", "İstanbul", "i̇stanbul", "", " ", "\x0b", "a b", "a  b", "Ä", "ä", "é\r", "x" * 300]
    pool += [f"line {i}" for i in range(40)]
    out = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(120)]
    return out + [None, "", "\n", "\n\n", "Home\nHome\nhome", "\n".join(f"only here {i}" for i in range(20_000)) + "\nHOME",
                  "same text\nevery line", "same text\nevery line", "same text\nevery line"]


def run(df, **kw):
    return {r["k"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in L.drop_common_lines(df, **kw).collect()}


def test_against_plain_python(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ts)], "doc_id long, text string, k int").repartition(5)
    for kw in ({"min_docs": 3}, {"min_docs": 1}, {"min_docs": 2, "min_chars": 5}, {"min_docs": 3, "batches": 7, "fanout": 3}):
        want = brute(ts, kw["min_docs"], kw.get("min_chars", 1))
        assert run(df, **kw) == dict(enumerate(want)), kw


def test_digest(spark):
    df = spark.createDataFrame([(i, "Top\n" + ("" if i else "own")) for i in range(10)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.digest(df).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept_sha256) == (2, 1, hashlib.sha256(b"own").hexdigest())
    assert got[5].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_repeated_and_missing_ids_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, k int, KEPT string, row int, h long, pos int, gone int, _rid int"
    rows = [(1, "a\nb", 0), (1, "a\nc", 1), (None, "a\nd", 2), (None, None, 3)]
    df = spark.createDataFrame([(*r, "old", 7, 7, 7, 7, 7) for r in rows], schema)
    out = L.drop_common_lines(df, min_docs=3)
    assert out.columns == ["doc_id", "text", "k", "row", "h", "pos", "gone", "_rid", "n_lines", "n_dropped", "kept"]
    assert {r.k: (r.kept, r.row, r["_rid"]) for r in out.collect()} == {0: ("b", 7, 7), 1: ("c", 7, 7), 2: ("d", 7, 7), 3: ("", 7, 7)}
    assert L.drop_common_lines(df.limit(0)).count() == 0


def hashed(spark, docs):
    df = spark.createDataFrame([("\n".join(d),) for d in docs], "text string")
    return L.document_keys(df, 1)


def test_batches_meet_the_runs(spark):
    runs = L.LineRuns(spark, min_docs=2, fanout=2)
    runs.add(hashed(spark, [["a", "b"], ["a", "c"]]))
    assert [len(x) for x in runs.levels] == [1]
    assert runs.unseen(hashed(spark, [["a", "d"], ["e"]])).count() == 2
    assert runs.seen(hashed(spark, [["a", "d"], ["e"]])).count() == 1
    runs.add(hashed(spark, [["a", "b"], ["d"]]))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(hashed(spark, [["a", "f"]]))
    # "a" was settled by the first run: the last one does not write it again
    (name, _), = runs.levels[0]
    assert spark.table(name).count() == 1
    want = {tuple(r) for r in hashed(spark, [["a", "b"]]).collect()}
    assert {(r.h, r.g) for r in runs.common().collect()} == want
    assert len(runs.runs()) == 1
    runs.close()
    assert runs.common().count() == 0 and runs.unseen(hashed(spark, [["a"]])).count() == 1


def test_runs_are_merged_in_place(spark):
    """Neither the anti-joins with a run nor the merge of runs shuffles a run."""
    runs = L.LineRuns(spark, min_docs=2, fanout=9)
    for _ in range(3):
        runs.add(hashed(spark, [["a", "b"], ["a", "c"]]))
    tables = [spark.table(n) for n, _ in runs.runs()]
    every = tables[0].unionAll(tables[1]).unionAll(tables[2])
    plan = every.groupBy("h", "g").sum("n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = hashed(spark, [["a"]]).groupBy("h", "g").count().withColumnRenamed("count", "n")
        plan = runs._unsettled(counts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and "Python" not in plan
    runs.close()
