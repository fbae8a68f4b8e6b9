"""Enrichment goldens (hand-derived from the rules)."""

import pytest
from pyspark.sql import functions as F

from tagflow.operators import enrich, ingest

COLS = "id long, created_at string, text string, lang string, in_reply_to_status_id long, " \
       "quoted_status_id long, hashtags string, mentions string, truncated int, lat double"


def _data(spark, rows):
    t = spark.createDataFrame(rows, COLS)
    data = ingest.explore(ingest.filter_lang(t))
    return data, ingest.remove_retweets(data)


def test_enrichment_rules(spark):
    rows = [
        (1, "2020-01-01 00:00:00", "base one", "en", None, None, "a", "u1"),
        (2, "2020-01-01 00:01:00", "base two", "en", None, None, None, None),
        (3, "2020-01-01 00:02:00", "quotes one", "en", None, 1, "b", None),       # quote
        (4, "2020-01-01 00:03:00", "replies two", "en", 2, None, None, "u4"),     # reply
        (5, "2020-01-01 00:04:00", "both", "en", 2, 1, "c", None),                # quote and reply
        (6, "2020-01-01 00:05:00", "missing ref", "en", 99, None, None, None),    # no match
        (7, "2020-01-01 00:06:00", "RT retweet reply", "en", 1, None, None, None),  # RT reply
        (8, "2020-01-01 00:07:00", "quotes a retweet", "en", None, 7, None, None),  # ref is RT
    ]
    rows = [r + (None, None) for r in rows]
    data, data1 = _data(spark, rows)
    d2 = {r.id: r for r in enrich.enrich_tweets(data1).collect()}
    assert set(d2) == {1, 2, 3, 4, 5, 6, 8}                  # retweets are not in data2
    assert d2[1].text == "base one"
    assert (d2[3].text, d2[3].hashtags) == ("base one quotes one", "a; b")
    assert (d2[4].text, d2[4].mentions) == ("base two replies two", "u4")
    assert d2[5].text == "base one both base two both"        # own text twice
    assert d2[5].hashtags == "a; c; c"
    assert d2[6].text == " missing ref"                       # leading blank when unmatched
    assert d2[8].text == " quotes a retweet"                  # a retweet is never a lookup target
    chk = enrich.check_enrich(data).first()
    assert not chk.ok and chk.enriched_rows == chk.expected_rows + 1   # the RT reply


def test_enrich_parts(spark):
    rows = [(1, "t", "a", "en", None, None, None, None, None, None),
            (2, "t", "b", "en", 1, 1, "x", None, None, None)]
    data, data1 = _data(spark, rows)
    q = enrich.enrich_quotes(data, data1).first()
    r = enrich.enrich_replies(data, data1).first()
    b = enrich.enrich_both(data, data1).first()
    assert (q.text, r.text, b.text) == ("a b", "a b", "a b a b")
    assert b.hashtags == "x; x"


def test_repeated_ids_are_refused(spark):
    rows = [(1, "t", "a", "en", None, None, None, None, None, None), (1, "t", "b", "en", None, None, None, None, None, None),
            (2, "t", "c", "en", 1, None, None, None, None, None)]
    data, data1 = _data(spark, rows)
    with pytest.raises(Exception, match="tweet id 1 is repeated"):
        enrich.enrich_replies(data, data1).collect()


def test_check_counts_joined_rows(spark):
    rows = [(i, "t", f"x{i}", "en", i - 1 if i % 2 else None, i - 2 if i % 3 == 0 and i > 2 else None, None, None, None, None)
            for i in range(1, 30)]
    data, _ = _data(spark, rows)
    row = enrich.check_enrich(data).first()
    quoting = {r[0] for r in rows if r[5]}
    replying = {r[0] for r in rows if r[4]}
    assert row.ok and row.enriched_rows == len(quoting | replying)
