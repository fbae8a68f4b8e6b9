"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path
from . import (decontaminate, filter_audit, html, license, line_dedup, packing, quality, simhash, substring_dedup,
               suffix_dedup, token_align, tokens, warc)
from .common import table

TOKEN_LIMIT = 2048


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses stated in each document that states one."""
    found = license.with_licenses(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.explode("licenses").alias("m")).select("doc_id", "m.*")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path(),
                               TOKEN_LIMIT, keep=["doc_id"])


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, max_bits=3)


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "archive")
    warc.write_warc(table(spark, sf, "pages"), path, without_id=True)
    got = warc.read_captures(spark, path, with_payload=False)
    return got.select(warc.page_of(F.col("record_id")).alias("page_id"),
                      F.col("response.payload_bytes").alias("payload_bytes"),
                      F.col("response.payload_digest").alias("payload_digest"),
                      F.col("response.warc_type").alias("record_type"),
                      warc.page_of(F.col("response.refers_to")).alias("refers_to"),
                      F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that leak a test item, one row per document and item."""
    found = decontaminate.with_leaks(table(spark, sf, "documents").select("doc_id", "text"),
                                     table(spark, sf, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.*")


def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf, "documents").select("doc_id", "text"), size=400)


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf, "documents").select("doc_id", "text"), size=35)


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), capacity=TOKEN_LIMIT, end_id=0)


def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.main_text(table(spark, sf, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over ``documents``."""
    from corpus_pipeline import run

    return run(spark, sf)


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.quality_rules(docs, model, keep=["doc_id"])


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf, "documents"), min_docs=10, min_chars=1)


AUDITED = {"A": filter_audit.few_words(50), "B": filter_audit.repetitive(65), "C": filter_audit.shouting(5),
           "D": filter_audit.holds(r"[#$%&*|]")}


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes per source, under every order of the filters."""
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"), AUDITED, copies="E",
                              part_col="source")


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_align.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], groups="sha256")


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_counts, op3_simhash_near_dedup, op4_warc, op5_decontaminate,
    op6_suffix_array_dedup, op7_substring_dedup, op8_best_fit_packing, op9_html_extraction, op10_quality_rules,
    op11_line_dedup, op12_filter_audit, op13_token_alignment, pipeline)}

ORACLE = {
    "op7_substring_dedup": """
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents)),
v AS (
  SELECT doc_id, word, pos, md5(string_agg(word, ' ') OVER s) AS win, count(*) OVER s AS n FROM w
  WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT win FROM v WHERE n = 35 GROUP BY win HAVING count(*) > 1),
m AS (SELECT v.doc_id, word, pos, n = 35 AND again.win IS NOT NULL AS starts FROM v LEFT JOIN again ON v.win = again.win),
k AS (
  SELECT doc_id, word, pos, max(CAST(starts AS INTEGER)) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
d AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, 1 AS n_requests, 1 AS n_metadata
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
    "op11_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, line, pos, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op12_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (
  SELECT d.part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels USING (doc_id)),
cell AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter,
              substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) AS g(step)),
m AS (
  SELECT part, filter_order, step, filter, n, good, toxic, list_contains(failed, filter) AS fails,
         len(list_filter(failed, lambda x: contains(earlier, x))) > 0 AS gone, len(failed) = 1 AS single FROM cell, st),
r AS (
  SELECT part, filter_order, step, filter,
         CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails AND single), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, filter)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
""",
}
