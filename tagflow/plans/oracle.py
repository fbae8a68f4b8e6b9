"""DuckDB SQL for each registered query (the correctness oracle).

The SQL is written independently of the Spark code: common table
expressions rebuild the same stages from the shared views.  Regex classes
are the same explicit classes as ``functions.text`` (RE2 accepts the
``\\x{...}`` and ``\\p{L}`` forms too).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import lru_cache

from ..functions import fixed
from ..functions import text as tx
from ..functions.stopwords import default_stopwords
from ..operators import urls
from ..operators.embeddings import MIN_COUNT, WINDOW
from ..operators.idsets import ARRAY_IDS
from ..sources.fixtures import EXTRA_STOPWORDS, MAX_TURNS
from .chain import MIN_WORDS, POPULAR_MIN

ORACLE: dict[str, Callable[[], str]] = {}


def oracle_strings() -> dict[str, str]:
    """The SQL of every query, each built on its own: one that cannot be built is left out with a warning."""
    out = {}
    for name, build in ORACLE.items():
        try:
            out[name] = build()
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"no oracle SQL for {name}: {e!r}", stacklevel=2)
    return out


def s(v: str) -> str:
    """SQL string literal."""
    return "'" + v.replace("'", "''") + "'"


WS = tx.WS
BLANK_RE = "^" + WS + "*$"


def blank_null(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, {s(BLANK_RE)}) THEN NULL ELSE {e} END)"


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, {s('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {s(WS + '+')}), lambda w: w <> '')"


def is_ascii(e: str) -> str:
    return f"(NOT regexp_matches({e}, {s(tx.NON_ASCII_RE)}))"


def pre_clean(e: str) -> str:
    src = "".join(a for a, _ in fixed.PRE_REPLACE)
    dst = "".join(b for _, b in fixed.PRE_REPLACE)
    t = f"translate({e}, {s(src)}, {s(dst)})"
    t = f"regexp_replace({t}, {s(tx.URL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {s(tx.MENTION_RE)}, '', 'g')"
    return f"lower({t})"


def contraction_case(h: str) -> str:
    seen: dict[str, str] = {}
    for k, v in fixed.CONTRACTIONS:
        seen.setdefault(k, v)
    whens = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in seen.items())
    return f"(CASE {h} {whens} ELSE '' END)"


def contract(parts: str, hits: str) -> str:
    return (f"array_to_string(list_transform(range(1, len({parts}) + 1), "
            f"lambda i: {parts}[i] || coalesce({contraction_case(hits + '[i]')}, '')), '')")


def post_clean(e: str) -> str:
    t = f"regexp_replace({e}, {s(tx.EMOJI_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {s(tx.PUNCT_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {s(tx.DIGITS_RE)}, '', 'g')"
    return f"regexp_replace({t}, {s(WS + '+')}, ' ', 'g')"


def clean_ctes(src: str, col: str, name: str) -> str:
    """CTEs ``{name}_a.._c`` adding ``preprocessed`` = clean(col) to every row of src."""
    cre = s(tx.CONTRACTION_ALT_RE)
    return f"""
{name}_a AS (SELECT *, {pre_clean(col)} AS _pre FROM {src}),
{name}_b AS (SELECT *, regexp_split_to_array(_pre, {cre}) AS _parts,
                       regexp_extract_all(_pre, {cre}, 1) AS _hits FROM {name}_a),
{name} AS (SELECT * EXCLUDE (_pre, _parts, _hits), {post_clean(contract('_parts', '_hits'))} AS preprocessed
           FROM {name}_b)"""


def stop_list() -> str:
    return "[" + ", ".join(s(w) for w in default_stopwords()) + "]"


def tokens(e: str) -> str:
    return (f"list_filter({words(e)}, lambda t: length(t) >= {fixed.MIN_TOKEN_LEN} "
            f"AND NOT contains({s(fixed.TOKEN_PUNCTUATION)}, t) AND NOT list_contains({stop_list()}, t))")


TWEETS = r"""
tweets AS (
select doc_id+1 as id,
  strftime(make_timestamp((1577836800+doc_id*60)*1000000),'%Y-%m-%d %H:%M:%S') as created_at,
  (case when doc_id%11=0 then 'RT ' else '' end)||text as text, lang,
  case when doc_id%7=0 and doc_id>=7 then doc_id-6 end as in_reply_to_status_id,
  case when doc_id%5=0 and doc_id>=5 then doc_id-4 end as quoted_status_id,
  nullif(array_to_string(list_filter(list_transform(list_slice(regexp_split_to_array(text,'[ \n]'),1,doc_id%4),
    lambda w: regexp_replace(w,'[^A-Za-z]','','g')), lambda w: w<>''),';'),'') as hashtags,
  case when doc_id%6=0 then 'user'||cast(doc_id%50 as varchar) end as mentions,
  CAST(NULL AS INTEGER) AS truncated, CAST(NULL AS DOUBLE) AS lat
from documents)"""


def _enriched(tag: str) -> str:
    return (f"coalesce({tag}.ref_text, '') || ' ' || coalesce(d.text, 'nan') AS {tag}_etext, "
            f"{blank_null(f'concat_ws(chr(59) || chr(32), {tag}.ref_tags, d.hashtags)')} AS {tag}_etags, "
            f"{blank_null(f'concat_ws(chr(59) || chr(32), {tag}.ref_mentions, d.mentions)')} AS {tag}_ementions")


@lru_cache(maxsize=None)
def base() -> str:
    return TWEETS + f""",
data AS (
  SELECT id, created_at, text, coalesce(in_reply_to_status_id, 0) AS in_reply_to_status_id,
         coalesce(quoted_status_id, 0) AS quoted_status_id, hashtags, mentions,
         coalesce(truncated, 0) AS truncated, coalesce(lat, 0) AS lat,
         CAST(starts_with(text, 'RT') AS INTEGER) AS retweet
  FROM tweets WHERE lang = 'en'),
data1 AS (
  SELECT id, created_at, text, quoted_status_id, retweet, in_reply_to_status_id, hashtags, mentions
  FROM data WHERE NOT starts_with(text, 'RT')),
lk AS (SELECT id AS ref_id, text AS ref_text, hashtags AS ref_tags, mentions AS ref_mentions FROM data1),
enr AS (
  SELECT d.*, {_enriched('q')}, {_enriched('r')}
  FROM data1 d LEFT JOIN lk q ON d.quoted_status_id = q.ref_id
               LEFT JOIN lk r ON d.in_reply_to_status_id = r.ref_id),
data2_raw AS (
  SELECT id, created_at, quoted_status_id, retweet, in_reply_to_status_id,
    CASE WHEN quoted_status_id <> 0 AND in_reply_to_status_id <> 0 THEN q_etext || ' ' || r_etext
         WHEN quoted_status_id <> 0 THEN q_etext
         WHEN in_reply_to_status_id <> 0 THEN r_etext ELSE text END AS text,
    CASE WHEN quoted_status_id <> 0 AND in_reply_to_status_id <> 0
           THEN coalesce({blank_null('concat_ws(chr(59) || chr(32), q_etags, r_etags)')}, hashtags)
         WHEN quoted_status_id <> 0 THEN coalesce(q_etags, hashtags)
         WHEN in_reply_to_status_id <> 0 THEN coalesce(r_etags, hashtags) ELSE hashtags END AS hashtags,
    CASE WHEN quoted_status_id <> 0 AND in_reply_to_status_id <> 0
           THEN coalesce({blank_null('concat_ws(chr(59) || chr(32), q_ementions, r_ementions)')}, mentions)
         WHEN quoted_status_id <> 0 THEN coalesce(q_ementions, mentions)
         WHEN in_reply_to_status_id <> 0 THEN coalesce(r_ementions, mentions) ELSE mentions END AS mentions
  FROM enr),
data2 AS (
  SELECT id, strftime(strptime(created_at, '%Y-%m-%d %H:%M:%S'), '%m/%d/%Y') AS created_at,
         text, hashtags, mentions FROM data2_raw),
d2h AS (
  SELECT *, text AS text_h_in,
         coalesce(string_split(hashtags, ';'), []) AS hashtags_list,
         CAST(len(coalesce(string_split(hashtags, ';'), [])) AS INTEGER) AS h_number,
         coalesce(string_split(mentions, ';'), []) AS mentions_list,
         CAST(len(coalesce(string_split(mentions, ';'), [])) AS INTEGER) AS men_number
  FROM data2),{clean_ctes('d2h', 'text_h_in', 'cleaned')},
dedup AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY preprocessed, hashtags ORDER BY id) AS _rn FROM cleaned)
  WHERE _rn = 1),
staged AS (SELECT * FROM dedup WHERE len({words('preprocessed')}) >= {MIN_WORDS}),
dfx AS (
  SELECT *, {tokens('preprocessed')} AS tokenized FROM staged
  WHERE {is_ascii('preprocessed')} AND (hashtags IS NULL OR {is_ascii('hashtags')})),
inc_raw AS (SELECT id AS tweet_id, unnest(string_split(hashtags, ';')) AS tag FROM dfx WHERE hashtags IS NOT NULL),
inc AS (SELECT tweet_id, {py_strip('lower(tag)')} AS tag FROM inc_raw),
counts AS (SELECT tag, count(*) AS "Count", count(DISTINCT tweet_id) AS n_tweets FROM inc GROUP BY tag),
popular AS (SELECT * FROM counts WHERE "Count" >= {POPULAR_MIN}),
nodes AS (SELECT row_number() OVER (ORDER BY "Count" DESC, tag ASC) AS "Id", tag AS "Name", tag AS "Label", "Count"
          FROM popular),
reduced AS (SELECT * FROM inc WHERE tag IN (SELECT tag FROM popular)),
rdist AS (SELECT DISTINCT tweet_id, tag FROM reduced),
pairs AS (SELECT a.tweet_id, a.tag AS tag_a, b.tag AS tag_b FROM rdist a JOIN rdist b
          ON a.tweet_id = b.tweet_id AND a.tag < b.tag),
edges AS (SELECT p.tweet_id AS "TweetID", least(na."Id", nb."Id") AS "Source", greatest(na."Id", nb."Id") AS "Target",
                 'Undirected' AS "Type", 1 AS "Weight"
          FROM pairs p LEFT JOIN nodes na ON p.tag_a = na."Name" LEFT JOIN nodes nb ON p.tag_b = nb."Name")
"""


def with_base(select: str) -> str:
    return "WITH " + base() + "\n" + select


def q(name: str, build: Callable[[], str]):
    ORACLE[name] = build


# ---- ingest ---------------------------------------------------------------
q("filter_lang", lambda: with_base("SELECT * EXCLUDE (lang) FROM tweets WHERE lang = 'en'"))
q("flag_retweets", lambda: with_base("SELECT id, CAST(starts_with(text, 'RT') AS INTEGER) AS retweet FROM tweets"))
q("fill_sentinels", lambda: with_base(
    "SELECT id, in_reply_to_status_id, quoted_status_id, truncated, lat, retweet FROM data"))
q("remove_retweets", lambda: with_base("SELECT * FROM data1"))
q("format_dates", lambda: with_base(
    "SELECT id, strftime(strptime(created_at, '%Y-%m-%d %H:%M:%S'), '%m/%d/%Y') AS created_at FROM data1"))
q("corpus_profile", lambda: with_base("""
SELECT * FROM (VALUES ('Tweets', (SELECT count(*) FROM tweets)),
  ('English Tweets', (SELECT count(*) FROM tweets WHERE lang = 'en')),
  ('Unique English Tweets (not retweet)', (SELECT count(*) FROM tweets WHERE lang = 'en' AND NOT starts_with(text, 'RT'))))
  AS t(characteristic, value)"""))

_FULL = [
    ("Number of columns", "max(10)"),
    ("English tweets", "count(*)"),
    ("--Retweets (RT)", "count(*) FILTER (WHERE retweet = 1)"),
    ("--Unique tweets (not RT)", "count(*) FILTER (WHERE retweet <> 1)"),
    ("--Replies", "count(*) FILTER (WHERE in_reply_to_status_id <> 0)"),
    ("--Quoting tweets", "count(*) FILTER (WHERE quoted_status_id <> 0)"),
    ("--RT & quoting", "count(*) FILTER (WHERE retweet = 1 AND quoted_status_id <> 0)"),
    ("--RT & reply", "count(*) FILTER (WHERE retweet = 1 AND in_reply_to_status_id <> 0)"),
    ("--RT & not quoting", "count(*) FILTER (WHERE retweet = 1 AND quoted_status_id = 0)"),
    ("--not RT & quoting", "count(*) FILTER (WHERE retweet = 0 AND quoted_status_id <> 0)"),
    ("--not RT & not quoting & reply",
     "count(*) FILTER (WHERE retweet = 0 AND quoted_status_id = 0 AND in_reply_to_status_id <> 0)"),
    ("--not RT & quoting & not reply",
     "count(*) FILTER (WHERE retweet = 0 AND quoted_status_id <> 0 AND in_reply_to_status_id = 0)"),
    ("--not RT & not quoting & not reply",
     "count(*) FILTER (WHERE retweet = 0 AND quoted_status_id = 0 AND in_reply_to_status_id = 0)"),
    ("--not RT & quoting & reply",
     "count(*) FILTER (WHERE retweet = 0 AND quoted_status_id <> 0 AND in_reply_to_status_id <> 0)"),
    ("--RT or quoting or reply",
     "count(*) FILTER (WHERE NOT (retweet = 0 AND quoted_status_id = 0 AND in_reply_to_status_id = 0))"),
    ("--Truncated tweets", "count(*) FILTER (WHERE truncated = 1)"),
    ("--GeoTagged tweets", "count(*) FILTER (WHERE lat <> 0)"),
]
q("corpus_profile_full", lambda: with_base(" UNION ALL ".join(
    f"SELECT {s(name)} AS characteristic, CAST(({expr}) AS BIGINT) AS value FROM data" for name, expr in _FULL)))

# ---- enrichment -----------------------------------------------------------
def _enrich_sql(where: str, key: str, tag: str) -> str:
    return f"""
SELECT d.id, d.created_at, d.retweet, d.quoted_status_id, d.in_reply_to_status_id,
       {tag}_etext AS text, {tag}_etags AS hashtags, {tag}_ementions AS mentions
FROM (SELECT d.*, {_enriched(tag)} FROM data d LEFT JOIN lk {tag} ON d.{key} = {tag}.ref_id WHERE {where}) d"""


q("enrich_quotes", lambda: with_base(_enrich_sql("d.quoted_status_id <> 0 AND d.retweet = 0", "quoted_status_id", "q")))
q("enrich_replies", lambda: with_base(_enrich_sql("d.in_reply_to_status_id <> 0", "in_reply_to_status_id", "r")))
q("enrich_both", lambda: with_base(f"""
SELECT id, retweet, quoted_status_id, in_reply_to_status_id, q_etext || ' ' || r_etext AS text,
       {blank_null('concat_ws(chr(59) || chr(32), q_etags, r_etags)')} AS hashtags,
       {blank_null('concat_ws(chr(59) || chr(32), q_ementions, r_ementions)')} AS mentions
FROM (SELECT d.*, {_enriched('q')}, {_enriched('r')}
      FROM data d LEFT JOIN lk q ON d.quoted_status_id = q.ref_id
                  LEFT JOIN lk r ON d.in_reply_to_status_id = r.ref_id
      WHERE d.quoted_status_id <> 0 AND d.retweet = 0 AND d.in_reply_to_status_id <> 0)"""))
q("enrich_tweets", lambda: with_base("SELECT * FROM data2"))
q("check_enrich", lambda: with_base("""
SELECT enriched_rows, expected_rows, enriched_rows = expected_rows AS ok FROM (
  SELECT count(*) FILTER (WHERE quoted_status_id <> 0 AND retweet = 0)
       + count(*) FILTER (WHERE in_reply_to_status_id <> 0)
       - count(*) FILTER (WHERE quoted_status_id <> 0 AND retweet = 0 AND in_reply_to_status_id <> 0) AS enriched_rows,
         count(*) FILTER (WHERE retweet = 0 AND quoted_status_id <> 0)
       + count(*) FILTER (WHERE retweet = 0 AND quoted_status_id = 0 AND in_reply_to_status_id <> 0) AS expected_rows
  FROM data)"""))

# ---- cleaning -------------------------------------------------------------
q("clean_text", lambda: "WITH " + TWEETS + "," + clean_ctes("tweets", "text", "ct") + "\nSELECT id, preprocessed FROM ct")
q("expand_contractions", lambda: "WITH " + TWEETS + f""",
x AS (SELECT id, lower(text) AS t FROM tweets),
y AS (SELECT id, regexp_split_to_array(t, {s(tx.CONTRACTION_ALT_RE)}) AS _parts,
             regexp_extract_all(t, {s(tx.CONTRACTION_ALT_RE)}, 1) AS _hits FROM x)
SELECT id, {contract('_parts', '_hits')} AS expanded FROM y""")
q("tag_text_modes", lambda: with_base(f"""
SELECT id, text AS text_h_in, regexp_replace(text, {s(tx.TAG_RE)}, '', 'g') AS text_h_out,
       regexp_replace(regexp_replace(text, {s(tx.URL_RE)}, '', 'g'), {s(tx.END_TAGS_RE)}, '', 'g') AS text_h_ne
FROM data2"""))
q("tag_lists", lambda: with_base("""
SELECT id, array_to_string(hashtags_list, '|') AS hashtags_list, h_number,
       array_to_string(mentions_list, '|') AS mentions_list, men_number FROM d2h"""))
q("inline_tags", lambda: with_base(f"""
SELECT id, array_to_string(l, '|') AS hashtags_ne, CAST(len(l) AS INTEGER) AS h_ne_number FROM (
  SELECT id, regexp_extract_all(regexp_replace(regexp_replace(text, {s(tx.URL_RE)}, '', 'g'),
                                {s(tx.END_TAGS_RE)}, '', 'g'), {s(tx.TAG_RE)}, 1) AS l FROM data2)"""))
q("dedup_first", lambda: with_base("SELECT id, preprocessed, hashtags FROM dedup"))
q("min_words", lambda: with_base(f"SELECT id, CAST(len({words('preprocessed')}) AS INTEGER) AS n_words FROM staged"))
q("ascii_only", lambda: with_base(f"SELECT id FROM staged WHERE {is_ascii('preprocessed')}"))
q("ascii_tags", lambda: with_base("SELECT id FROM dfx"))
q("length_hist", lambda: "WITH " + base() + "," + clean_ctes("data1", "text", "c1") + "," + clean_ctes("data2", "text", "c2")
  + f"""
SELECT 'data1' AS dataset, CAST(len({words('preprocessed')}) AS INTEGER) AS textlen, count(*) AS count FROM c1 GROUP BY 2
UNION ALL
SELECT 'data2' AS dataset, CAST(len({words('preprocessed')}) AS INTEGER) AS textlen, count(*) AS count FROM c2 GROUP BY 2""")
q("tokenize_lemma", lambda: with_base(
    "SELECT id, array_to_string(tokenized, ' ') AS tokenized, CAST(len(tokenized) AS INTEGER) AS n_tokens FROM dfx"))

# ---- tags -----------------------------------------------------------------
q("tagged_tweets", lambda: with_base(
    "SELECT id, CAST(len(string_split(hashtags, ';')) AS INTEGER) AS n_tags, h_number FROM dfx WHERE hashtags IS NOT NULL"))
q("explode_tags", lambda: with_base("SELECT tweet_id, tag FROM inc_raw"))
q("normalize_tags", lambda: with_base("SELECT tweet_id, tag FROM inc"))
q("tag_counts", lambda: with_base("SELECT * FROM counts"))
q("word_cooccurrence", lambda: with_base(f"""
, t AS (SELECT id, tokenized AS t FROM dfx), w AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM t),
known AS (SELECT w FROM w GROUP BY w HAVING count(*) >= {MIN_COUNT}),
pn AS (SELECT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b, count(*) AS n FROM w x JOIN w y
       ON x.id = y.id AND y.p > x.p AND y.p <= x.p + {WINDOW} AND x.w <> y.w
       WHERE x.w IN (SELECT w FROM known) AND y.w IN (SELECT w FROM known) GROUP BY 1, 2),
e AS (SELECT w, sum(n) AS n FROM (SELECT a AS w, n FROM pn UNION ALL SELECT b, n FROM pn) GROUP BY w)
SELECT a, b, n, round(x, 9) AS x FROM (
  SELECT a, b, pn.n, ln(CAST(pn.n AS DOUBLE) * (SELECT 2 * sum(n) FROM pn) / (CAST(ea.n AS DOUBLE) * eb.n)) AS x
  FROM pn JOIN e ea ON a = ea.w JOIN e eb ON b = eb.w) WHERE x > 0"""))
BASKETS = """inc AS (SELECT DISTINCT l.l_orderkey AS id, p.p_brand AS tag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""
q("tag_id_sets", lambda: f"""
WITH {BASKETS}
SELECT tag, bucket, count(*) AS n, CASE WHEN count(*) >= {ARRAY_IDS} THEN 'bits' ELSE 'ids' END AS kind,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
FROM (SELECT tag, id, CASE WHEN id > 0 THEN (id - 1) // 32768 + 1 ELSE CAST(trunc(id / 32768) AS BIGINT) END AS bucket FROM inc)
GROUP BY tag, bucket""")
q("tag_overlaps", lambda: f"""
WITH {BASKETS},
n AS (SELECT tag, count(*) AS n FROM inc GROUP BY tag),
w AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS shared FROM inc a JOIN inc b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2)
SELECT tag_a, tag_b, na.n AS n_a, nb.n AS n_b, shared, round(shared / (na.n + nb.n - shared), 9) AS jaccard
FROM w JOIN n na ON tag_a = na.tag JOIN n nb ON tag_b = nb.tag""")
q("popular_tags", lambda: with_base("SELECT * FROM popular"))
q("graph_nodes", lambda: with_base("SELECT * FROM nodes"))
q("top_tags", lambda: with_base(
    'SELECT CAST("Id" AS INTEGER) AS "Id", "Label", "Count" FROM nodes WHERE "Id" <= ' + str(fixed.TOP_TAGS)))
q("cooccur_edges", lambda: with_base("SELECT * FROM edges"))
q("cooccur_weighted", lambda: """
WITH inc AS (SELECT l.l_orderkey AS tweet_id, p.p_brand AS tag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
counts AS (SELECT tag, count(*) AS c FROM inc GROUP BY tag),
nodes AS (SELECT row_number() OVER (ORDER BY c DESC, tag) AS id, tag FROM counts),
d AS (SELECT DISTINCT tweet_id, tag FROM inc),
w AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS "Weight" FROM d a JOIN d b
      ON a.tweet_id = b.tweet_id AND a.tag < b.tag GROUP BY 1, 2)
SELECT least(na.id, nb.id) AS "Source", greatest(na.id, nb.id) AS "Target", 'Undirected' AS "Type", "Weight"
FROM w JOIN nodes na ON w.tag_a = na.tag JOIN nodes nb ON w.tag_b = nb.tag""")
q("url_by_tagcount", lambda: with_base(f"""
SELECT h_number AS hash_count, count(*) AS number_of_tweets, CAST(sum(uc) AS BIGINT) AS url_total_count,
       count(*) FILTER (WHERE uc > 0) AS url_total_withurl,
       round(count(*) FILTER (WHERE uc > 0) / count(*), 9) AS url_percent_withurl
FROM (SELECT h_number, len(regexp_extract_all(text, {s(tx.LINK_RE)}, 0)) AS uc FROM dfx)
GROUP BY h_number"""))
q("extract_urls", lambda: f"""
SELECT page_id, CAST(len(l) AS INTEGER) AS url_count, array_to_string(l, ' ') AS urls FROM (
  SELECT page_id, regexp_extract_all(concat_ws(' ', url, html), {s(tx.LINK_RE)}, 0) AS l
  FROM pages)""")
q("bare_urls", lambda: f"""
WITH suffix AS (SELECT DISTINCT lower(regexp_extract(regexp_extract(url, '^https?://([^/?#:]*)', 1), '[^.]+$', 0)) AS suffix FROM pages),
run AS (
  SELECT page_id AS id, unnest(l) AS run, generate_subscripts(l, 1) AS pos FROM (
    SELECT page_id, list_filter(regexp_extract_all(concat_ws(' ', regexp_replace(url, '^https?://', ''), html), {s(urls.RUN)}, 0),
                                lambda r: contains(r, '.') OR contains(r, '://')) AS l FROM pages)),
u AS (SELECT id, pos, regexp_replace(run, {s(urls.TRAILING)}, '') AS url FROM run),
h AS (
  SELECT *, regexp_matches(url, {s(urls.SCHEME)}) AS scheme,
         regexp_extract(regexp_replace(url, {s(urls.SCHEME)}, ''), '^[^/?#]*', 0) AS host FROM u),
c AS (
  SELECT id, pos, url, scheme, lower(regexp_replace(
    CASE WHEN scheme THEN regexp_replace(host, '^.*@', '') ELSE host END, ':[0-9]*$', '')) AS host FROM h),
k AS (
  SELECT c.*, string_split(host, '.') AS l FROM c
  WHERE CASE WHEN scheme THEN host <> '' ELSE regexp_matches(host, {s(urls.HOST)}) END),
m AS (
  SELECT id, pos, url, scheme, any_value(l) AS l, max(d) FILTER (s.suffix IS NOT NULL) AS d
  FROM (SELECT k.*, unnest(range(1, 4)) AS d FROM k) x
  LEFT JOIN suffix s ON d <= len(l) AND array_to_string(l[len(l) - d + 1:], '.') = s.suffix GROUP BY id, pos, url, scheme),
f AS (
  SELECT id, pos, url, scheme, CASE WHEN d < len(l) THEN array_to_string(l[len(l) - d:], '.') END AS domain FROM m
  WHERE scheme OR d < len(l)),
g AS (
  SELECT id, CAST(count(*) AS INTEGER) AS url_count, count(*) FILTER (NOT scheme) AS bare_count,
         string_agg(url, ' ' ORDER BY pos) AS urls,
         array_to_string(list_sort(list(DISTINCT domain) FILTER (domain IS NOT NULL)), ' ') AS domains FROM f GROUP BY id)
SELECT page_id AS id, coalesce(url_count, 0) AS url_count, coalesce(bare_count, 0) AS bare_count,
       coalesce(urls, '') AS urls, coalesce(domains, '') AS domains FROM pages LEFT JOIN g ON page_id = id""")
q("tag_report", lambda: with_base("""
SELECT * FROM (VALUES
 ('cleaned tweets', (SELECT count(*) FROM dfx)),
 ('Total hashtags (repetitive) in cleaned tweets', (SELECT count(*) FROM inc)),
 ('-- Unique hashtags', (SELECT count(DISTINCT tag) FROM inc)),
 ('Total hashtags (repetitive) after removing unpopular hashtags', (SELECT count(*) FROM reduced)),
 ('-- Unique hashtags after removing unpopular hashtags', (SELECT count(DISTINCT tag) FROM reduced)),
 ('Tweets containing no hashtags', (SELECT count(*) FILTER (WHERE hashtags IS NULL) FROM dfx)),
 ('Tweets containing at least one hashtag', (SELECT count(*) FILTER (WHERE hashtags IS NOT NULL) FROM dfx)),
 ('-- One hashtag per tweet', (SELECT count(*) FILTER (WHERE h_number = 1) FROM dfx)),
 ('-- Two hashtags per tweet', (SELECT count(*) FILTER (WHERE h_number = 2) FROM dfx)),
 ('-- More than two hashtags per tweet', (SELECT count(*) FILTER (WHERE h_number >= 3) FROM dfx)),
 ('Maximum number of hashtags used in a tweet', (SELECT max(h_number) FROM dfx)),
 ('Total hashtag co-occurrences after removing unpopular hashtags', (SELECT count(*) FROM edges))
) AS t(characteristic, value)"""))

# ---- documents and similarity --------------------------------------------
from .chain import SIM_THRESHOLD, TERM_SIM_THRESHOLD, TFIDF_MAX_DF, TOP_FEATURES  # noqa: E402

_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

@lru_cache(maxsize=None)
def sim() -> str:
    return base().rstrip() + f""",
inc_tok AS (SELECT tweet_id, {py_strip('lower(tag)')} AS tag, tokenized, preprocessed FROM (
              SELECT id AS tweet_id, unnest(string_split(hashtags, ';')) AS tag, tokenized, preprocessed
              FROM dfx WHERE hashtags IS NOT NULL)),
segs AS (SELECT DISTINCT tag, tokenized, preprocessed FROM inc_tok WHERE tag IN (SELECT tag FROM popular)),
texts AS (SELECT DISTINCT s.tag, s.tokenized, n."Id" AS doc_id FROM segs s JOIN nodes n ON s.tag = n."Name"),
toks AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(array_to_string(tokenized, ', '), {s(_TOKEN_PATTERN)}, 0),
                                       lambda t: NOT list_contains({stop_list()}, t))) AS term FROM texts),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
ndocs AS (SELECT count(DISTINCT doc_id) AS n FROM texts),
vstats AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tf GROUP BY term),
vocab AS (SELECT term, df, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM vstats, ndocs
          WHERE df <= {TFIDF_MAX_DF} * n),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN vocab USING (term)),
wts AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw),
cos AS (SELECT a.doc_id AS "Source", b.doc_id AS "Target", sum(a.weight * b.weight) AS "Weight"
        FROM wts a JOIN wts b ON a.term = b.term AND a.doc_id > b.doc_id GROUP BY 1, 2
        HAVING sum(a.weight * b.weight) >= {SIM_THRESHOLD}),
vocabs AS (SELECT v.term, idf FROM vocab v JOIN vstats USING (term) ORDER BY ctf DESC, v.term ASC LIMIT {TOP_FEATURES}),
raws AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN vocabs USING (term)),
wtss AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raws),
tcols AS (SELECT term AS col, doc_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY term)) AS u FROM wtss),
tsim1 AS (SELECT a.col AS t1, b.col AS t2, sum(a.u * b.u) AS s FROM tcols a JOIN tcols b
          ON a.doc_id = b.doc_id AND a.col > b.col GROUP BY 1, 2 HAVING sum(a.u * b.u) >= {TERM_SIM_THRESHOLD}),
tsim AS (SELECT t1, t2, s FROM tsim1 UNION ALL SELECT t2 AS t1, t1 AS t2, s FROM tsim1),
sy AS (SELECT doc_id, term, sum(v) AS v FROM (
         SELECT y.doc_id, ts.t1 AS term, ts.s * y.weight AS v FROM wtss y JOIN tsim ts ON y.term = ts.t2
         UNION ALL SELECT doc_id, term, weight AS v FROM wtss) GROUP BY 1, 2),
selfdot AS (SELECT w.doc_id, sum(w.weight * sy.v) AS n FROM wtss w JOIN sy USING (doc_id, term) GROUP BY 1),
soft AS (SELECT d1 AS "Source", d2 AS "Target", dot / sqrt(n1.n * n2.n) AS "Weight" FROM (
           SELECT x.doc_id AS d1, s2.doc_id AS d2, sum(x.weight * s2.v) AS dot FROM wtss x JOIN sy s2
           ON x.term = s2.term AND x.doc_id > s2.doc_id GROUP BY 1, 2) p
         JOIN selfdot n1 ON p.d1 = n1.doc_id JOIN selfdot n2 ON p.d2 = n2.doc_id
         WHERE dot / sqrt(n1.n * n2.n) >= {SIM_THRESHOLD})
"""


def with_sim(select: str) -> str:
    return "WITH " + sim() + "\n" + select


q("tag_docs", lambda: with_sim("""
SELECT c.tag AS "Name", n."Id", c.count, t.n_texts, t.n_tokens FROM
  (SELECT tag, count(*) AS count FROM segs GROUP BY tag) c
  JOIN (SELECT tag, count(*) AS n_texts, CAST(sum(len(tokenized)) AS BIGINT) AS n_tokens
        FROM (SELECT DISTINCT tag, tokenized FROM segs) GROUP BY tag) t USING (tag)
  LEFT JOIN nodes n ON c.tag = n."Name" """))
q("tfidf", lambda: with_sim("SELECT doc_id, term, round(weight, 9) AS weight FROM wts"))
q("cosine_pairs", lambda: with_sim('SELECT "Source", "Target", round("Weight", 9) AS "Weight" FROM cos'))
q("similarity_edges", lambda: with_sim("SELECT \"Source\", \"Target\", round(\"Weight\", 9) AS \"Weight\", 'Undirected' AS \"Type\" FROM cos"))
q("check_pairs", lambda: with_sim("""
SELECT (SELECT count(*) FROM nodes) AS n_nodes,
       (SELECT count(*) * (count(*) - 1) // 2 FROM nodes) AS max_pairs,
       count(*) AS edge_rows, count(*) FILTER (WHERE "Source" <= "Target") AS misordered,
       count(*) FILTER (WHERE "Weight" > 1 + 1e-9) AS above_one,
       count(*) <= (SELECT count(*) * (count(*) - 1) // 2 FROM nodes)
         AND count(*) FILTER (WHERE "Source" <= "Target") = 0
         AND count(*) FILTER (WHERE "Weight" > 1 + 1e-9) = 0 AS ok
FROM cos"""))
q("soft_cosine_pairs", lambda: with_sim('SELECT "Source", "Target", round("Weight", 9) AS "Weight" FROM soft'))
# The same over the whole vocabulary, term by term.
q("soft_cosine_pairs_all", lambda: "WITH " + sim().rstrip() + f""",
tcolsa AS (SELECT term AS col, doc_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY term)) AS u FROM wts),
tsima1 AS (SELECT a.col AS t1, b.col AS t2, sum(a.u * b.u) AS s FROM tcolsa a JOIN tcolsa b
           ON a.doc_id = b.doc_id AND a.col > b.col GROUP BY 1, 2 HAVING sum(a.u * b.u) >= {TERM_SIM_THRESHOLD}),
tsima AS (SELECT t1, t2, s FROM tsima1 UNION ALL SELECT t2 AS t1, t1 AS t2, s FROM tsima1),
sya AS (SELECT doc_id, term, sum(v) AS v FROM (
          SELECT y.doc_id, ts.t1 AS term, ts.s * y.weight AS v FROM wts y JOIN tsima ts ON y.term = ts.t2
          UNION ALL SELECT doc_id, term, weight AS v FROM wts) GROUP BY 1, 2),
selfdota AS (SELECT w.doc_id, sum(w.weight * sya.v) AS n FROM wts w JOIN sya USING (doc_id, term) GROUP BY 1)
SELECT d1 AS "Source", d2 AS "Target", round(dot / sqrt(n1.n * n2.n), 9) AS "Weight" FROM (
  SELECT x.doc_id AS d1, s2.doc_id AS d2, sum(x.weight * s2.v) AS dot FROM wts x JOIN sya s2
  ON x.term = s2.term AND x.doc_id > s2.doc_id GROUP BY 1, 2) p
JOIN selfdota n1 ON p.d1 = n1.doc_id JOIN selfdota n2 ON p.d2 = n2.doc_id
WHERE dot / sqrt(n1.n * n2.n) >= {SIM_THRESHOLD}""")
_WORDS = """
SELECT word, count(*) AS count FROM (SELECT lower(unnest(tokenized)) AS word FROM dfx) WHERE word <> ''
GROUP BY word"""
q("word_freq", lambda: with_base(_WORDS))
q("word_freq_top", lambda: with_base(
    _WORDS + f" ORDER BY count DESC, word ASC LIMIT {fixed.WORDCLOUD_MAX_WORDS}"))


def tfidf_sql(tokens: str, limit: int | None) -> str:
    """TF-IDF of the tag documents for another token list of a text or a cut vocabulary."""
    cut = f"ORDER BY ctf DESC, term ASC LIMIT {limit}" if limit else ""
    return with_sim(f"""
, toks2 AS (SELECT doc_id, unnest({tokens}) AS term FROM (
    SELECT doc_id, list_filter(regexp_extract_all(array_to_string(tokenized, ', '), {s(_TOKEN_PATTERN)}, 0),
                               lambda t: NOT list_contains({stop_list()}, t)) AS l FROM texts)),
tf2 AS (SELECT doc_id, term, count(*) AS tf FROM toks2 GROUP BY ALL),
vocab2 AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM (
             SELECT term, count(*) AS df, sum(tf) AS ctf FROM tf2 GROUP BY term), ndocs
           WHERE df <= {TFIDF_MAX_DF} * n {cut}),
raw2 AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf2 JOIN vocab2 USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw2""")


q("tfidf_top_terms", lambda: tfidf_sql("l", TOP_FEATURES))
q("tfidf_ngrams", lambda: tfidf_sql(
    "list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))", None))
q("tag_doc_texts", lambda: "WITH " + clusters() + """
SELECT 'tokenized' AS text_col, doc_id, array_to_string(tokenized, ', ') AS text FROM texts
UNION ALL SELECT DISTINCT 'preprocessed', n."Id", preprocessed FROM segs s JOIN nodes n ON s.tag = n."Name"
UNION ALL SELECT 'spacy_lemmatized', doc_id, array_to_string(sl, ', ') FROM ptexts""")

# ---- clusters ---------------------------------------------------------------
# Label propagation is unrolled; past its fixpoint further rounds change nothing.
LPA_ROUNDS = 16


def _lpa_round(i: int) -> str:
    prev = f"lab{i - 1}"
    return f"""
lab{i} AS MATERIALIZED (SELECT "Id", coalesce(new, cluster) AS cluster FROM {prev} LEFT JOIN (
  SELECT src, arg_max(lab, struct_pack(s := s, neg := -lab)) AS new FROM (
    SELECT v.src, l.cluster AS lab, sum(v.w) AS s FROM votes v JOIN {prev} l ON v.dst = l."Id" GROUP BY 1, 2)
  GROUP BY src) ON "Id" = src)"""


@lru_cache(maxsize=None)
def clusters() -> str:
    """The common stages with phrase lists, tag clusters and cluster documents."""
    rounds = ",".join(_lpa_round(i) for i in range(1, LPA_ROUNDS + 1))
    return phrases().rstrip() + sim()[len(base().rstrip()):].rstrip() + f""",
weighted AS (SELECT "Source", "Target", sum("Weight") AS w FROM edges GROUP BY 1, 2),
sym AS (SELECT "Source" AS src, "Target" AS dst, CAST(w AS DOUBLE) AS w FROM weighted
        UNION ALL SELECT "Target", "Source", CAST(w AS DOUBLE) FROM weighted),
votes AS MATERIALIZED (SELECT src, dst, w FROM sym UNION ALL SELECT src, src, max(w) FROM sym GROUP BY src),
lab0 AS (SELECT "Id", "Id" AS cluster FROM nodes),{rounds},
labels AS (SELECT "Id", cluster FROM lab{LPA_ROUNDS}),
ptexts AS (SELECT DISTINCT n."Id" AS doc_id, i.tag, f.sl FROM inc i JOIN nodes n ON i.tag = n."Name"
           JOIN fused f ON i.tweet_id = f.id),
tdocs AS (SELECT t.tag, min(l.cluster) AS cluster, list_sort(list(array_to_string(t.tokenized, ', '))) AS doc
          FROM texts t JOIN labels l ON t.doc_id = l."Id" GROUP BY t.tag),
chosen AS (SELECT cluster, doc, min(tag) AS tag FROM tdocs GROUP BY cluster, doc),
ctexts AS (SELECT cluster, tag, unnest(doc) AS text FROM chosen),
ctoks AS (SELECT cluster, tag, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+', 0) AS tokens FROM ctexts)
"""


def with_clusters(select: str) -> str:
    return "WITH " + clusters() + "\n" + select


q("tag_clusters", lambda: with_clusters('SELECT "Id", "Name", cluster FROM labels JOIN nodes USING ("Id")'))
q("cluster_summary", lambda: with_clusters("""
SELECT (SELECT count(DISTINCT cluster) FROM labels) AS n_clusters, (SELECT count(*) FROM reduced) AS labeled_rows"""))
q("modularity", lambda: with_clusters("""
, per AS (SELECT a.cluster, sum(w) AS deg, sum(CASE WHEN a.cluster = b.cluster THEN w ELSE 0 END) AS inner_w
          FROM sym JOIN labels a ON src = a."Id" JOIN labels b ON dst = b."Id" GROUP BY a.cluster),
tot AS (SELECT sum(w) / 2 AS m FROM sym)
SELECT (SELECT count(DISTINCT cluster) FROM labels) AS n_clusters,
       round((SELECT sum(inner_w / 2 / m - (deg / (2 * m)) ** 2) FROM per, tot), 9) AS modularity"""))
q("cluster_docs", lambda: with_clusters("""
SELECT cluster, count(*) AS n_terms, CAST(sum(c) AS BIGINT) AS n_tokens FROM (
  SELECT cluster, term, count(*) AS c FROM (SELECT cluster, unnest(tokens) AS term FROM ctoks) GROUP BY 1, 2)
GROUP BY cluster"""))


# Modularity classes are unrolled too: a round without a move that gains, and a level without one, change nothing.
CLASS_LEVELS, CLASS_ROUNDS = 4, 9


def _class_round(level: int, i: int) -> str:
    prev, me = f"st{level}_{i - 1}", f"{level}_{i}"
    beats = lambda x, y: f"({x}.g > {y}.g OR {x}.g = {y}.g AND {x}.move < {y}.move)"
    return f"""
dg{me} AS (SELECT c, sum(k) AS t FROM {prev} GROUP BY c),
op{me} AS MATERIALIZED (SELECT * FROM (
  SELECT b."Id", b.c, b.k, b.d, b.v - (b.m2 * b.w_own - b.k * (t.t - b.k)) AS g FROM (
    SELECT i.src AS "Id", s.c, s.k, m2, coalesce(sum(i.w) FILTER (i.d = s.c), 0) AS w_own,
           max(m2 * i.w - s.k * t.t) FILTER (i.d <> s.c) AS v,
           arg_max(i.d, struct_pack(v := m2 * i.w - s.k * t.t, neg := -i.d)) FILTER (i.d <> s.c) AS d
    FROM (SELECT e.src, p.c AS d, sum(e.w) AS w FROM ce{level} e JOIN {prev} p ON e.dst = p."Id"
          WHERE e.src <> e.dst GROUP BY 1, 2) i
    JOIN dg{me} t ON i.d = t.c JOIN {prev} s ON i.src = s."Id" CROSS JOIN cm GROUP BY i.src, s.c, s.k, m2) b
  JOIN dg{me} t ON b.c = t.c) WHERE g > 0),
ou{me} AS (SELECT c, max(g) AS g, arg_max("Id", struct_pack(g := g, neg := -"Id")) AS move FROM op{me} GROUP BY c),
it{me} AS (SELECT d, max(g) AS g, arg_max("Id", struct_pack(g := g, neg := -"Id")) AS move FROM op{me} GROUP BY d),
mv{me} AS (
  SELECT o."Id", o.c, o.d, o.k, o.g,
         CASE WHEN oc.move = o."Id" AND id.move = o."Id" THEN 31
              ELSE 31 - length(bin(((o."Id" % 2147483648 + 1) * (843314861 + 14737574 * {i})) % 2147483648)) END AS lv
  FROM op{me} o JOIN ou{me} oc ON o.c = oc.c JOIN it{me} id ON o.d = id.d
  LEFT JOIN it{me} ic ON o.c = ic.d LEFT JOIN ou{me} od ON o.d = od.c
  WHERE (ic.d IS NULL OR {beats("oc", "ic")}) AND (od.c IS NULL OR {beats("id", "od")})),
ok{me} AS (
  SELECT a."Id", a.d FROM mv{me} a WHERE a.g > a.k * (
    (SELECT sum(k) FROM mv{me} b WHERE b.d = a.d AND b.lv >= a.lv) +
    (SELECT sum(k) FROM mv{me} b WHERE b.c = a.c AND b.lv >= a.lv) - 2 * a.k)),
st{me} AS MATERIALIZED (SELECT s."Id", coalesce(ok.d, s.c) AS c, s.k FROM {prev} s LEFT JOIN ok{me} ok ON s."Id" = ok."Id")"""


def _class_level(level: int) -> str:
    end = f"st{level}_{CLASS_ROUNDS}"
    return f"""
st{level}_0 AS (SELECT n."Id", n."Id" AS c, coalesce(sum(w), 0) AS k FROM cn{level} n LEFT JOIN ce{level} ON src = "Id"
               GROUP BY n."Id"),{",".join(_class_round(level, i) for i in range(1, CLASS_ROUNDS + 1))},
lb{level} AS (SELECT "Id", min("Id") OVER (PARTITION BY c) AS c FROM {end}),
mb{level} AS (SELECT m."Id", l.c AS here FROM mb{level - 1} m JOIN lb{level} l ON m.here = l."Id"),
ce{level + 1} AS (SELECT a.c AS src, b.c AS dst, sum(w) AS w FROM ce{level} e JOIN lb{level} a ON e.src = a."Id"
                 JOIN lb{level} b ON e.dst = b."Id" GROUP BY 1, 2),
cn{level + 1} AS (SELECT DISTINCT c AS "Id" FROM lb{level})"""


def with_classes(select: str) -> str:
    levels = ",".join(_class_level(x) for x in range(1, CLASS_LEVELS + 1))
    found = " UNION ALL ".join(
        f"""SELECT "Id", {x} AS level, here AS cluster FROM mb{x}"""
        + (f""" WHERE EXISTS (FROM lb{x} WHERE "Id" <> c)""" if x > 1 else "") for x in range(1, CLASS_LEVELS + 1))
    return with_clusters(f""",
ce1 AS (SELECT src, dst, w FROM sym WHERE src <> dst), cm AS (SELECT sum(w) AS m2 FROM ce1),
cn1 AS (SELECT "Id" FROM nodes), mb0 AS (SELECT "Id", "Id" AS here FROM nodes),{levels},
classes AS MATERIALIZED ({found})""") + select


q("modularity_classes", lambda: with_classes(
    'SELECT "Id", "Name", CAST(level AS INTEGER) AS level, cluster FROM classes JOIN nodes USING ("Id")'))
q("modularity_levels", lambda: with_classes("""
, every AS (SELECT "Id", 0 AS level, cluster FROM labels UNION ALL SELECT "Id", level, cluster FROM classes),
per AS (SELECT a.level, a.cluster, sum(w) AS deg, sum(CASE WHEN a.cluster = b.cluster THEN w ELSE 0 END) AS inner_w
        FROM sym JOIN every a ON src = a."Id" JOIN every b ON dst = b."Id" AND a.level = b.level GROUP BY 1, 2)
SELECT CAST(level AS INTEGER) AS level, n_clusters, modularity FROM (
  SELECT level, count(DISTINCT cluster) AS n_clusters FROM every GROUP BY level) LEFT JOIN (
  SELECT level, round(sum(inner_w / m2 - (deg / m2) ** 2), 9) AS modularity FROM per, cm GROUP BY level) USING (level)"""))
q("class_docs", lambda: with_classes("""
, top AS (SELECT "Id", arg_max(cluster, level) AS cluster FROM classes GROUP BY "Id"),
cdocs AS (SELECT t.tag, min(l.cluster) AS cluster, list_sort(list(array_to_string(t.tokenized, ', '))) AS doc
          FROM texts t JOIN top l ON t.doc_id = l."Id" GROUP BY t.tag),
cone AS (SELECT cluster, doc, min(tag) AS tag FROM cdocs GROUP BY cluster, doc),
cterms AS (SELECT cluster, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+', 0)) AS term
           FROM (SELECT cluster, unnest(doc) AS text FROM cone))
SELECT cluster, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT cluster, term, count(*) AS n FROM cterms GROUP BY 1, 2) GROUP BY cluster"""))


def _pool(scheme: str, text: str, rows: str) -> str:
    return f"""
SELECT '{scheme}' AS scheme, '{text}' AS text, count(DISTINCT doc_key) AS n_docs, count(*) AS n_terms,
       CAST(sum(c) AS BIGINT) AS n_tokens FROM (
  SELECT doc_key, term, count(*) AS c FROM ({rows}) WHERE term <> '' GROUP BY 1, 2)"""


q("pool_documents", lambda: with_clusters(" UNION ALL ".join([
    _pool("all", "tokenized", "SELECT id AS doc_key, unnest(tokenized) AS term FROM dfx"),
    _pool("tagged", "tokenized", "SELECT id AS doc_key, unnest(tokenized) AS term FROM dfx WHERE hashtags IS NOT NULL"),
    _pool("tag", "tokenized", "SELECT doc_id AS doc_key, unnest(tokenized) AS term FROM texts"),
    _pool("cluster", "tokenized", "SELECT cluster AS doc_key, unnest(tokens) AS term FROM ctoks"),
    _pool("all", "spacy_lemmatized", "SELECT id AS doc_key, unnest(sl) AS term FROM fused"),
    _pool("tag", "spacy_lemmatized", "SELECT doc_id AS doc_key, unnest(sl) AS term FROM ptexts"),
    _pool("tag", "preprocessed", f"""SELECT doc_key, unnest({words('preprocessed')}) AS term FROM (
      SELECT DISTINCT n."Id" AS doc_key, preprocessed FROM segs s JOIN nodes n ON s.tag = n."Name")"""),
])))

# c_v by explicit windows: every window of every cluster document.
q("coherence_terms", lambda: with_clusters(f"""
, ttc AS (SELECT cluster AS topic, term, count(*) AS n FROM (SELECT cluster, unnest(tokens) AS term FROM ctoks) GROUP BY 1, 2),
tt AS (SELECT topic, term FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM ttc)
       WHERE r <= {fixed.COHERENCE_TOP_WORDS}),
offs AS (SELECT cluster, tokens, coalesce(sum(len(tokens)) OVER (PARTITION BY cluster ORDER BY tag, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         greatest(sum(len(tokens)) OVER (PARTITION BY cluster) - {fixed.COHERENCE_WINDOW}, 0) AS last FROM ctoks),
nwin AS (SELECT sum(last + 1) AS n FROM (SELECT cluster, min(last) AS last FROM offs GROUP BY cluster)),
pos AS (SELECT cluster, last, start + i - 1 AS p, tokens[i] AS term FROM (
          SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM offs)),
wins AS MATERIALIZED (SELECT DISTINCT cluster, term, unnest(range(CAST(greatest(p - {fixed.COHERENCE_WINDOW - 1}, 0) AS BIGINT),
                                                CAST(least(p, last) AS BIGINT) + 1)) AS w
         FROM pos WHERE term IN (SELECT term FROM tt)),
one AS (SELECT term, count(*) AS c FROM wins GROUP BY term),
two AS (SELECT a.term AS t1, b.term AS t2, count(*) AS c FROM wins a JOIN wins b ON a.cluster = b.cluster AND a.w = b.w
        GROUP BY 1, 2),
np AS (SELECT i.topic, i.term AS wi, j.term AS wj,
              ln((coalesce(two.c, 0) / n + {fixed.COHERENCE_EPS!r}) / (a.c / n * (b.c / n)))
              / -ln(coalesce(two.c, 0) / n + {fixed.COHERENCE_EPS!r}) AS v
       FROM tt i JOIN tt j ON i.topic = j.topic JOIN one a ON a.term = i.term JOIN one b ON b.term = j.term
       LEFT JOIN two ON two.t1 = i.term AND two.t2 = j.term, nwin),
ctx AS (SELECT topic, wj, sum(v) AS cv FROM np GROUP BY 1, 2),
per AS (SELECT np.topic, wi, sum(v * cv) AS dot, sqrt(sum(v * v)) AS ni FROM np JOIN ctx USING (topic, wj) GROUP BY 1, 2),
nrm AS (SELECT topic, sqrt(sum(cv * cv)) AS nw FROM ctx GROUP BY 1)
SELECT topic, round(avg(dot / (ni * nw)), 6) AS coherence FROM per JOIN nrm USING (topic) GROUP BY topic"""))


# ---- phrase model -----------------------------------------------------------
_PHRASE_TOKEN_RE = r"[\p{L}\p{Nl}\p{No}_]+"


def phrase_toks(e: str) -> str:
    t = f"strip_accents(lower(replace(regexp_replace({e}, {s(WS + '+')}, ' ', 'g'), chr(39), '')))"
    return (f"list_filter(regexp_extract_all({t}, {s(_PHRASE_TOKEN_RE)}, 0), "
            f"lambda w: length(w) >= {fixed.PHRASE_TOKEN_MIN} AND length(w) <= {fixed.PHRASE_TOKEN_MAX} "
            f"AND NOT starts_with(w, '_'))")


def phrase_stop_list() -> str:
    return "[" + ", ".join(s(w) for w in list(default_stopwords()) + list(fixed.PHRASE_EXTRA_STOPWORDS)) + "]"


@lru_cache(maxsize=None)
def phrases() -> str:
    return base().rstrip() + f""",
ptok AS (SELECT id, {phrase_toks('preprocessed')} AS t FROM staged),
uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM ptok) GROUP BY w),
bi AS (SELECT a, b, count(*) AS n_ab FROM (
         SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM ptok))
       GROUP BY a, b),
vsz AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS "V"),
phr AS (SELECT bi.a, bi.b, ua.n AS n_a, ub.n AS n_b, n_ab,
               (n_ab - {fixed.PHRASE_MIN_COUNT}) / (ua.n * ub.n) * "V" AS score
        FROM bi JOIN uni ua ON bi.a = ua.w JOIN uni ub ON bi.b = ub.w, vsz
        WHERE (n_ab - {fixed.PHRASE_MIN_COUNT}) / (ua.n * ub.n) * "V" > {fixed.PHRASE_THRESHOLD}),
t2 AS (SELECT id, list_filter({phrase_toks('preprocessed')}, lambda w: NOT list_contains({phrase_stop_list()}, w)) AS t
       FROM dfx),
hits AS (SELECT p.id, p.i FROM (SELECT id, i - 1 AS i, t[i] AS a, t[i + 1] AS b
                                FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM t2)) p
         JOIN phr ON p.a = phr.a AND p.b = phr.b),
runs AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM hits),
st AS (SELECT id, list(i) AS s FROM (SELECT id, i, i - min(i) OVER (PARTITION BY id, g) AS k FROM runs)
       WHERE k % 2 = 0 GROUP BY id),
fused AS (SELECT id, raw, list_filter(raw, lambda w: length(w) >= {fixed.MIN_TOKEN_LEN}) AS sl FROM (
  SELECT t2.id, list_filter(list_transform(range(0, len(t)), lambda i:
             CASE WHEN list_contains(coalesce(s, []), i) THEN t[i + 1] || '_' || t[i + 2]
                  WHEN list_contains(coalesce(s, []), i - 1) THEN NULL ELSE t[i + 1] END),
             lambda w: w IS NOT NULL) AS raw
          FROM t2 LEFT JOIN st ON t2.id = st.id))
"""
q("mine_bigrams", lambda: "WITH " + phrases() + "\nSELECT a, b, n_a, n_b, n_ab, round(score, 9) AS score FROM phr")
q("apply_bigrams", lambda: "WITH " + phrases()
  + "\nSELECT id, array_to_string(sl, ' ') AS spacy_lemmatized, CAST(len(sl) AS INTEGER) AS n_tokens FROM fused")


LEXICON = """
lex0 AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS form FROM documents WHERE lang = 'en'),
lex AS (SELECT form, length(form) % 6 AS c,
               CASE WHEN length(form) > 3 THEN substr(form, 1, length(form) - 1) ELSE substr(form, 1, 2) END AS lemma
        FROM lex0 WHERE length(form) >= 3 AND (form LIKE '%n' OR form LIKE '%t'))"""
# Classes by length: 0 noun, 1 verb, 2 pronoun, 3 adjective, 4 proper noun, 5 adverb.


def kept_token(t: str) -> str:
    return (f"length({t}) >= {fixed.MIN_TOKEN_LEN} AND NOT contains({s(fixed.TOKEN_PUNCTUATION)}, {t}) "
            f"AND NOT list_contains({stop_list()}, {t})")


q("tokenize_lemma_lexicon", lambda: "WITH " + base().rstrip() + "," + LEXICON + f""",
w AS (SELECT id, l[i] AS form, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT id, {words('preprocessed')} AS l FROM dfx))),
t AS (SELECT id, i, CASE WHEN c IN (0, 1, 3, 5) THEN lemma ELSE w.form END AS tok FROM w LEFT JOIN lex ON w.form = lex.form),
g AS (SELECT id, string_agg(tok, ' ' ORDER BY i) AS l, CAST(count(*) AS INTEGER) AS n FROM t
      WHERE {kept_token('tok')} GROUP BY id)
SELECT id, coalesce(l, '') AS tokenized, coalesce(n, 0) AS n_tokens FROM dfx LEFT JOIN g USING (id)""")
q("apply_bigrams_lexicon", lambda: "WITH " + phrases().rstrip() + "," + LEXICON + f""",
w AS (SELECT id, l[i] AS form, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT id, raw AS l FROM fused))),
t AS (SELECT id, i, coalesce(lemma, w.form) AS tok FROM w LEFT JOIN lex ON w.form = lex.form WHERE coalesce(c, 0) <> 2),
g AS (SELECT id, string_agg(tok, ' ' ORDER BY i) AS l, CAST(count(*) AS INTEGER) AS n FROM t
      WHERE length(tok) >= {fixed.MIN_TOKEN_LEN} GROUP BY id)
SELECT id, coalesce(l, '') AS spacy_lemmatized, coalesce(n, 0) AS n_tokens FROM dfx LEFT JOIN g USING (id)""")


def detached() -> str:
    """CTEs ``w`` (id, form, i), ``bases`` and ``entries`` (form, pos, lemma) after ``base()``."""
    from ..operators.lemmas import RULES

    rules = ", ".join(f"({s(kind)}, {place}, {s(suffix)}, {s(new)})" for kind, of_kind in RULES.items()
                      for place, (suffix, new) in enumerate(of_kind))
    cut = "substr({0}, 1, length({0}) - length(suffix)) || new"
    return "WITH " + base().rstrip() + f""",
words0 AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS form FROM documents WHERE lang = 'en'),
bases AS (SELECT DISTINCT b.form, pos FROM (SELECT form, pos, form || ending AS longer
            FROM words0, (VALUES ('VERB', 'ed'), ('VERB', 'ing'), ('ADJ', 'er'), ('ADJ', 'est'), ('NOUN', 's')) e(pos, ending)) b
          JOIN words0 a ON a.form = b.longer WHERE length(b.form) >= 3),
w AS (SELECT id, l[i] AS form, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT id, {words('preprocessed')} AS l FROM dfx))),
rules(pos, place, suffix, new) AS (VALUES {rules}),
unknown AS (SELECT DISTINCT form FROM w WHERE form NOT IN (SELECT form FROM bases)),
one AS (SELECT form, pos, 1 AS step, place, {cut.format('form')} AS lemma FROM unknown, rules
        WHERE ends_with(form, suffix) AND length(form) > length(suffix)),
two AS (SELECT form, pos, 2 AS step, r.place, {cut.format('lemma')} AS lemma FROM one JOIN rules r USING (pos)
        WHERE ends_with(lemma, suffix) AND length(lemma) > length(suffix)),
entries AS (SELECT form, pos, form AS lemma FROM bases UNION ALL
  SELECT form, pos, lemma FROM (
    SELECT c.form, c.pos, c.lemma,
           row_number() OVER (PARTITION BY c.form, c.pos ORDER BY step, length(c.lemma), place, c.lemma) AS k
    FROM (SELECT * FROM one UNION ALL SELECT * FROM two) c JOIN bases b ON b.form = c.lemma AND b.pos = c.pos)
  WHERE k = 1)"""


q("detached_lemmas", lambda: detached() + "\nSELECT form, pos, lemma FROM entries")
q("tokenize_lemma_detached", lambda: detached() + f""",
first AS (SELECT form, lemma FROM (SELECT form, lemma, row_number() OVER (PARTITION BY form ORDER BY
            CASE pos WHEN 'NOUN' THEN 0 WHEN 'VERB' THEN 1 ELSE 2 END, lemma) AS k FROM entries) WHERE k = 1),
t AS (SELECT id, i, coalesce(lemma, w.form) AS tok FROM w LEFT JOIN first ON w.form = first.form),
g AS (SELECT id, string_agg(tok, ' ' ORDER BY i) AS l, CAST(count(*) AS INTEGER) AS n FROM t
      WHERE {kept_token('tok')} GROUP BY id)
SELECT id, coalesce(l, '') AS tokenized, coalesce(n, 0) AS n_tokens FROM dfx LEFT JOIN g USING (id)""")
q("tokenize_stopword_table", lambda: with_base(f"""
SELECT id, array_to_string(l, ' ') AS tokenized, CAST(len(l) AS INTEGER) AS n_tokens FROM (
  SELECT id, list_filter(tokenized, lambda t: t NOT IN ({', '.join(s(w) for w in EXTRA_STOPWORDS)})) AS l FROM dfx)"""))


# ---- sources ----------------------------------------------------------------
q("scan_tweets", lambda: with_base("SELECT * FROM tweets"))


def _width(mn: str, mx: str) -> str:
    return f"""CASE WHEN {mn} >= 0 THEN
  CASE WHEN {mx} < 255 THEN 'uint8' WHEN {mx} < 65535 THEN 'uint16'
       WHEN {mx} < 4294967295 THEN 'uint32' ELSE 'uint64' END
 ELSE
  CASE WHEN {mn} > -128 AND {mx} < 127 THEN 'int8' WHEN {mn} > -32768 AND {mx} < 32767 THEN 'int16'
       WHEN {mn} > -2147483648 AND {mx} < 2147483647 THEN 'int32' ELSE 'int64' END END"""


q("narrow_types", lambda: with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min_value, max_value, {_width('min_value', 'max_value')} AS width FROM "
    f"(SELECT min(coalesce({c}, 0)) AS min_value, max(coalesce({c}, 0)) AS max_value FROM data)"
    for c in ["id", "in_reply_to_status_id", "quoted_status_id", "truncated", "retweet"])))


NARROWED = ["id", "in_reply_to_status_id", "quoted_status_id", "truncated", "retweet"]
WIDTH_TYPES = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
               "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}


def _type_of(c: str) -> str:
    whens = " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in WIDTH_TYPES.items())
    return f"(SELECT CASE {_width(f'min(coalesce({c}, 0))', f'max(coalesce({c}, 0))')} {whens} END FROM data)"


q("narrowed_table", lambda: with_base(
    "SELECT " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in NARROWED)
    + ", " + " || ',' || ".join(map(_type_of, NARROWED)) + " AS types FROM data"))


q("source_distances", lambda: """
WITH w AS (SELECT coalesce(source, '') AS a, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents),
c AS (SELECT a, term, count(*) AS n FROM w WHERE term <> '' GROUP BY 1, 2),
p AS (SELECT a, term, n / sum(n) OVER (PARTITION BY a) AS p FROM c),
g AS (SELECT x.a, y.a AS b FROM (SELECT DISTINCT a FROM p) x JOIN (SELECT DISTINCT a FROM p) y ON x.a < y.a),
u AS (SELECT a, b, term, sum(x) AS x, sum(y) AS y FROM (
        SELECT g.a, g.b, term, p AS x, 0 AS y FROM g JOIN p ON p.a = g.a
        UNION ALL SELECT g.a, g.b, term, 0, p FROM g JOIN p ON p.a = g.b) GROUP BY 1, 2, 3)
SELECT a, b, count(*) FILTER (x > 0 AND y > 0) AS shared,
       round(greatest(0, sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END
                             + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END) / 2), 9) AS divergence
FROM u GROUP BY a, b HAVING count(*) FILTER (x > 0 AND y > 0) > 0""")


# ---- reply chains (conversations) -------------------------------------------
q("enrich_reply_chains", lambda: f"""
WITH c AS (SELECT conv_id * {MAX_TURNS} + turn + 1 AS id,
                  CASE WHEN turn > 0 THEN conv_id * {MAX_TURNS} + turn END AS in_reply_to_status_id, role, text
           FROM conversations),
d AS (SELECT id, coalesce(in_reply_to_status_id, 0) AS in_reply_to_status_id, text, role AS mentions,
             CAST(starts_with(text, 'RT') AS INTEGER) AS retweet FROM c),
lk AS (SELECT id AS ref_id, text AS ref_text, mentions AS ref_mentions FROM d WHERE retweet = 0)
SELECT d.id, d.in_reply_to_status_id, coalesce(lk.ref_text, '') || ' ' || coalesce(d.text, 'nan') AS text,
       {blank_null('concat_ws(chr(59) || chr(32), lk.ref_mentions, d.mentions)')} AS mentions
FROM d LEFT JOIN lk ON d.in_reply_to_status_id = lk.ref_id
WHERE d.in_reply_to_status_id <> 0""")
