"""Native column expressions for tweet text.

All functions take and return ``Column`` objects and compile to JVM
expressions (``regexp_replace``, ``split``, ``zip_with`` ...): no Python
UDF runs per row.  Python's regex classes are Unicode-aware while Java's are
ASCII by default, so every class is spelled out explicitly here (whitespace
as the exact set of ``str.isspace`` characters, word characters as
``[\\p{L}\\p{N}_]``).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _esc(cp: int) -> str:
    """Java/RE2 escape of one code point inside a character class."""
    ch = chr(cp)
    if ch.isalnum() and cp < 128:
        return ch
    return "\\x{%X}" % cp


def _class(cps) -> str:
    """Character class of code points, consecutive runs written as ranges."""
    cps = sorted(set(cps))
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(_esc(cps[i]) if i == j else _esc(cps[i]) + "-" + _esc(cps[j]))
        i = j + 1
    return "[" + "".join(out) + "]"


def java_class(cps) -> str:
    """The class of ``_class`` in the form that Java tests fastest.

    Code points below 256 stand singly, which makes them one table of bits; the
    rest is met with the range that it spans, so a text of plain letters costs
    two tests a letter instead of one for each range.
    """
    cps = sorted(set(cps))
    low = "".join(_esc(c) for c in cps if c < 256)
    high = [c for c in cps if c >= 256]
    if high:
        low += "[%s-%s&&%s]" % (_esc(high[0]), _esc(high[-1]), _class(high))
    return "[" + low + "]"


# Python's whitespace (str.isspace), derived by rule; all of it lies below U+3100.
PY_SPACE_CPS = tuple(c for c in range(0x3100) if chr(c).isspace())
WS = _class(PY_SPACE_CPS)                       # one whitespace char
NOT_WS = "[^" + WS[1:]                          # one non-whitespace char
JAVA_WS = java_class(PY_SPACE_CPS)              # WS for expressions that only Spark runs
WORD = r"[\p{L}\p{N}_]"                          # Python's Unicode \w

URL_RE = "http" + NOT_WS + "+"                  # case-sensitive, unanchored
MENTION_RE = r"[@][\p{L}\p{N}_-]+"
TAG_RE = "#(" + WORD + "+)"
END_TAGS_RE = "(?:" + WS + "*#" + WORD + "+)+" + WS + "*$"
EMOJI_RE = ("[" + "".join(_esc(c) for c in fixed.EMOJI_SINGLES)
            + _esc(fixed.EMOJI_RANGE[0]) + "-" + _esc(fixed.EMOJI_RANGE[1]) + "]+")


def _member_class(chars) -> str:
    return "[" + "".join(
        ("\\" + ch) if ch in "[]^-\\&" else (_esc(ord(ch)) if ord(ch) > 127 or ch == " " else ch)
        for ch in chars) + "]"


PUNCT_CLASS = _member_class(fixed.PUNCT_MEMBERS)
PUNCT_RE = PUNCT_CLASS + "+"                    # a run becomes one blank
JAVA_PUNCT_RE = java_class(map(ord, fixed.PUNCT_MEMBERS)) + "+"
JAVA_GAP_RE = java_class([*map(ord, fixed.PUNCT_MEMBERS), *PY_SPACE_CPS]) + "+"
DIGITS_RE = "[0-9]+"
NON_ASCII_RE = "[^\\x{0}-\\x{7F}]"
LINK_RE = "(?i)https?://[^" + WS[1:-1] + '"<>]+'

# Every key starts with at most this many letters before its first apostrophe;
# the lookahead rejects other positions early without changing any match.
_KEY_LEAD = max(len(k.split("'")[0]) for k, _ in fixed.CONTRACTIONS)
CONTRACTION_ALT_RE = "(" + "|".join(k for k, _ in fixed.CONTRACTIONS) + ")"
CONTRACTION_RE = "(?=[A-Za-z]{0,%d}')" % _KEY_LEAD + CONTRACTION_ALT_RE


def _contraction_map() -> Column:
    # First key wins, as in a dictionary literal with repeated keys.
    seen: dict[str, str] = {}
    for k, v in fixed.CONTRACTIONS:
        seen.setdefault(k, v)
    return F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])


def normalize_dashes(c: Column) -> Column:
    src = "".join(a for a, _ in fixed.PRE_REPLACE)
    dst = "".join(b for _, b in fixed.PRE_REPLACE)
    # Every one of these characters is beyond ASCII.
    return F.when(is_ascii(c), c).otherwise(F.translate(c, src, dst))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_RE, "")


def remove_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION_RE, "")


def expand_contractions(c: Column) -> Column:
    """One left-to-right pass of the contraction alternation.

    ``split`` yields the text between matches, ``regexp_extract_all`` the
    matches; zipping them and mapping each match through the table rebuilds
    the string without re-scanning replaced text (a chain of
    ``regexp_replace`` calls would cascade).
    """
    parts = F.split(c, CONTRACTION_RE, -1)
    hits = F.regexp_extract_all(c, F.lit(CONTRACTION_RE), 1)
    table = _contraction_map()
    joined = F.zip_with(parts, hits,
                        lambda a, b: F.concat(F.coalesce(a, F.lit("")),
                                              F.coalesce(F.try_element_at(table, b), F.lit(""))))
    # Every key holds an apostrophe: texts without one are returned as is.
    return F.when(F.instr(c, "'") == 0, c).otherwise(F.array_join(joined, ""))


def remove_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI_RE, "")


def punctuation_to_space(c: Column) -> Column:
    return F.regexp_replace(c, JAVA_PUNCT_RE, " ")


def remove_digits(c: Column) -> Column:
    return F.regexp_replace(c, DIGITS_RE, "")


def gaps_to_space(c: Column) -> Column:
    """``collapse_whitespace(punctuation_to_space(c))`` in one pass."""
    return F.regexp_replace(c, JAVA_GAP_RE, " ")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, JAVA_WS + "+", " ")


_PRE_STEPS = (normalize_dashes, remove_urls, remove_mentions, F.lower)
_POST_STEPS = (remove_emoji, punctuation_to_space, remove_digits, collapse_whitespace)


def clean_text(c: Column) -> Column:
    """The ordered cleaning chain; no trim at the end (a blank may remain).

    As a single expression the lower-cased text is spelled out several times
    inside the contraction step; prefer ``clean_text_df``, which computes it
    once.
    """
    steps = [*_PRE_STEPS, expand_contractions, *_POST_STEPS]
    return reduce(lambda acc, f: f(acc), steps, c)


def clean_text_df(df, src: str, out: str = "preprocessed"):
    """``df`` plus ``out`` = clean_text(src), one named column per step.

    Each step reads the previous step's column, so no sub-expression is
    spelled out twice, and steps that cannot match are skipped by cheap
    native tests: the URL rule needs 'http', the mention rule '@', the
    contraction rule an apostrophe, and emoji are all non-ASCII (a text whose
    byte length equals its character length is ASCII).  No digit is punctuation
    or whitespace, so digits may go first and the gaps are closed in one pass.
    """
    c = "__tagflow_clean_step"
    g = F.col(c)
    steps = [
        normalize_dashes(F.col(src)),
        F.when(F.instr(g, "http") > 0, remove_urls(g)).otherwise(g),
        F.when(F.instr(g, "@") > 0, remove_mentions(g)).otherwise(g),
        F.lower(g),
        expand_contractions(g),
        F.when(is_ascii(g), g).otherwise(remove_emoji(g)),
        remove_digits(g),
        gaps_to_space(g),
    ]
    for e in steps:
        df = df.withColumn(c, e)
    return df.withColumn(out, g).drop(c)


def remove_all_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_RE, "")


def remove_end_tags(c: Column) -> Column:
    """Drop URLs, then the run of tags (and blanks) closing the text."""
    return F.regexp_replace(remove_urls(c), END_TAGS_RE, "")


def inline_tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TAG_RE), 1)


def is_ascii(c: Column) -> Column:
    """As many bytes as characters; that is to say, nothing that NON_ASCII_RE finds."""
    return F.length(c) == F.octet_length(c)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace character."""
    return F.regexp_replace(c, "^" + WS + "+|" + WS + "+$", "")


def blank_to_null(c: Column) -> Column:
    """Empty or whitespace-only text becomes NULL."""
    return F.when(c.rlike("^" + WS + "*$"), F.lit(None)).otherwise(c)


def split_words(c: Column) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty parts."""
    return F.filter(F.split(c, JAVA_WS + "+"), lambda w: w != F.lit(""))


def word_count(c: Column) -> Column:
    """``len(text.split())``: the number of non-whitespace runs.

    Whitespace is sought, not its complement: Java tests a negated class of
    many ranges range by range at every character.
    """
    return F.array_size(split_words(c))


def has_words(c: Column, n: int) -> Column:
    """``word_count(c) >= n``; the text is split no further than that takes.

    Of n + 2 parts only the first and the last can be empty.
    """
    return F.size(F.filter(F.split(c, JAVA_WS + "+", max(n, 0) + 2), lambda w: w != F.lit(""))) >= n


def split_list(c: Column, sep: str = ";") -> Column:
    """Delimited string to array; NULL becomes the empty array."""
    return F.coalesce(F.split(c, sep), F.array().cast("array<string>"))


def extract_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK_RE), 0)


def _deaccent_pairs():
    """Per-character accent stripping derived from Unicode data.

    Rule: NFD, drop nonspacing marks (category Mn), NFC.  A character whose
    result is a different single character maps to it; a lone mark is
    deleted.  Built for every code point below the emoji range, whatever its
    script: cleaning has removed all above it.
    """
    src, dst, drop = [], [], []
    for cp in range(0x80, fixed.EMOJI_RANGE[0]):
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            drop.append(ch)
            continue
        nfd = unicodedata.normalize("NFD", ch)
        out = unicodedata.normalize("NFC", "".join(x for x in nfd if unicodedata.category(x) != "Mn"))
        if out != ch and len(out) == 1:
            src.append(ch)
            dst.append(out)
    return "".join(src) + "".join(drop), "".join(dst)


_DEACC_SRC, _DEACC_DST = _deaccent_pairs()


def deaccent(c: Column) -> Column:
    return F.translate(c, _DEACC_SRC, _DEACC_DST)
