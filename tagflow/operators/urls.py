"""URLs in texts, with a scheme or as a bare domain.

A run of characters that may stand in a URL is a candidate.  With a scheme it is
a URL; without one it is a URL if its host ends in a public suffix with a label
before it, and is no e-mail address.  The host's last one, two and three
labels are looked up in a suffix table by an equi-join; the longest match counts
and gives the registered domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import lookup_join

RUN = r"""[^\x00-\x20\x7F\x{85}\x{A0}"'<>(){}\[\]|,;]+"""
TRAILING = r"[.!?:*_]+$"
SCHEME = r"(?i)^(https?|ftp)://"
HOST = r"^([\p{L}\p{N}]([\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}$"
MAX_LABELS = 3

#: Generic suffixes; countries come from the Java runtime's list.
GENERIC = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "tel", "jobs", "travel",
           "museum", "coop", "aero", "cat", "xyz", "app", "dev", "online", "site", "blog", "news", "shop", "eu", "uk")
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu")


def default_suffixes(spark: SparkSession) -> DataFrame:
    """``(suffix)``: generic names, ISO country codes, and the usual second levels below a country.

    A rule, not the public list, which can be passed in its place.
    """
    countries = sorted({c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()} | {"uk", "eu"})
    rows = {*GENERIC, *countries, *(f"{s}.{c}" for c in countries for s in SECOND)}
    return spark.createDataFrame([(r,) for r in sorted(rows)], "suffix string")


def candidates(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, url, scheme, host)``: runs that may be URLs, in the order of the text."""
    runs = F.filter(F.regexp_extract_all(text_col, F.lit(RUN), 0), lambda r: r.contains(".") | r.contains("://"))
    c = texts.select(F.col(id_col).alias("id"), F.posexplode(runs).alias("pos", "run"))
    c = c.select("id", "pos", F.regexp_replace("run", TRAILING, "").alias("url"))
    c = c.select("*", F.col("url").rlike(SCHEME).alias("scheme"),
                 F.regexp_extract(F.regexp_replace("url", SCHEME, ""), "^[^/?#]*", 0).alias("host"))
    host = F.when(F.col("scheme"), F.regexp_replace("host", "^.*@", "")).otherwise(F.col("host"))
    c = c.select("id", "pos", "url", "scheme", F.lower(F.regexp_replace(host, ":[0-9]*$", "")).alias("host"))
    return c.where(F.when(F.col("scheme"), F.col("host") != "").otherwise(F.col("host").rlike(HOST)))


def urls(texts: DataFrame, suffixes: DataFrame, id_col: str = "id", text_col: str = "text",
         suffix_rows: int | None = None) -> DataFrame:
    """``(id, pos, url, scheme, domain)``: the URLs; ``domain`` is null where a scheme's host has no known suffix."""
    c = candidates(texts, id_col, text_col)
    labels = F.split("host", r"\.")
    deep = F.transform(F.sequence(F.lit(1), F.lit(MAX_LABELS)), lambda d: F.when(
        d <= F.size(labels), F.array_join(F.slice(labels, F.size(labels) - d + 1, d), ".")))
    each = c.select("*", F.posexplode(deep).alias("depth", "suffix"))
    known = suffixes.select("suffix", F.lit(True).alias("known")).distinct()
    hit = lookup_join(each, known, "suffix", "left", suffix_rows)
    best = hit.groupBy("id", "pos", "url", "scheme", "host").agg(F.max(F.when(F.col("known"), F.col("depth") + 2)).alias("take"))
    # a host that is a suffix as a whole has no domain
    best = best.withColumn("take", F.when(F.col("take") <= F.size(labels), F.col("take")))
    domain = F.array_join(F.slice(labels, F.size(labels) - F.col("take") + 1, F.col("take")), ".")
    return best.where(F.col("scheme") | F.col("take").isNotNull()).select("id", "pos", "url", "scheme", domain.alias("domain"))


def url_lists(texts: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, url_count, bare_count, urls, domains)`` for every row of ``texts``, whose ids are unique."""
    per = found.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "url", "domain"))).alias("l"),
        F.count_if(~F.col("scheme")).alias("bare_count"))
    j = texts.select(F.col(id_col).alias("id")).join(per, "id", "left")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("l", lambda x: x["domain"]), lambda d: d.isNotNull())))
    return j.select("id", F.coalesce(F.array_size("l"), F.lit(0)).alias("url_count"),
                    F.coalesce("bare_count", F.lit(0)).alias("bare_count"),
                    F.coalesce(F.array_join(F.transform("l", lambda x: x["url"]), " "), F.lit("")).alias("urls"),
                    F.coalesce(F.array_join(names, " "), F.lit("")).alias("domains"))
