"""Bare domains and schemes, e-mail addresses, longest suffixes."""

from tagflow.operators import urls as U

CASES = {
    "see example.com/a?b=1.": [("example.com/a?b=1", False, "example.com")],
    "(www.shop.example.co.uk)": [("www.shop.example.co.uk", False, "example.co.uk")],
    "http://localhost:8080/x and https://User@Host.Example.ORG:443/": [
        ("http://localhost:8080/x", True, None), ("https://User@Host.Example.ORG:443/", True, "example.org")],
    "mail me@example.com, or a.b@mail.example.net!": [],
    "the end.Then 3.14 and v1.2.3, e.g. this...": [],
    "co.uk com .com a..com -x.com x-.com": [],
    "münchen.de!": [("münchen.de", False, "münchen.de")],
    "EXAMPLE.COM:80/X,b.example.com": [("EXAMPLE.COM:80/X", False, "example.com"), ("b.example.com", False, "example.com")],
    "http:// https://": [],
    '<a href="ftp://files.example.net/x">': [("ftp://files.example.net/x", True, "example.net")],
    "unknown.suffixx http://a.suffixx": [("http://a.suffixx", True, None)],
    "": [],
}


def frame(spark):
    return spark.createDataFrame([*enumerate(CASES), (99, None)], "id long, text string")


def test_cases(spark):
    suffixes = U.default_suffixes(spark)
    n = suffixes.count()
    for rows in (n, None):                                  # broadcast, and the planner's choice
        got = {}
        for r in sorted(U.urls(frame(spark), suffixes, suffix_rows=rows).collect(), key=lambda r: (r.id, r.pos)):
            got.setdefault(r.id, []).append((r.url, r.scheme, r.domain))
        assert got == {i: w for i, w in enumerate(CASES.values()) if w}


def test_lists_keep_every_row(spark):
    df = frame(spark)
    got = {r.id: r for r in U.url_lists(df, U.urls(df, U.default_suffixes(spark))).collect()}
    assert len(got) == len(CASES) + 1 and (got[99].url_count, got[99].urls, got[99].domains) == (0, "", "")
    assert (got[2].url_count, got[2].bare_count, got[2].domains) == (2, 0, "example.org")
    assert (got[7].bare_count, got[7].domains) == (2, "example.com")


def test_repeated_suffixes_and_empty_tables(spark):
    df = frame(spark)
    few = spark.createDataFrame([("com",), ("com",), ("example.com",)], "suffix string")
    got = {(r.url, r.domain) for r in U.urls(df, few).collect() if not r.scheme}
    # a host that is a suffix as a whole has no domain, though it ends in a shorter one
    assert got == {("b.example.com", "b.example.com")}
    assert U.urls(df.limit(0), few).count() == 0 and {r.scheme for r in U.urls(df, few.limit(0)).collect()} == {True}
