"""Main text of pages."""

import random

import pytest

from tagflow.llm import html

LONG = "Words of the story go on, and on, with commas, until the line is long enough to count as a paragraph of its own."

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("plain text  only\n", "plain text only"),
    ("<p>a</p><p>b", "a\nb"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Short.</article><footer>f</footer>",
     f"T & U\n{LONG}\nShort."),
    (f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f"<div class='ad'>Buy</div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>",
     f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG} yes</p></div><form><p>Mail</p></form></article>", LONG),
    (f"<article><p>a<b>b</b> c<br>d&nbsp;e&#33;</p><script>var t='</p>';</script><p>{LONG}</article>", f"ab c d e!\n{LONG}"),
    (f"<article><ul><li>One<li>Two</ul><p>{LONG}</p></article>", f"One\nTwo\n{LONG}"),
    (f"<article><p>{LONG}<!-- no <p>x</p> --></p></article", LONG),
    (f"<article><p>{LONG} &am", f"{LONG} &am"),
    (f"<main><p>{LONG}</p><section><h2>Part</h2><p>{LONG}</p></section></main>", f"{LONG}\nPart\n{LONG}"),
    ("<article><p>Ok.</p></article><footer>" + LONG * 5 + "</footer>", "Ok."),
    (f"<div class='page sidebar-left'><main><p>{LONG}</p></main><div class='ad-content'><p>{LONG}</p></div></div>", LONG),
    (f"<div class='content has-sidebar'><div class='entry-header'><h1>Top</h1></div><p>{LONG}</p></div>"
     f"<div id='relatedPosts'><p>{LONG}</p></div>", f"Top\n{LONG}"),
    (f"<div id=main data-id=menu><p>{LONG}</p></div><div class='cookieNotice'>{LONG}</div>", LONG),
    (f"<p hidden>x</p><div role=navigation>y</div><p>{LONG}</p><p style='display:none'>z</p>", LONG),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert html.extract(page) == want


def test_pages(spark):
    df = spark.createDataFrame([(i, None, p, 3) for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), None)
    assert html.main_text(df.limit(0)).count() == 0


def test_any_markup_is_parsed():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b", "</", "<", ">", "<!--", "-->", "<td>", "<li>", "<table>", "</table>", "text ",
            "&amp;", "<script>", "</script>", "<a href='>'>", "</a>", "<br/>", "<body>", "</body>", "\"", "é"]
    for _ in range(500):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        assert isinstance(html.extract(page), str)


def test_deep_nesting_and_long_pages():
    assert html.extract("<div>" * 5000 + "<p>" + LONG) == LONG
    assert html.extract("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>") == "\n".join([LONG] * 5000)


NOTE = "<article class=comment><p>I have read it, and again, and I must say, with commas, that I liked it very much indeed.</p></article>"
FULL = f"<p>{LONG}</p>" * 3
WANT = "\n".join([LONG] * 3)


@pytest.mark.parametrize("page,want", [
    (f"<main>{FULL}<section id=comments>{NOTE * 9}</section></main>", WANT),
    (f"<body><article>{FULL}<section class=comments>{NOTE * 9}</section></article>", WANT),
    (f"<main><article>{FULL}</article><div id=related><article><p>{LONG}</p></article></div>{NOTE}</main>", WANT),
    (f"<article>{FULL}</article><div class=widget><article><p>{LONG}</p></article></div>", WANT),
    (f"<div id=content>{FULL}</div><div class=sidebar><article><p>{LONG}</p></article></div>", WANT),
    (f"<div class='widget page'><article class='post tag-social'>{FULL}</article></div>", WANT),
    (f"<main><div class='widget'><article>{FULL}</article></div></main>", WANT),
    (f"<h1>Talk</h1><div class=discussion><article class=comment>{FULL}</article></div>", WANT),
    (f"<main><article><h2>A</h2>{FULL}</article><article class='category-related'><p>{LONG}</p></article></main>", f"A\n{WANT}\n{LONG}"),
])
def test_comments_and_teasers_marked_as_articles(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("page,want", [
    (f"<div>{FULL * 2}</div><h2>Part</h2><pre>x = 1</pre><div><p>The end.</div>", f"{WANT}\n{WANT}\nPart\nx = 1\nThe end."),
    (f"<body><div><h1>Title</h1></div><div id=content>{FULL}</div>", f"Title\n{WANT}"),
    (f"<body>Bare <b>text</b>, <a href=x>linked</a> too.<div>{FULL}</div>more of it<ul><li>One</ul><blockquote>Q</blockquote>"
     "<table><tr><td>c</table>", f"Bare text, linked too.\n{WANT}\nmore of it\nOne\nQ\nc"),
    (f"<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><h2><a href=z>Part</a></h2><div>{FULL}</div><h3><a href=w>More</a></h3>"
     "<div><a href=v>Another page</a></div>", f"Part\n{WANT}"),
    (f"<article>{FULL}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p></article>", f"{WANT}\nSo x=2."),
    (f"<article>{FULL}</article><p>Outside.</p>", WANT),
])
def test_parts_beside_the_best_container(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("page,want", [
    (f"<body><form id=form1 action=x><div class=menu><a href=x>Home</a></div><div id=content>{FULL}</div></form>", WANT),
    (f"<form id=aspnetForm><div class=sidebar><p>Side</p></div><article>{FULL}</article></form>", WANT),
    (f"<div class='elementor-widget-container'>{FULL}</div>", WANT),
    (f"<div class='elementor-widget'><div class='elementor-widget-container'>{FULL}</div></div><div class=widget><p>W</p></div>", WANT),
    (f"<article>{FULL}<div class='social-history'><p>{LONG}</p></div><div class='social-links'><p>Follow us</p></div></article>",
     f"{WANT}\n{LONG}"),
    (f"<article>{FULL}<div class='notice-of-change'><p>{LONG}</p></div><div class=notice><p>{LONG}</p></div></article>", f"{WANT}\n{LONG}"),
    (f"<div>{FULL}</div><div><h2>Sources</h2><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div>{FULL}</div>",
     f"{WANT}\nSources\nOne\nTwo\n{WANT}"),
    (f"<article>{FULL}</article><form>{FULL * 3}<input></form>", WANT),
    (f"<div id=content><p>Short.</p></div><div class='cookie-banner'>{FULL}</div>", "Short."),
    (f"<div class=comments>{FULL * 3}</div><div id=content>{FULL}</div>", WANT),
    ("<div>Write to us.</div><form><label>Name</label><input><label>Your message</label><textarea></textarea></form>", "Write to us."),
])
def test_names_drop_no_subtree_with_the_text(page, want):
    assert html.extract(page) == want


def by_walking_up(nodes) -> dict:
    """Points by the definition: every node's own points go to each ancestor, by distance."""
    got = {x: 0.0 for x in nodes}
    for x in nodes:
        up, level = x, 0
        while up is not None:
            got[up] += x.points * (1 if level == 0 else 1 / 2 if level == 1 else (2 / 3) ** (level - 2) / 6)
            up, level = up.parent, level + 1
    return got


def test_points_equal_a_walk_over_all_ancestors():
    rng = random.Random(4)
    for _ in range(30):
        nodes = [html.Node("div", "", None)]
        for _ in range(rng.randint(0, 60)):
            up = rng.choice(nodes[-5:])
            nodes.append(html.Node("div", "", up))
            up.kids.append(nodes[-1])
        for x in nodes:
            x.points = float(rng.choice([0, 0, 1, 2.5, 7]))
        want = by_walking_up(nodes)
        html.pass_up(nodes[::-1])
        assert all(abs(x.points - want[x]) < 1e-9 for x in nodes)


def a_page(rng) -> tuple:
    """A page made of known text and of boilerplate around it, without article or main."""
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", ", so."])
    want, inner = [], ""
    for _ in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "pre"])
        if kind == "ul":
            items = [line(rng.randint(6, 12)) for _ in range(3)]
            inner += "<ul>" + "".join(f"<li>{t}" for t in items) + "</ul>"
            want += items
        else:
            text = line(rng.randint(3, 6) if kind == "h2" else rng.randint(25, 60))
            inner += f"<{kind}>{text}" + ("" if kind == "p" and rng.random() < 0.3 else f"</{kind}>")
            want.append(text)
    inner += f"<p>{(last := line(40))}</p>"
    want.append(last)
    links = "".join(f"<li><a href=x>{word()} {word()}</a>" for _ in range(rng.randint(2, 8)))
    around = [f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'><p>{line(30)}</p></div>", f"<ul class=menu>{links}</ul>",
              f"<div id=comments><p>{line(30)}</p><p>{line(30)}</p></div>", f"<footer><p>{line(10)}</p></footer>",
              f"<div class='cookie-notice'>{line(15)}</div>", f"<script>var x='{line(9)}'</script>",
              f"<form><p>{line(4)}</p><input></form>", f"<div class='ad'>{line(9)}</div>", f"<ul>{links}</ul>"]
    rng.shuffle(around)
    cut = rng.randint(0, 5)
    page = "".join(around[:cut]) + f"<div id=content>{inner}</div>" + "".join(around[cut:rng.randint(cut, 10)])
    for _ in range(rng.randint(0, 3)):
        page = rng.choice(["<div>{}</div>", "<form>{}</form>", "<div class='page widget'>{}</div>", "<section>{}</section>"]).format(page)
    return f"<html><head><title>T</title></head><body>{page}</body></html>", "\n".join(want)


def test_known_text_comes_back():
    rng = random.Random(8)
    for _ in range(300):
        page, want = a_page(rng)
        assert html.extract(page) == want, page


def test_work_is_linear_in_depth():
    assert html.extract("<div>" * 100000 + "<p>" + LONG) == LONG
    assert len(html.extract("<div>x, y " * 50000)) == 50000 * 5 - 1
    assert html.extract("<p><button>" + "<div>" * 50000) == ""


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, FULL, "old", 3), (1, FULL, "old", 3), (None, None, None, None)],
                               "page_id long, html string, Text string, N_CHARS int")
    got = html.main_text(df)
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted(((r.page_id or 0, r.text, r.n_chars) for r in got.collect())) == [(0, "", 0)] + [(1, WANT, len(WANT))] * 2
