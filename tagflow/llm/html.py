"""Main text of web pages by tree scoring.

The page becomes a tree, as a browser would repair it.  Boilerplate
subtrees (menus, page headers and footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles) are dropped by tag, role, or words
of class and id.  A name that speaks of layout, or a form, drops no subtree that
holds most of the page's text where no article or main does; a name that has
such a word beside a subject (``social-history``) drops no prose.  Every
paragraph then passes points to its ancestors: one for being there, one per
comma, one per hundred characters (three at most); the parent gets all, the
grandparent half, the next a sixth, and each above two thirds of the one below.
A container's points are discounted by its link density.  The best container is
kept.  Where no article or main marks the text, its siblings of low link density
are kept too (elements and bare text, headings before what is kept, and parts
with a heading between kept ones); beside an article or main only those that
score enough.  The work is linear in the page, however deep it is.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside "
                    "form button select textarea input dialog menu title xmp noembed noframes "
                    "annotation annotation-xml".split())     # sources of a formula, not shown
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                   "pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article section div main body td blockquote center figure details ul ol dl table".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCKS - frozenset(("body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"))
# Opening one of the keys closes an open element of the values, up to the barrier tags.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"),
          "tfoot": ("tbody", "thead", "tr", "td", "th")}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
P_BARRIERS = frozenset("table td th caption button object html".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form "
                      "toolbar".split())
BAD_WORDS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs "
                      "comment comments commentlist discussion disqus consent cookie cookies gdpr footer header "
                      "masthead menu nav navbar navigation newsletter notice notices outbrain pager pagination popup "
                      "modal overlay promo promotion related recommended rail share sharing sidebar sidebars skip "
                      "social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
# Names of what holds texts of others or of other pages.
OTHER_TEXTS = frozenset("ad ads adv advert adverts advertisement advertising comment comments commentlist discussion disqus "
                        "outbrain promo promotion recommended related sponsor sponsored taboola".split())
# A header of one of these is part of the text; names with these prefixes speak of what a wrapper has.
TEXT_WORDS = frozenset("article content entry main post story text".split())
ABOUT_LAYOUT = frozenset("has no with without".split())
# Layout words that also name subjects, and words that leave them a name of layout.
SUBJECTS = frozenset("rail share sharing skip social".split())
OF_LAYOUT = frozenset("bar block box btn button buttons center col column container content cta fixed float follow group "
                      "icon icons inline inner item items left legal link links list main media mobile nav network "
                      "networks outer page panel post profile profiles right row section site small sticky this to top wrap "
                      "wrapper".split())
# What is named so is never the whole page.
NOTICES = frozenset("breadcrumb breadcrumbs consent cookie cookies gdpr modal newsletter notice notices overlay pager pagination "
                    "popup skip subscribe subscription".split())
PROSE = 80            # characters outside links that make a paragraph prose
# First words of the names by which an article tells its kind and subject.
ABOUT_POST = frozenset("category format status tag type".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LINKED = 0.5          # share of characters in links from which a sibling is a list of links
# How a subtree is judged: text, layout by its name, other texts by its name, no text at all.
TEXT, LAYOUT, OTHERS, NO_TEXT = range(4)

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
                 r"|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$))", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# The white space of HTML text, no-break space included.
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "points", "in_text", "prose")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent, self.kids, self.points = tag, attrs, parent, [], 0.0
        self.prose = False
        self.in_text = parent is not None and (parent.in_text or parent.tag in ("article", "main"))


def parse(page: str) -> Node:
    """Tree of a page: nodes and text strings, with missing end tags repaired."""
    root = Node("html", "", None)
    at, n = 0, len(page)
    path: list = []       # open elements below the root
    places: dict = {}     # places in ``path`` of the open elements of each tag

    def innermost(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    def open_above(names, barriers) -> int:
        """Place of the innermost open element of ``names`` that no open one of ``barriers`` hides; -1 if none."""
        found = innermost(names)
        return found if found >= innermost(barriers) else -1

    def close(place: int) -> None:
        while len(path) > place >= 0:
            places[path.pop().tag].pop()

    while at < n:
        cur = path[-1] if path else root
        m = TAG.search(page, at)
        if m is None:
            cur.kids.append(page[at:])
            break
        if m.start() > at:
            cur.kids.append(page[at:m.start()])
        at = m.end()
        if m.group(2):
            tag = m.group(2).lower()
            if tag == "html" or tag == "body" and places.get("body"):
                continue
            if tag in ENDS_P:
                close(open_above(("p",), P_BARRIERS))
            if tag == "body":
                close(open_above(("head",), ()))
            if tag in CLOSES:
                old = open_above(CLOSES[tag], BARRIERS[tag])
                while old >= 0:
                    close(old)
                    old = open_above(CLOSES[tag], BARRIERS[tag])
            attrs = m.group(3) or ""
            cur = path[-1] if path else root
            node = Node(tag, attrs, cur)
            cur.kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                node.kids.append(page[at:end.start() if end else n])
                at = end.end() if end else n
            elif tag not in VOID and not attrs.endswith("/"):
                places.setdefault(tag, []).append(len(path))
                path.append(node)
        elif m.group(1):
            tag = m.group(1).lower()
            if tag not in ("html", "body"):
                close(open_above((tag,), P_BARRIERS if tag not in BLOCKS else ()))
    return root


def judge(node: Node) -> int:
    """Whether a subtree is no main text, by its tag, role, and words of class and id."""
    tag = node.tag
    if tag in DROPPED:
        return NO_TEXT
    if tag == "header":
        return TEXT if node.in_text else NO_TEXT
    if not node.attrs or tag in ("html", "body", "main"):
        return TEXT
    found = TEXT
    for name, value in ATTR.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'")
        if tag != "article":
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return NO_TEXT
            if name == "role" and value.lower() in BAD_ROLES:
                return NO_TEXT
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return NO_TEXT
        if name in ("class", "id"):
            for part in value.split():
                split = [w.lower() for w in WORDS.findall(part)]
                words = set(split)
                bad = words & BAD_WORDS
                if not bad or words & ABOUT_LAYOUT or bad == {"header"} and words & TEXT_WORDS:
                    continue
                if tag == "article" and split[0] in ABOUT_POST:
                    continue
                if node.prose and not bad & OTHER_TEXTS and ("of" in words or bad <= SUBJECTS and words - bad - OF_LAYOUT):
                    continue
                found = max(found, OTHERS if bad & OTHER_TEXTS else LAYOUT)
    return found


def find_prose(root: Node) -> None:
    """Set ``prose`` where some paragraph of a subtree holds ``PROSE`` characters outside links."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str)]
    inline: dict = {}
    for x in reversed(order):
        chars = 0
        for k in x.kids:
            if isinstance(k, str):
                chars += len(k.strip())
            elif k.tag not in DROPPED or k.tag == "form":
                x.prose = x.prose or k.prose
                if k.tag not in BLOCKS and k.tag != "a":
                    chars += inline[k]
        inline[x] = chars
        x.prose = x.prose or chars >= PROSE and x.tag != "a"


def names(node: Node) -> set:
    return {w.lower() for name, value in ATTR.findall(node.attrs) if name.lower() in ("class", "id")
            for w in WORDS.findall(value)}


def heavy_wrappers(root: Node) -> tuple[set, set]:
    """Forms, and elements with a name of layout, that hold more than half of the page's text and some prose.

    Text is what lies in no other dropped element and in no link.  Forms are
    none if an article or main outside of forms has text.
    """
    order, todo, named, forms, marked = [], [(root, False, False)], [], [], []
    while todo:
        x, quiet, in_form = todo.pop()
        how = judge(x) if x is not root else TEXT
        if x.tag == "form":
            forms.append(x)
            in_form = True
        elif how in (OTHERS, NO_TEXT):
            continue
        elif how == LAYOUT and not names(x) & NOTICES:
            named.append(x)
        elif x.tag in ("article", "main") and not in_form:
            marked.append(x)
        quiet = quiet or x.tag == "a"
        order.append((x, quiet))
        todo += [(k, quiet, in_form) for k in x.kids if not isinstance(k, str)]
    if not named and not forms:
        return set(), set()
    chars: dict = {}
    for x, quiet in reversed(order):
        own = 0 if quiet else sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        chars[x] = own + sum(chars.get(k, 0) for k in x.kids if not isinstance(k, str))
    if any(chars[x] for x in marked):
        forms = []
    return tuple({x for x in xs if x.prose and 2 * chars[x] > chars[root]} for xs in (forms, named))


def marked_text(scope: Node, judged: dict) -> Node | None:
    """The element below ``scope`` that is marked as the text: a main, or else the article with the most text.

    An article inside something named as layout is the text only if it holds
    more than all outside of such; one that is or lies in other texts (comments,
    related pages), only if there is nothing but headings outside.  Characters
    in links do not count.
    """
    order, todo = [], [(scope, TEXT, False)]
    while todo:
        x, kind, quiet = todo.pop()
        if x is not scope:
            if x not in judged:
                judged[x] = judge(x)
            if judged[x] == NO_TEXT:
                continue
            kind = max(kind, judged[x])
        quiet = quiet or x.tag == "a"
        order.append((x, kind, quiet))
        todo += [(k, kind, quiet) for k in reversed(x.kids) if not isinstance(k, str)]
    if all(kind == TEXT for _, kind, _ in order):
        return None       # no name drops anything here
    chars: dict = {}
    outside = 0
    for x, kind, quiet in reversed(order):
        own = 0 if quiet else sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        chars[x] = own + sum(chars.get(k, 0) for k in x.kids if not isinstance(k, str))
        if kind == TEXT and x.tag not in HEADINGS:
            outside += own
    mains = [x for x, _, _ in order if x.tag == "main" and x is not scope and chars[x]]
    if mains:
        return max(mains, key=chars.get)
    articles = [(x, kind) for x, kind, _ in order if x.tag == "article" and x is not scope]
    near = [a for a in articles if a[1] != OTHERS]
    if not articles:
        return None
    x, kind = max(near or articles, key=lambda a: chars[a[0]])
    if kind == TEXT or kind == LAYOUT and outside < chars[x] or kind == OTHERS and outside < 25:
        return x
    return None


def prune(root: Node) -> None:
    """Drop boilerplate; a wrapper by its name only if it holds neither the marked text nor most of the page's."""
    find_prose(root)
    forms, named = heavy_wrappers(root)
    judged = {x: TEXT for x in forms}
    wraps, text = set(), marked_text(root, judged)
    if text is None:
        judged |= {x: TEXT for x in named}
        text = marked_text(root, judged)
    while text is not None:
        up = text
        while up is not None and up not in wraps:
            wraps.add(up)
            up = up.parent
        text = marked_text(text, judged)
    todo = [root]
    while todo:
        x = todo.pop()
        kept = []
        for k in x.kids:
            if not isinstance(k, str):
                how = judged[k] if k in judged else judge(k)
                if how == NO_TEXT or how != TEXT and k not in wraps:
                    continue
                todo.append(k)
            kept.append(k)
        x.kids = kept


def clean(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def blocks_of(node: Node) -> list:
    """Text blocks of a subtree in page order."""
    out, run = [], []

    def flush():
        if run:
            text = clean("".join(run))
            if text:
                out.append(text)
            run.clear()

    todo = [(node, False)]
    while todo:
        x, done = todo.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if x.tag in BLOCKS:
            flush()
        if x.tag == "br":
            run.append("\n")
        if not done and x.kids:
            if x.tag in BLOCKS:
                todo.append((x, True))
            todo += [(k, False) for k in reversed(x.kids)] if not done else []
    flush()
    return out


def sizes(root: Node) -> dict:
    """Per node: characters of text, of those in links, and commas of the text."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str)]
    got = {}
    for x in reversed(order):
        chars = linked = commas = 0
        for k in x.kids:
            if isinstance(k, str):
                t = clean(k)
                chars += len(t)
                commas += t.count(",") + t.count("，") + t.count("、") + t.count("،")
            else:
                c, a, m = got[k]
                chars, linked, commas = chars + c, linked + a, commas + m
        got[x] = (chars, chars if x.tag == "a" else linked, commas)
    return got


def is_paragraph(node: Node) -> bool:
    """A paragraph tag, or any block that holds text of its own."""
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in BLOCKS and any(isinstance(k, str) and k.strip() or
                                      not isinstance(k, str) and k.tag not in BLOCKS and k.kids for k in node.kids)


def pass_up(order) -> None:
    """Add to each node's points those of what lies below it; ``order`` has children before parents.

    A node has its own points, half of its children's, a sixth of its
    grandchildren's, and of each level below two thirds as much.
    """
    own: dict = {}
    below: dict = {}
    far: dict = {}
    for x in order:
        kids = [k for k in x.kids if not isinstance(k, str)]
        own[x] = x.points
        below[x] = sum(own[k] for k in kids)
        far[x] = sum(below[k] / 6 + far[k] * 2 / 3 for k in kids)
        x.points += below[x] / 2 + far[x]


def has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            return True
        todo += [k for k in x.kids if not isinstance(k, str)]
    return False


def extract(page: str | None) -> str:
    """Main text of one page: blocks joined by a line break, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    size = sizes(root)
    for node, (chars, _, commas) in size.items():
        if not chars or not is_paragraph(node):
            continue
        to = node.parent if node.tag in PARAGRAPHS else node
        if to is not None:
            to.points += 1 + commas + min(chars / 100, 3)
    pass_up(size)
    scored = [x for x in size if x.points]
    if not scored:
        return "\n".join(blocks_of(root))

    def score(x: Node) -> float:
        chars, linked, _ = size[x]
        return x.points * (1 - linked / chars if chars else 0.0)

    order = {x: i for i, x in enumerate(size)}
    best = max(scored, key=lambda x: (score(x), -order[x]))
    while best.parent is not None and best.tag not in CONTAINERS:
        best = best.parent
    # Parts of one article: climb while the parent article holds more text than the best part.
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    parent, top = best.parent, score(best)
    if parent is None:
        return "\n".join(blocks_of(best))
    if best.tag in ("article", "main"):
        out = []
        for k in parent.kids:
            if not isinstance(k, str) and (k is best or k.points and score(k) >= max(10.0, 0.2 * top)):
                out += blocks_of(k)
        return "\n".join(out)
    # Siblings; bare text and what stands in a line with it are one.
    parts: list = []
    for k in parent.kids:
        inline = k is not best and (isinstance(k, str) or k.tag not in BLOCKS)
        if inline and parts and parts[-1][0]:
            parts[-1][1].append(k)
        else:
            parts.append((inline, [k]))
    stays, after = [], False
    for inline, kids in reversed(parts):
        chars = linked = 0
        for k in kids:
            c, a = (len(clean(k)), 0) if isinstance(k, str) else size[k][:2]
            chars, linked = chars + c, linked + a
        k = kids[0]
        good = (k is best or chars and linked < LINKED * chars
                or not inline and k.points and score(k) >= max(10.0, 0.2 * top))
        after = bool(after or good)
        stays.append(bool(good) or after and not inline and k.tag in HEADINGS)
    stays.reverse()
    # Parts with a heading between others of the text, such as a list of sources.
    bodies = [i for i, (inline, kids) in enumerate(parts) if stays[i] and not inline and kids[0].tag not in HEADINGS]
    for i, (inline, kids) in enumerate(parts):
        if not stays[i] and not inline and bodies and bodies[0] < i < bodies[-1]:
            stays[i] = bool(size[kids[0]][0]) and has_heading(kids[0])
    kept = [kids for kids, stay in zip((kids for _, kids in parts), stays) if stay]
    whole = Node("div", "", None)
    whole.kids = [k for kids in kept for k in kids]
    return "\n".join(blocks_of(whole))


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``text`` and ``n_chars`` (its code points).

    Null and empty pages, and pages without text, give an empty text; pages of
    any length and depth are read whole.  Each row is read for itself, so
    repeated rows and ids give equal rows, an empty table none.  Of containers
    of equal score the first, innermost one is taken.  Columns of ``pages`` named
    ``text`` or ``n_chars`` (in any case) are replaced, others stay.
    """

    def compute(col):
        texts = [extract(p) for p in col.to_pylist()]
        return [texts, [len(t) for t in texts]]

    return append_columns(pages, FIELDS, [html_col], compute, keep)
