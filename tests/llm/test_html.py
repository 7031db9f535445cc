import random
import time
from html.parser import HTMLParser
from statistics import fmean, pstdev

import pytest

from sluice.llm import html_text as h

W = "Words here, and more of them. " * 8
squeeze = lambda t: " ".join(t.split())


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='has-sidebar'><article><p>{W}</p></article></div>", W),
        (f"<body><form id='page'><div class='content'><p>{W}</p><p>Short.</p></div></form><footer>f</footer></body>", W + "Short."),
        (f"<body><form><div><p>{W}</p></div><label>Name</label></form></body>", W),
        (f"<body><form action='/s'><p>Search, please.</p></form><div><p>{W}</p></div></body>", W),
        (f"<div class='main no-comments'><p>{W}</p></div>", W),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{W}</p></article>", "Title " + W),
        (f"<article><h1>T</h1><p>{W}</p><div class='x1'><a href='/'>More like this</a> <a href='/b'>Other</a></div><p>End.</p></article>", f"T {W} End."),
        (f"<article><p>{W * 30}</p><ul><li>one</li><li>two</li></ul><ol><li><a href='/'>aaa bbb</a></li></ol></article>", f"{W * 30} one two"),
        (f"<div class='comments'><p>{W}</p></div>", W),
        (f"<body><div class='post'><p>Short text</p></div><div class='comments'><p>{W}</p></div></body>", "Short text"),
    ],
)
def test_wrappers_and_paths_inside_the_article(page, text):
    assert h.main_text(page) == squeeze(text)


def test_without_the_ratios_the_result_is_another():
    off = lambda found: {b.element.path: 1.0 for b in found} | {-1: 0.0}
    page = f"<body><div class='x'><p>Menu one</p></div><ul><li><a href='/'>a</a></li></ul><div><h1>T</h1><p>{W}</p><ol><li><a href='/'>Next, please.</a></li></ol><p>End.</p></div></body>"
    assert h.main_text(page) == squeeze(f"T {W} End.")
    assert " ".join(b.text for b in h.main_blocks(h.Page(page), off)) != h.main_text(page)
    inside = f"<article><p>{W}</p><ol><li><a href='/'>Next, please.</a></li></ol></article>"
    assert h.main_text(inside) == squeeze(W)
    assert " ".join(b.text for b in h.main_blocks(h.Page(inside), off)) == squeeze(W + " Next, please.")


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.up, self.names, self.role = tag, up, attrs.get("class") or "", attrs.get("role") or ""
        self.line = [*(up.line if up else []), self]

    def path(self):
        parts = []
        for n in self.line:
            if n.tag not in h.INLINE:
                parts.append((n.tag, tuple(sorted(h.NAME_PARTS.findall(n.names)))) if n.tag in ("div", "section", "td") else n.tag)
        return tuple(parts)

    def block(self):
        return next(n for n in reversed(self.line) if n.tag not in h.INLINE)

    def declared(self):
        for kind in ("article", "main"):
            found = [n for n in self.line if n.tag == kind]
            if found:
                return found[0]
        return None

    def says(self):
        if self.tag in ("html", "body", "article", "main", "p", "header") or self.tag in h.INLINE | h.HEADINGS:
            return ""
        return h.names_say(tuple(tuple(x.lower() for x in h.NAME_PARTS.findall(n)) for n in self.names.split()), self.up is not None and self.up.declared() is not None)


class Plain(HTMLParser):
    """Blocks of a well-formed page: node, text, characters, those in links, punctuation marks."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.at, self.blocks, self.text, self.nodes = Node("#root", {}, None), [], [], []
        self.nodes.append(self.at)
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = squeeze("".join(t for t, _ in self.text))
        if text:
            size = sum(len("".join(t.split())) for t, _ in self.text)
            linked = sum(len("".join(t.split())) for t, a in self.text if a)
            self.blocks.append((self.at.block(), text, size, linked, sum(c in ".,;:!?" for c in text)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append((" ", False))
            return
        if tag not in h.INLINE:
            self.flush()
        self.at = Node(tag, dict(attrs), self.at)
        self.nodes.append(self.at)

    def handle_endtag(self, tag):
        assert self.at.tag == tag
        if tag not in h.INLINE:
            self.flush()
        self.at = self.at.up

    def handle_data(self, data):
        self.text.append((data, any(n.tag == "a" for n in self.at.line)))


def plain_main_text(page):
    """The definition, read straight from the docstring, with whole paths and lists of ancestors."""
    p = Plain(page)
    left = [b for b in p.blocks if not any(n.tag in h.NOT_CONTENT_TAGS for n in b[0].line)]
    links = lambda b: 2 * b[3] > b[2]
    marked = {b[0].path() for b in left if b[4]}
    under = lambda n, blocks: [b for b in blocks if n in b[0].line]
    prose = lambda n: sum(b[2] - b[3] for b in under(n, left) if b[0].path() in marked and not links(b))
    root = p.nodes[0]
    rest = sum(b[2] - b[3] for b in left if not any(n.says() == "no" for n in b[0].line))

    def out(n):
        most = 2 * prose(n) > prose(root) > 0
        if n.tag in h.DOUBTFUL_TAGS or n.role in h.NOT_CONTENT_ROLES or (n.tag == "header" and not (n.up and n.up.declared())):
            if not most:
                return True
        if n.says() == "no" and not (most and rest == 0):
            return True
        if n.says() == "doubt" and sum(len(b[1]) * (1 if b[4] and not links(b) else -1) for b in under(n, left) if b[0].tag not in h.HEADINGS) < 0:
            return True
        return next((x for x in n.line if x.tag == "main"), None) is not n and n.up is not None and out(n.up)

    found = [b for b in left if not out(b[0])]
    if not found:
        return ""
    paths = [b[0].path() for b in found]
    of = lambda q: [b for b, x in zip(found, paths) if x == q]
    length = [sum(b[2] - b[3] for b in of(q)) / len(of(q)) for q in paths]
    marks = [sum(b[4] for b in of(q)) / len(of(q)) for q in paths]
    near = lambda x, k: 0.25 * x[max(k - 1, 0)] + 0.5 * x[k] + 0.25 * x[min(k + 1, len(x) - 1)]
    fused = [near(length, k) * (1 + near(marks, k)) * sum(b[2] - b[3] for b in of(q)) / sum(b[2] for b in of(q)) for k, q in enumerate(paths)]
    mean = {q: fmean(f for f, x in zip(fused, paths) if x == q) for q in paths}
    least = 0.5 * pstdev(fused)
    chosen = [b for b, q in zip(found, paths) if mean[q] >= least and mean[q] > 0] or found
    own = [b for b in chosen if b[0].declared()]
    article = None
    if 2 * sum(len(b[1]) for b in own) >= sum(len(b[1]) for b in chosen):
        chosen_of = own
        if len({b[0].declared() for b in own}) == 1:
            article = own[0][0].declared()
    else:
        chosen_of = chosen
    if article is None:
        article = next(n for n in reversed(chosen_of[0][0].line) if all(n in b[0].line for b in chosen_of))
        while article.up and article.tag in h.HEADINGS | {"p", "li", "ul", "ol"}:
            article = article.up
        if article.declared():
            article = article.declared()
        else:
            outside = [b for b in found if links(b) and article not in b[0].line]
            while article.tag not in h.PAGE and article.up.tag not in h.PAGE and not any(article.up in b[0].line for b in outside):
                article = article.up
    at = [k for k, b in enumerate(found) if article in b[0].line]
    if article.tag in h.PAGE:
        span = [k for k in at if any(found[k] is b for b in chosen)]
        at = list(range(span[0], span[-1] + 1))
    while at[0] > 0 and found[at[0] - 1][0].tag in h.HEADINGS and (article.tag in h.PAGE or found[at[0]][0].tag not in h.HEADINGS):
        at = [at[0] - 1, *at]
    inside = least**0.25 if least > 1 else least
    good = [k for k in at if mean[paths[k]] > 0 and mean[paths[k]] >= inside]
    if good:
        heads = lambda k: next((j in good for j in at if j > k and found[j][0].tag not in h.HEADINGS), True)
        at = [k for k in at if (heads(k) if found[k][0].tag in h.HEADINGS else k in good)]
    return " ".join(found[k][1] for k in at)


def random_page(rng):
    names = ["", "", "", "content", "post related", "sidebar", "ad", "share", "comments", "x", "has-sidebar", "related-work", "header"]
    words = lambda n: " ".join(rng.choice(["word", "And, so", "stop.", "of", "long"]) for _ in range(n))

    def leaf():
        kind = rng.randrange(8)
        if kind < 4:
            return f"<p>{words(rng.choice([3, 12, 60]))}<b>{words(2)}</b></p>"
        if kind == 4:
            return f"<h2>{words(2)}</h2>"
        if kind == 5:
            return "<ul>" + "".join(f"<li><a href='/'>{words(2)}</a></li>" for _ in range(3)) + "</ul>"
        return "<ul>" + "".join(f"<li>{words(2)}</li>" for _ in range(2)) + "</ul>" if kind == 6 else f"<p><a href='/'>{words(3)}</a></p>"

    def box(depth):
        tag = rng.choice(["div", "div", "div", "section", "article", "main", "form", "nav", "header"])
        name = rng.choice(names)
        inner = "".join(box(depth + 1) if depth < 3 and rng.random() < 0.4 else leaf() for _ in range(rng.randrange(1, 5)))
        return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{inner}</{tag}>"

    return "<html><body>" + "".join(box(0) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def test_random_pages_against_a_plain_second_version():
    rng = random.Random(12)
    pages = [random_page(rng) for _ in range(400)]
    for page in pages:
        assert h.main_text(page) == plain_main_text(page), page
    assert sum(bool(h.main_text(p)) for p in pages) > 200


@pytest.mark.parametrize("piece", ["<div>x, y. ", "<div class='post related'>x, y. ", "<b>x, y. ", "<div><a>x</a>", "<table><tr><td>x, y. ", "<li>x<div>"])
def test_deeply_nested_pages_take_linear_time(piece):
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        h.main_text(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_a_very_long_page_is_whole():
    assert h.main_text("<article>" + "<p>One, two. three</p>" * 100_000 + "</article>") == "One, two. three " * 99_999 + "One, two. three"
