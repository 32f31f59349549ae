import random
import re
import time
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import htmltext
from docloom.llm.htmltext import extract, main_text

LONG = "Sentence one, which is long enough. Sentence two follows; it has marks."
PAGE = f"""<html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, it is cheap. Really, do buy it now.</div><div id="cookie-notice"><p>{LONG}</p></div>
<article><h1>Head&amp;line</h1><p>{LONG}<br>more&nbsp;text <b>bold</b> <a href=x>link</a>.<p>Short.<ul><li>item one, two.<li>item three.</ul><script>x<y</script>
<section class="comments"><p>{LONG}</p></section></article><aside class="sidebar"><p>{LONG}</p></aside><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""


def test_article_blocks():
    assert extract(PAGE).split("\n") == ["Head&line", f"{LONG} more text bold link.", "Short.", "item one, two.", "item three."]


def test_without_article_element_ratios_decide():
    page = f"<body><div class=menu><a href=1>Home</a></div><div class=top><span>12</span></div><div class=text><h2>Title here</h2><p>{LONG}</p><p>{LONG}</p><p>And.</p></div><div class=bottom><p>ok</p></div></body>"
    assert extract(page).split("\n") == ["Title here", LONG, LONG, "And."]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>alert(1)", "<nav><a>x</a></nav>"])
def test_no_text(page):
    assert extract(page) in ("", "<")


def test_headers_inside_and_outside_the_article():
    page = f"<div class='site-header'><p>{LONG}</p></div><main><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='entry-footer'><p>Tags</p></div></main>"
    assert extract(page).split("\n") == ["Title", LONG]


def test_broken_and_long():
    assert extract("<article><p>One two.<p>Three &am") == "One two.\nThree &am"
    body = "word, " * 50_000
    assert extract(f"<article><p>{body}</p></article>") == body.strip()
    assert extract("plain text only, no tags.") == "plain text only, no tags."


def test_column(spark):
    df = spark.createDataFrame([(1, PAGE, "t"), (2, None, "t"), (2, None, "t")], "page_id long, html string, text string")
    rows = df.withColumn("main", main_text(F.col("html"))).orderBy("page_id").collect()
    assert rows[0].main == extract(PAGE) and rows[1].main == rows[2].main == "" and rows[0].text == "t"
    assert df.limit(0).withColumn("main", main_text(F.col("html"))).collect() == []


@pytest.mark.parametrize("text, items", [(500, 20), (5000, 6)])
def test_short_blocks_stay_beside_long_paragraphs(text, items):
    p, li = "word, " * (text // 6), "i" * 25
    body = f"<h1>{'h' * 30}</h1><p>{p}</p><ul>{f'<li>{li}</li>' * items}</ul><table><tr><td>cell</td><td>1</td></tr></table>"
    page = f"<nav><ul><li>Home</li></ul></nav><article>{body}<div class='ad'>Buy, now.</div></article><p>Outside, short.</p>"
    assert extract(page).split("\n") == ["h" * 30, p.strip(), *[li] * items, "cell", "1"]


def test_word_around_the_article_does_not_exclude_it():
    body = f"<article><h1>Title</h1><p>{LONG}</p><div class=share>Share this.</div></article>"
    assert extract(f"<div class='page has-sidebar'><p class=menu>Home</p>{body}</div>").split("\n") == ["Title", LONG]
    assert extract(f"<div class=comments><article><p>{LONG} Comment.</p></article></div>{body}").split("\n") == ["Title", LONG]
    assert extract(f"<div class=sidebar hidden>{body}</div>") == ""


N = 100_000
HOSTILE = [
    "<p>Hello.</p><div " + "a" * N, "<p>Hello.</p><div " + "a" * N + " <", "<p>Hello.</p>" + "<a " * N, "<p>Hello.</p>" + "<div x=\"" * N, "<p>Hello.</p>" + "<script></script " * N,
    "<p>Hello.</p>" + "<!-- " * N, "<p>Hello.</p><p " + "class " * N, "<p>Hello.</p><p " + "class = " * N + ">", "<p>Hello.</p><p class" + " " * N + ">",
]


@pytest.mark.parametrize("page", HOSTILE)
def test_unfinished_tags_take_linear_time(page):
    start = time.perf_counter()
    assert extract(page) == "Hello."
    assert time.perf_counter() - start < 1


def test_deep_and_unbalanced_pages():
    start = time.perf_counter()
    assert extract("<div>" * N + "<p>Hello.</p>" + "</q></div>" * N) == "Hello."
    assert extract("<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000 + "<p>Hello.</p>") == "Hello."
    assert extract("a < b " * 20_000) == ("a < b " * 20_000).strip()
    assert extract("<p title='it > x'>One, two.</p><p title=it's>Three.</p><p title=\"x>Four.</p>") == "One, two.\nThree.\nFour."
    assert time.perf_counter() - start < 10


class Plain(HTMLParser):
    """Blocks of a well-formed page with their paths, as lists of (tag, class)."""

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.linked = [], [], False

    def handle_starttag(self, tag, attrs):
        self.linked |= tag == "a"
        if tag != "a":
            self.stack.append((tag, dict(attrs).get("class", "")))
            self.found.append([tuple(self.stack), "", 0])

    def handle_endtag(self, tag):
        self.linked &= tag != "a"
        if tag != "a":
            self.stack.pop()
            self.found.append([tuple(self.stack), "", 0])

    def handle_data(self, data):
        self.found[-1][1] += data
        self.found[-1][2] += len(data) * self.linked


def plain_extract(page):
    """Path ratios in the plainest way, for pages of div, p, h2, ul and li without telling names."""
    p = Plain()
    p.feed(page)
    found = [(path, t.strip(), linked) for path, t, linked in p.found if t.strip()]
    length, marks = lambda r: max(0, len(r[1]) - r[2]), lambda r: 0 if r[2] else sum(c in ".,;:!?" for c in r[1])
    fused = {}
    for path in {r[0] for r in found}:
        own, near = [r for r in found if r[0] == path], [r for r in found if r[0][:-1] == path[:-1]]
        fused[path] = (sum(map(length, own)) + sum(map(length, near))) / 2 * (1 + (sum(map(marks, own)) + sum(map(marks, near))) / 2) if sum(map(length, own)) else 0
    chosen = {x for x, f in fused.items() if f >= 0.3 * max(fused.values())}
    opened = {x[:-1] for x in chosen}
    for path in fused:
        k = len(path)
        while k and path[k - 1][0] in ("p", "h2", "ul", "li") and path[: k - 1] not in opened:
            k -= 1
        own = [r for r in found if r[0] == path]
        if k and path[k - 1][0] in ("p", "h2", "ul", "li") and (path[-1][0] == "h2" or 2 * sum(map(length, own)) > sum(len(r[1]) for r in own)):
            chosen.add(path)
    return [r[1] for r in found if r[0] in chosen], [r[1] for r in found]


def random_page(rng):
    """A page without marks: (html, article blocks)."""
    words = lambda a, b, end: " ".join("w" * rng.randrange(2, 9) + "," * (rng.random() < 0.15) for _ in range(rng.randrange(a, b))) + f" {rng.random()}{end}"
    links = lambda n: "".join(f"<li><a href=x>{words(1, 3, '')}</a></li>" for _ in range(n))
    article, body = [], ""
    for _ in range(rng.randrange(3, 9)):
        kind, t = rng.choice(["h2", "p", "p", "p", "li"]), words(2, 5, "")
        t = words(25, 90, ".") if kind == "p" else t
        article.append(t)
        body += f"<ul><li>{t}</li></ul>" if kind == "li" else f"<{kind}>{t}</{kind}>"
    t = words(30, 90, ".")
    page = f"<div class=a1><ul>{links(6)}</ul></div><div class=b2>{words(2, 6, '')}</div><div class=c3><p>{t}</p>{body}<ul class=e5>{links(3)}</ul></div><div class=d4><p>{words(2, 7, '.')}</p></div>"
    return page, [t, *article]


def test_ratios_against_a_plain_version():
    rng = random.Random(4)
    right = kept = wanted = 0
    for _ in range(200):
        page, article = random_page(rng)
        got, everything = extract(page).split("\n"), plain_extract(page)[1]
        assert got == plain_extract(page)[0]
        assert got != everything and set(got) <= set(everything)
        right, kept, wanted = right + len(set(got) & set(article)), kept + len(got), wanted + len(article)
    assert right / kept > 0.97 and right / wanted > 0.99


def test_ratios_decide_beside_marks():
    article = f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><ul><li><a href=x>Other page</a></li><li><a href=y>One more page</a></li></ul></article>"
    assert extract(article).split("\n") == ["Title", LONG, LONG, "Other page", "One more page"]  # the article's own links stay
    teaser = f"<article><p>Tiny.</p></article><div class=c1>{f'<p>{LONG * 20}</p>' * 3}</div>"
    assert extract(teaser).split("\n") == [LONG * 20] * 3
    assert extract("<article><p><a href=x>Only a link</a></p></article><p><a>Menu</a></p>") == "Only a link"


def test_without_marks_ratios_stand_alone():
    got = extract(PAGE, marked=False).split("\n")
    assert LONG in got and "One" not in got and "Name" not in got


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the tables aren't here")
def test_ratios_decide_on_the_given_pages(monkeypatch):
    """With constant ratios the marks alone choose otherwise; without marks the ratios find the article's blocks nearly as well."""
    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist() if x]
    real, bare = [extract(x) for x in pages], [extract(x, marked=False) for x in pages]
    want = [{t for t in extract(f"<article>{m[1]}</article>").split("\n")} if (m := re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", x)) else None for x in pages]
    kept = [(set(b.split("\n")), w) for b, w in zip(bare, want, strict=True) if w]
    assert sum(len(b & w) for b, w in kept) > 0.9 * sum(len(b) for b, _ in kept) and sum(len(b & w) for b, w in kept) > 0.9 * sum(len(w) for _, w in kept)
    assert all(set(r.split("\n")) == w for r, w in zip(real, want, strict=True) if w)
    monkeypatch.setattr(htmltext, "fused_ratios", constant(htmltext.fused_ratios))
    assert sum(extract(x) != r for x, r in zip(pages, real, strict=True)) > 0.5 * len(pages)


def constant(fused):
    """Fused ratios of pages as long, whose every path has the same text and punctuation; marks, names and kinds stay."""

    def run(paths, smoothing, weight, reach):
        return [f and f / r for f, r in zip(fused(paths, smoothing, weight, reach), fused(paths, smoothing, 1.0, reach), strict=True)]

    return run
