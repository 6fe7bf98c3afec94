import html as entities
import math
import random
import re

import pytest

from pagewright.llm import html

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site <a href="/">home</a></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The  title</h1><p>First   paragraph with &amp; some &eacute; words,<br>and a break.<p>Second <b>bold <i>text</b> here.
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class="ad">Buy now</div><form>name <input></form></article>
<aside>side</aside><section id="comments"><article class="comment"><p>What a great post this is, I could read it again and again and again.</p></article></section>
<footer>&copy; all</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE) == "The title First paragraph with & some é words, and a break. Second bold text here. one two a b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<div><script>x", ""),
        ("<body><div id='main-content'><h1>T</h1><p>some words of text that go on.</p><p>and more of it, as it is.</p></div><div class='related-links'><a href=x>see this too</a></div></body>", "T some words of text that go on. and more of it, as it is."),
        ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>cut in a tag<di", "cut in a tag"), ("<article><p>5 < 6 and a &lt; b</p></article>", "5 < 6 and a < b"),
        ("<main><article><section><p>part one is here.</p></section><section><p>part two is here.</p></section></article></main>", "part one is here. part two is here."),
    ],
)
def test_cases(page, text):
    assert html.main_text(page) == text


BODY = "<article><h1>The title</h1><p>Some words of the text that go on.</p><p>And more of it, as it is.</p></article>"
WORDS = "The title Some words of the text that go on. And more of it, as it is."
BARE = BODY.replace("article>", "div>")


@pytest.mark.parametrize(
    "page",
    [f"<body><div class='{c}'>{b}</div><div class='cookie-notice'>We use cookies</div></body>" for b in (BODY, BARE) for c in ("content has-sidebar", "layout no-sidebar", "page with-header-menu", "post-comments-open", "sidebar", "header", "comments")]
    + [f"<body><form id='aspnetForm'>{BODY}<form>name <input></form></form></body>", f"<body><form>{BARE}</form><p><a href='/'>home</a></p></body>", f"<body><div role='form'>{BODY}</div></body>"]
    + [f"<article><div class='{c}'>{BARE}</div><div class='share-buttons'>Share this</div></article>" for c in ("body share-enabled", "share")]
    + [f"<body>{BODY}<div class='related'><article><p>Another page, in short.</p></article></div><div id='comments'><article><p>Me too.</p></article></div></body>"]
    + [f"<body>{BODY}<div class='comments'><p>{'A long thread of what readers wrote. ' * 200}</p></div></body>"],
)
def test_names_do_not_take_the_article_out(page):
    assert html.main_text(page) == WORDS


def test_named_parts_are_read_where_nothing_else_is():
    assert html.main_text("<body><div class='notice'><p>one is here.</p></div><div class='popup'><p>two is here.</p></div></body>") == "one is here. two is here."


def test_deep_and_long_pages_end():
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert len(html.main_text("<article>" + "<p>word word word</p>" * 20_000 + "</article>").split()) == 60_000


def test_odd_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out) == sorted((str(r[0]), html.main_text(r[2]), len(html.main_text(r[2]))) for r in rows)
    assert html.extract(pages.where("false")).count() == 0


def test_tables(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub("<[^>]*>", " ", re.search("<article>(.*?)</article>", r["html"], re.S)[1])
        assert html.main_text(r["html"]) == " ".join(entities.unescape(body).split())


def test_articles_without_semantic_elements(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        assert html.main_text(plain) == html.main_text(r["html"])


def _brute(page: str):
    """Density, density sum and text of every element of a well-formed page, each from its own definition."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(page)
    size = lambda s: len("".join((s or "").split(" ")))
    chars = lambda el: size("".join(el.itertext()))
    links = lambda el: chars(el) if el.tag == "a" else sum(links(c) for c in el)
    tags = lambda el: sum(1 for _ in el.iter()) - 1
    link_tags = lambda el: sum(1 for x in el.iter("a") if x is not el)
    all_c, all_l = max(chars(root), 1), links(root)

    def density(el):
        c, lc, t, lt = chars(el), links(el), max(tags(el), 1), link_tags(el)
        if not c:
            return 0.0
        base = math.log(lc * c / max(c - lc, 1) + all_l * c / all_c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(min(lt, t), 1) + 1e-9) / math.log(max(base, 1.3))

    def blocks_below(el):
        for child in el:
            if child.tag in html.INLINE:
                yield from blocks_below(child)
            else:
                yield child

    return [(el.tag, density(el), sum(density(b) for b in blocks_below(el)) if el.tag not in html.INLINE else 0.0) for el in root.iter()]


def test_densities_are_those_of_the_definition():
    rng = random.Random(3)

    def grown(depth):
        tag = rng.choice(["div", "section", "div", "b", "p"]) if depth else "p"
        inner = "".join(rng.choice([grown(depth - 1), "some words ", "<a>a link</a>", "<i>x</i>"]) for _ in range(rng.randint(0, 4))) if depth and tag not in ("p", "b") else "".join(rng.choice(["words of text ", "<a>link</a>", "<b>bold</b>"]) for _ in range(rng.randint(0, 5)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(200):
        text = f"<body>{''.join(grown(4) for _ in range(3))}</body>"
        page = html._Page()
        page.feed(text)
        page.close()
        dense, _, _ = html.densities(page)
        sums = html.density_sums(page, dense, page.aside)
        want = _brute(text)
        assert page.tag[1:] == [t for t, _, _ in want]
        assert dense[1:] == pytest.approx([d for _, d, _ in want])
        assert [s if t not in html.INLINE else 0.0 for t, s in zip(page.tag[1:], sums[1:], strict=True)] == pytest.approx([s for _, _, s in want])


def test_the_largest_sum_is_content_whole():
    page = "<body><div><a href='/1'>one</a><a href='/2'>two</a></div><div><h1>T</h1><section><p>some words of text that go on and on.</p><p>x.</p></section><p>short.</p><section><p>more of it, as it is, and again more.</p></section><ul><li><a href='/3'>see also</a></li></ul></div></body>"
    assert html.main_text(page) == "T some words of text that go on and on. x. short. more of it, as it is, and again more."
