"""Main text on layouts that the generator of labelled pages does not make, and on the whole pages table."""

import pytest

from lektor.llm import main_text, tables

SENTENCES = ("The ferry left an hour late because of fog. Most passengers had already gone home.", "A second boat is expected in June, the harbour office says. Tickets stay valid until then.", "Fishermen have used the pier since 1921. Its timbers were renewed twice.", "Nobody was hurt. The captain thanked the crew for their patience.")
MENU = '<nav><ul><li><a href="/">Start</a></li><li><a href="/p">People</a></li><li><a href="/m">Map</a></li></ul></nav>'
FOOT = "<footer>&copy; 2023 Harbour Gazette. All rights reserved.</footer>"
LAYOUTS = {
    "body": "<html><body>{p}</body></html>",
    "body div": "<html><body><div>{p}</div></body></html>",
    "between menu and footer": "<html><body>{menu}<div>{p}</div>{foot}</body></html>",
    "body between menu and footer": "<html><body>{menu}{p}{foot}</body></html>",
    "article": "<html><body>{menu}<article>{p}</article>{foot}</body></html>",
    "id only": '<html><body>{menu}<div id="x1">{p}</div>{foot}</body></html>',
    "no element": "{t}",
    "line breaks": "{br}",
    "one cell": "<table><tr><td>{p}</td></tr></table>",
    "old school": "<body bgcolor=white><center><font size=2>{p}</font></center></body>",
    "meaningless classes": '<body><div class="wrap"><div class="zz9">{p}</div></div>{foot}</body>',
    "preformatted": "<pre>{t}</pre>",
    "quote": "<body><blockquote>{t}</blockquote></body>",
    "list": "<body><ul>{li}</ul></body>",
    "short others": "<body><nav>x</nav>{p}<footer>c</footer></body>",
    "beside a sidebar": '<body>{menu}<div>{p}</div><aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">One</a></li></ul></aside></body>',
    "under an advert": '<body><div class="ad">Buy now. Cheap.</div><div>{p}</div></body>',
    "a div each": "<body>{div}</body>",
}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("name", LAYOUTS)
def test_plain_pages(name, n):
    texts = SENTENCES[:n]
    each = lambda tag: "".join(f"<{tag}>{x}</{tag}>" for x in texts)
    page = LAYOUTS[name].format(p=each("p"), t=" ".join(texts), br="<br><br>".join(texts), li=each("li"), div=each("div"), menu=MENU, foot=FOOT)
    assert main_text.trained().text(page) == " ".join(texts)


def test_malformed_and_long():
    model = main_text.trained()
    long = " ".join(f"Sentence number {i} stands here." for i in range(40_000))
    assert model.text(f"<article><p>{long}</p></article>") == long
    for page in ("<" * 1000, "<p" * 1000, "<div>" * 5000 + "x", "</p>" * 100, "<!-- open", "<a href='", "&#xffffffff; &bogus; &#0;", "<p>" + "<b>" * 3000):
        assert isinstance(model.text(page), str)


def test_pages_table(spark):
    """Every page of the table has a text made of pieces of its own html, and its menu and scripts aren't part of it."""
    import html
    import re

    pages = tables.read(spark, "/root/testdata/sf0.01", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    got = main_text.extract(pages, main_text.trained()).collect()
    assert len(got) == len(source) and all(r.n_chars == len(r.text) for r in got)
    plain = {k: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", v or ""))).split()) for k, v in source.items()}
    squeeze = lambda x: re.sub(r"\s+", "", x)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id] or "")
        assert len(r.text) <= len(plain[r.page_id])
        if article and "<div" not in article[1] and "<aside" not in article[1] and "<nav" not in article[1]:
            assert squeeze(r.text) == squeeze(html.unescape(re.sub(r"<[^>]*>|<!--.*?-->", " ", article[1])))
