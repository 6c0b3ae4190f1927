"""Main text of web pages from a tree-structured graphical model.

A page becomes a tree of its block elements with its text blocks as leaves; inline elements only mark text as link or not. Every node
carries a hidden state, content or not. Its potential is a sum of weights of its features (tag, key words of class, id and role, size,
link share, punctuation); every edge has a 2 x 2 potential by the child's kind. Sum-product messages, once from the leaves to the root and once
back, give the exact marginal of every node; the text blocks whose marginal favours content are the result, in page order.

Weights are the maximum-likelihood estimate on labelled pages: the gradient is what the labels show less what the marginals expect.
The labelled pages are drawn from ``labelled_pages``, a generator of page layouts (semantic, plain and unnamed containers, text straight in the
body or without any element, from one paragraph on; menus, headers, sidebars, notices, adverts, forms, related links, comments, footers), since
no table of labelled pages exists; their number is a parameter.

Text that is never shown (script, style, head, template and the like) is left out by the parser. Character references are decoded; white
space inside a block becomes one space; a line break element is white space; blocks are joined by one space.

Defined results: null, empty or textless html gives the empty text; unclosed and stray tags are repaired as browsers do for paragraphs, list
items, cells and options; repeated rows stay separate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektor.llm import tables

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+)|(<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-y|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIP = {"head", "svg", "math", "select", "button", "canvas", "object", "audio", "video", "map", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "meter", "nobr", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote"}
KEYS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead topbar logo branding sitehead",
    "foot": "footer foot copyright contentinfo colophon bottom",
    "side": "sidebar side aside rail widget widgets complementary",
    "comment": "comment comments disqus reply replies discussion respond",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert banner dialog paywall",
    "form": "form search login signup subscribe newsletter signin register",
    "share": "share sharing social follow",
    "related": "related recommended more trending popular recirc links tags",
    "main": "content article post main entry story body text prose page",
    "hidden": "hidden none",
}
KEYWORDS: dict[str, list[str]] = {}
for _key, _words in KEYS.items():
    for _word in _words.split():
        KEYWORDS.setdefault(_word, []).append("k:" + _key)
_split = re.compile(r"[a-z]+")
_stop = re.compile(r"[.!?。！？](?=\s|$|[\"'”»)])")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Nodes in document order, parents before children: parent, features, label or None, and text of the leaves."""

    __slots__ = ("parent", "features", "label", "text", "links")

    def __init__(self) -> None:
        self.parent, self.features, self.label, self.text, self.links = [-1], [["tag:root"]], [None], [None], [0]

    def add(self, parent: int, features: list[str], label, text=None, links: int = 0) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.label.append(label)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def _attributes(raw: str) -> tuple[list[str], int | None]:
    found, label = [], None
    if raw and not raw.isspace():
        for m in ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name == "data-y":
                label = int(value == "1")
            elif name == "style":
                if _hidden.search(value):
                    found.append("k:hidden")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                found.append("k:hidden")
            else:
                found += [k for w in set(_split.findall(value.lower())) for k in KEYWORDS.get(w, ())]
    return found, label


def parse(source: str, label: int | None = None) -> Page:
    """The tree of a page; ``label`` is the root's."""
    page = Page()
    page.label[0] = label
    stack: list[tuple[str, int]] = [("", 0)]  # open block elements
    parts: list[str] = []
    links, in_link, skipping, at, n = 0, 0, 0, 0, len(source)
    skip_tag = ""

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = stack[-1][1]
                size = len(text)
                share = min(1.0, links / size)
                linked = "none" if share == 0 else "some" if share < 0.4 else "most"
                stops = min(3, len(_stop.findall(text)))
                f = [f"len:{min(9, size.bit_length())}", "link:" + linked, "end:" + ("stop" if text[-1] in ".!?:;\"'”»)" else "open"), f"words:{min(5, (text.count(' ') + 1).bit_length())}", f"stops:{stops}/{linked}"]
                if "©" in text:
                    f.append("mark:copy")
                page.add(node, f, page.label[node], text, links)
            parts.clear()
        links = 0

    while at < n:
        m = TOKEN.match(source, at)
        at = m.end()
        text = m[7] or m[8]
        if text is not None:
            if not skipping:
                parts.append(html.unescape(text) if "&" in text else text)
                if in_link:
                    links += len(text)
            continue
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if skipping:
            if name == skip_tag and not raw.endswith("/"):
                skipping += -1 if closing else 1
            elif skip_tag == "head" and name == "body" and not closing:
                skipping = 0
            if skipping or name != "body":
                if not closing and name in RAW:
                    at = _raw_end(source, at, name)
                continue
        if name in RAW:
            if not closing:
                at = _raw_end(source, at, name)
            continue
        if name in SKIP:
            if not closing and not raw.endswith("/"):
                skip_tag, skipping = name, 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append("")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = 0
            continue
        shut = CLOSES.get(name)
        if stack[-1][0] == "p" or shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or shut and stack[k][0] in shut:
                    del stack[k:]
                    if not shut:
                        break
                elif stack[k][0] in SCOPE:
                    break
        found, label = _attributes(raw)
        node = stack[-1][1]
        index = page.add(node, ["tag:" + name, "in:" + name + "<" + (stack[-1][0] or "root"), *(found or ["plain:" + name])], label if label is not None else page.label[node])
        if not raw.endswith("/"):
            stack.append((name, index))
    flush()
    return page


_ends = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _raw_end(source: str, at: int, name: str) -> int:
    m = _ends[name].search(source, at)
    return m.end() if m else len(source)


class Model:
    """Weights of features, and two edge tables (block elements, text leaves) of the four pairs of states."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.edge = [[0.0] * 4, [0.0] * 4]  # [kind][2 * parent state + child state]

    def marginals(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """(log-odds of content, messages upward, log-odds without the own message) of each node."""
        parent, n, get = page.parent, len(page.parent), self.weight.get
        own = [sum([get(f, 0.0) for f in fs]) for fs in page.features]
        up = [0.0] * n
        exp, log = math.exp, math.log
        tables_ = [[exp(min(30, e)) for e in t] for t in self.edge]
        for v in range(n - 1, 0, -1):
            x = exp(max(-30.0, min(30.0, own[v])))
            e = tables_[page.text[v] is not None]
            up[v] = log((e[3] * x + e[2]) / (e[1] * x + e[0]))
            own[parent[v]] += up[v]
        rest = [0.0] * n
        for v in range(1, n):
            rest[v] = max(-30.0, min(30.0, own[parent[v]] - up[v]))
            x = exp(rest[v])
            e = tables_[page.text[v] is not None]
            own[v] += log((e[3] * x + e[1]) / (e[2] * x + e[0]))
        return own, up, rest

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        odds = self.marginals(page)[0]
        return " ".join(t for t, o in zip(page.text, odds) if t is not None and o > 0)


def fit(sources: list[tuple[str, int]], epochs: int = 20, rate: float = 0.35, decay: float = 1e-3, seed: int = 3) -> Model:
    """Maximum likelihood by Adagrad; each page is one step."""
    model, rng = Model(), random.Random(seed)
    pages = [parse(s, root) for s, root in sources]
    squares: dict[object, float] = {}

    def move(key, gradient: float, now: float) -> float:
        gradient -= decay * now
        squares[key] = squares.get(key, 1e-2) + gradient * gradient
        return now + rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        rng.shuffle(pages)
        for page in pages:
            odds, up, rest = model.marginals(page)
            scale = 1 / math.sqrt(len(odds))
            sums: dict[str, float] = {}
            edges = [[0.0] * 4, [0.0] * 4]
            label = [x or 0 for x in page.label]
            for v, o in enumerate(odds):
                d = label[v] - 1 / (1 + math.exp(-max(-30.0, min(30.0, o))))
                for f in page.features[v]:
                    sums[f] = sums.get(f, 0.0) + d
                if v:
                    kind = page.text[v] is not None
                    down = [math.exp(e) for e in model.edge[kind]]
                    x = math.exp(rest[v])
                    below = o - math.log((down[3] * x + down[1]) / (down[2] * x + down[0]))  # without the parent's message
                    y = math.exp(max(-30.0, min(30.0, below)))
                    joint = [down[0], down[1] * y, down[2] * x, down[3] * x * y]
                    total = sum(joint)
                    for k in range(4):
                        edges[kind][k] -= joint[k] / total
                    edges[kind][2 * label[page.parent[v]] + label[v]] += 1
            for f, g in sums.items():
                model.weight[f] = move(f, g * scale, model.weight.get(f, 0.0))
            for kind in range(2):
                for k in range(4):
                    model.edge[kind][k] = max(-6.0, min(6.0, move((kind, k), edges[kind][k] * scale, model.edge[kind][k])))
    return model


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, int]]:
    """Pages of many layouts and the label of their root; ``data-y`` marks what is content (1) and what isn't (0)."""
    r = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u en or al".split()]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(2, 18).capitalize() + r.choice(". . . . ! ?".split())
    some = lambda f, a, b: "".join(f() for _ in range(r.randint(a, b)))

    def inline(text: str) -> str:
        parts = text.split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(parts))
            parts[k] = r.choice(["<b>%s</b>", "<em>%s</em>", '<a href="#">%s</a>', "<span>%s</span>", "%s<br>", "&quot;%s&quot;", "%s &amp;"]) % parts[k]
        return " ".join(parts)

    paragraph = lambda: inline(" ".join(sentence() for _ in range(r.randint(1, 9))))
    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'
    listing = lambda tag="ul": f"<{tag}>" + some(lambda: f"<li>{link()}</li>", 3, 9) + f"</{tag}>"

    def block() -> str:
        close = r.choice(["</p>", "</p>", "</p>", ""])
        return r.choices([
            lambda: f"<p>{paragraph()}{close}", lambda: f"<h{r.randint(2, 4)}>{words(1, 8)}</h{r.randint(2, 4)}>" if r.random() < 0.1 else f"<h2>{words(1, 8)}</h2>",
            lambda: f"<ul>{some(lambda: f'<li>{inline(words(1, 20))}</li>', 2, 6)}</ul>", lambda: f"<ol>{some(lambda: f'<li>{sentence()}</li>', 2, 6)}</ol>",
            lambda: f"<blockquote><p>{paragraph()}</p></blockquote>", lambda: f"<pre>{words(2, 20)}</pre>", lambda: f"<table>{some(lambda: f'<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>', 2, 5)}</table>",
            lambda: f"<figure><img src=x><figcaption>{words(2, 12)}</figcaption></figure>", lambda: f"<div>{paragraph()}</div>", lambda: f"<p>{words(1, 3)}{close}", lambda: f"<p><b>{paragraph()}<br>", lambda: f"<section><h3>{words(1, 5)}</h3><p>{paragraph()}</p></section>", lambda: paragraph() + "<br>",
        ], [30, 6, 3, 2, 3, 1, 2, 1, 5, 4, 3, 2, 1])[0]()

    def off(tag: str, names: str, body: str) -> str:
        how = r.choice(['class="%s"', 'id="%s"', 'class="%s box"']) % r.choice(names.split()) if names else ""
        return f'<{tag} {how} data-y="0">{body}</{tag}>'

    def comments() -> str:
        return off(r.choice(["div", "section", "ul"]), "comments comment-list user-comments replies discussion", f"<h3>{words(1, 3)}</h3>" + some(lambda: f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><b>{word()}</b><p>{paragraph()}</p></div>', 1, 6))

    def loose() -> str:
        """What isn't content, without a name: a menu, a copyright line, a lone link."""
        return r.choice([lambda: f'<ul data-y="0">{some(lambda: f"<li>{link(1, 2)}</li>", 2, 8)}</ul>', lambda: f'<div data-y="0">{some(lambda: link(1, 2) + r.choice([" ", " | "]), 2, 8)}</div>', lambda: f'<p data-y="0">&copy; {words(1, 6)}</p>', lambda: f'<div data-y="0">{link(1, 3)}</div>', lambda: f'<nav data-y="0">{r.choice("abcxyz")}</nav>', lambda: f'<footer data-y="0">{r.choice(["c", "&copy;", word(), sentence()])}</footer>'])()

    def plain_page() -> tuple[str, int]:
        """Content that no container announces, often short, alone or between other things."""
        body = [f"<h{k}>{words(1, 8)}</h{k}>" for k in (r.randint(1, 3),) if r.random() < 0.4]
        body += [f"<p>{inline(' '.join(sentence() for _ in range(r.randint(1, 5))))}</p>" if r.random() < 0.75 else block() for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4, 6]))]
        held = lambda tag, how="": f'<{tag} {how} data-y="1">{"".join(body)}</{tag}>'
        kind = r.choice([0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8])
        if kind == 0:
            return " ".join(sentence() for _ in range(r.randint(1, 9))), 1
        if kind == 1:
            return "<br>".join(inline(" ".join(sentence() for _ in range(r.randint(1, 4)))) for _ in range(r.randint(1, 5))), 1
        if kind == 2:
            return "".join(body), 1
        around = lambda: "".join(r.choice([loose, loose, lambda: off("nav", "", listing()), lambda: off("footer", "", sentence()), lambda: off(r.choice(["header", "div"]), "header masthead", f"<p>{words(1, 5)}</p>"), lambda: off("div", "ad advert promo", sentence())])() for _ in range(r.choice([0, 0, 1, 1, 2])))
        first, last = around(), around()
        if kind in (3, 4):
            return f'<html data-y="1"><head><title>{words(1, 4)}</title></head><body data-y="1">{first}{"".join(body)}{last}</body></html>', 1
        core = {5: lambda: held("div"), 6: lambda: held("div", f'id="{word()}"'), 7: lambda: f'<div data-y="1">{held("div", r.choice(["", f"""class="{word()}" """]))}</div>', 8: lambda: r.choice([f'<table data-y="1"><tr><td>{"".join(body)}</td></tr></table>', held("center"), held("section"), "".join(f'<div data-y="1">{b}</div>' for b in body)])}[kind]()
        return f"<html><body>{first}{core}{last}</body></html>", 0

    pages = []
    for _ in range(n):
        if r.random() < 0.45:
            pages.append(plain_page())
            continue
        before, after, inside = [], [], []
        put = lambda p, where, f: where.append(f()) if r.random() < p else None
        put(0.25, before, lambda: off("div", "cookie-notice consent gdpr notice alert", r.choice([f"<p>{sentence()} {link()}</p>", sentence()])))
        put(0.5, before, lambda: off(r.choice(["header", "div"]), "header masthead site-header topbar", r.choice([f"<h1>{words(1, 3)}</h1>", f"<div class=logo>{words(1, 3)}</div>", f"<p>{words(2, 8)}</p>"]) + r.choice(["", listing()])))
        put(0.8, before, lambda: off("nav", r.choice(["", "nav menu main-nav"]), listing()) if r.random() < 0.7 else off(r.choice(["div", "ul"]), "nav menu navbar navigation breadcrumbs", some(lambda: f"<li>{link()}</li>", 3, 8)))
        put(0.6, before, lambda: off(r.choice(["div", "div", "aside", "section"]), "ad ads advert sponsored promo", r.choice([sentence(), f"<p>{sentence()}</p>", link(2, 8), " ".join(sentence() for _ in range(r.randint(1, 4)))])))
        put(0.2, before, lambda: off("form", r.choice(["", "search login"]), f"<label>{words(1, 3)}</label><input><button>{word()}</button><p>{words(2, 6)}</p>"))
        put(0.4, after, lambda: off(r.choice(["aside", "aside", "div"]), "sidebar widget side rail", f"<h3>{words(1, 4)}</h3>" + r.choice([listing(), f"<p>{paragraph()}</p>"])))
        put(0.3, after, comments)
        put(0.3, after, lambda: off(r.choice(["div", "section"]), "related recommended more-links trending", f"<h4>{words(1, 3)}</h4>" + listing()))
        put(0.2, after, lambda: off("form", r.choice(["", "newsletter subscribe"]), f"<p>{sentence()}</p><input><button>{word()}</button>"))
        put(0.8, after, lambda: off("footer", "", r.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; {words(2, 8)}</p>" + listing(), sentence()])) if r.random() < 0.7 else off("div", "footer foot copyright", f"<p>&copy; {words(2, 8)}</p>"))
        put(0.15, inside, lambda: off(r.choice(["div", "aside"]), "ad promo sponsored", r.choice([sentence(), f"<p>{sentence()}</p>"])))
        put(0.1, inside, lambda: off("div", "share social", some(lambda: link(1, 2) + " ", 2, 4)))
        put(0.1, inside, comments)
        body = [f"<h1>{words(1, 12)}</h1>"] if r.random() < 0.8 else []
        body += [block() for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
        for x in inside:
            body.insert(r.randint(1, len(body)), x)
        tag, names = r.choice([("article", ""), ("article", ""), ("article", "post story"), ("main", ""), ("main", "content"), ("div", "content main-content article-body post entry-content story"), ("section", "content article"), ("div", "")])
        how = f'class="{r.choice(names.split())}"' if names else ""
        core = f'<{tag} {how} data-y="1">{"".join(body)}</{tag}>'
        if r.random() < 0.3:
            core = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}" data-y="1">{core}{"".join(after[:1])}</div>'
            after = after[1:]
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{core}{''.join(after)}" + r.choice(["</body></html>", ""]), 0))
    return pages


PAGES = 1000
_trained: dict[int, Model] = {}


def trained(pages: int = PAGES) -> Model:
    if pages not in _trained:
        _trained[pages] = fit(labelled_pages(pages))
    return _trained[pages]


def extract(pages: DataFrame, model: Model, column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one pass over the pages, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast((model.weight, model.edge))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model()
        own.weight, own.edge = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [own.text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).cast("string").alias("html")).mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tables.read(spark, sf_dir, "pages").select("page_id", "url", "html"), trained())
