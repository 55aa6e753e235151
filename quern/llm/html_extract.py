"""Main text of web pages: boosted trees over DOM nodes, decoded hierarchically.

A page becomes a tree of elements and text nodes.  Each node gets features of its
subtree (text, link density, tags), its attributes' tokens, its depth, its siblings
and its ancestors.  Boosted trees, trained in numpy on generated pages of many
layouts, give each node the probability that it belongs to the article or holds
it.  Decoding maximises the total likelihood under the constraint that whatever
lies under a dropped node is dropped, so no ancestor and descendant contradict
each other.

Blocks are the text runs between block elements, of kept nodes, with references
decoded and white space folded.  Defined results: null or empty html gives an
empty text; scripts, styles, templates and comments never give text; a page in
which nothing is kept is empty; repeated rows are extracted each; an empty table
gives an empty result.  Nothing is cut off.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_batches
from quern.llm.trees import Boosted, boost

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b(?P<rattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:class|id|role|aria-label|name|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul caption button".split()
)
_CLOSES = {  # an opening tag ends these open elements, up to the given boundary
    **dict.fromkeys(BLOCK - {"option", "button", "title", "legend", "summary", "caption"}, (("p",), ("body", "html", "table", "td", "th", "button", "object"))),
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)), "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head", "p"), ("html",)),
}
_NEVER = frozenset("script style template noscript iframe svg textarea".split())
_BAD = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright sidebar side aside widget rail "
    "comment comments reply replies discussion disqus respond cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login form search share social related "
    "recommended toolbar tags pagination pager legal disclaimer complementary contentinfo".split()
)
_GOOD = frozenset("article main content post entry story text articlebody prose body".split())
_GROUPS = (
    ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "input", "select", "button", "label", "fieldset"), ("article",), ("main",), ("section",), ("div",), ("p", "pre", "blockquote"),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li",), ("ul", "ol", "dl"), ("a",), ("body", "html"), ("head", "title"), ("table", "tr", "td", "th", "tbody"), ("figure", "img", "figcaption"), ("#text",),
)
_GROUP = {t: i for i, g in enumerate(_GROUPS) for t in g}


class Node:
    __slots__ = ("tag", "up", "kids", "text", "attrs", "chars", "link", "size", "depth", "bad", "good", "ps", "punct")

    def __init__(self, tag: str, up: Node | None, attrs: str = "") -> None:
        self.tag, self.up, self.kids, self.text = tag, up, [], ""
        tokens = re.findall(r"[a-z]+", " ".join(_ATTR.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs))).lower()) if attrs else ()
        self.bad, self.good = sum(t in _BAD for t in tokens), sum(t in _GOOD for t in tokens)
        self.depth = up.depth + 1 if up else 0
        if up is not None:
            up.kids.append(self)


def parse(page: str) -> list[Node]:
    """All nodes in page order; the first is a root that holds the rest."""
    root = Node("#root", None)
    nodes, at = [root], root
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if at.kids and at.kids[-1].tag == "#text":
                at.kids[-1].text += text
            else:
                t = Node("#text", at)
                t.text = text
                nodes.append(t)
            continue
        raw = m["raw"]
        if raw is not None:
            raw = raw.lower()
            if raw == "title":
                t = Node("title", at, m["rattr"])
                c = Node("#text", t)
                c.text = m["body"]
                nodes += [t, c]
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in _NEVER:
                continue
            x = at
            while x is not root and x.tag != tag:
                x = x.up
            if x is not root:
                at = x.up
            continue
        closes = _CLOSES.get(tag)
        if closes:
            x, last = at, None
            while x is not root and x.tag not in closes[1]:
                if x.tag in closes[0]:
                    last = x
                x = x.up
            if last is not None:
                at = last.up
        n = Node(tag, at, m["attr"])
        nodes.append(n)
        if tag not in VOID and not m["attr"].rstrip().endswith("/"):
            at = n
    return nodes


N_FEATURES = len(_GROUPS) + 24


def features(nodes: list[Node]) -> np.ndarray:
    for n in reversed(nodes):
        if n.tag == "#text":
            s = n.text
            n.chars, n.link, n.size, n.ps, n.punct = len(s.strip()), 0, 1, 0, s.count(".") + s.count(",")
            continue
        chars = link = ps = punct = 0
        size = 1
        for k in n.kids:
            chars += k.chars
            link += k.link
            size += k.size
            punct += k.punct
            # Low bits: paragraphs in the subtree; from bit 20 on: articles among the children.
            ps += (k.ps & 0xFFFFF) + ((k.tag in _MAIN) << 20)
        n.chars, n.size, n.punct, n.ps = chars, size, punct, ps + (n.tag in _PARA)
        n.link = chars if n.tag == "a" else link
    none = (0,) * 8
    nears: dict[tuple, int] = {none: 0}
    flags: dict[int, tuple] = {}
    rows, groups, near_ids = [], [], []
    for n in nodes:
        up = n.up
        if up is None:
            near = none
            rows.append((n.depth, n.chars, n.link, n.size, n.ps, n.punct, n.bad, n.good, 1, n.chars, 0, 1, 0))
        else:
            near = flags[id(up)]
            rows.append((n.depth, n.chars, n.link, n.size, n.ps, n.punct, n.bad, n.good, len(up.kids), up.chars, up.link, up.chars, (up.ps >> 20) > (n.tag in _MAIN)))
        groups.append(_GROUP.get(n.tag, len(_GROUPS)))
        near_ids.append(nears[near])
        if n.kids:
            k = _FLAG.get(n.tag)
            if k is not None or n.bad or n.good:
                more = list(near)
                if k is not None:
                    more[k] = 1
                more[6] += n.bad > 0
                more[7] += n.good > 0
                near = tuple(more)
                nears.setdefault(near, len(nears))
            flags[id(n)] = near
    r = np.array(rows, dtype=np.float64)
    g = len(_GROUPS)
    x = np.zeros((len(nodes), N_FEATURES))
    x[np.arange(len(nodes)), groups] = 1
    depth, chars, link, size, ps, punct, bad, good, siblings, around, up_link, up_chars, beside = r.T
    own = np.maximum(chars, 1)
    packed = ps.astype(np.int64)
    x[:, g] = depth
    x[:, g + 1] = np.log1p(chars)
    x[:, g + 2] = chars / max(1, nodes[0].chars)
    x[:, g + 3] = link / own
    x[:, g + 4] = np.log1p(size)
    x[:, g + 5] = chars / size
    x[:, g + 6] = packed & 0xFFFFF
    x[:, g + 7] = punct / own
    x[:, g + 8] = bad > 0
    x[:, g + 9] = good > 0
    x[:, g + 10] = siblings
    x[:, g + 11] = np.log1p(around)
    x[:, g + 12 : g + 20] = np.array(list(nears), dtype=np.float64)[near_ids]
    x[:, g + 20] = up_link / np.maximum(up_chars, 1)
    x[:, g + 21] = chars / np.maximum(up_chars, 1)
    x[:, g + 22] = beside
    x[:, g + 23] = packed >> 20
    return x


_PARA = frozenset(("p", "h1", "article"))
_MAIN = frozenset(("article", "main"))
_FLAG = {"nav": 0, "menu": 0, "footer": 1, "header": 1, "aside": 2, "form": 3, "button": 3, "select": 3, "article": 4, "main": 4, "head": 5, "title": 5}


def _page(rng: random.Random) -> str:
    """A generated page; parts that aren't the article stand between the marks \\x01 and \\x02."""
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        s = words(2, 14).capitalize()
        return s + rng.choice([".", ".", ".", "?", "", ","])

    def para() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6, 12])))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def junk(kind: str) -> str:
        body = {
            "nav": lambda: f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>",
            "menu": lambda: f'<div class="{rng.choice(["menu", "navbar", "nav-main", "breadcrumbs"])}"><ul>{links(rng.randint(2, 9))}</ul></div>',
            "header": lambda: f"<header>{rng.choice(['<a href=/>' + words(1, 3) + '</a>', '<h2>' + words(1, 4) + '</h2>', words(1, 5)])}</header>",
            "footer": lambda: f"<footer>{rng.choice(['', '<p>'])}&copy; {words(1, 3)} &middot; {para()}</footer>",
            "footdiv": lambda: f'<div id="footer"><p>{para()}</p></div>',
            "ad": lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "banner"])}">{rng.choice(["", "<p>"])}{para()}</div>',
            "aside": lambda: f"<aside><h3>{words(1, 4)}</h3><p>{para()}</p></aside>",
            "side": lambda: f'<div class="sidebar">{rng.choice(["<ul>" + links(4) + "</ul>", "<p>" + para() + "</p>"])}</div>',
            "notice": lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent popup"])}">{para()}</div>',
            "form": lambda: f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><button>{words(1, 2)}</button></form>',
            "comments": lambda: f'<{rng.choice(["div", "section"])} class="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{para()}</p></div>' for _ in range(rng.randint(1, 6))) + "</div>",
            "related": lambda: f'<div class="related"><ul>{links(5)}</ul></div>',
        }[kind]()
        return f"\x01{body}\x02"

    inner = [rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "{}"]).format(words(1, 12))]
    for _ in range(rng.choice([1, 2, 3, 6, 12, 30])):
        k = rng.random()
        if k < 0.6:
            inner.append(f"<p>{para()}{rng.choice(['</p>', '</p>', ''])}")
        elif k < 0.7:
            inner.append(f"<p><b>{para()}<br>" if rng.random() < 0.5 else f"<p><b>{sentence()}</b> {para()}</p>")
        elif k < 0.76:
            inner.append(f"<h2>{words(1, 6)}</h2>")
        elif k < 0.83:
            inner.append("<ul>" + "".join(f"<li>{para()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif k < 0.88:
            inner.append(f"<blockquote>{para()}</blockquote>")
        elif k < 0.92:
            inner.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        elif k < 0.96:
            inner.append(f'<p>{para()} <a href="/x">{words(1, 3)}</a> {sentence()}</p>')
        else:
            inner.append(junk(rng.choice(["ad", "aside", "related", "form", "notice"])))
    if rng.random() < 0.15:
        inner.append(junk("comments"))
    wrap = rng.choice(
        ["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content"><div class="post">{}</div></div>', "<section>{}</section>", "<div>{}</div>"]
    )
    before = [junk(k) for k in ("header", "nav", "menu", "notice", "ad", "form") if rng.random() < 0.45]
    after = [junk(k) for k in ("side", "aside", "comments", "related", "ad", "footer", "footdiv", "notice", "form") if rng.random() < 0.4]
    body = "".join(before) + wrap.format("".join(inner)) + "".join(after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["page", "wrapper", "container"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head>\x01<meta charset=utf-8><title>{words(1, 12)}</title>\x02</head><body>{body}</body></html>"


def _labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes in the article or around it; the marks tell, and are taken out of the texts."""
    y = np.zeros(len(nodes))
    place = {id(n): i for i, n in enumerate(nodes)}
    off = 0
    for n in nodes:
        if n.tag == "#text":
            kept = False
            for part in re.split("([\x01\x02])", n.text):
                if part == "\x01":
                    off += 1
                elif part == "\x02":
                    off -= 1
                elif part.strip() and not off:
                    kept = True
            n.text = n.text.replace("\x01", "").replace("\x02", "")
            if kept:
                x: Node | None = n
                while x is not None:
                    y[place[id(x)]] = 1
                    x = x.up
    return y


@lru_cache(maxsize=2)
def model(pages: int = 250, seed: int = 3) -> Boosted:
    """Trained once per process that asks; the same everywhere, as all is seeded."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(_page(rng))
        y = _labels(nodes)
        keep = [i for i, n in enumerate(nodes) if n.tag != "#text" or n.text.strip()]
        xs.append(features(nodes)[keep])
        ys.append(y[keep])
    return boost(np.concatenate(xs), np.concatenate(ys), trees=20, depth=5, rate=0.4, least=3)


def decode(nodes: list[Node], z: np.ndarray) -> list[bool]:
    """The likeliest keep/drop per node under: below a dropped node all is dropped."""
    keep_ll, drop_ll = (-np.logaddexp(0, -z)).tolist(), (-np.logaddexp(0, z)).tolist()
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [-1 if n.up is None else place[id(n.up)] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
        keep_ll[up[i]] += max(drop_ll[i], keep_ll[i])
        drop_ll[up[i]] += drop_ll[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[up[i]] and keep_ll[i] >= drop_ll[i]
    return out


def blocks(nodes: list[Node], kept: list[bool]) -> str:
    """Text of kept nodes, one line a block."""
    keep = {id(n) for n, k in zip(nodes, kept) if k}
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            lines.append(line)
        run.clear()

    todo: list[tuple[Node, bool]] = [(nodes[0], True)]
    while todo:
        n, opening = todo.pop()
        if id(n) not in keep or n.tag in BLOCK:
            flush()
        if not opening or id(n) not in keep:
            continue
        if n.tag == "#text":
            run.append(html.unescape(n.text))
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                todo.append((n, False))
            todo += [(k, True) for k in reversed(n.kids)]
    flush()
    return "\n".join(lines)


def extract(page: str, m: Boosted) -> str:
    if not page or page.isspace():
        return ""
    nodes = parse(page)
    return blocks(nodes, decode(nodes, m.raw(features(nodes))))


def extract_pages(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def make() -> Callable:
        m = shared.value

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            out: list[str] = []
            group: list[list[Node]] = []

            def flush() -> None:
                if not group:
                    return
                z = m.raw(np.concatenate([features(n) for n in group]))  # trees run over many pages at once
                at = 0
                for nodes in group:
                    out.append(blocks(nodes, decode(nodes, z[at : at + len(nodes)])))
                    at += len(nodes)
                group.clear()

            size = 0
            for page in batch.column(2).to_pylist():
                group.append(parse(page or ""))
                size += len(group[-1])
                if size > 20_000:
                    flush()
                    size = 0
            flush()
            return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

        return step

    return map_batches(narrow, make, "page_id long, url string, text string, n_chars long")
