"""Cleaning of html into text lines, and its outbound links, in one pass per page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Element:
    __slots__ = ("attrs", "kids", "name", "up")

    def __init__(self, name: str, attrs: dict[str, str], up: Element | None) -> None:
        self.name, self.attrs, self.up = name, attrs, up
        self.kids: list[Element | str] = []

    def strings(self) -> Iterator[str]:
        todo = self.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                yield k
            elif k.name not in SILENT:
                todo += k.kids[::-1]

    def walk(self) -> Iterator[Element]:
        todo = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while todo:
            k = todo.pop()
            yield k
            todo += [x for x in reversed(k.kids) if isinstance(x, Element)]

    def text(self, sep: str = "", strip: bool = False) -> str:
        parts = [s.strip() for s in self.strings()] if strip else list(self.strings())
        return sep.join(p for p in parts if p or not strip)

    def become(self, text: str) -> None:
        if self.up is not None and self in self.up.kids:
            self.up.kids[self.up.kids.index(self)] = text


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.made: list[Element] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(e)
        self.made.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.kids.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.name != tag:
            e = e.up
        if e is not None and e.up is not None:
            self.at = e.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


@contextmanager
def dom(page: str) -> Iterator[Element]:
    """The page's tree, which goes at the end: without the ways up, nothing has to wait for the collector of cycles."""
    b = _Builder()
    b.feed(page or "")
    b.close()
    try:
        yield b.root
    finally:
        for e in b.made:
            e.up = None


def clean(page: str, skip_tags: tuple[str, ...] = (), deduplicate: bool = False) -> str:
    with dom(page) as root:
        for e in [x for x in root.walk() if x.name in skip_tags]:
            if e.up is not None and e in e.up.kids:
                e.up.kids.remove(e)
        for e in [x for x in root.walk() if x.name == "a" and "href" in x.attrs]:
            href = e.attrs["href"].strip()
            if href and not href.startswith("#"):
                label = e.text(strip=True)
                e.become(f"{label} ({href})" if label else f"({href})")
        for e in [x for x in root.walk() if x.name == "li"]:
            e.become("- " + e.text())
        for level in range(1, 7):
            for e in [x for x in root.walk() if x.name == f"h{level}"]:
                e.become("#" * level + " " + e.text())
        for table in [x for x in root.walk() if x.name == "table"]:
            rows = [" | ".join(c.text(strip=True) for c in r.walk() if c.name in ("td", "th")) for r in table.walk() if r.name == "tr"]
            table.become("\n".join(rows))
        lines = [x.strip() for x in root.text("\n").splitlines()]
        lines = [x for x in lines if x]
        return "\n".join(dict.fromkeys(lines) if deduplicate else lines)


def links(page: str, base: str) -> list[str]:
    out = set()
    with dom(page) as root:
        for e in root.walk():
            href = e.attrs.get("href", "").strip() if e.name == "a" else ""
            if href and not href.startswith("#"):
                try:
                    url = urljoin(base, href)
                    if urlparse(url).scheme in ("http", "https"):
                        out.add(url)
                except ValueError:
                    continue
    return sorted(out)


#: Answers leave after so many pages, or so many characters of them.
MOST_PAGES, MOST_CHARS = 256, 1 << 21


def per_page(pages: DataFrame, keep: list[str], name: str, kind: str, of: Callable[[str, str], object]) -> DataFrame:
    """Columns ``keep``, and ``of`` (html, url) as column ``name`` of type ``kind``; null counts as empty.

    One page after the other is read from the Arrow batch, and answers leave in small batches, so a worker holds
    one batch of input and little else.
    """
    asked = pages.select("html", "url", *keep)
    schema = StructType([*asked.schema.fields[2:], StructField(name, DataType.fromDDL(kind))])
    arrow = to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[object] = []
            at = chars = 0
            for i, (page, url) in enumerate(zip(batch.column(0), batch.column(1))):
                text = page.as_py() or ""
                done.append(of(text, url.as_py() or ""))
                chars += len(text)
                if len(done) >= MOST_PAGES or chars >= MOST_CHARS or i + 1 == batch.num_rows:
                    some = batch.slice(at, len(done))
                    yield pa.RecordBatch.from_arrays([*some.columns[2:], pa.array(done, arrow)], names=schema.names)
                    done, at, chars = [], i + 1, 0

    return asked.mapInArrow(run, schema)


def page_links(pages: DataFrame, keep: list[str]) -> DataFrame:
    return per_page(pages, keep, "links", "array<string>", links)


def page_text(pages: DataFrame, keep: list[str], skip_tags: tuple[str, ...] = (), deduplicate: bool = False) -> DataFrame:
    return per_page(pages, keep, "text", "string", lambda page, _: clean(page, skip_tags, deduplicate))
