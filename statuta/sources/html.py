"""Captured HTML to titles, texts, links, list rows and table cells, by one pass of the standard parser.

The helper reads one page; Spark deals out the pages, and everything after is built-in.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

BLOCKS = frozenset("p div li ul ol tr td th table h1 h2 h3 h4 h5 h6 br section article header footer nav title".split())
_TEXT = T.StringType()
PAGE = T.StructType([T.StructField("title", _TEXT), T.StructField("text", _TEXT), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", _TEXT), T.StructField("text", _TEXT)]))), T.StructField("cells", T.ArrayType(T.ArrayType(_TEXT)))])
LEAST_BODY = 200


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.cells, self.hidden, self.in_title, self.anchor, self.cell = None, [], [], [], 0, False, None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "title":
            self.in_title, self.title = True, self.title or ""
        elif tag == "a":
            self.anchor = [dict(attrs).get("href") or "", ""]
        elif tag == "tr":
            self.cells.append([])
        elif tag in ("td", "th") and self.cells:
            self.cell = []
            self.cells[-1].append(self.cell)
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor:
            self.links.append(tuple(self.anchor))
            self.anchor = None
        elif tag in ("td", "th", "tr", "table"):
            self.cell = None
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
            if self.anchor:
                self.anchor[1] += data
            if self.cell is not None:
                self.cell.append(data)


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    rows = [[" ".join(" ".join(c).split()) for c in row] for row in page.cells]
    return {"title": None if page.title is None else " ".join(page.title.split()), "text": "".join(page.text), "links": [{"href": h, "text": " ".join(t.split())} for h, t in page.links], "cells": rows}


@F.pandas_udf(PAGE)
def parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "text", "links", "cells"])


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_joined(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([[urljoin(b or "", h or "") for h in hs] for b, hs in zip(base, hrefs, strict=True)], dtype=object)


def page_contents(pages: DataFrame) -> DataFrame:
    """pages (url, html, …) with title, body_text, usable, links and cells."""
    out = pages.withColumn("page", parsed("html"))
    body = S.normalize_text(F.col("page.text"))
    return out.withColumns({"page_title": F.col("page.title"), "body_text": body, "usable": F.length(body) >= LEAST_BODY, "links": F.col("page.links"), "cells": F.col("page.cells")}).drop("page")


def site_check(pages: DataFrame, name: str = "SiteName") -> DataFrame:
    """pages (html, expected) with site and status: failed where the page's meta tag of that name lacks the expected word."""
    tag = F.regexp_extract("html", rf"(?i)<meta\s[^>]*name\s*=\s*[\"']?{name}[\"']?[^>]*>", 0)
    site = F.regexp_extract(tag, r"(?i)content\s*=\s*[\"']([^\"']*)", 1)
    return pages.withColumns({"site": site, "status": F.when(F.contains(site, F.col("expected")), "ok").otherwise("failed")})


def linked(pages: DataFrame) -> DataFrame:
    """page_contents with links as (at, text, href) in page order, absolute; other schemes than http are left out."""
    out = page_contents(pages).withColumn("hrefs", all_joined("url", "links.href"))
    at_text = F.transform("links", lambda l, i: F.struct(i.alias("at"), l["text"].alias("text")))
    links = F.zip_with(at_text, "hrefs", lambda l, href: F.struct(l["at"].alias("at"), l["text"].alias("text"), href.alias("href")))
    return out.withColumn("links", F.filter(links, lambda l: l["href"].rlike("^https?://"))).drop("hrefs")


def page_links(pages: DataFrame) -> DataFrame:
    """A row per link in page order, absolute; other schemes than http are left out."""
    return linked(pages).select("url", F.inline("links"))


def attachment_links(pages: DataFrame) -> DataFrame:
    """Distinct links to pdf, docx and doc files, ranked in page order."""
    ext = F.lower(F.regexp_extract("href", r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    found = page_links(pages).withColumn("extension", ext).filter(F.col("extension").isin("pdf", "docx", "doc"))
    return found.groupBy("url", "href", "extension").agg(F.min("at").alias("at"))


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends, and those beyond which it ends none.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ROWS = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("title", "href", "date", "row")]))
_STEP = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+|:last-child)*)\Z")


class _Element:
    def __init__(self, tag: str, attrs: dict, up: _Element | None):
        self.tag, self.attrs, self.up, self.inside = tag, attrs, up, []
        self.classes = (attrs.get("class") or "").split()

    def elements(self):
        """Those below in page order."""
        left = [x for x in reversed(self.inside) if isinstance(x, _Element)]
        while left:
            x = left.pop()
            yield x
            left += [y for y in reversed(x.inside) if isinstance(y, _Element)]

    def text(self) -> str:
        out, left = [], list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.tag not in ("script", "style"):
                left += reversed(x.inside)
        return " ".join(filter(None, out))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def _close(self, tags: tuple, beyond: tuple = ()) -> None:
        x = self.at
        while x.up and x.tag not in tags and x.tag not in beyond:
            x = x.up
        if x.up and x.tag in tags:
            self.at = x.up

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCKS:
            self._close(("p",), ("td", "th", "li", "table", "div", "section", "article"))
        x = _Element(tag, dict(attrs), self.at)
        self.at.inside.append(x)
        if tag not in VOID:
            self.at = x

    def handle_endtag(self, tag):
        self._close((tag,), () if tag == "table" else ("table",))

    def handle_data(self, data):
        self.at.inside.append(data)


def selector(text: str) -> list[tuple[str, list[str]]]:
    """Steps (tag or "", conditions) of a selector of tags, .class, #id, :last-child and descendants; others raise ValueError."""
    out = []
    for step in text.split():
        if not (m := _STEP.match(step)):
            raise ValueError(f"selector {text!r} is not understood")
        out.append(((m["tag"] or "").lower().replace("*", ""), re.findall(r"[.#][\w-]+|:last-child", m["rest"])))
    return out


def _fits(x: _Element, step: tuple[str, list[str]]) -> bool:
    def holds(c: str) -> bool:
        if c == ":last-child":
            return next(y for y in reversed(x.up.inside) if isinstance(y, _Element)) is x
        return c[1:] in x.classes if c[0] == "." else x.attrs.get("id") == c[1:]

    return step[0] in ("", x.tag) and all(map(holds, step[1]))


def _selected(root: _Element, steps: list):
    for x in root.elements():
        if _fits(x, steps[-1]):
            up, left = x.up, len(steps) - 1
            while left and up.up:
                left -= _fits(up, steps[left - 1])
                up = up.up
            if not left:
                yield x


def read_rows(html: str | None, item: str | None, title: str | None, link: str | None, date: str | None) -> list[dict]:
    """A row per item that has a title and a link; none without an item selector."""
    if not (item or "").strip():
        return []
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    of = {k: selector(v if (v or "").strip() else "a") for k, v in (("title", title), ("link", link))}
    dated, out = selector(date or ""), []
    for x in _selected(tree.root, selector(item)):
        head, anchor = (next(_selected(x, of[k]), None) for k in ("title", "link"))
        if head and anchor:
            day = next(_selected(x, dated), None) if dated else None
            out.append({"title": head.text(), "href": anchor.attrs.get("href"), "date": day.text() if day else None, "row": x.text()})
    return out


@F.pandas_udf(ROWS)
def listed(html: pd.Series, item: pd.Series, title: pd.Series, link: pd.Series, date: pd.Series) -> pd.Series:
    return pd.Series([read_rows(*x) for x in zip(html, item, title, link, date, strict=True)], dtype=object)


def list_docs(pages: DataFrame) -> DataFrame:
    """Documents of list pages (source_id, url, html, selectors), one per item with a title of four characters and more.

    selectors: map of item, title, link and date; title and link are "a" by default, pages without
    an item selector give nothing. published_on is the date node's, or else the whole row's.
    """
    of = [F.try_element_at("selectors", F.lit(k)) for k in ("item", "title", "link", "date")]
    rows = pages.select("source_id", F.col("url").alias("list_url"), F.posexplode(listed("html", *of)).alias("at", "r"))
    date = F.coalesce(S.parse_date(F.col("r.date")), S.parse_date(F.col("r.row")))
    out = rows.filter(F.length("r.href") > 0).select("source_id", "list_url", "at", S.clean_title(F.col("r.title")).alias("title"), joined("list_url", "r.href").alias("url"), date.alias("published_on"))
    return out.filter((F.length("title") >= 4) & F.col("url").rlike("^https?://"))


def meta(html, name: str):
    """The content of a meta element, names without regard to case; "" if there is none."""
    return F.regexp_extract(html, f"(?is)<meta[^>]*name\\s*=\\s*[\"']{re.escape(name)}[\"'][^>]*content\\s*=\\s*[\"']([^\"']*)", 1)


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Text of DOCX files, a paragraph a line; null where the file can't be read."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(raw):
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    return content.map(one)
