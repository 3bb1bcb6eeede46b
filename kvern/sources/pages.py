"""HTML pages, feeds, sitemaps and post lists to rows."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_MANY = T.ArrayType(T.StringType())
PAGE = _strings("title", "description", "h1", "lang", "canonical").add("lines", _MANY).add("links", T.ArrayType(_strings("url", "text")))
PAGE = PAGE.add("feeds", _MANY).add("jsonld", _MANY).add("contacts", _MANY)
_BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br tr td th table section article header footer nav main aside title".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))
FEED_ITEMS = 20
POSTS = 10


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.out = {k: None for k in ("title", "description", "h1", "lang", "canonical")} | {k: [] for k in ("links", "feeds", "jsonld", "contacts")}
        self.lines, self.line = [], []
        self.inside: list[str] = []
        self.link: dict | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.lines.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _BLOCKS:
            self._flush()
        if tag not in ("br", "meta", "link", "img", "input", "hr"):
            self.inside.append(tag)
        if tag == "html":
            self.out["lang"] = a.get("lang")
        elif tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description"):
            self.out["description"] = self.out["description"] or a.get("content")
        elif tag == "link":
            rel = (a.get("rel") or "").lower()
            if "canonical" in rel and a.get("href"):
                self.out["canonical"] = urljoin(self.url, a["href"])
            if "alternate" in rel and re.search("rss|atom", a.get("type") or "") and a.get("href"):
                self.out["feeds"].append(urljoin(self.url, a["href"]))
        elif tag == "a" and a.get("href"):
            href = a["href"].strip()
            if re.match(r"(?i)(mailto|tel):", href):
                self.out["contacts"].append(href)
            else:
                self.link = {"url": urljoin(self.url, href), "text": ""}
        elif tag == "script" and "ld+json" in (a.get("type") or ""):
            self.inside[-1] = "ld+json"

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._flush()
        if tag == "a" and self.link:
            self.link["text"] = " ".join(self.link["text"].split())
            self.out["links"].append(self.link)
            self.link = None
        names = (tag, "ld+json") if tag == "script" else (tag,)
        for k in range(len(self.inside) - 1, -1, -1):
            if self.inside[k] in names:
                del self.inside[k:]
                break

    def handle_data(self, data):
        if "ld+json" in self.inside:
            self.out["jsonld"].append(data)
        elif not _SILENT & set(self.inside):
            for tag, name in (("title", "title"), ("h1", "h1")):
                if tag in self.inside:
                    self.out[name] = (self.out[name] or "") + data
            if "title" not in self.inside:
                self.line.append(data)
            if self.link:
                self.link["text"] += data


def parse_page(body: str | None, url: str | None) -> dict | None:
    """A page's parts; ``None`` for no body.  Of links to one URL the first with a text stays."""
    if body is None:
        return None
    page = _Page(url or "")
    page.feed(body)
    page.close()
    page._flush()
    links: dict[str, str] = {}
    for x in page.out["links"]:
        links[x["url"]] = links.get(x["url"]) or x["text"]
    lists = {k: list(dict.fromkeys(page.out[k])) for k in ("feeds", "contacts")}
    names = {k: None if page.out[k] is None else " ".join(page.out[k].split()) for k in ("title", "h1")}
    return page.out | lists | names | {"lines": page.lines, "links": [{"url": u, "text": t} for u, t in links.items()]}


@pandas_udf(PAGE)
def pages_of(bodies: pd.Series, urls: pd.Series) -> pd.DataFrame:
    rows = [parse_page(b, u) or {} for b, u in zip(bodies, urls, strict=True)]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in PAGE.names})


_ITEMS = T.ArrayType(_strings("title", "url", "published"))


def feed_items(body: str | None) -> list[dict]:
    """Items of an RSS or Atom feed, at most ``FEED_ITEMS``; none from a body that declares entities or is no XML."""
    if not body or re.search(r"<!(DOCTYPE|ENTITY)", body, re.IGNORECASE):
        return []
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter():
        if item.tag.rsplit("}", 1)[-1] in ("item", "entry"):
            part = {c.tag.rsplit("}", 1)[-1]: c for c in reversed(list(item))}
            text = lambda *names: next((part[n].text.strip() for n in names if n in part and part[n].text), None)  # noqa: B023, E731
            link = text("link") or (part["link"].get("href") if "link" in part else None)
            out.append({"title": text("title"), "url": link, "published": text("pubDate", "published", "updated", "date")})
    return out[:FEED_ITEMS]


@pandas_udf(_ITEMS)
def feeds_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(feed_items)


def sitemap_urls(body: Column) -> Column:
    """The addresses a sitemap lists."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def posts(body: DataFrame, column: str) -> DataFrame:
    """``(post, published, link, title)`` of WordPress post lists in a JSON column, the first ``POSTS`` of each."""
    schema = "array<struct<id:bigint,date:string,link:string,title:struct<rendered:string>>>"
    each = body.select("*", F.posexplode(F.from_json(column, schema)).alias("_pos", "_post")).where(F.col("_pos") < POSTS)
    return each.select(*body.columns, F.col("_post.id").alias("post"), F.col("_post.date").alias("published"), F.col("_post.link").alias("link"), F.col("_post.title.rendered").alias("title"))


def structured_nodes(body: str) -> list[dict]:
    """Every typed node of a JSON-LD text with its path, outermost first, to a depth of 20."""
    try:
        root = json.loads(html.unescape(body))
    except ValueError:
        return []
    out, todo = [], [(root, "$", 0)]
    while todo:
        node, path, depth = todo.pop(0)
        if depth > 20:
            continue
        if isinstance(node, dict):
            if "@type" in node:
                out.append({"path": path, "type": json.dumps(node["@type"]), "node": json.dumps(node)})
            todo += [(v, f"{path}.{k}", depth + 1) for k, v in node.items()]
        elif isinstance(node, list):
            todo += [(v, f"{path}[{i}]", depth + 1) for i, v in enumerate(node)]
    return out


@pandas_udf(T.ArrayType(_strings("path", "type", "node")))
def nodes_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: structured_nodes(b) if b else [])
