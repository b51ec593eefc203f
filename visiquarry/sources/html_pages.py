"""Pages from raw HTML: one pass of a tolerant parser over each page, everything after it is columns.

``extract`` adds on-page fields to a table of (url, html, ...); links and structured-data blocks come as arrays to explode.
A null or empty HTML gives empty fields, broken markup is read as far as it goes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TEXT_RATIO, MIN_SCRIPTS = 0.02, 5
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options")
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_SPACE = re.compile(r"\s+")

FIELDS = (
    "title string, meta_description string, canonical_href string, robots string, viewport string, lang string, h1s array<string>, heading_order array<string>, "
    "schema_blocks array<struct<type:string,keys:array<string>>>, links array<struct<target_url:string,anchor_text:string>>, external_links int, hreflangs array<string>, "
    "body_text string, body_length int, images_missing_alt int, images_missing_dimensions int, mixed_content int, og_complete boolean, scripts int"
)


class _Reader(HTMLParser):
    """Collects what the fields need while tags go by."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.host = base, urlsplit(base).netloc.lower() if base else ""
        self.title = self.description = self.canonical = self.robots = self.viewport = self.lang = None
        self.h1s: list[str] = []
        self.headings: list[str] = []
        self.json_ld: list[str] = []
        self.links: list[dict] = []
        self.external = self.no_alt = self.no_size = self.insecure = self.scripts = 0
        self.hreflangs: list[str] = []
        self.og: set[str] = set()
        self.body: list[str] = []
        self.in_body = False
        self.open: dict[str, list] = {}  # texts being gathered: title, h1, a, ld

    def handle_starttag(self, tag: str, given: list) -> None:
        a = {k: v if v is not None else "" for k, v in reversed(given)}
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "body":
            self.in_body = True
        elif tag == "title" and self.title is None and "title" not in self.open:
            self.open["title"] = []
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            rel = a.get("rel", "")
            if rel == "canonical" and self.canonical is None:
                self.canonical = a.get("href")
            if rel == "alternate" and a.get("hreflang", "").strip():
                self.hreflangs.append(a["hreflang"].strip())
            self.insecure += a.get("href", "").startswith("http://")
        elif tag in _HEADINGS:
            self.headings.append(tag)
            if tag == "h1":
                self._close("h1")
                self.open["h1"] = []
        elif tag == "img":
            self.no_alt += "alt" not in a
            self.no_size += "width" not in a or "height" not in a
        elif tag == "a" and "href" in a:
            self._close("a")
            self._link(a["href"])
        elif tag == "script":
            if a.get("type") == "application/ld+json":
                self.open["ld"] = []
            else:
                self.scripts += 1
        if tag in ("img", "script", "iframe"):
            self.insecure += a.get("src", "").startswith("http://")

    def _meta(self, a: dict) -> None:
        name = a.get("name")
        if name == "description" and self.description is None:
            self.description = a.get("content", "")
        elif name == "robots" and self.robots is None:
            self.robots = a.get("content")
        elif name == "viewport" and self.viewport is None:
            self.viewport = a.get("content")
        if "content" in a and a.get("property") in ("og:title", "og:description", "og:image"):
            self.og.add(a["property"])

    def _link(self, href: str) -> None:
        if not href.strip() or href.startswith("#"):
            return
        try:
            target = urljoin(self.base, href.strip())
            parts = urlsplit(target)
        except ValueError:
            return
        if parts.scheme in ("javascript", "mailto", "tel", "sms"):
            return
        if parts.netloc.lower() != self.host:
            self.external += 1
            return
        self.links.append({"target_url": target if parts.path else f"{target}/", "anchor_text": ""})
        self.open["a"] = []

    def handle_endtag(self, tag: str) -> None:
        self._close({"script": "ld"}.get(tag, tag))

    def _close(self, name: str) -> None:
        if (got := self.open.pop(name, None)) is None:
            return
        text = "".join(got)
        if name == "title":
            self.title = text.strip()
        elif name == "h1":
            self.h1s.append(text.strip())
        elif name == "a":
            self.links[-1]["anchor_text"] = text.strip()
        elif name == "ld" and text.strip():
            self.json_ld.append(text)

    def handle_data(self, data: str) -> None:
        if self.in_body:
            self.body.append(data)
        for got in self.open.values():
            got.append(data)


def _plain_keys(node: dict) -> list[str]:
    return [k for k in node if not k.startswith("@")]


def _blocks(raw: str) -> Iterator[dict]:
    """Types and key names of a JSON-LD text, with one nested level."""
    try:
        parsed = json.loads(raw)
    except ValueError:
        return
    for node in parsed if isinstance(parsed, list) else [parsed]:
        graph = node.get("@graph") if isinstance(node, dict) else None
        for item in graph if isinstance(graph, list) else [node]:
            if not isinstance(item, dict):
                continue
            kinds = item.get("@type")
            keys = []
            for k in _plain_keys(item):
                keys.append(k)
                inner = item[k][0] if isinstance(item[k], list) and item[k] else item[k]
                if isinstance(inner, dict):
                    keys += [f"{k}.{x}" for x in _plain_keys(inner)]
            for kind in [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []:
                if isinstance(kind, str):
                    yield {"type": kind, "keys": keys}


def parse_page(html: str | None, base: str | None) -> dict:
    reader = _Reader(base or "")
    reader.feed(html or "")
    reader.close()
    for name in list(reader.open):
        reader._close(name)
    body = _SPACE.sub(" ", "".join(reader.body)).strip()
    return {
        "title": reader.title or None, "meta_description": reader.description, "canonical_href": reader.canonical, "robots": reader.robots,
        "viewport": reader.viewport, "lang": reader.lang, "h1s": reader.h1s, "heading_order": reader.headings,
        "schema_blocks": [b for raw in reader.json_ld for b in _blocks(raw)], "links": reader.links, "external_links": reader.external,
        "hreflangs": reader.hreflangs, "body_text": body, "body_length": len("".join(reader.body).strip()),
        "images_missing_alt": reader.no_alt, "images_missing_dimensions": reader.no_size, "mixed_content": reader.insecure,
        "og_complete": len(reader.og) == 3, "scripts": reader.scripts,
    }


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns but the HTML, the fields, word_count and is_client_rendered."""
    kept = pages.drop(html)
    schema = StructType(kept.schema.fields + StructType.fromDDL(FIELDS).fields)
    arrow = to_arrow_schema(schema)
    given = pages.select(*(F.col(c) for c in kept.columns), F.col(html).alias("__html"))
    at = kept.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                got = [parse_page(h, u) for h, u in zip(batch.column("__html").to_pylist(), batch.column(at).to_pylist())]
                own = batch.columns[:-1]
                new = [pa.array([g[f.name] for g in got], f.type) for f in list(arrow)[len(own) :]]
                yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

    return given.mapInArrow(run, schema).withColumn("word_count", words(F.col("body_text")))


def words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def client_rendered(html_length: Column) -> Column:
    """Hardly any text beside much script."""
    return (html_length > 0) & (F.col("body_length") / html_length < TEXT_RATIO) & (F.col("scripts") >= MIN_SCRIPTS)


def parse_headers(headers: Column) -> dict[str, Column]:
    """X-Robots-Tag, MIME type, security headers and hreflang codes of a map of response headers with lower-case names."""
    trimmed = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    entries = F.filter(F.split(F.element_at(headers, "link"), r",(?=\s*<)"), lambda e: e.rlike(r'(?i)rel="?alternate"?'))
    codes = F.filter(F.transform(entries, lambda e: F.regexp_extract(e, r'(?i)hreflang="?([a-zA-Z-]+)"?', 1)), lambda c: c != "")
    return {
        "x_robots_tag": trimmed(F.element_at(headers, "x-robots-tag")),
        "content_type": trimmed(F.split_part(F.element_at(headers, "content-type"), F.lit(";"), F.lit(1))),
        "security_headers": F.filter(F.array(*map(F.lit, SECURITY_HEADERS)), lambda n: F.map_contains_key(headers, n)),
        "header_hreflangs": F.coalesce(codes, F.array().cast("array<string>")),
    }


def sitemap_urls(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Every non-empty <loc> of landed sitemap documents; entities of XML decoded."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    rows = documents.select(*(c for c in documents.columns if c != xml), F.explode(found).alias("url"))
    plain = F.regexp_replace(F.col("url"), r"^<!\[CDATA\[\s*|\s*\]\]>$", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return rows.withColumn("url", plain).where("url <> ''").distinct()
