"""Article fields from HTML (D-01 to D-06). Parsing is in Arrow, over the standard library's parser; dates and links are settled natively."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lists
from .urls import domain_of, is_http_url, normalize_url

_FIELDS = ("canonical", "title", "author", "published", "site", "excerpt", "lang", "body")
PARSED = T.StructType([*[T.StructField(n, T.StringType()) for n in _FIELDS], T.StructField("links", T.ArrayType(T.StringType())), T.StructField("promotional", T.BooleanType())])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """One pass: metadata of the head, JSON-LD, links, and text blocks of the page and of its article and main parts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.canonical = self.title = self.lang = None
        self.linked: list[dict] = []
        self.links: list[str] = []
        self.blocks: list[tuple[str, str]] = []
        self._open: list[tuple[str, bool]] = []
        self._parts: list[tuple[int, list[str]]] = []
        self._script: list[str] | None = None
        self._name: list[str] | None = None
        self.loose: list[str] = []

    def _dropped(self) -> bool:
        return any(d for _, d in self._open)

    def _place(self) -> str:
        tags = [t for t, _ in self._open]
        return "article" if "article" in tags else "main" if "main" in tags else "body"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.lang = a["lang"]
        elif tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or a.get("itemprop") or "").lower(), a["content"].strip())
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"].strip())
        elif tag == "title" and self.title is None:
            self._name = []
        elif tag == "script" and a.get("type") == "application/ld+json":
            self._script = []
        if tag in _VOID:
            return
        classes = set(a.get("class", "").split())
        self._open.append((tag, tag in lists.DROPPED_TAGS or bool(classes & set(lists.DROPPED_CLASSES)) or a.get("role") == "navigation" or a.get("aria-hidden") == "true"))
        if tag in lists.BLOCK_TAGS and not self._dropped():
            self._parts.append((len(self._open), []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self._name is not None:
            self.title, self._name = " ".join("".join(self._name).split()), None
        if tag == "script" and self._script is not None:
            try:
                self._take(json.loads("".join(self._script)))
            except ValueError:
                pass
            self._script = None
        depth = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == tag), None)
        if depth is None:
            return
        while self._parts and self._parts[-1][0] > depth:
            text = " ".join(" ".join(self._parts.pop()[1]).split())
            if len(text.split()) >= 4:
                self.blocks.append((self._place(), text))
        del self._open[depth:]

    def _take(self, found: object) -> None:
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                self._take(x.get("@graph", []))
                kinds = x.get("@type", [])
                if set([kinds] if isinstance(kinds, str) else kinds) & set(lists.ARTICLE_TYPES):
                    self.linked.append(x)

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
        elif self._name is not None:
            self._name.append(data)
        elif data.strip() and not self._dropped():
            self.loose.append(data.strip())
            for _, words in self._parts:
                words.append(data)

    def body(self) -> str:
        for place in ("article", "main", None):
            blocks = [t for p, t in self.blocks if place in (p, None)]
            if blocks:
                return "\n\n".join({t.lower()[:100]: t for t in reversed(blocks)}[k] for k in dict.fromkeys(t.lower()[:100] for t in blocks))
        return " ".join(self.loose)


def _name_of(x: object) -> str | None:
    if isinstance(x, list):
        return _name_of(x[0]) if x else None
    return x.get("name") if isinstance(x, dict) else x if isinstance(x, str) else None


def parse(html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    meta, ld = reader.meta, (reader.linked or [{}])[0]
    first = lambda *names: next((meta[n] for n in names if meta.get(n)), None)
    body = reader.body()
    marks = sum(m in body.lower() for m in lists.PROMOTIONAL)
    return {
        "canonical": reader.canonical or first("og:url"), "title": ld.get("headline") or first("og:title", "twitter:title") or reader.title, "author": _name_of(ld.get("author")) or first("author", "article:author"),
        "published": ld.get("datePublished") or first("article:published_time", "datepublished", "date", "pubdate"), "site": first("og:site_name") or _name_of(ld.get("publisher")), "excerpt": first("og:description", "description"),
        "lang": reader.lang, "body": body, "links": reader.links, "promotional": marks >= 2 or (marks == 1 and len(body.split()) < 400),
    }


@F.pandas_udf(PARSED)
def _parse_many(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in s], columns=PARSED.fieldNames())


@F.pandas_udf(PARSED)
def _parse_from(s: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(x := parse(h)) | {"links": _resolved(x["links"], u)} for h, u in zip(s, base, strict=True)], columns=PARSED.fieldNames())


def parse_html(html: Column, base: Column | None = None) -> Column:
    """D-01 to D-04: a struct of the page's fields. With a base its links are absolute, so that `page_links` needs no second Python process a task."""
    return _parse_many(html) if base is None else _parse_from(html, base)


def parse_date(c: Column, latest_year: int) -> Column:
    """D-06: a timestamp from the usual forms; years before 1995 or after `latest_year` are none."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss Z", "MMMM d, yyyy", "dd MMM yyyy")
    t = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms if not f.startswith("EEE")], F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss Z")))
    return F.when(F.year(t).between(1995, latest_year), t)


def _resolved(hrefs: list[str] | None, url: str | None) -> list[str]:
    out = []
    for h in hrefs if hrefs is not None else []:
        if not h.startswith(("mailto:", "tel:", "javascript:", "#")):
            try:
                out.append(urljoin(url or "", h))
            except ValueError:
                continue
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute(links: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_resolved(a, b) for a, b in zip(links, base, strict=True)])


def page_links(links: Column, base: Column, absolute: bool = False) -> Column:
    """D-05: links of the same domain worth following, normalised, each once. `absolute` tells that they are so already."""
    near = F.filter(links if absolute else _absolute(links, base), lambda u: is_http_url(u) & (domain_of(u) == domain_of(base)) & ~u.rlike(lists.SKIPPED_LINKS))
    return F.array_distinct(F.filter(F.transform(near, normalize_url), lambda u: u != normalize_url(base)))
