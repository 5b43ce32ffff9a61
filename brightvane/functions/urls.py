"""URL functions on columns (C-01 to C-11), by regular expressions, so that no malformed URL raises."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists
from .text import let


def _with_scheme(trimmed: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed, "^(?=//)", "https:"), "^(?!.*://)", "https://")


def _authority(u: Column) -> Column:
    """Host and port of a URL with a scheme, without user."""
    return F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]*://([^/?#]*)", 1), r"^.*@", "")


def _bare_host(authority: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d*$", "")), r"^www\.", "")


def _host(u: Column) -> Column:
    """The host of a URL with a scheme: without user, port and `www.`, in lower case."""
    return _bare_host(_authority(u))


def domain_of(c: Column) -> Column:
    """C-03"""
    return _host(F.regexp_replace(F.coalesce(c, F.lit("")), "^(?!.*://)", "https://"))


def _quoted(c: Column) -> Column:
    """Form encoding, in which `~` stays and `*` is escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _unquoted(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _query(u: Column) -> Column:
    """The query of a URL in its comparable form: sorted, without what only tracks, and with its question mark."""
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(_unquoted(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _unquoted(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*lists.TRACKING)))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    return F.regexp_replace(text, "^(?=.)", "?")


def normalize_url(c: Column) -> Column:
    """C-01: a comparable form. Schemes other than http and https pass unchanged."""
    index = "|".join(re.escape(x.lstrip("/")) for x in lists.INDEX_FILES)

    def whole(v: Column) -> Column:
        port = F.regexp_extract(v["authority"], r":(\d+)$", 1)
        port = F.regexp_replace(F.concat(v["scheme"], F.lit(":"), port), r"^(?:http:80|https:443|\w*:)$|^\w*(?=:)", "")
        path = F.regexp_extract(v["u"], r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
        path = F.regexp_replace(F.regexp_replace(path, f"(?i)/(?:{index})$", "/"), "/+$", "")
        path = F.regexp_replace(path, "^$", "/")
        query = F.when(F.contains(v["u"], F.lit("?")), _query(v["u"])).otherwise("")
        form = F.concat(F.lit("https://"), _bare_host(v["authority"]), port, path, query)
        return F.when(v["trimmed"] == "", "").when(v["scheme"].isin("", "http", "https"), form).otherwise(v["trimmed"])

    # each step has a value of its own, or else all before it would be done once for every use
    trimmed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    given = let(trimmed, lambda t: F.struct(t.alias("trimmed"), _with_scheme(t).alias("u")))
    scheme = lambda u: F.lower(F.regexp_extract(u, r"^([^:/?#]*)://", 1))
    return let(let(given, lambda g: F.struct(g["trimmed"].alias("trimmed"), g["u"].alias("u"), scheme(g["u"]).alias("scheme"), _authority(g["u"]).alias("authority"))), whole)


def canonicalize(url: Column, declared: Column) -> Column:
    """C-02: the declared form if it is on the same host."""
    own, other = normalize_url(url), normalize_url(declared)
    return F.when((other != "") & (domain_of(other) != "") & (domain_of(other) == domain_of(own)), other).otherwise(own)


def registrable_domain(c: Column) -> Column:
    """C-04: the last two labels, or three under a two-part suffix."""
    host = domain_of(c)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(n <= 2, host).when(last(2).isin(*lists.TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def is_http_url(c: Column) -> Column:
    """C-05: http, https, or a bare host."""
    u = F.trim(F.coalesce(c, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.when(scheme != "", scheme.isin("http", "https")).otherwise((u != "") & ~u.rlike(r"^[/#?]"))


def under(host: Column, domains: Iterable[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        d = d.lower().lstrip(".").removeprefix("www.")
        out = out | (host == d) | host.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def is_allowed(c: Column, allowed: Iterable[str], blocked: Iterable[str] = ()) -> Column:
    """C-06"""
    host = domain_of(c)
    return (host != "") & ~under(host, blocked) & under(host, allowed)


def same_site(a: Column, b: Column) -> Column:
    """C-07"""
    return (registrable_domain(a) != "") & (registrable_domain(a) == registrable_domain(b))


def video_id(c: Column) -> Column:
    """C-08: the id in a video link of any of its forms, or null."""
    u = F.coalesce(c, F.lit(""))
    u = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    host, path = _host(u), F.regexp_extract(u, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    short = F.regexp_extract(path, r"^/*([^/]*)", 1)
    watched = F.regexp_extract(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), r"(?:^|&)v=([^&]+)(?!.*&v=)", 1)
    other = F.regexp_extract(path, r"^/(?:shorts|embed|live|v)/([^/]*)", 1)
    got = F.when(host == "youtu.be", short).when(F.contains(host, F.lit("youtube.com")), F.when(path == "/watch", watched).otherwise(other))
    return F.when(got != "", got)


def is_aggregator(domain: Column) -> Column:
    """C-09"""
    return under(F.lower(F.coalesce(domain, F.lit(""))), lists.AGGREGATORS)


def is_first_party(domain: Column, own: Iterable[str]) -> Column:
    """C-09"""
    return under(F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^\.+", ""), own)


def social_handle(c: Column) -> Column:
    """C-10: who posted, read out of the link to a post; null for links of any other shape."""
    u = F.coalesce(c, F.lit(""))
    posted, status = F.regexp_extract(u, r"(?i)linkedin\.com/posts/([^/_?#]+)", 1), F.regexp_extract(u, r"(?i)(?:x|twitter)\.com/([^/?#]+)/status/", 1)
    return F.when(posted != "", posted).when(~F.lower(status).isin("", "i", "home"), status)


def platform(c: Column) -> Column:
    """C-11: by substring, the first that matches; `x.com` also fits hosts that end so."""
    u = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(u, F.lit("linkedin.com")), "linkedin").when(F.contains(u, F.lit("x.com")) | F.contains(u, F.lit("twitter.com")), "x").when(F.contains(u, F.lit("reddit.com")), "reddit").otherwise("other")
