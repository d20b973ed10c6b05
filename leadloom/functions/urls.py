"""URL and host functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import constants as K


def with_scheme(c: Column) -> Column:
    u = F.trim(c)
    return F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(c: Column) -> Column:
    """The host in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(with_scheme(c), r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_key(c: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or bare root slash; null for what is no URL."""
    u = with_scheme(c)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z]+)://", 1))
    h = host(c)
    port = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    rest = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "/", "").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    out = F.concat(scheme, F.lit("://"), h, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), rest)
    return F.when(h.rlike(r"""^[^\s<>^|%"]+$"""), out)


def domain(c: Column) -> Column:
    """The host without leading www.; null for what is no URL."""
    h = host(c)
    return F.when(h.rlike(r"""^[^\s<>^|%"]+$"""), F.regexp_replace(h, r"^www\.", ""))


def path(c: Column) -> Column:
    """The path in lower case, '/' for none."""
    p = F.lower(F.regexp_extract(with_scheme(c), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return F.when(p == "", "/").otherwise(p)


def path_priority(c: Column) -> Column:
    """Place of the first priority path that the URL's path equals or ends in, else 100."""
    p = F.regexp_replace(path(c), r"/$", "")
    p = F.when(p == "", "/").otherwise(p)
    out = F.lit(100)
    for i in range(len(K.PRIORITY_PATHS) - 1, -1, -1):
        out = F.when((p == K.PRIORITY_PATHS[i]) | p.endswith(K.PRIORITY_PATHS[i]), i).otherwise(out)
    return out


def is_aggregator(h: Column) -> Column:
    """Is the host, www. aside, one of the directories and social sites or under one?"""
    bare = F.regexp_replace(F.lower(h), r"^www\.", "")
    return bare.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in K.AGGREGATOR_HOSTS) + ")$")


def is_search_engine(h: Column) -> Column:
    x = F.lower(h)
    return x.contains("google.") | x.contains("gstatic.com") | x.contains("googleusercontent.com") | (x == "g.page") | x.endswith(".google")


def is_private_ip(ip: Column) -> Column:
    """Loopback, link-local, private and carrier-grade addresses."""
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    four = (F.size(F.split(ip, r"\.")) == 4) & a.isNotNull() & b.isNotNull() & part(3).isNotNull() & part(4).isNotNull()
    ranges = (
        a.isin(10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    )
    return ip.isin("::1", "0.0.0.0") | ip.rlike("^(fe80:|fc|fd)") | F.coalesce(four & ranges, F.lit(False))


def is_safe_url(c: Column) -> Column:
    """http(s), and neither a blocked or metadata host nor a private address."""
    h = host(c)
    return F.coalesce(
        url_key(c).isNotNull() & ~h.isin(*K.BLOCKED_HOSTS) & ~h.endswith(".localhost") & ~h.contains("169.254.169.254") & ~is_private_ip(h), F.lit(False)
    )


def unwrap_redirect(c: Column) -> Column:
    """The target of a search engine's redirect link; any other link as it is."""
    q = F.regexp_extract(c, r"^https?://(?:www\.)?google\.com/url\?(?:[^#]*&)?q=([^&#]+)", 1)
    return F.when(q != "", F.coalesce(F.try_url_decode(q), q)).otherwise(c)


def place_id(c: Column) -> Column:
    """Identifier in a map link: hex pair, knowledge id, ChIJ token, else the link without query."""
    hex_, kg, chij = (F.regexp_extract(c, p, 1) for p in (r"(?i)!1s(0x[a-f0-9]+:0x[a-f0-9]+)", r"(?i)!16s([^!]+)", r"(ChIJ[a-zA-Z0-9_-]+)"))
    return F.when(hex_ != "", hex_).when(kg != "", F.coalesce(F.try_url_decode(kg), kg)).when(chij != "", chij).otherwise(F.substring_index(c, "?", 1))


def tel_number(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i)^tel:([^?#]+)", 1)), F.lit(""))


def label_number(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, r"(?i)(?:phone|call|mobile)[:\s]+([+\d][\d\s().-]{7,})", 1), r"\s+", " ")), F.lit(""))


def pick_website(links: Column) -> Column:
    """The first link of an array, redirects unwrapped, that is no directory, social site or search engine."""
    plain = F.transform(links, lambda x: unwrap_redirect(F.trim(x)))
    own = F.filter(plain, lambda x: x.startswith("http") & ~is_aggregator(host(x)) & ~is_search_engine(host(x)))
    return F.try_element_at(own, F.lit(1))


def parse_label(c: Column) -> Column:
    """struct(name, category_hint, address_hint) of a listing label split at middle dots."""
    parts = F.filter(F.transform(F.split(c, "·"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(F.slice(parts, 2, 1000), lambda x: ~x.rlike(r"(?i)stars?|\(\d+\)"))
    is_address = lambda x: x.rlike(r"^\d") | x.contains(",")
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.trim(c)).alias("name"),
        F.try_element_at(F.filter(rest, lambda x: ~is_address(x)), F.lit(1)).alias("category_hint"),
        F.try_element_at(F.filter(rest, is_address), F.lit(-1)).alias("address_hint"),
    )


def links_in(html: Column) -> Column:
    """All href values of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))


def resolve(href: Column, base: Column) -> Column:
    """href against the page's URL: absolute, root-relative and path-relative links; fragments dropped, dots not resolved."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    h = F.regexp_replace(F.trim(href), r"#.*$", "")
    return F.when(h.rlike(r"^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(origin, h)).when(h == "", base).otherwise(F.concat(folder, h))


def place_details(tel_hrefs: Column, labels: Column, authority: Column, links: Column) -> Column:
    """struct(phone, website) of a place's signals: the first tel link's number, else the first label's; authority links come before others.

    Null arrays count as empty.
    """
    none = F.array().cast("array<string>")
    first = lambda c, f: F.try_element_at(F.filter(F.transform(F.coalesce(c, none), f), lambda x: x.isNotNull()), F.lit(1))
    return F.struct(
        F.coalesce(first(tel_hrefs, tel_number), first(labels, label_number)).alias("phone"),
        pick_website(F.concat(F.coalesce(authority, none), F.coalesce(links, none))).alias("website"),
    )


MAPS = "https://www.google.com"


def place_url(href: Column) -> Column:
    """A listing's link, absolute."""
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(MAPS), href)).otherwise(F.concat(F.lit(MAPS + "/"), href))


def search_url(text: Column) -> Column:
    """The search page of a query text, percent-encoded."""
    e = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(char))
    return F.concat(F.lit(f"{MAPS}/maps/search/"), e)
