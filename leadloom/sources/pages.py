"""Pages: a templated page source over businesses, and rules over captured robots, sitemap and link lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import urls

HOME = (
    '<!doctype html><html{lang}><head><title>{name} - {city}</title>{meta}<link rel="canonical" href="{site}">'
    '{viewport}<script async src="https://www.googletagmanager.com/gtm.js?id=GTM-1"></script>{tech}'
    '<script type="application/ld+json">{{"@type":["LocalBusiness","Store"],"name":"shop","telephone":"{phone}","email":"{email}"}}</script></head>'
    '<body><header><nav><a href="/contact">Contact</a> <a href="/about#team">About</a> <a href="https://other.example/x">Partner</a></nav></header>'
    '<main><h1>{name}</h1><p>Book an appointment today. Rated by our customers, licensed and certified.</p><img src="a.jpg" alt="shop front"><img src="b.jpg">'
    '<a href="tel:{phone}">Call now</a> <a href="https://wa.me/{digits}">WhatsApp</a></main>'
    '<footer><a href="mailto:{email}?subject=Hello">Write to us</a></footer></body></html>'
)
CONTACT = (
    '<!doctype html><html><head><title>Contact {name}</title></head><body><h1>Contact</h1><h1>Visit</h1>'
    '<form action="/Contact/send"><label for="e">Mail</label><input id="e" name="email"><textarea name="message"></textarea><input type="hidden" name="t"><select name="s"></select></form>'
    '<p>Phone {phone}&nbsp;or mail {email}</p><script>var x = "a@b.js";</script><img src="http://cdn.example/p.png"></body></html>'
)
TECH = ("", '<script src="/wp-content/jquery.min.js"></script>', '<link href="/bootstrap.min.css"><div data-reactroot></div>', '<script src="https://static.hotjar.com/c.js"></script>')
PARTS = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a field, text) of a template with {fields}; doubled braces stand for themselves."""
    out: list[tuple[bool, str]] = []
    last = 0
    for m in PARTS.finditer(template):
        out.append((False, template[last: m.start()]))
        out.append((True, m[1]) if m[1] else (False, m[0][0]))
        last = m.end()
    out.append((False, template[last:]))
    return [p for p in out if p[1]]


def fill(template: str) -> Column:
    return F.concat(*[F.col(t) if field else F.lit(t) for field, t in pieces(template)])


def fixture_pages(businesses: DataFrame) -> DataFrame:
    """Home and contact page of every business (business_id, name, city, phone, email, site): (business_id, seq, url, html, headers).

    Null phone, email and city become empty. Every third page lacks the viewport, every fifth the description,
    every seventh the language, so that the audits have something to find.
    """
    b = businesses.select("business_id", "name", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("phone", F.lit("")).alias("phone"), F.coalesce("email", F.lit("")).alias("email"), "site")
    k = F.col("business_id")
    b = (
        b.withColumn("digits", F.regexp_replace("phone", "[^0-9]", ""))
        .withColumn("viewport", F.when(k % 3 == 0, "").otherwise('<meta name="viewport" content="width=device-width, initial-scale=1">'))
        .withColumn("meta", F.when(k % 5 == 0, "").otherwise('<meta name="description" content="A small shop"><meta property="og:title" content="shop">'))
        .withColumn("lang", F.when(k % 7 == 0, "").otherwise(' lang="en"'))
        .withColumn("tech", F.element_at(F.array(*[F.lit(t) for t in TECH]), (k % 4 + 1).cast("int")))
    )
    headers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("content-type").alias("k"), F.lit("text/html").alias("v")),
        F.when(k % 2 == 0, F.struct(F.lit("strict-transport-security").alias("k"), F.lit("max-age=1").alias("v"))),
        F.when(k % 3 == 1, F.struct(F.lit("set-cookie").alias("k"), F.lit("sid=1; Path=/; Secure").alias("v"))),
        F.when(k % 5 == 1, F.struct(F.lit("server").alias("k"), F.lit("nginx").alias("v"))),
    ), lambda x: x.isNotNull()))
    pages = F.array(
        F.struct(F.lit(1).alias("seq"), F.concat("site", F.lit("/")).alias("url"), fill(HOME).alias("html")),
        F.struct(F.lit(2).alias("seq"), F.concat("site", F.lit("/contact")).alias("url"), fill(CONTACT).alias("html")),
    )
    return b.select("business_id", headers.alias("headers"), F.explode(pages).alias("p")).select("business_id", "p.seq", "p.url", "p.html", "headers")


def crawl_frontier(links: DataFrame, max_pages: int = K.MAX_PAGES) -> DataFrame:
    """(domain, url, priority, place): the pages of every domain to fetch, by path priority, then seq, then url.

    links: (url, seq). URLs that differ in a trailing slash only are one; the rank filter becomes a group limit,
    so a domain with many links sends max_pages rows at most per partition.
    """
    u = F.regexp_replace(urls.url_key(F.col("url")), r"/$", "")  # exploded alone below, so that filters don't multiply its code
    l = links.select(F.explode(F.array(u)).alias("url"), "seq").filter("url is not null").groupBy("url").agg(F.min("seq").alias("seq"))
    l = l.select(urls.domain(F.col("url")).alias("domain"), "url", urls.path_priority(F.col("url")).alias("priority"), "seq")
    w = Window.partitionBy("domain").orderBy("priority", "seq", "url")
    return l.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_pages).select("domain", "url", "priority", "place")


def crawl_plan(sites: DataFrame, sitemaps: DataFrame, links: DataFrame, max_pages: int = K.MAX_PAGES, from_sitemap: int = 20) -> DataFrame:
    """(domain, url, priority, place): what a crawl of each site (url) fetches, before any page is seen.

    Its start page, the priority paths, at most from_sitemap same-domain locations (id is the domain, place, loc) and
    the links (url) already known, in this order of sight; then crawl_frontier ranks them.
    """
    start = sites.select(F.explode(F.array(urls.url_key(F.col("url")))).alias("start")).filter("start is not null").distinct()
    start = start.withColumn("domain", urls.domain(F.col("start"))).withColumn("origin", F.regexp_extract("start", r"^(https?://[^/?#]+)", 1))
    own = start.select("domain", F.col("start").alias("url"), F.lit(0).alias("seq"))
    paths = start.select("domain", F.posexplode(F.array(*[F.concat("origin", F.lit(p)) for p in K.PRIORITY_PATHS])).alias("seq", "url")).select("domain", "url", F.col("seq") + 1)
    maps = sitemaps.filter(F.col("place") <= from_sitemap).select(F.col("id").alias("domain"), F.col("loc").alias("url"), (F.col("place") + 100).alias("seq"))
    maps = maps.withColumn("_d", F.explode(F.array(urls.domain(F.col("url"))))).filter("_d = domain").drop("_d").join(start.select("domain").distinct(), "domain", "left_semi")
    seen = links.select(F.explode(F.array(urls.domain(F.col("url")))).alias("domain"), "url", F.lit(1_000).alias("seq")).join(start.select("domain").distinct(), "domain", "left_semi")
    every = own.unionByName(paths.toDF("domain", "url", "seq")).unionByName(maps).unionByName(seen)
    return crawl_frontier(every.select("url", "seq"), max_pages)


def robots_rules(bodies: DataFrame) -> DataFrame:
    """(id, allowed, sitemap) of captured robots files (id, body): is everything forbidden, and the first sitemap."""
    head = F.array_join(F.slice(F.split("body", "\n"), 1, 50), "\n")
    return bodies.select(
        "id", (~head.rlike(r"(?im)disallow:\s*/\s*$")).alias("allowed"), F.nullif(F.regexp_extract("body", r"(?i)sitemap:\s*(\S+)", 1), F.lit("")).alias("sitemap")
    )


def sitemap_locations(bodies: DataFrame, most: int = 20) -> DataFrame:
    """(id, place, loc): the first locations of captured sitemaps (id, body)."""
    locs = F.slice(F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), F.lit(1)), 1, most)
    return bodies.select("id", F.posexplode(locs).alias("place", "loc")).select("id", (F.col("place") + 1).alias("place"), F.trim("loc").alias("loc"))


def discovered_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): distinct same-domain http links of pages (page_id, url, html), without fragments."""
    l = pages.select("page_id", "url", F.explode(urls.links_in(F.col("html"))).alias("href")).filter(~F.col("href").rlike(r"^(mailto:|tel:|javascript:)|^$"))
    l = l.select("page_id", "url", urls.resolve(F.col("href"), F.col("url")).alias("link"))
    return l.filter(F.col("link").rlike(r"^https?://") & (urls.domain(F.col("link")) == urls.domain(F.col("url")))).select("page_id", "link").distinct()
