"""Static audits of captured pages: one wide row of metrics and a score per site and module.

Input everywhere: pages (site_id, seq, url, html, status, headers), headers with lower-case keys. Signals are
read by patterns on the source text, which is exact for flat markup; functions/dom.py parses where ancestry
counts. A site's home page is its first page with path '/', else its first page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import text, urls


def home_pages(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("site_id").orderBy(F.when(urls.path(F.col("url")) == "/", 0).otherwise(1), "seq")
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def at_home(module: Callable[[DataFrame], DataFrame], pages: DataFrame) -> DataFrame:
    """A row-wise module over the home page of every site, without moving any page.

    Every page is reduced to its metrics where it lies; the home page's are kept by one partial aggregation.
    """
    wide = module(pages.withColumn("site_id", F.struct("site_id", F.when(urls.path(F.col("url")) == "/", 0).otherwise(1).alias("other"), "seq")))
    names = [c for c in wide.columns if c != "site_id"]
    best = wide.groupBy(F.col("site_id.site_id").alias("site_id")).agg(F.min_by(F.struct(*names), F.struct("site_id.other", "site_id.seq")).alias("m"))
    return best.select("site_id", "m.*")


def _one(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def _count(html: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))


def _points(points: list[Column], total: Column | float) -> Column:
    return reduce(lambda a, b: a + b, points) / total * 100


def seo(home: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Eleven points: title, description, one h1, canonical, viewport, social tags, structured data, image texts, length, sitemap, robots.

    sites (site_id, has_sitemap, robots_allowed) is optional; without it there is no sitemap and robots allow.
    """
    h = home.join(sites, "site_id", "left") if sites is not None else home.withColumns({"has_sitemap": F.lit(False), "robots_allowed": F.lit(True)})
    html = F.coalesce("html", F.lit(""))
    imgs = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    with_alt = F.size(F.filter(imgs, lambda t: t.rlike(r"""(?i)\balt=["'][^"']*\S[^"']*["']""")))
    body = text.squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)$", 1), r"<[^>]+>", " "))
    h = h.select("site_id", "has_sitemap", "robots_allowed", html.alias("html"), F.size(imgs).alias("n_img"), with_alt.alias("n_alt"), F.length(body).alias("n_text"), _count(html, r"(?i)<h1\b").alias("n_h1"))
    x = F.col("html")
    cover = F.when(F.col("n_img") > 0, F.col("n_alt") / F.col("n_img")).otherwise(1.0)
    scripts = F.regexp_extract_all(x, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    nodes = F.flatten(F.transform(scripts, lambda j: F.coalesce(F.from_json(F.when(F.trim(j).startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]"))), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))))
    kinds = F.transform(nodes, lambda n: F.try_element_at(n, F.lit("@type")))
    types = F.aggregate(kinds, F.lit(0), lambda k, t: k + F.when(t.isNull(), 0).when(t.startswith("["), F.coalesce(F.size(F.from_json(t, "array<string>")), F.lit(0))).otherwise(1))
    m = {
        "title": _one(text.page_title(x) != ""), "description": _one(x.rlike(r"""(?i)<meta\s[^>]*name=["']description["'][^>]*content=["']\s*[^"'\s]""")),
        "h1": F.when(F.col("n_h1") == 1, 1.0).when(F.col("n_h1") > 1, 0.5).otherwise(0.0), "canonical": _one(x.rlike(r"""(?i)<link\s[^>]*rel=["']canonical["'][^>]*href=["'][^"']""")),
        "viewport": _one(x.rlike(r"""(?i)<meta\s[^>]*name=["']viewport["'][^>]*content=["'][^"']""")),
        "social": _one(x.rlike(r"""(?i)<meta\s[^>]*(property=["']og:(title|description)["']|name=["']twitter:card["'])""")),
        "structured": _one(x.rlike(r"(?i)application/ld\+json")), "alt_coverage": cover, "thin": _one((F.col("n_text") > 0) & (F.col("n_text") < 200)),
        "hreflang": _one(x.rlike(r"(?i)<link\s[^>]*hreflang=")), "sitemap": _one(F.col("has_sitemap")), "robots": _one(F.coalesce("robots_allowed", F.lit(True))),
        "ld_types": types,
    }
    h = h.select("site_id", "n_h1", *[v.alias(k) for k, v in m.items()])
    c = F.col
    pts = [c("title"), c("description"), _one(c("n_h1") == 1), c("canonical"), c("viewport"), c("social"), c("structured"),
           F.when(c("alt_coverage") >= 0.7, 1.0).otherwise(c("alt_coverage") * 0.7), 1 - c("thin"), c("sitemap"), c("robots")]
    content = (c("title") + c("description") + _one(c("n_h1") == 1) + (1 - c("thin"))) / 4 * 100
    return h.select("site_id", *list(m), _points(pts, 11.0).alias("score"), content.alias("content_score"))


def security(home: DataFrame) -> DataFrame:
    """Seven points, nine with a cookie: https, five headers, no mixed content, cookie flags."""
    hd = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    https = F.col("url").startswith("https://")
    cookie = hd("set-cookie")
    mixed = https & F.coalesce("html", F.lit("")).rlike(r"""(?i)(?:src|href)=["']http://""")
    m = {
        "https": _one(https), "hsts": _one(hd("strict-transport-security") != ""), "csp": _one(hd("content-security-policy") != ""),
        "content_type_options": _one(hd("x-content-type-options") != ""), "referrer_policy": _one(hd("referrer-policy") != ""),
        "permissions_policy": _one((hd("permissions-policy") != "") | (hd("feature-policy") != "")), "no_mixed": _one(~mixed),
        "cookie_secure": F.when(cookie != "", _one(cookie.rlike(r"(?i);\s*secure"))), "cookie_http_only": F.when(cookie != "", _one(cookie.rlike(r"(?i);\s*httponly"))),
        "server_shown": _one(hd("server") != ""),
    }
    h = home.select("site_id", *[v.alias(k) for k, v in m.items()])
    names = ["https", "hsts", "csp", "content_type_options", "referrer_policy", "permissions_policy", "no_mixed"]
    pts = [F.col(n) for n in names] + [F.coalesce(n, F.lit(0.0)) for n in ("cookie_secure", "cookie_http_only")]
    return h.withColumn("score", _points(pts, F.when(F.col("cookie_secure").isNotNull(), 9.0).otherwise(7.0)))


def conversion(pages: DataFrame) -> DataFrame:
    """Ways to get in touch over all pages of a site, aggregated per page before the shuffle; capped at 100."""
    x = F.coalesce("html", F.lit(""))
    any_ = lambda rx: F.max(_one(x.rlike(rx)))
    forms = F.regexp_extract_all(x, F.lit(r"(?is)<form.*?</form>"), F.lit(0))
    fields = F.aggregate(forms, F.lit(0), lambda n, f: n + F.size(F.regexp_extract_all(f, F.lit(r"(?i)<(?:input|textarea|select)\b"), F.lit(0))))
    a = pages.groupBy("site_id").agg(
        any_(r"""(?i)<a\s[^>]*href=["']tel:""").alias("phone"), any_(r"""(?i)<a\s[^>]*href=["'][^"']*(?:wa\.me|whatsapp)""").alias("chat"), any_(r"""(?i)<a\s[^>]*href=["']mailto:""").alias("mail"),
        any_(r"(?i)<form\b").alias("form"), any_(r"(?i)book|appoint|schedule|reserve").alias("booking"), any_(r"(?i)sticky|fixed|call now|whatsapp").alias("sticky"),
        any_(r"(?i)google maps|reviews?|testimonial|rated|years? of experience|licensed|certified|address|street|road|avenue").alias("trust"),
        F.max(_one(F.col("url").rlike("(?i)contact"))).alias("contact_url"), F.sum(fields).alias("fields"),
    )
    c = F.col
    s = (c("phone") * (12 + 8 * c("sticky")) + c("chat") * (12 + 6 * c("sticky")) + c("mail") * 8 + c("form") * (15 + 5 * c("contact_url")) + c("booking") * 15 + c("trust") * 10
         + F.when((c("form") > 0) & (c("fields") >= 3), 5).otherwise(0))
    return a.withColumn("score", F.least(F.lit(100.0), s))


def technical(pages: DataFrame) -> DataFrame:
    """85 for a reachable home page, 20 for none, else 30; five less for every page with an error."""
    broken = pages.groupBy("site_id").agg(F.count_if(F.col("status") >= 400).alias("broken"), F.count("*").alias("pages"))
    st = F.coalesce("status", F.lit(0))
    base = F.when(st.between(200, 399), 85.0).when(st == 0, 20.0).otherwise(30.0)
    h = at_home(lambda p: p.select("site_id", st.alias("status"), base.alias("base")), pages.select("site_id", "seq", "url", "status"))
    return h.join(broken, "site_id").select("site_id", "status", "broken", "pages", F.greatest(F.lit(0.0), F.col("base") - F.col("broken") * 5).alias("score"))


def accessibility(home: DataFrame) -> DataFrame:
    """Six points by patterns; a field counts as labelled with an aria attribute or a label for its id."""
    x = F.coalesce("html", F.lit(""))
    imgs = F.regexp_extract_all(x, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    inputs = F.filter(F.regexp_extract_all(x, F.lit(r"(?i)<(?:input|select|textarea)\b[^>]*>"), F.lit(0)), lambda t: ~t.rlike(r"""(?i)type=["']hidden["']"""))
    labels = F.regexp_extract_all(x, F.lit(r"""(?i)<label\s[^>]*for=["']([^"']*)["']"""), F.lit(1))
    bare = F.filter(inputs, lambda t: ~t.rlike(r"""(?i)aria-label(?:ledby)?=["'][^"']""") & ~F.array_contains(labels, F.regexp_extract(t, r"""(?i)\sid=["']([^"']+)["']""", 1)))
    h = home.select("site_id", x.alias("html"), F.size(imgs).alias("images"), F.size(F.filter(imgs, lambda t: ~t.rlike(r"(?i)\balt="))).alias("no_alt"), F.size(bare).alias("unlabeled"))
    x = F.col("html")
    m = {
        "lang": _one(x.rlike(r"""(?i)<html\s[^>]*lang=["']\s*[^"'\s]""")), "landmarks": _one(x.rlike(r"""(?i)<(?:main|nav|header|footer)\b|role=["'](?:main|navigation)["']""")),
        "skip_link": _one(x.rlike(r"""(?i)href=["']#(?:main|content)["']|class=["'][^"']*skip""")),
        "contrast": _one(~(x.rlike(r"color:\s*#(?:[fF]{3}|[eE]{3})") & x.rlike(r"background(?:-color)?:\s*#(?:[fF]{3})"))),
    }
    h = h.select("site_id", "images", "no_alt", "unlabeled", *[v.alias(k) for k, v in m.items()])
    c = F.col
    alt_ok = (c("images") == 0) | (c("no_alt") / F.nullif(c("images"), F.lit(0)) <= 0.3)
    pts = [c("lang"), c("landmarks"), F.when(alt_ok, 1.0).otherwise(0.4), F.when(c("unlabeled") == 0, 1.0).otherwise(0.3), F.when(c("skip_link") > 0, 1.0).otherwise(0.5), F.when(c("contrast") > 0, 1.0).otherwise(0.3)]
    return h.withColumn("score", _points(pts, 6.0))


def mobile(home: DataFrame) -> DataFrame:
    """Five points: viewport, tap targets, base font, overflow, a way to call or chat."""
    x = F.coalesce("html", F.lit(""))
    small = F.size(F.regexp_extract_all(x, F.lit(r"""(?i)<(?:a|button)\s[^>]*style=["'][^"']*font-size:\s*(?:[0-9]|1[01])px"""), F.lit(0)))
    m = {
        "viewport": _one(x.rlike(r"""(?i)<meta\s[^>]*name=["']viewport["'][^>]*content=["'][^"']*width\s*=\s*device-width""")), "taps": _one(~(small > 3)),
        "font": _one(~x.rlike(r"""(?i)<(?:body|html)\s[^>]*style=["'][^"']*font-size:\s*(?:1[0-2]|[0-9])px""")),
        "overflow": _one(x.rlike(r"(?i)overflow-x:\s*scroll|min-width:\s*(?:[5-9]\d{2}|[1-9]\d{3,})px")),
        "cta": _one(x.rlike(r"""(?i)<a\s[^>]*href=["'](?:tel:|[^"']*wa\.me|[^"']*whatsapp)|call now|whatsapp|book now""")),
    }
    h = home.select("site_id", *[v.alias(k) for k, v in m.items()])
    c = F.col
    pts = [c("viewport"), F.when(c("taps") > 0, 1.0).otherwise(0.4), F.when(c("font") > 0, 1.0).otherwise(0.5), F.when(c("overflow") > 0, 0.4).otherwise(1.0), F.when(c("cta") > 0, 1.0).otherwise(0.4)]
    return h.withColumn("score", _points(pts, 5.0))


FINDINGS = {
    "SEO": [("MISSING_TITLE", "MAJOR", "title = 0"), ("MISSING_META_DESCRIPTION", "MAJOR", "description = 0"), ("H1_ISSUE", "MINOR", "h1 < 1"), ("MISSING_CANONICAL", "MINOR", "canonical = 0"),
            ("MISSING_VIEWPORT", "MAJOR", "viewport = 0"), ("MISSING_OG", "MINOR", "social = 0"), ("THIN_CONTENT", "MINOR", "thin = 1")],
    "SECURITY": [("NO_HTTPS", "CRITICAL", "https = 0"), ("SERVER_HEADER", "INFO", "server_shown = 1"), ("COOKIE_NOT_SECURE", "MAJOR", "cookie_secure = 0"), ("MIXED_CONTENT", "MAJOR", "no_mixed = 0")],
    "CONVERSION": [("LOW_CONVERSION", "MAJOR", "phone = 0 and chat = 0 and form = 0")],
    "TECHNICAL": [("UNREACHABLE", "CRITICAL", "status = 0"), ("BAD_STATUS", "CRITICAL", "status <> 0 and not status between 200 and 399"), ("BROKEN_LINKS", "MAJOR", "broken > 0")],
    "ACCESSIBILITY": [("MISSING_LANG", "MAJOR", "lang = 0"), ("IMG_MISSING_ALT", "MINOR", "no_alt > 0"), ("CONTRAST_HEURISTIC", "INFO", "contrast = 0")],
    "MOBILE_UX": [("BAD_VIEWPORT", "MAJOR", "viewport = 0"), ("OVERFLOW_RISK", "MINOR", "overflow = 1")],
}


def findings(module: str, audited: DataFrame) -> DataFrame:
    """(site_id, module, code, severity) of one module's wide rows."""
    codes = F.filter(F.array(*[F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, cond in FINDINGS[module]]), lambda x: x.isNotNull())
    return audited.select("site_id", F.lit(module).alias("module"), F.explode(codes).alias("f")).select("site_id", "module", "f.code", "f.severity")


def metrics(module: str, audited: DataFrame) -> DataFrame:
    """(site_id, module, name, value): a module's wide rows as long ones, under their fixed names; null metrics are left out."""
    w = audited
    if module == "SEO":
        w = w.withColumns({"alt_percent": F.floor(F.col("alt_coverage") * 100 + 0.5), "local_score": F.when((F.col("structured") == 1) & (F.col("title") == 1), 75.0).otherwise(40.0)})
    if module == "SECURITY":
        w = w.withColumn("tls_valid", F.col("https"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in METRIC_NAMES[module].items() if c in w.columns])
    return w.select("site_id", F.lit(module).alias("module"), F.explode(pairs).alias("m")).select("site_id", "module", "m.name", "m.value").filter("value is not null")


def all_modules(pages: DataFrame) -> dict[str, DataFrame]:
    return {"SEO": at_home(seo, pages), "SECURITY": at_home(security, pages), "CONVERSION": conversion(pages), "TECHNICAL": technical(pages), "ACCESSIBILITY": at_home(accessibility, pages), "MOBILE_UX": at_home(mobile, pages)}


# How the metrics are named in metric rows, which lookups by module and name rely on.
METRIC_NAMES = {
    "SEO": {"title": "titlePresent", "description": "descriptionPresent", "h1": "h1Present", "canonical": "canonical", "viewport": "viewport", "social": "openGraph", "structured": "structuredData", "hreflang": "hreflang",
            "alt_percent": "imageAltCoverage", "thin": "thinContent", "sitemap": "sitemap", "robots": "robots", "score": "technicalSEOScore", "content_score": "contentSEOScore", "local_score": "localSEOReadiness", "ld_types": "structuredDataTypes"},
    "SECURITY": {"https": "https", "hsts": "hsts", "csp": "csp", "content_type_options": "xContentTypeOptions", "referrer_policy": "referrerPolicy", "permissions_policy": "permissionsPolicy", "cookie_secure": "cookieSecure",
                 "cookie_http_only": "cookieHttpOnly", "no_mixed": "mixedContent", "tls_valid": "tlsValid"},
    "CONVERSION": {"phone": "phoneCta", "chat": "whatsappCta", "mail": "emailCta", "form": "contactForm", "booking": "bookingCta", "trust": "trustSignals", "fields": "formFieldCount", "score": "conversionReadinessScore"},
    "TECHNICAL": {"status": "statusCode", "broken": "brokenLinks", "pages": "pagesCrawled"},
    "ACCESSIBILITY": {"lang": "lang", "landmarks": "landmarks", "no_alt": "imagesMissingAlt", "unlabeled": "unlabeledInputs", "skip_link": "skipLink", "contrast": "contrastHeuristic", "score": "accessibilityScore"},
    "MOBILE_UX": {"viewport": "viewportQuality", "taps": "tapTargetHeuristic", "font": "readableFontBase", "overflow": "horizontalOverflowRisk", "cta": "mobileCta", "score": "mobileUxScore"},
}
CONFIDENCE = {"SEO": 0.85, "SECURITY": 0.8, "CONVERSION": 0.75, "TECHNICAL": 0.8, "ACCESSIBILITY": 0.75, "MOBILE_UX": 0.7}


def technologies(pages: DataFrame) -> DataFrame:
    """(site_id, name, category, confidence): fingerprints found on any page of a site.

    Each page is matched against all fingerprints in one projection; pages of a site are reduced before the shuffle.
    """
    x = F.coalesce("html", F.lit(""))
    hits = F.filter(F.array(*[F.when(x.rlike("(?i)" + rx), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(s).alias("confidence"))) for n, c, rx, s in K.FINGERPRINTS]), lambda h: h.isNotNull())
    return pages.select("site_id", F.explode(hits).alias("t")).select("site_id", "t.name", "t.category", "t.confidence").distinct()


def marketing(found: DataFrame, sites: DataFrame) -> DataFrame:
    """One row a site with the eight marketing tools as 'detected' or 'not detected'."""
    t = found.groupBy("site_id").agg(F.collect_set("name").alias("names"))
    label = lambda n: F.when(F.array_contains(F.coalesce("names", F.array().cast("array<string>")), n), "detected").otherwise("not detected")
    return sites.select("site_id").distinct().join(t, "site_id", "left").select("site_id", *[label(n).alias(k) for k, n in K.MARKETING.items()])


def weighted_mean(dims: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Mean of (key, score, reliable) rows by the weights of the reliable ones; null where none is."""
    w = F.coalesce(*[F.when(F.col("key") == k, v) for k, v in weights.items()])
    ok = F.col("reliable") & F.col("score").isNotNull()
    return dims.groupBy(*keys).agg((F.sum(F.when(ok, w * F.col("score"))) / F.sum(F.when(ok, w))).alias("health"))


REPORT = (("performanceScore", "perf", 45, 92, 1, 0.85), ("lighthouseAccessibility", "a11y", 50, 95, 1, 0.85), ("bestPractices", "bp", 55, 95, 1, 0.85), ("lighthouseSeo", "seo", 60, 98, 1, 0.85),
          ("lcpMs", "lcp", 1200, 4500, 1, 0.8), ("cls", "cls", 1, 25, 100, 0.8), ("tbtMs", "tbt", 50, 600, 1, 0.8), ("fcpMs", "fcp", 800, 3000, 1, 0.8))


def performance_rows(sites: DataFrame) -> DataFrame:
    """(site_id, name, value, confidence): reproducible stand-in measurements of sites (site_id, url) as metric rows."""
    rows = [F.struct(F.lit(n).alias("name"), (text.hash_score(F.col("url"), salt, lo, hi) / div).alias("value"), F.lit(c).alias("confidence")) for n, salt, lo, hi, div, c in REPORT]
    return sites.select("site_id", F.explode(F.array(*rows)).alias("m")).select("site_id", "m.name", F.round("m.value", 2).alias("value"), "m.confidence")


def crawl_coverage(pages: DataFrame) -> DataFrame:
    """(site_id, attempted, succeeded, coverage) of pages (site_id, status)."""
    ok = F.count_if(F.col("status").between(200, 399))
    return pages.groupBy("site_id").agg(F.count("*").alias("attempted"), ok.alias("succeeded"), F.round(ok / F.count("*"), 6).alias("coverage"))


def due_sites(sites: DataFrame, detected: DataFrame, now: Column, kind: str) -> DataFrame:
    """Sites whose latest detection (site_id, at) is not fresh any more, or missing: what must be computed again."""
    from leadloom.functions.freshness import is_fresh

    last = detected.groupBy("site_id").agg(F.max("at").alias("at"))
    return sites.join(last.filter(is_fresh(F.col("at"), now, kind)), "site_id", "left_anti")


def evidence(*parts: DataFrame) -> DataFrame:
    """Evidence rows (subject, field, value, method, confidence) of several stages in one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)
