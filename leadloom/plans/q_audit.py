"""Queries of the audits and of technology detection, over the made pages; technical also over captured ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import dom
from leadloom.operators import audit
from leadloom.session import saved, table

from . import duck as D
from .q_sources import PAGE_ROWS, made_pages
from .registry import query


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return made_pages(spark, d).select(F.col("business_id").alias("site_id"), "seq", "url", "html", F.lit(200).alias("status"), "headers")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


HOME = f"{PAGE_ROWS}, home AS (SELECT business_id AS site_id, * EXCLUDE (business_id) FROM page WHERE seq = 1), al AS (SELECT business_id AS site_id, * EXCLUDE (business_id) FROM page)"
n = lambda cond: f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)::DOUBLE"
rx = lambda p: f"regexp_matches(html, {D.q(p)})"
_SEO = f"""seo0 AS (SELECT site_id, {n("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> ''")} AS title, {n(rx(r'''(?i)<meta\s[^>]*name=["']description["'][^>]*content=["']\s*[^"'\s]'''))} AS description,
  len(regexp_extract_all(html, '(?i)<h1\\b')) AS nh, {n(rx(r'''(?i)<link\s[^>]*rel=["']canonical["'][^>]*href=["'][^"']'''))} AS canonical, {n(rx(r'''(?i)<meta\s[^>]*name=["']viewport["'][^>]*content=["'][^"']'''))} AS viewport,
  {n(rx(r'''(?i)<meta\s[^>]*(property=["']og:(title|description)["']|name=["']twitter:card["'])'''))} AS social, {n(rx(r'(?i)application/ld\+json'))} AS structured, regexp_extract_all(html, '(?i)<img\\b[^>]*>') AS imgs,
  length({D.squeeze(D.sub("regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)", '<[^>]+>', ' '))}) AS nt, {n(rx(r'(?i)<link\s[^>]*hreflang='))} AS hreflang, coalesce(json_array_length(nullif(regexp_extract(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1), ''), '$."@type"'), 0)::INTEGER AS ld_types FROM home),
  seo1 AS (SELECT site_id, title, description, CASE WHEN nh = 1 THEN 1.0 WHEN nh > 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS h1, canonical, viewport, social, structured,
    CASE WHEN len(imgs) > 0 THEN len(list_filter(imgs, lambda t: regexp_matches(t, {D.q(r'''(?i)\balt=["'][^"']*\S[^"']*["']''')}))) / len(imgs)::DOUBLE ELSE 1.0 END AS alt_coverage, {n('nt > 0 AND nt < 200')} AS thin, hreflang, 0.0::DOUBLE AS sitemap, 1.0::DOUBLE AS robots, ld_types FROM seo0),
  seo AS (SELECT *, (title + description + {n('h1 = 1')} + canonical + viewport + social + structured + (CASE WHEN alt_coverage >= 0.7 THEN 1.0 ELSE alt_coverage * 0.7::DOUBLE END) + 1 - thin + sitemap + robots) / 11.0::DOUBLE * 100 AS score, (title + description + {n('h1 = 1')} + 1 - thin) / 4 * 100 AS content_score FROM seo1)"""
_SEC = f"""sec AS (SELECT site_id, 1.0::DOUBLE AS https, {n('hsts')} AS hsts, 0.0::DOUBLE AS csp, 0.0::DOUBLE AS content_type_options, 0.0::DOUBLE AS referrer_policy, 0.0::DOUBLE AS permissions_policy, {n('NOT ' + rx('''(?i)(?:src|href)=["']http://'''))} AS no_mixed,
  CASE WHEN cookie THEN 1.0::DOUBLE END AS cookie_secure, CASE WHEN cookie THEN 0.0::DOUBLE END AS cookie_http_only, {n('server')} AS server_shown FROM home),
  security AS (SELECT *, (https + hsts + no_mixed + coalesce(cookie_secure, 0)) / (CASE WHEN cookie_secure IS NOT NULL THEN 9.0 ELSE 7.0 END)::DOUBLE * 100 AS score FROM sec)"""
_any = lambda p: f"max({n(rx(p))})"
_CONV = f"""conv AS (SELECT site_id, {_any('''(?i)<a\\s[^>]*href=["']tel:''')} AS phone, {_any('''(?i)<a\\s[^>]*href=["'][^"']*(?:wa\\.me|whatsapp)''')} AS chat, {_any('''(?i)<a\\s[^>]*href=["']mailto:''')} AS mail, {_any('(?i)<form\\b')} AS form,
  {_any('(?i)book|appoint|schedule|reserve')} AS booking, {_any('(?i)sticky|fixed|call now|whatsapp')} AS sticky, {_any('(?i)google maps|reviews?|testimonial|rated|years? of experience|licensed|certified|address|street|road|avenue')} AS trust,
  max({n("regexp_matches(url, '(?i)contact')")}) AS contact_url, sum(len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<form.*?</form>'), ' '), '(?i)<(?:input|textarea|select)\\b')))::BIGINT AS fields FROM al GROUP BY site_id),
  conversion AS (SELECT *, least(100.0, phone * (12 + 8 * sticky) + chat * (12 + 6 * sticky) + mail * 8 + form * (15 + 5 * contact_url) + booking * 15 + trust * 10 + CASE WHEN form > 0 AND fields >= 3 THEN 5 ELSE 0 END)::DOUBLE AS score FROM conv)"""
_A11Y = f"""a0 AS (SELECT site_id, regexp_extract_all(html, '(?i)<img\\b[^>]*>') AS imgs, list_filter(regexp_extract_all(html, '(?i)<(?:input|select|textarea)\\b[^>]*>'), lambda t: NOT regexp_matches(t, {D.q('''(?i)type=["']hidden["']''')})) AS inp,
  regexp_extract_all(html, {D.q(r'''(?i)<label\s[^>]*for=["']([^"']*)["']''')}, 1) AS lab, {n(rx(r'''(?i)<html\s[^>]*lang=["']\s*[^"'\s]'''))} AS lang, {n(rx(r'''(?i)<(?:main|nav|header|footer)\b|role=["'](?:main|navigation)["']'''))} AS landmarks,
  {n(rx(r'''(?i)href=["']#(?:main|content)["']|class=["'][^"']*skip'''))} AS skip_link, {n('NOT (' + rx(r'color:\s*#(?:[fF]{3}|[eE]{3})') + ' AND ' + rx(r'background(?:-color)?:\s*#(?:[fF]{3})') + ')')} AS contrast FROM home),
  a1 AS (SELECT site_id, len(imgs)::INTEGER AS images, len(list_filter(imgs, lambda t: NOT regexp_matches(t, '(?i)\\balt=')))::INTEGER AS no_alt, len(list_filter(inp, lambda t: NOT regexp_matches(t, {D.q('''(?i)aria-label(?:ledby)?=["'][^"']''')}) AND NOT list_contains(lab, regexp_extract(t, {D.q(r'''(?i)\sid=["']([^"']+)["']''')}, 1))))::INTEGER AS unlabeled, lang, landmarks, skip_link, contrast FROM a0),
  accessibility AS (SELECT *, (lang + landmarks + (CASE WHEN images = 0 OR no_alt / images::DOUBLE <= 0.3 THEN 1.0 ELSE 0.4 END)::DOUBLE + (CASE WHEN unlabeled = 0 THEN 1.0 ELSE 0.3 END)::DOUBLE + (CASE WHEN skip_link > 0 THEN 1.0 ELSE 0.5 END)::DOUBLE + (CASE WHEN contrast > 0 THEN 1.0 ELSE 0.3 END)::DOUBLE) / 6.0::DOUBLE * 100 AS score FROM a1)"""
_MOB = f"""m0 AS (SELECT site_id, {n(rx(r'''(?i)<meta\s[^>]*name=["']viewport["'][^>]*content=["'][^"']*width\s*=\s*device-width'''))} AS viewport, {n('NOT len(regexp_extract_all(html, ' + D.q(r'''(?i)<(?:a|button)\s[^>]*style=["'][^"']*font-size:\s*(?:[0-9]|1[01])px''') + ')) > 3')} AS taps,
  {n('NOT ' + rx(r'''(?i)<(?:body|html)\s[^>]*style=["'][^"']*font-size:\s*(?:1[0-2]|[0-9])px'''))} AS font, {n(rx(r'(?i)overflow-x:\s*scroll|min-width:\s*(?:[5-9]\d{2}|[1-9]\d{3,})px'))} AS overflow, {n(rx(r'''(?i)<a\s[^>]*href=["'](?:tel:|[^"']*wa\.me|[^"']*whatsapp)|call now|whatsapp|book now'''))} AS cta FROM home),
  mobile AS (SELECT *, (viewport + (CASE WHEN taps > 0 THEN 1.0 ELSE 0.4 END)::DOUBLE + (CASE WHEN font > 0 THEN 1.0 ELSE 0.5 END)::DOUBLE + (CASE WHEN overflow > 0 THEN 0.4 ELSE 1.0 END)::DOUBLE + (CASE WHEN cta > 0 THEN 1.0 ELSE 0.4 END)::DOUBLE) / 5.0::DOUBLE * 100 AS score FROM m0)"""
_TECH_CAPTURED = "tp AS (SELECT DISTINCT page_no, site_domain AS site_id, url, status_code AS status FROM crawl_page WHERE site_domain IS NOT NULL)"


@query(f"{HOME}, {_SEO} SELECT * REPLACE (round(score, 6) AS score) FROM seo")
def audit_seo(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.seo, _pages(spark, d)))


@query(f"{HOME}, {_SEC} SELECT * REPLACE (round(score, 6) AS score) FROM security")
def audit_security(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.security, _pages(spark, d)))


@query(f"{HOME}, {_CONV} SELECT * FROM conversion")
def audit_conversion(spark: SparkSession, d: str) -> DataFrame:
    return audit.conversion(_pages(spark, d))


@query(
    f"""WITH {_TECH_CAPTURED}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN {D.path('url')} = '/' THEN 0 ELSE 1 END, page_no) AS k FROM tp), b AS (SELECT site_id, count(*) FILTER (status >= 400) AS broken, count(*) AS pages FROM tp GROUP BY 1)
    SELECT site_id, coalesce(status, 0) AS status, broken, pages, greatest(0.0, CASE WHEN coalesce(status, 0) BETWEEN 200 AND 399 THEN 85.0 WHEN coalesce(status, 0) = 0 THEN 20.0 ELSE 30.0 END - broken * 5)::DOUBLE AS score FROM r JOIN b USING (site_id) WHERE k = 1"""
)
def audit_technical(spark: SparkSession, d: str) -> DataFrame:
    """Reachability of all captured sites."""
    p = table(spark, d, "crawl_page").filter("site_domain is not null").select(F.col("page_no").alias("seq"), F.col("site_domain").alias("site_id"), "url", F.col("status_code").alias("status")).distinct()
    return audit.technical(p)


@query(f"{HOME}, {_A11Y} SELECT * REPLACE (round(score, 6) AS score) FROM accessibility")
def audit_a11y(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.accessibility, _pages(spark, d)))


@query(f"{HOME}, {_MOB} SELECT * REPLACE (round(score, 6) AS score) FROM mobile")
def audit_mobile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.mobile, _pages(spark, d)))


_TECHNICAL = "technical AS (SELECT DISTINCT site_id, 200 AS status, 0 AS broken, 2 AS pages, 85.0::DOUBLE AS score FROM al)"
_WIDE = {"SEO": "seo", "SECURITY": "security", "CONVERSION": "conversion", "TECHNICAL": "technical", "ACCESSIBILITY": "accessibility", "MOBILE_UX": "mobile"}
_ALL = f"{HOME}, {_SEO}, {_SEC}, {_CONV}, {_TECHNICAL}, {_A11Y}, {_MOB}"
_F_SQL = " UNION ALL ".join(f"SELECT site_id, '{m}' AS module, '{code}' AS code, '{sev}' AS severity FROM {t} WHERE {cond}" for m, t in _WIDE.items() for code, sev, cond in audit.FINDINGS[m])


def findings_of(pages: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [audit.findings(m, a) for m, a in audit.all_modules(pages).items()])


def metric_rows_of(pages: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [audit.metrics(m, a) for m, a in audit.all_modules(pages).items()])


@query(f"{_ALL}, f AS ({_F_SQL}) SELECT site_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'MAJOR') AS major, count(*) FILTER (severity = 'MINOR') AS minor, count(DISTINCT module) AS modules FROM f GROUP BY site_id")
def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every site by severity, over all six modules."""
    f = findings_of(saved(_pages(spark, d)))
    by = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return f.groupBy("site_id").agg(by("CRITICAL"), by("MAJOR"), by("MINOR"), F.countDistinct("module").alias("modules"))


_DERIVED = {"alt_percent": "floor(alt_coverage * 100 + 0.5)", "local_score": "CASE WHEN structured = 1 AND title = 1 THEN 75.0 ELSE 40.0 END", "tls_valid": "https"}
_METRICS = f"{_ALL}, metric AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT site_id, '{m}' AS module, '{name}' AS name, ({_DERIVED.get(c, c)})::DOUBLE AS value FROM {_WIDE[m]}" for m, names in audit.METRIC_NAMES.items() for c, name in names.items()
) + ") WHERE value IS NOT NULL)"


@query(f"{_METRICS} SELECT site_id, module, name, round(value, 6) AS value FROM metric")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """All modules' wide rows as long metric rows."""
    return metric_rows_of(saved(_pages(spark, d))).withColumn("value", F.round("value", 6))


_FP = "(VALUES " + ", ".join(f"({D.q(a)}, {D.q(b)}, {D.q('(?i)' + c)}, {s}::DOUBLE)" for a, b, c, s in K.FINGERPRINTS) + ") AS fp(name, category, rx, confidence)"
_TECHS = f"{HOME}, tech AS (SELECT DISTINCT site_id, name, category, confidence FROM al, {_FP} WHERE regexp_matches(html, rx))"


@query(f"{_TECHS} SELECT * FROM tech")
def tech_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return audit.technologies(_pages(spark, d))


@query(f"{_TECHS} SELECT s.site_id, " + ", ".join(f"CASE WHEN bool_or(name = {D.q(v)}) THEN 'detected' ELSE 'not detected' END AS \"{k}\"" for k, v in K.MARKETING.items()) + " FROM (SELECT DISTINCT site_id FROM al) s LEFT JOIN tech ON tech.site_id = s.site_id GROUP BY s.site_id")
def marketing_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return audit.marketing(audit.technologies(p), p.select("site_id"))


_DIMS = {"performance": "market_readiness", "conversion": "conversion_readiness", "technical": "business_vitality", "seo": "contact_confidence"}


@query(
    "WITH s AS (SELECT DISTINCT score_no, " + ", ".join(_DIMS.values()) + " FROM scoring_result), l AS (" + " UNION ALL ".join(f"SELECT score_no, {K.HEALTH_WEIGHTS[k]}::DOUBLE AS w, {c} AS v FROM s" for k, c in _DIMS.items())
    + ") SELECT score_no, round(sum(w * v) FILTER (v IS NOT NULL AND NOT isnan(v)) / sum(w) FILTER (v IS NOT NULL AND NOT isnan(v)), 6) AS health FROM l GROUP BY score_no"
)
def weighted_health(spark: SparkSession, d: str) -> DataFrame:
    """Four recorded dimensions weighed as website health, missing ones left out of the weights."""
    s = table(spark, d, "scoring_result").select("score_no", *_DIMS.values()).distinct()
    dims = s.select("score_no", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("score"), (F.col(c).isNotNull() & ~F.isnan(c)).alias("reliable")) for k, c in _DIMS.items()])).alias("x")).select("score_no", "x.*")
    return audit.weighted_mean(dims, ["score_no"], K.HEALTH_WEIGHTS).withColumn("health", F.round("health", 6))


@query()
def dom_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of parsed pages (rows only: SQL has no parser)."""
    p = made_pages(spark, d).select((F.col("business_id") * 10 + F.col("seq")).alias("page_id"), "html")
    return dom.dom_signals(p)


_REPORT = " UNION ALL ".join(f"SELECT site_id, '{nm}' AS name, round(({D.hash_score('url', salt, lo, hi)}) / {div}.0, 2)::DOUBLE AS value, {c}::DOUBLE AS confidence FROM u" for nm, salt, lo, hi, div, c in audit.REPORT)


@query(f"WITH u AS (SELECT site_domain AS site_id, min(url) AS url FROM crawl_page WHERE site_domain IS NOT NULL GROUP BY 1) {_REPORT}")
def performance_rows(spark: SparkSession, d: str) -> DataFrame:
    """Eight stand-in measurements of every captured site as metric rows."""
    p = table(spark, d, "crawl_page").filter("site_domain is not null").groupBy(F.col("site_domain").alias("site_id")).agg(F.min("url").alias("url"))
    return audit.performance_rows(p)


@query("SELECT site_domain AS site_id, count(*) AS attempted, count(*) FILTER (status_code BETWEEN 200 AND 399) AS succeeded, round(count(*) FILTER (status_code BETWEEN 200 AND 399) / count(*)::DOUBLE, 6) AS coverage FROM (SELECT DISTINCT page_no, site_domain, status_code FROM crawl_page) GROUP BY 1")
def crawl_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "crawl_page").select("page_no", F.col("site_domain").alias("site_id"), F.col("status_code").alias("status")).distinct()
    return audit.crawl_coverage(p)


_CLOCK = "2024-12-31 00:00:00"


@query(f"SELECT site_domain AS site_id FROM crawl_page WHERE site_domain IS NOT NULL GROUP BY 1 HAVING coalesce((epoch_us(TIMESTAMP '{_CLOCK}') - epoch_us(max(fetched_at))) / 86400000000.0 > 30, true)")
def due_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites whose technologies were last seen more than 30 days before a given clock."""
    p = table(spark, d, "crawl_page").filter("site_domain is not null").select(F.col("site_domain").alias("site_id"), F.col("fetched_at").alias("at"))
    return audit.due_sites(p.select("site_id").distinct(), p, F.lit(_CLOCK).cast("timestamp"), "technology")


@query(
    f"""{HOME}, {_MOB}, c AS (SELECT DISTINCT contact_no, contact_type, contact_value, extract_method, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence FROM extracted_contact)
    SELECT contact_no::VARCHAR AS subject, lower(contact_type) AS field, contact_value AS value, extract_method AS method, confidence FROM c UNION ALL SELECT site_id::VARCHAR, 'finding', code, 'AUDIT', 0.9::DOUBLE FROM (
      SELECT site_id, 'BAD_VIEWPORT' AS code FROM mobile WHERE viewport = 0 UNION ALL SELECT site_id, 'OVERFLOW_RISK' FROM mobile WHERE overflow = 1)"""
)
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of extracted contacts and of one module's findings in one table."""
    c = table(spark, d, "extracted_contact").select("contact_no", "contact_type", "contact_value", "extract_method", "confidence").distinct()
    a = c.select(F.col("contact_no").cast("string").alias("subject"), F.lower("contact_type").alias("field"), F.col("contact_value").alias("value"), F.col("extract_method").alias("method"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"))
    f = audit.findings("MOBILE_UX", audit.at_home(audit.mobile, _pages(spark, d)))
    b = f.select(F.col("site_id").cast("string").alias("subject"), F.lit("finding").alias("field"), F.col("code").alias("value"), F.lit("AUDIT").alias("method"), F.lit(0.9).alias("confidence"))
    return audit.evidence(a, b)


# the same modules over the captured pages themselves
_CAPTURED = f"""WITH al AS (SELECT DISTINCT site_domain AS site_id, page_no AS seq, coalesce(final_url, url) AS url, html_snippet AS html FROM crawl_page WHERE site_domain IS NOT NULL AND html_snippet IS NOT NULL),
  home AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN {D.path('url')} = '/' THEN 0 ELSE 1 END, seq) AS k FROM al) WHERE k = 1)"""


def _captured(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "crawl_page").filter("site_domain is not null and html_snippet is not null")
    return c.select(F.col("site_domain").alias("site_id"), F.col("page_no").alias("seq"), F.coalesce("final_url", "url").alias("url"), F.col("html_snippet").alias("html")).distinct()


@query(f"{_CAPTURED}, {_SEO} SELECT * REPLACE (round(score, 6) AS score) FROM seo")
def captured_seo(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.seo, _captured(spark, d)))


@query(f"{_CAPTURED}, {_A11Y} SELECT * REPLACE (round(score, 6) AS score) FROM accessibility")
def captured_a11y(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.accessibility, _captured(spark, d)))


@query(f"{_CAPTURED}, {_MOB} SELECT * REPLACE (round(score, 6) AS score) FROM mobile")
def captured_mobile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(audit.at_home(audit.mobile, _captured(spark, d)))


@query(f"{_CAPTURED}, {_CONV} SELECT * FROM conversion")
def captured_conversion(spark: SparkSession, d: str) -> DataFrame:
    return audit.conversion(_captured(spark, d))


@query(f"{_CAPTURED} SELECT DISTINCT site_id, name, category, confidence FROM al, {_FP} WHERE regexp_matches(html, rx)")
def captured_technologies(spark: SparkSession, d: str) -> DataFrame:
    return audit.technologies(_captured(spark, d))
